"""A tolerant reader of HTML: block elements as flat lists in page order, and their text blocks.

Every character is looked at a bounded number of times, however broken the page: a search that found
nothing is not made again, and open elements are found by name.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What may end a tag or begin an attribute's value; a value without quotes is taken whole.
_STEP = re.compile(r">|=\s*(?:[\"']|[^\s>\"'][^\s>]*)")
#: Elements whose content is raw text up to their end tag, and no text of the page.
_RAW = {"script", "style", "title", "textarea", "iframe"}
#: Of these, those that take the rest of the page where their end tag is missing.
_CODE = {"script", "style"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: Fixed: elements that begin and end a block of text.
BLOCKS = ("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 "
          "h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption label "
          "select optgroup option").split()  # fmt: skip
_BLOCK = set(BLOCKS)
#: A start tag ends an open element of these names, up to the nearest element of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_KEEPS_P = {"label", "legend", "caption", "summary", "td", "th", "tr", "li", "dd", "dt", "body", "html", "tbody", "thead", "tfoot", "select", "optgroup", "option"}
#: Levels below which elements stand side by side instead of inside each other.
DEEPEST = 500


@dataclass
class Page:
    """Block elements in page order: name, attribute text, parent (-1 for the root) and depth; text
    blocks in page order: the element they stand in, their text and how much of it is links."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    attrs: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    inline: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


class _Scanner:
    """Finds things in a page, and remembers what is nowhere behind."""

    def __init__(self, source: str) -> None:
        self.source, self.absent, self.loose = source, set(), False

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag: the first one outside quotes; any, from the first
        tag on that has none."""
        first = self.find(">", at)
        if first < 0 or self.loose:
            return first
        while step := _STEP.search(self.source, at):
            if step.group() == ">":
                return step.start()
            at = step.end()
            if step.group()[-1] in "\"'" and step.group()[:-1].strip() == "=":
                close = self.find(step.group()[-1], at)
                at = at if close < 0 else close + 1
        self.loose = True
        return first

    def raw_end(self, name: str, at: int) -> int:
        """The place of the end tag of a raw element, -1 if there is none."""
        if "/" + name in self.absent:
            return -1
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.source, at)
        if not found:
            self.absent.add("/" + name)
            return -1
        return found.start()


class _Open:
    """The open elements, inline ones too, with the block element each stands in; and for each name
    the places of its elements among them."""

    def __init__(self) -> None:
        self.names, self.nodes, self.where, self.blocks = ["#page"], [0], {}, [0]

    def push(self, name: str, node: int) -> None:
        self.where.setdefault(name, []).append(len(self.names))
        if name in _BLOCK:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def pop(self) -> str:
        name = self.names.pop()
        self.nodes.pop()
        self.where[name].pop()
        if name in _BLOCK:
            self.blocks.pop()
        return name

    def last(self, names: set[str]) -> int:
        return max((places[-1] for n in names if (places := self.where.get(n))), default=0)


def read(source: str) -> Page:
    """Read a page, however broken. Character references are decoded and white space is made single.

    An unclosed comment, script or style takes the rest of the page, as it does in browsers; any
    other element without an end tag takes nothing but its tag. Elements below ``DEEPEST`` levels
    keep their text, and hang from the element at that level.
    """
    page, scan, stack = Page(), _Scanner(source), _Open()
    buffer: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                page.blocks.append((stack.nodes[-1], text, min(links, len(text))))
            buffer.clear()
        links = 0

    def text(part: str) -> None:
        nonlocal links
        if part:
            buffer.append(html.unescape(part))  # a reference ends where its text does: markup inside it leaves it as it is
            if in_link:
                links += len(part)

    def close(depth: int) -> None:
        nonlocal in_link
        while len(stack.names) > depth:
            if stack.names[-1] in _BLOCK:
                flush()
            in_link -= stack.pop() == "a"

    def end_tag(name: str) -> None:
        at = stack.last(_HEADINGS if name in _HEADINGS else {name})  # any heading's end tag ends an open heading
        if at and (name in _BLOCK or at > stack.blocks[-1]):
            close(at)
        elif name == "p":
            flush()

    def start_tag(name: str, attrs: str) -> None:
        nonlocal in_link
        node = stack.nodes[-1]
        if name == "hr":
            flush()
        elif name == "br":
            buffer.append(" ")
        if name in _VOID:
            page.inline[node] += 1
        elif name in _BLOCK:
            if name not in _KEEPS_P and (p := stack.last({"p"})) > stack.last({"td", "th", "table", "button"}):
                close(p)
            if name in _ENDS and (old := stack.last(_ENDS[name][0])) > stack.last(_ENDS[name][1]):
                close(old)
            flush()
            parent = stack.nodes[-1]
            if page.depths[parent] >= DEEPEST:
                parent = page.parents[parent]
            page.tags.append(name)
            page.attrs.append(attrs)
            page.parents.append(parent)
            page.depths.append(page.depths[parent] + 1)
            page.inline.append(0)
            stack.push(name, len(page.tags) - 1)
        else:
            page.inline[node] += 1
            if name != "head":
                in_link += name == "a"
                stack.push(name, node)

    at, size = 0, len(source)
    while at < size:
        here = scan.find("<", at)
        text(source[at : size if here < 0 else here])
        if here < 0:
            break
        kind = source[here + 1 : here + 2]
        if source.startswith("<!--", here):
            if source.startswith((">", "->"), here + 4):
                at = source.index(">", here) + 1
                continue
            ends = [(e, e + len(mark)) for mark in ("-->", "--!>") if (e := scan.find(mark, here + 4)) >= 0]
            at = min(ends)[1] if ends else size
            continue
        name = _NAME.match(source, here + (2 if kind == "/" else 1))
        if not name:
            if kind and kind in "/!?":
                end = scan.find(">", here)
                at = end + 1 if end >= 0 else size
            else:
                text("<")
                at = here + 1
            continue
        end = scan.tag_end(name.end())
        if end < 0:  # no tag ends behind this: the broken one goes
            behind = scan.find("<", name.end())
            at = behind if behind >= 0 else size
            continue
        at = end + 1
        lower = name.group().lower()
        if kind == "/":
            end_tag(lower)
        elif lower in _RAW:
            stop = scan.raw_end(lower, at)
            at = stop if stop >= 0 else size if lower in _CODE else at
        else:
            start_tag(lower, source[name.end() : end].strip())
    close(1)
    flush()
    return page
