"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each block element is a row of features: density of its subtree, tokens of its attributes and of its
ancestors', depth, and how it compares with its siblings. The trees are fitted with Spark's
GBTClassifier on a bounded sample of pages: as they are where they mark their article themselves, and
rebuilt from their own sentences into pages of many other layouts, where the truth is known. A page's
elements are then kept or dropped together: an element can be kept only if its parent is, and the
most likely choice of that kind is found by one pass up and one pass down the tree.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import dom
from meterlake.llm.staging import staged
from meterlake.llm.words import frugal

#: Pages that the model is fitted on at most: those of least hash of url and page_id.
MAX_TRAINING_PAGES = 240
#: Pages of other layouts that they are rebuilt into together, at least so many from each.
REBUILT, LAYOUTS = 1200, 5
#: Fixed: tokens of class, id and role that speak for and against main text.
FOR = "article content post entry main body story text blog page single prose".split()
AGAINST = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs tabs pagination pager toc".split(),
    "top": "header masthead banner logo topbar hero brand".split(),
    "bottom": "footer foot colophon copyright legal bottom".split(),
    "side": "sidebar side aside widget related recommended popular trending more rail teaser".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay banner message warning".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense affiliate".split(),
    "form": "form login signup search subscribe newsletter contact register".split(),
    "talk": "comment comments reply replies discussion disqus respond feedback reviews".split(),
    "share": "share social sharing follow meta tags byline author".split(),
}
_GROUPS = {t: i for i, ts in enumerate(("article main", "nav menu", "header hgroup", "footer address", "aside dialog details", "form fieldset label legend search select optgroup option", "p blockquote pre", "h1 h2 h3 h4 h5 h6",
                                         "li ul ol dl dt dd dir", "table tbody thead tfoot tr td th caption", "figure figcaption")) for t in ts.split()}
_N_GROUPS, _N_TOKENS = 12, 1 + len(AGAINST)
_WORD = re.compile(r"[a-z]+")
_ATTR = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_STOPS = re.compile(r"[.!?,;:]")


def _tokens(attrs: str, known: dict[str, tuple]) -> tuple:
    """Whether the attributes hold a token for main text, and one of each kind against it."""
    if attrs not in known:
        if len(known) > 50_000:
            known.clear()
        words = set(_WORD.findall(" ".join(re.sub(r"([a-z])([A-Z])", r"\1 \2", m) for m in _ATTR.findall(attrs)).lower()))
        known[attrs] = (bool(words & set(FOR)), *(bool(words & set(ts)) for ts in AGAINST.values()))
    return known[attrs]


def _up(parent: np.ndarray, levels: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Sums over subtrees."""
    out = values.astype(float).copy()
    for level in reversed(levels[1:]):
        np.add.at(out, parent[level], out[level])
    return out


class Forest:
    """Block elements of several pages as one forest, level by level."""

    def __init__(self, pages: list[dom.Page]) -> None:
        sizes = np.array([len(p.tags) for p in pages])
        start = np.cumsum(sizes) - sizes
        self.pages, self.start = pages, start
        self.parent = np.concatenate([np.array(p.parents) + s for p, s in zip(pages, start, strict=True)])
        self.parent[start] = start  # a root is its own parent
        self.depth = np.concatenate([p.depths for p in pages])
        self.page = np.repeat(np.arange(len(pages)), sizes)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, self.depth.max() + 1)))
        self.node = np.array([start[i] + b[0] for i, p in enumerate(pages) for b in p.blocks], np.int64)
        self.chars = np.array([len(b[1]) for p in pages for b in p.blocks], float)

    def features(self, known: dict[str, tuple]) -> np.ndarray:
        n, parent, up = len(self.parent), self.parent, lambda v: _up(self.parent, self.levels, v)
        blocks = [b for p in self.pages for b in p.blocks]
        own = lambda values: np.bincount(self.node, np.array(values, float), n) if len(self.node) else np.zeros(n)
        chars, words = own(self.chars), own([b[1].count(" ") + 1 for b in blocks])
        links, stops = own([b[2] for b in blocks]), own([len(_STOPS.findall(b[1])) for b in blocks])
        short, signs = own([len(b[1]) < 60 for b in blocks]), own(["©" in b[1] or "|" in b[1] for b in blocks])
        count = own(np.ones(len(blocks)))
        group = np.array([_GROUPS.get(t, _N_GROUPS - 1) for p in self.pages for t in p.tags])
        token = np.array([_tokens(a, known) for p in self.pages for a in p.attrs], float)
        inline = np.concatenate([p.inline for p in self.pages])
        s_chars, s_words, s_links, s_stops, s_count, s_short, s_signs, s_inline = map(up, (chars, words, links, stops, count, short, signs, inline))
        s_nodes, s_p, s_li, s_h, s_for = up(np.ones(n)), up(group == 6), up(group == 8), up(group == 7), up(group == 5)
        inherited = np.column_stack([token, group == 0, group == 1, group == 2, group == 3, group == 4, group == 5]).astype(float)
        for level in self.levels[1:]:
            inherited[level] = np.maximum(inherited[level], inherited[parent[level]])
        root = self.start[self.page]
        children = np.bincount(parent, minlength=n) - (np.arange(n) == parent)
        place = np.arange(n) - root
        kin = np.maximum(children[parent], 1)
        kin_chars = np.bincount(parent, s_chars, n)[parent] / kin
        most = np.zeros(n)
        np.maximum.at(most, parent[np.arange(n) != parent], s_chars[np.arange(n) != parent])
        safe = lambda a, b: a / np.maximum(b, 1)
        before = np.cumsum(chars) - chars
        offset = before - before[root]
        columns = [
            self.depth, np.log1p(chars), np.log1p(s_chars), np.log1p(s_words), safe(s_chars, s_nodes), safe(s_links, s_chars), safe(s_stops, s_words),
            safe(s_chars, s_count), safe(s_short, s_count), safe(s_inline, s_nodes), safe(s_p, s_nodes), safe(s_li, s_nodes), safe(s_h, s_nodes), s_for,
            s_signs > 0, safe(s_chars, s_chars[root]), safe(s_chars, s_chars[parent]), safe(s_chars, kin_chars), s_chars >= most[parent], np.log1p(kin),
            np.log1p(children), safe(offset, s_chars[root]), safe(place, np.bincount(self.page)[self.page]), s_links[parent] / np.maximum(s_chars[parent], 1),
            safe(s_words, s_count)]
        near = np.eye(_N_GROUPS)[group]
        return np.column_stack([*columns, near, near[parent], token, inherited])

    def decode(self, score: np.ndarray) -> np.ndarray:
        """Which elements are kept: the likeliest choice where whatever is kept has a kept parent.
        ``score`` is the log odds of each element; an element weighs with the text it holds itself."""
        held = np.bincount(self.node, self.chars, len(score)) if len(self.node) else np.zeros(len(score))
        gain = score * (0.25 + np.log1p(held))
        best = gain.copy()
        for level in reversed(self.levels[1:]):  # what keeping an element gains, over dropping all of it
            np.add.at(best, self.parent[level], np.maximum(best[level], 0))
        kept = best > 0
        kept[self.start] = True
        for level in self.levels[1:]:
            kept[level] &= kept[self.parent[level]]
        return kept

    def texts(self, kept: np.ndarray) -> list[str]:
        return ["\n".join(b[1] for b in p.blocks if kept[s + b[0]]) for p, s in zip(self.pages, self.start, strict=True)]


# -- training pages -----------------------------------------------------------------------------


def _truth(page: dom.Page, marks: bool) -> np.ndarray | None:
    """1 for an element that holds or is in main text. ``marks``: of a rebuilt page, which says so in
    data-main; else of a page that has one article or main element of its own."""
    n = len(page.tags)
    inside = np.zeros(n, int)
    for i in range(1, n):
        inside[i] = inside[page.parents[i]]
        if marks and (found := re.search(r'data-main="(\d)"', page.attrs[i])):
            inside[i] = int(found[1])
        elif not marks and page.tags[i] in ("article", "main"):
            inside[i] = 1
        elif not marks and page.tags[i] in ("nav", "footer", "aside", "form") or not marks and page.tags[i] == "header" and page.parents[i] and page.tags[page.parents[i]] == "body":
            inside[i] = 0
    if not inside.any():
        return None
    out = inside.copy()
    for i in range(n - 1, 0, -1):
        out[page.parents[i]] |= out[i]
    return out


def rebuilt(sentences: list[str], rng: random.Random) -> str:
    """A page of a random layout from given sentences; data-main marks what is main text."""
    pick = rng.choice
    say = lambda n: " ".join(pick(sentences) for _ in range(n))
    few = lambda n: " ".join(pick(sentences).split()[:n])

    def element(tags: str, names: str, inner: str, named: float = 0.75, mark: str = "") -> str:
        tag = pick(tags.split())
        how = pick(["class", "class", "id"])
        attr = f' {how}="{pick(names.split())}"' if tag in ("nav", "header", "footer", "aside", "article", "main", "form") and rng.random() < 0.4 or tag not in ("nav", "header", "footer", "aside", "article", "main", "form") and rng.random() < named else ""
        return f"<{tag}{attr}{mark}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{few(rng.randint(1, 3))}</a></li>' for i in range(n)) + "</ul>"

    def paragraph() -> str:
        body = say(rng.choice([1, 1, 2, 3, 4, 6, 9]))
        kind = rng.random()
        if kind < 0.1:
            return f"<h{pick('234')}>{few(6)}</h{pick('234')}>"
        if kind < 0.15:
            return "<ul>" + "".join(f"<li>{say(1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.2:
            return f"<blockquote><p>{body}</p></blockquote>"
        if kind < 0.24:
            return f"<figure><img src=x><figcaption>{say(1)}</figcaption></figure>"
        if kind < 0.27:
            return f"<table><tr><th>{few(2)}</th><td>{few(4)}</td></tr><tr><th>{few(2)}</th><td>{few(4)}</td></tr></table>"
        if kind < 0.36:
            return f"<p><b>{few(6)}<br>"
        if kind < 0.45:
            return f'<p>{body} <a href="/x">{few(3)}</a> {say(1)}</p>'
        if kind < 0.5:
            return f"<div>{body}</div>"
        return f"<p>{body}" + pick(["</p>", "</p>", "</p>", ""])

    off = ' data-main="0"'
    menu = lambda: element("nav nav div ul", "nav menu navbar main-menu topnav breadcrumbs", links(rng.randint(3, 14)), mark=off)
    advert = lambda: element("div div aside p section", "ad ads advert sponsored promo ad-slot", say(rng.randint(1, 2)), 0.95, off)
    notice = lambda: element("div section aside", "cookie-banner cookie notice consent gdpr-notice alert popup", f"<p>{say(rng.randint(1, 3))}</p><button>OK</button>", 0.95, off)
    form = lambda: element("form form div", "newsletter search login-form subscribe contact", f"<form><label>{few(2)}</label><input><p>{say(1)}</p><button>Go</button></form>", 0.9, off)
    side = lambda: element("aside aside div section", "sidebar side related widget popular recommended", f"<h3>{few(3)}</h3>{links(rng.randint(3, 8))}" + pick(["", f"<p>{say(1)}</p>", f"<p>{say(2)}</p>"]), 0.95, off)
    talk = lambda: element("div section ol", "comments comment-list replies discussion reader-comments", f"<h3>{few(2)}</h3>" + "".join(element("div li article", "comment reply comment-body", f"<b>{few(1)}</b><p>{say(rng.randint(1, 5))}</p>", 0.9) for _ in range(rng.randint(1, 6))), 1.0, off)
    share = lambda: element("div ul p", "share social byline meta tags", " ".join(f'<a href="/s">{few(1)}</a>' for _ in range(rng.randint(2, 5))), 0.95, off)
    some = lambda p, *makers: "".join(m() for m in makers if rng.random() < p)

    inner = f"<h1>{few(8)}</h1>" * (rng.random() < 0.8) + some(0.15, share) + "".join(paragraph() + some(0.04, advert, side) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20]))) + some(0.15, share, talk, form)
    main = element("article article main div div section td", "article post content entry-content story main-content post-body text", inner, 0.7, ' data-main="1"')
    if rng.random() < 0.3:
        main = element("main div section", "main page content-area wrapper container row", main + some(0.3, talk))
    head = element("header header div", "header site-header masthead top", f"<a href='/'>{few(2)}</a>" + pick(["", f"<p>{few(7)}</p>", menu()]), 0.9, off)
    foot = element("footer footer div", "footer site-footer colophon bottom legal", pick(["&copy; ", "", "(c) "]) + few(2) + pick(["", " &middot; " + say(1), f"<p>{say(1)}</p>", links(4), menu() + f"<p>{few(8)}</p>"]), 0.9, off)
    parts = some(0.3, notice) + head * (rng.random() < 0.5) + some(0.75, menu) + some(0.4, advert) + some(0.15, side, form) + main + some(0.25, side, talk, form) + some(0.15, advert, notice) + foot * (rng.random() < 0.85)
    if rng.random() < 0.3:
        parts = element("div table", "wrapper page container site layout", parts)
    return f"<!DOCTYPE html><html><head><title>{few(5)}</title></head><body>{parts}" + pick(["</body></html>", ""])


def _training_rows(frames: Iterator[pd.DataFrame], layouts: int) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple] = {}
    for frame in frames:
        for seed, source in zip(frame["seed"], frame["html"], strict=True):
            rng = random.Random(int(seed))
            page = dom.read(source)
            own, truth = [(page, t)] * 3 if (t := _truth(page, False)) is not None else [], None
            inside = own[0][1] if own else None
            sentences = [s for node, text, _ in page.blocks if inside is None or inside[node] for s in re.split(r"(?<=[.!?])\s+", text) if s][:400]
            for _ in range(layouts if sentences else 0):
                made = dom.read(rebuilt(sentences, rng))
                if (truth := _truth(made, True)) is not None:
                    made.attrs = [re.sub(r' ?data-main="\d"', "", a) for a in made.attrs]
                    own.append((made, truth))
            for made, truth in own:
                x = Forest([made]).features(known)
                yield pd.DataFrame({"features": list(x[1:]), "label": truth[1:].astype(float)})


@dataclass
class Trees:
    """Boosted trees as arrays: feature, threshold, children and value of every node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (self.left[at] >= 0).any():
                inner = self.left[at] >= 0
                low = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 2 * total  # the classifier's probability is a logistic of twice its margin


def _arrays(model) -> Trees:
    rows: list[list] = []

    def add(node, weight: float) -> int:
        at = len(rows)
        rows.append([0, 0.0, -1, -1, weight * node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][0], rows[at][1] = split.featureIndex(), split.threshold()
            rows[at][2], rows[at][3] = add(node.leftChild(), weight), add(node.rightChild(), weight)
        return at

    roots = [add(tree._java_obj.rootNode(), weight) for tree, weight in zip(model.trees, model.treeWeights, strict=True)]
    columns = list(zip(*rows, strict=True))
    return Trees(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4]), roots)


def fit(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_pages: int = MAX_TRAINING_PAGES) -> Trees | None:
    """Fit the trees on ``max_pages`` pages at most; None if no page has text to learn from."""
    rows = pages.select(F.xxhash64(pages[url_col], pages[id_col]).alias("seed"), pages[html_col].cast("string").alias("html")).filter(F.col("html") != "")
    chosen = rows.orderBy("seed", F.length("html")).limit(max_pages).repartition(8, "seed")
    chosen = staged(chosen, "training-pages")
    layouts = max(LAYOUTS, -(-REBUILT // max(1, chosen.count())))
    nodes = staged(chosen.mapInPandas(lambda frames: _training_rows(frames, layouts), "features array<double>, label double"), "dom-nodes")
    if nodes.select("label").distinct().count() < 2:
        return None
    grown = GBTClassifier(maxIter=24, maxDepth=5, stepSize=0.25, maxBins=48, subsamplingRate=1.0, seed=7, cacheNodeIds=False)
    return _arrays(grown.fit(nodes.select(array_to_vector("features").alias("features"), "label").coalesce(4)))


def main_text(pages: DataFrame, trees: Trees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``. A null page is empty; a page
    without text gives an empty text; without trees (there was nothing to learn from) all text of a
    page counts as main text; very long pages are read whole; repeated rows give repeated rows;
    other columns are ignored."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                read = [dom.read(h or "") for h in part.column("html").to_pylist()]
                forest = Forest(read)
                model = shared.value
                kept = np.ones(len(forest.parent), bool) if model is None else forest.decode(model.log_odds(forest.features(known)))
                texts = forest.texts(kept)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=arrow)

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(frugal(run), "page_id long, url string, text string, n_chars long")
