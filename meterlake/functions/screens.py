"""Screens of agents classified to a state, by expressions over the screen's lines.

Three layouts: "ruled" has its input line under a rule, "arrow" an input line with a narrow arrow,
"boxed" a composer whose header tells idle from busy. What does not match is ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import key_of, next_clock_time

#: Fixed values of the layouts.
RULE = r"^\s*─{8,}\s*$"
SPINNER = r"^\s*\S\s+\S+…\s+\(\d+[smh]|esc to interrupt"
RULED_LIMIT = r"(?i)usage limit reached|you've hit your [\w\- ]*limit|you've reached your [\w\- ]*limit|(fable|opus|sonnet|weekly|session) limit reached"
SELF_RESUME = r"(?i)continuing automatically|continues automatically when it resets"
RULED_MODEL = r"(?i)\b(?:Opus|Sonnet|Haiku|Fable)\s+[\d.]+"
RESETS = r"(?i)resets? (?:at )?(\d{1,2}(?::\d{2})?\s*[ap]\.?m\.?)"
ARROW_LIMIT = r"(?i)you've hit your usage limit"
ARROW_BUSY = r"(?i)esc to interrupt|^\s*[•◦]\s*Working\b"
TRY_AGAIN = r"(?i)try again at ((?:[A-Z][a-z]{2} \d{1,2}, \d{4} )?\d{1,2}:\d{2}\s*[AP]M)"
MODEL_FOR = r"(?i)usage limit for ([\w.\-]+)"
BOXED_ERROR = r"(?i)^\s*Error: .*(?:429|rate_limit_error|usage limit)"
BOXED_MORE = r"(?i)rate_limit_error|retry-after-ms|request_id|^\s*later\.|^\s*\{"
BOXED_MODEL = r"[◒◔◑◐○●◕◓◌]\s+([A-Za-z][\w.\- ]*?)\s+>"
BOX = "╭╮╰╯│├└┌┐┘─┃╎▶◀ "


def lines_of(text: Column) -> Column:
    """Lines that are not blank, without white space at their ends."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def visible_text(styled: Column) -> Column:
    """What a reader would take for typed on a styled line: hints are shown dim or grey, and go. The line
    is cut at its escapes, and each part carries on or changes the brightness; no code at all resets it."""
    # Cut at the escapes; each part keeps its own codes in front.
    parts = F.split(F.regexp_replace(styled, r"\x1b\[([0-9;]*)m", "\x1e$1\x1f"), "\x1e")
    start = F.struct(F.lit(False).alias("dim"), F.lit("").alias("out"))

    def step(state: Column, part: Column) -> Column:
        has = part.contains("\x1f")
        given = F.filter(F.split(F.split_part(part, F.lit("\x1f"), F.lit(1)), ";"), lambda c: c != "")
        codes = F.when(has, F.when(F.size(given) == 0, F.array(F.lit("0"))).otherwise(given)).otherwise(F.array().cast("array<string>"))
        said = F.filter(codes, lambda c: c.isin("0", "22", "39", "2", "90"))
        dim = F.when(F.size(said) > 0, F.element_at(said, -1).isin("2", "90")).otherwise(state["dim"])
        text = F.when(has, F.split_part(part, F.lit("\x1f"), F.lit(2))).otherwise(part)
        return F.struct(dim.alias("dim"), F.concat(state["out"], F.when(dim, "").otherwise(text)).alias("out"))

    return F.regexp_replace(F.aggregate(parts, start, step)["out"], r"\x1b\[[0-9;?]*[A-Za-z]", "")


def _last_index(lines: Column, holds) -> Column:
    """Place (from 1) of the last line that fits; 0 without one."""
    return F.coalesce(F.array_max(F.transform(lines, lambda x, i: F.when(holds(x), i + 1))), F.lit(0))


def _first(texts: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(texts, pattern, group)
    return F.when(found != "", found)


def _tail(lines: Column, end: Column, n: int) -> Column:
    """The ``n`` lines before place ``end``."""
    begin = F.greatest(end - n, F.lit(1))
    return F.slice(lines, begin, F.greatest(end - begin, F.lit(0)))


def _reading(state: Column, model: Column, error: Column, reset: Column, wait: Column) -> Column:
    stalled = state == "stalled"
    return F.struct(state.alias("state"), model.alias("model"), F.when(stalled, error).alias("error_key"), F.when(stalled, reset).alias("reset_text"), F.when(stalled, wait).alias("retry_after_ms"))


def _typed(rows: DataFrame, mark: str) -> Column:
    """What is typed after the input mark; by the styled screen where there is one."""
    own = F.trim(F.substring_index(F.get("_lines", F.col("_at") - 1), mark, -1))
    marked = F.filter(F.split("_styled", r"\r\n|\r|\n"), lambda x: x.contains(mark))
    shown = F.trim(F.regexp_replace(visible_text(F.get(marked, F.size(marked) - 1)), f"^.*?{mark}", ""))
    return F.when(F.col("_styled").contains(mark), shown).otherwise(own)


def _ruled(rows: DataFrame) -> DataFrame:
    at, near = F.col("_at"), F.col("_near")
    rows = rows.withColumn("_at", _last_index(F.col("_lines"), lambda x: F.ltrim(x).startswith("❯")))
    rows = rows.withColumn("_near", _tail(F.col("_lines"), at - 1, 5)).withColumn("_hit", F.filter("_near", lambda x: x.rlike(RULED_LIMIT) & ~F.lower(x).contains("context limit")))
    box = (at > 1) & F.coalesce(F.get("_lines", at - 2).rlike(RULE), F.lit(False))
    model = _first(F.array_join(F.slice("_lines", F.greatest(at, F.lit(1)), F.size("_lines") + 1), "\n"), RULED_MODEL, 0)
    busy = F.exists(F.slice(near, F.greatest(F.size(near) - 3, F.lit(1)), F.lit(4)), lambda x: x.rlike(SPINNER))
    text = F.array_join(near, "\n")
    state = F.when(~box, "unknown").when(_typed(rows, "❯") != "", "typing").when(busy, "busy").when(F.size("_hit") == 0, "idle").when(text.rlike(SELF_RESUME), "resuming").otherwise("stalled")
    rows = rows.withColumn("_state", state)
    return rows.withColumn("_r", _reading(F.col("_state"), F.when(F.col("_state") != "unknown", model), key_of(F.col("_harness"), F.array_join("_hit", "\n")), _first(text, RESETS), F.lit(None).cast("long")))


def _arrow(rows: DataFrame) -> DataFrame:
    at, near = F.col("_at"), F.col("_near")
    rows = rows.withColumn("_at", _last_index(F.col("_lines"), lambda x: F.ltrim(x).startswith("›")))
    rows = rows.withColumn("_near", _tail(F.col("_lines"), at, 5)).withColumn("_hit", F.filter("_near", lambda x: x.rlike(ARROW_LIMIT)))
    busy = F.exists(_tail(F.col("_lines"), at, 10), lambda x: x.rlike(ARROW_BUSY))
    state = F.when(at == 0, "unknown").when(_typed(rows, "›") != "", "typing").when(busy, "busy").when(F.size("_hit") == 0, "idle").otherwise("stalled")
    rows, text = rows.withColumn("_state", state), F.array_join(near, "\n")
    return rows.withColumn("_r", _reading(F.col("_state"), F.when(F.col("_state") == "stalled", _first(text, MODEL_FOR)), key_of(F.col("_harness"), F.array_join("_hit", "\n")), _first(text, TRY_AGAIN), F.lit(None).cast("long")))


def _boxed(rows: DataFrame) -> DataFrame:
    at, body, error = F.col("_at"), F.col("_near"), F.col("_error")
    rows = rows.withColumn("_at", _last_index(F.col("_lines"), lambda x: x.startswith("╭──")))
    rows = rows.withColumn("_near", F.when(at > 1, F.slice("_lines", F.lit(1), at - 1)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_error", _last_index(body, lambda x: x.rlike(BOXED_ERROR)))
    header = F.get("_lines", at - 1)
    model = F.trim(_first(header, BOXED_MODEL))
    typed = F.exists(F.slice("_lines", at + 1, F.size("_lines") + 1), lambda x: F.btrim(x, F.lit(BOX)) != "")
    own = F.forall(F.slice(body, error + 1, F.size(body) + 1), lambda x: F.trim(x).rlike(BOXED_MORE) | (F.trim(x) == "TODO") | F.lit(BOX).contains(F.substring(F.trim(x), 1, 1)))
    tail = F.array_join(F.slice(body, F.greatest(error - 3, F.lit(1)), F.size(body) + 1), "\n")
    ids, waits = F.regexp_extract_all(tail, F.lit(r'"request_id":"([^"]+)"')), F.regexp_extract_all(tail, F.lit(r"retry-after-ms=(\d+)"))
    state = F.when(at == 0, "unknown").when(~header.rlike(r"^╭──\s*π\s*>"), "busy").when(typed, "typing").when((error == 0) | ~own, "idle").otherwise("stalled")
    key = F.coalesce(F.get(ids, F.size(ids) - 1), key_of(F.get(body, error - 1)))
    rows = rows.withColumn("_state", state)
    return rows.withColumn("_r", _reading(F.col("_state"), F.when(F.col("_state") != "unknown", model), key, F.lit(None).cast("string"), F.get(waits, F.size(waits) - 1).cast("long")))


_LAYOUTS = {"ruled": _ruled, "arrow": _arrow, "boxed": _boxed}


def classify(screens: DataFrame, layout: str = "layout", plain: str = "plain", styled: str = "styled", harness: str | None = None, at: str | None = None, zone: str = "UTC") -> DataFrame:
    """``screens`` with a column ``reading`` of state, model, error_key, reset_text and retry_after_ms.
    Rows of an unknown layout are dropped. Each step is a column of its own, so none is computed twice.

    ``harness`` names the column whose value tells the error keys of one program from another's (the
    layout where it is not given). With ``at``, the column of the time at which the screen was taken, the
    reading has ``reset_hint`` too: the time that ``reset_text`` names on a clock in ``zone``.
    """
    shown = screens.withColumn("_lines", lines_of(F.col(plain))).withColumn("_styled", F.coalesce(F.col(styled), F.lit(""))).withColumn("_harness", F.col(harness or layout))
    reading = F.col("_r").withField("reset_hint", next_clock_time(F.col("_r.reset_text"), F.col(at), zone)) if at else F.col("_r")
    parts = [make(shown.filter(F.col(layout) == name)).select(*screens.columns, reading.alias("reading")) for name, make in _LAYOUTS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
