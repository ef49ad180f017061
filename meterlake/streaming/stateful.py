"""Streams that hold state for a key: stalls, pairings, sessions, fired alerts and triggers, which end by timer,
and links of secondary observations, which wait for their primary one.

All but the links take rows in the order of their times. A row waits in the state until the watermark has passed
it, so all rows before it have come; what a stream gives therefore does not depend on how its input fell
into batches, as long as no row is later than the watermark allows. Each gives versions of its rows, of
which :func:`latest` keeps the last; an ``ended`` row has no later version.

State lies in RocksDB (``spark.sql.streaming.stateStore.providerClass``, see :func:`configure`). For each key it is
what came within the watermark's delay, and what is open; a timer clears the rest.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """Let the session's new streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def latest(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last version of each row: the one that goes furthest by ``order``, an ended one before others."""
    value = [c for c in versions.columns if c not in key]
    newest = versions.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(*order, "ended")).alias("_v"))
    return newest.select(*key, *[F.col(f"_v.{c}").alias(c) for c in value])


def _tuples(frame: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Rows of a frame in the order of a schema, with None for nulls and whole numbers as such."""
    columns = []
    for field in schema:
        column = frame[field.name]
        column = column.astype("Int64") if isinstance(field.dataType, T.LongType) else column
        columns.append(column.astype(object).where(column.notna(), None).tolist())
    return list(zip(*columns, strict=True))


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    kinds = {f.name: "Int64" if isinstance(f.dataType, T.LongType) else "boolean" if isinstance(f.dataType, T.BooleanType) else object for f in schema}
    return pd.DataFrame(rows, columns=schema.names, dtype=object).astype(kinds)


class InOrder(StatefulProcessor):
    """Rows of a key in time order. ``ROW`` begins with the row's time (ms); ``HELD`` is what is remembered from row
    to row, or None; ``OUT`` is what comes out, the key first. After ``quiet_ms`` without a row the key is told
    so and forgotten. ``slack_ms`` keeps rows back for longer than the watermark does."""

    ROW: str
    HELD: str
    OUT: str

    def __init__(self, quiet_ms: int, slack_ms: int = 0) -> None:
        self.quiet_ms, self.slack_ms = quiet_ms, slack_ms
        # A schema's text can be read on the driver only.
        self.row, self.out = T.StructType.fromDDL(self.ROW), T.StructType.fromDDL(self.OUT)

    @abstractmethod
    def advance(self, held: Any, row: tuple) -> tuple[Any, list[tuple]]:
        """What is remembered after a row, and what comes out."""

    def settled(self, held: Any) -> list[tuple]:
        """What comes out when no more rows can be handed on for now."""
        return []

    @abstractmethod
    def ended(self, held: Any) -> list[tuple]:
        """What comes out when the key has been quiet for too long."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.held = handle.getValueState("held", self.HELD)
        self.clock = handle.getValueState("clock", "seen long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList(_tuples(frame, self.row))
        yield self._turn(key, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._turn(key, timerValues)

    def _turn(self, key: Any, timers: TimerValues) -> pd.DataFrame:
        """Hand on the rows that the watermark has passed, end what has been quiet, and set the next timer."""
        now = timers.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda row: tuple((x is not None, x) for x in row))
        due = sum(row[0] + self.slack_ms <= now for row in rows)
        seen, timer = self.clock.get() if self.clock.exists() else (None, None)
        before = held = self._known()
        out: list[tuple] = []
        for row in rows[:due]:
            if seen is not None and row[0] - seen > self.quiet_ms:
                out += self.ended(held)
                held = None
            held, more = self.advance(held, tuple(row))
            out, seen = out + more, row[0]
        if due and held is not None:
            out += self.settled(held)
        if due:
            self.waiting.put([tuple(row) for row in rows[due:]]) if due < len(rows) else self.waiting.clear()
        if seen is not None and due == len(rows) and seen + self.quiet_ms <= now:
            out += self.ended(held)
            held = seen = None
        if held is None:
            if before is not None:
                self.held.clear()
        elif due:
            self.held.update(held)
        self._wake(seen, rows[due][0] + self.slack_ms if due < len(rows) else None, timer)
        return _frame([(*key, *row) for row in out], self.out)

    def _known(self) -> Any:
        return tuple(self.held.get()) if self.held.exists() else None

    def _wake(self, seen: int | None, first: int | None, timer: int | None) -> None:
        """One timer a key: when the next row is due, or the key has been quiet for too long."""
        quiet = None if seen is None else seen + self.quiet_ms
        wake = min((t for t in (first, quiet) if t is not None), default=None)
        if timer is not None and timer != wake:
            self.handle.deleteTimer(timer)
        if wake is not None and timer != wake:
            self.handle.registerTimer(wake)
        if wake is None:
            self.clock.clear()
        else:
            self.clock.update((seen, wake))

    def close(self) -> None:
        pass


class Stalls(InOrder):
    """See :func:`stalls`."""

    ROW = "observed_at long, seq long, state string, error_key string, pane_pid long, pass_no long, reset_hint long, retry_after_ms long"
    HELD = "pass_no long, onset long, last_seen long, error_key string, pane_pid long, resets_at long, samples long"
    OUT = "pane string, onset long, last_seen long, error_key string, pane_pid long, resets_at long, samples long, ended boolean"

    def advance(self, held: Any, row: tuple) -> tuple[Any, list[tuple]]:
        at, _, state, error, pid, pass_no, hint, wait = row
        last, *stall = held or (None, None, None, None, None, None, None)
        out = []
        if stall[0] is not None and last is not None and pass_no is not None and pass_no - last > 1:
            out, stall = [(*stall, True)], [None] * 6
        if state is not None and state != "unknown":
            goes_on = stall[0] is not None and state == "stalled" and stall[2:4] == [error, pid]
            if stall[0] is not None and not goes_on:
                out, stall = [*out, (*stall, True)], [None] * 6
            if goes_on:
                stall = [stall[0], at, *stall[2:5], stall[5] + 1]
            elif state == "stalled":
                stall = [at, at, error, pid, hint if hint is not None else None if wait is None else at + wait, 1]
        return (last if pass_no is None else pass_no, *stall), out

    def settled(self, held: Any) -> list[tuple]:
        return [(*held[1:], False)] if held[1] is not None else []

    def ended(self, held: Any) -> list[tuple]:
        return [(*held[1:], True)] if held and held[1] is not None else []


class Pairings(InOrder):
    """See :func:`live_pairings`."""

    ROW = "observed_at long, pass_no long, session_key string, method string"
    _PAIR = "struct<session_key: string, method: string, first: long, last: long, passes: long, pass_no: long>"
    HELD = f"pass_no long, sightings array<struct<at: long, session_key: string, method: string>>, open array<{_PAIR}>"
    OUT = "pane string, session_key string, method string, first_observed_at long, last_confirmed_at long, passes long, ended boolean"

    def __init__(self, quiet_ms: int, slack_ms: int, weak_method: str) -> None:
        super().__init__(quiet_ms, slack_ms)
        self.weak_method = weak_method

    def advance(self, held: Any, row: tuple) -> tuple[Any, list[tuple]]:
        at, pass_no, session, method = row
        known = held or (pass_no, [], [])
        out: list[tuple] = []
        if known[0] != pass_no:
            pairs, out = self._passed(known)
            known = (pass_no, [], pairs)
        return (pass_no, [*map(tuple, known[1]), (at, session, method)], [*map(tuple, known[2])]), out

    def _passed(self, held: Any) -> tuple[list[tuple], list[tuple]]:
        """Open pairings after a whole pass, and those that it changed."""
        pass_no, sightings, open_ = held
        sure = [s for s in sightings if s[2] != self.weak_method]
        weak = [] if sure else [s for s in sightings if s[2] == self.weak_method]
        kept = sure or (weak if len({s[1] for s in weak}) == 1 else [])
        seen: dict[tuple, list[int]] = {}
        for at, session, method in kept:
            seen.setdefault((session, method), []).append(at)
        pairs, out = [], []
        for session, method, first, last, passes, newest in map(tuple, open_):
            times = seen.pop((session, method), None) if newest == pass_no - 1 else None
            if times is None:
                out.append((session, method, first, last, passes, True))
            else:
                pairs.append((session, method, min(first, *times), max(last, *times), passes + 1, pass_no))
        pairs += [(session, method, min(times), max(times), 1, pass_no) for (session, method), times in seen.items()]
        return pairs, out + [(*p[:5], False) for p in pairs]

    def ended(self, held: Any) -> list[tuple]:
        if not held:
            return []
        pairs, out = self._passed(held)
        return [row for row in out if row[5]] + [(*p[:5], True) for p in pairs]


class Sessions(InOrder):
    """See :func:`sessions`."""

    ROW = "observed_at long"
    HELD = "started_at long, last_seen_at long, sightings long"
    OUT = "session_key string, started_at long, last_seen_at long, sightings long, ended boolean"

    def advance(self, held: Any, row: tuple) -> tuple[Any, list[tuple]]:
        started, _, n = held or (row[0], None, 0)
        return (started, row[0], n + 1), []

    def settled(self, held: Any) -> list[tuple]:
        return [(*held, False)]

    def ended(self, held: Any) -> list[tuple]:
        return [(*held, True)] if held else []


class Alerts(InOrder):
    """See :func:`alerts`."""

    ROW = "observed_at long, source string, stream_key string, remaining_pct double, resets_at long"
    HELD = "fired array<struct<resets_at: long, threshold: long>>"
    OUT = "account string, window string, observed_at long, source string, remaining_pct double, resets_at long, threshold long"

    def __init__(self, quiet_ms: int, thresholds: tuple[int, ...]) -> None:
        super().__init__(quiet_ms)
        self.thresholds = sorted(thresholds)

    def advance(self, held: Any, row: tuple) -> tuple[Any, list[tuple]]:
        at, source, _, left, resets = row
        fired = [tuple(f) for f in (held[0] if held else []) if f[0] is None or f[0] > at]
        if left is None or (resets is not None and resets <= at):
            return (fired,), []
        crossed = [(resets, t) for t in self.thresholds if left <= t]
        new = [c for c in crossed if c not in fired]
        return (fired + new,), [(at, source, left, resets, crossed[0][1])] if new else []

    def ended(self, held: Any) -> list[tuple]:
        return []


class Held(InOrder):
    """See :func:`firings`."""

    ROW = "observed_at long, holds boolean"
    HELD = "at long, holds boolean, since long, fired_for long, fired_at long"
    OUT = "series string, since long, fired_at long"

    def __init__(self, quiet_ms: int, hold_ms: int, cooldown_ms: int) -> None:
        super().__init__(quiet_ms)
        self.hold_ms, self.cooldown_ms = hold_ms, cooldown_ms

    def advance(self, held: Any, row: tuple) -> tuple[Any, list[tuple]]:
        # Samples at one time count as one; nulls and false come first among them, so the first of them decides.
        at, holds = row[0], bool(row[1])
        before, held_before, since, fired_for, fired_at = held or (None, False, None, None, None)
        holds = holds and (before != at or held_before)
        since = (since if held_before else at) if holds else None
        ripe = holds and at - since >= self.hold_ms and since != fired_for
        if ripe and (fired_at is None or at - fired_at >= self.cooldown_ms):
            return (at, holds, since, since, at), [(since, at)]
        return (at, holds, since, fired_for, fired_at), []

    def ended(self, held: Any) -> list[tuple]:
        return []


def _in_order(rows: DataFrame, key: list[str], at: str, delay: str, processor: InOrder) -> DataFrame:
    timed = rows.filter(F.col(at).isNotNull()).withColumn("_at", F.timestamp_millis(F.col(at))).withWatermark("_at", delay)
    kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in processor.row]
    keyed = timed.select(*[F.col(c).cast("string").alias(c) for c in key], "_at", *kept)
    return keyed.groupBy(*key).transformWithStateInPandas(processor, processor.OUT, "Append", "EventTime")


def stalls(samples: DataFrame, absent_ms: int, delay: str = "1 minute") -> DataFrame:
    """Versions of the stalls of each pane, as :func:`meterlake.operators.sequences.stalls` has them with passes: ``pane,
    onset, last_seen, error_key, pane_pid, resets_at, samples, ended``; their key is pane and onset, their order ``samples``.

    ``samples`` are a stream with ``pass_no``. A pane that no pass has shown for ``absent_ms`` (over one pass, under two)
    is gone: a timer ends its stall, though no row comes."""
    return _in_order(samples, ["pane"], "observed_at", delay, Stalls(absent_ms))


def live_pairings(sightings: DataFrame, pass_ms: int, absent_ms: int, delay: str = "1 minute", weak_method: str = "open_session_file") -> DataFrame:
    """Versions of the pairings of each pane, as :func:`meterlake.operators.sequences.live_pairings` has them: ``pane,
    session_key, method, first_observed_at, last_confirmed_at, passes, ended``; the order of versions is ``passes``.

    A pass is looked at as a whole, when the next one of its pane is due: its rows lie within ``pass_ms``. A pane
    without rows for ``absent_ms`` (over ``pass_ms``) is gone, and a timer ends its pairings."""
    return _in_order(sightings, ["pane"], "observed_at", delay, Pairings(absent_ms, pass_ms, weak_method))


def sessions(sightings: DataFrame, quiet_ms: int, delay: str = "1 minute") -> DataFrame:
    """Versions of each session's life: ``session_key, started_at, last_seen_at, sightings, ended``. One that is not seen
    for over ``quiet_ms`` has ended, by timer if nothing more comes; seen again, it begins anew."""
    return _in_order(sightings, ["session_key"], "observed_at", delay, Sessions(quiet_ms))


def alerts(anchors: DataFrame, thresholds: tuple[int, ...] = (20, 5), keep_ms: int = 30 * 86_400_000, delay: str = "1 minute") -> DataFrame:
    """An alert (``account, window, observed_at, source, remaining_pct, resets_at, threshold``) for each reading at which a
    threshold of its window instance is first crossed: the most severe one, with which the milder ones count as
    fired. What has fired is forgotten when the instance ends, or the series is quiet for ``keep_ms``."""
    known = anchors.filter("account IS NOT NULL")
    return _in_order(known, ["account", "window"], "observed_at", delay, Alerts(keep_ms, thresholds))


def firings(samples: DataFrame, hold_ms: int, cooldown_ms: int = 0, keep_ms: int = 30 * 86_400_000, delay: str = "1 minute") -> DataFrame:
    """When a trigger fires, as :func:`meterlake.operators.triggers.firings` has it: ``series, since, fired_at`` of a stream of
    ``series, observed_at, holds``. A series that is quiet for ``keep_ms`` is forgotten."""
    return _in_order(samples, ["series"], "observed_at", delay, Held(keep_ms, hold_ms, cooldown_ms))


class Links(StatefulProcessor):
    """See :func:`late_links`."""

    ROW = "observation_id long, event_key string, source string, primary boolean"
    OUT = "observation_id long, event_key string"

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms
        self.row, self.out = T.StructType.fromDDL(self.ROW), T.StructType.fromDDL(self.OUT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "source string", "event_key string", self.keep_ms)
        self.waiting = handle.getListState("waiting", "observation_id long, source string", self.keep_ms)
        self.linked = handle.getMapState("linked", "observation_id long", "event_key string", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        told = False
        for frame in rows:
            waiting = []
            for number, event, source, primary in _tuples(frame, self.row):
                if not primary:
                    if not self.linked.containsKey((number,)):
                        waiting.append((number, source))
                elif not self.first.containsKey((source,)) or _before(event, self.first.getValue((source,))[0]):
                    self.first.updateValue((source,), (event,))
            if waiting:
                self.waiting.appendList(waiting)
            told = True
        yield self._link() if told else _frame([], self.out)

    def _link(self) -> pd.DataFrame:
        first = {k[0]: v[0] for k, v in self.first.iterator()}
        links, still = {}, {}
        for number, source in self.waiting.get():
            events = [e for s, e in first.items() if s != source]
            if events:
                links[number] = min(events, key=_order)
            else:
                still[number] = source
        for number, event in links.items():
            self.linked.updateValue((number,), (event,))
        if links:
            self.waiting.put(list(still.items())) if still else self.waiting.clear()
        return _frame(list(links.items()), self.out)

    def close(self) -> None:
        pass


def _order(event: str) -> tuple:
    """Numbers by value, other keys by their text."""
    return (0, int(event), event) if event.isdecimal() else (1, 0, event)


def _before(a: str, b: str) -> bool:
    return _order(a) < _order(b)


def late_links(observations: DataFrame, key: str = "observation_id", keep_ms: int | None = None) -> DataFrame:
    """A stream of :func:`meterlake.operators.linking.link_secondary`: ``observation_id, event_key``, each once.

    A secondary observation waits under its request key until a primary one of another source has come, in whatever
    batch, and is linked to the least event that is then known; links never move. A row that comes again
    changes nothing. No watermark drops a late row: without ``keep_ms`` a request key is remembered for ever,
    with it, each part of its state goes so long (by the clock) after it was last written. Such a stream goes by
    the clock and never runs out of batches: start it with a processing-time trigger, not with ``availableNow``."""
    rows = observations.filter("provider_request_key IS NOT NULL").select(
        "provider_request_key", F.col(key).cast("long").alias("observation_id"), F.col("event_key").cast("string").alias("event_key"), "source", "primary")
    return rows.groupBy("provider_request_key").transformWithStateInPandas(Links(keep_ms), Links.OUT, "Append", "ProcessingTime" if keep_ms else "None")
