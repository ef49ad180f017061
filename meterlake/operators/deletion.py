"""Deletion by account, project or date: all that hangs on it, and tombstones that keep it from coming back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.lineage import cut

TOMBSTONE_DAYS = 90


def doomed_sessions(sessions: DataFrame, effective: DataFrame, accounts: DataFrame | None = None, projects: DataFrame | None = None, before_ms: int | None = None) -> DataFrame:
    """``session_key`` of sessions to be forgotten: those attributed to one of ``accounts`` or ``projects`` (a column
    ``value`` each), those last seen before a time, and all that descend from one of them by ``parent_session_key``.

    ``effective`` (subject_id, dimension, state, value) attributes sessions; an ambiguous one hangs on no account."""
    firm = effective.filter("state = 'attributed'").select(F.col("subject_id").alias("session_key"), "dimension", "value")
    found = sessions.select("session_key").limit(0)
    for dimension, names in (("account", accounts), ("project", projects)):
        if names is not None:
            found = found.unionByName(firm.filter(F.col("dimension") == dimension).join(names.select("value").distinct(), "value", "left_semi").select("session_key"))
    if before_ms is not None:
        found = found.unionByName(sessions.filter(F.col("last_seen_at") < before_ms).select("session_key"))
    return descendants(sessions, found.distinct())


def descendants(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """``session_key`` of ``roots`` and all below them. Each round doubles how far a session sees upwards and whether a
    root is among what it passed, so rounds grow with the logarithm of the depth; a cycle ends with the
    rounds that cover all sessions."""
    marked = sessions.select("session_key", F.col("parent_session_key").alias("up")).join(roots.select("session_key", F.lit(True).alias("hit")), "session_key", "left")
    marked = cut(marked.select("session_key", F.coalesce("hit", F.lit(False)).alias("hit"), F.when(F.col("up") != F.col("session_key"), F.col("up")).alias("up")), "descent")
    reach, n = 1, marked.count()
    while reach < n and not marked.filter("up IS NOT NULL AND NOT hit").isEmpty():
        above = marked.select(F.col("session_key").alias("up"), F.col("hit").alias("_hit"), F.col("up").alias("_up"))
        joined = marked.join(above, "up", "left")
        marked = cut(joined.select("session_key", (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit"), F.col("_up").alias("up")), "descent")
        reach *= 2
    return marked.filter("hit").select("session_key")


def forget(doomed: DataFrame, events: DataFrame, observations: DataFrame, links: DataFrame, evidence: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """The five tables without what hangs on ``doomed`` sessions: their events, the observations of these sessions and those
    that support their events, the links of both, the evidence on sessions and events, and the sessions.

    Every step is an anti-join on a key; rows without a session stay."""
    gone_events = events.join(doomed, "session_key", "left_semi").select("event_key")
    supports = links.join(gone_events, "event_key", "left_semi").select("observation_id")
    own = observations.join(doomed, "session_key", "left_semi").select("observation_id")
    gone_observations = supports.unionByName(own).distinct()
    subjects = doomed.select(F.lit("session").alias("subject_kind"), F.col("session_key").cast("string").alias("subject_id")).unionByName(
        gone_events.select(F.lit("usage_event").alias("subject_kind"), F.col("event_key").cast("string").alias("subject_id")))
    return {
        "events": events.join(doomed, "session_key", "left_anti"), "observations": observations.join(gone_observations, "observation_id", "left_anti"),
        "links": links.join(gone_events, "event_key", "left_anti").join(gone_observations, "observation_id", "left_anti"),
        "evidence": evidence.join(subjects, ["subject_kind", "subject_id"], "left_anti"), "sessions": sessions.join(doomed, "session_key", "left_anti")}


def tombstones(now_ms: int, accounts: DataFrame | None = None, doomed: DataFrame | None = None, old: DataFrame | None = None, days: int = TOMBSTONE_DAYS) -> DataFrame:
    """``kind, value, forgotten_at``: what was forgotten, with ``old`` tombstones that have not run out. The newest date
    of each counts."""
    stones = [old.filter(F.col("forgotten_at") >= now_ms - days * 86_400_000)] if old is not None else []
    for kind, rows, name in (("account", accounts, "value"), ("session", doomed, "session_key")):
        if rows is not None:
            stones.append(rows.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("value"), F.lit(now_ms).cast("long").alias("forgotten_at")))
    if not stones:
        raise ValueError("nothing to bury")
    out = stones[0]
    for more in stones[1:]:
        out = out.unionByName(more)
    return out.groupBy("kind", "value").agg(F.max("forgotten_at").alias("forgotten_at"))


def unburied(rows: DataFrame, stones: DataFrame, now_ms: int, kind: str = "session", column: str = "session_key", days: int = TOMBSTONE_DAYS) -> DataFrame:
    """``rows`` that no live tombstone of that kind holds back: what logs still say of a forgotten session or account
    does not come back while its stone stands. Rows without a value stay."""
    live = stones.filter((F.col("kind") == kind) & (F.col("forgotten_at") >= now_ms - days * 86_400_000)).select(F.col("value").alias("_v")).distinct()
    return rows.join(live, F.col(column).cast("string") == F.col("_v"), "left_anti")
