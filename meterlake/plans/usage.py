"""Usage by any dimension: rows, total and shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import local_day
from meterlake.operators import attribution, measures, paths

#: Dimensions that evidence attributes, sessions or single events.
ATTRIBUTED = ("account", "branch", "role", "task", "pull_request", "billing_route")
DIMENSIONS = ("harness", "provider", "model", "session", "day", "project", *ATTRIBUTED)


@dataclass
class Usage:
    """``rows`` (key, state, label and measures), ``total`` (measures of one row, computed apart) and
    ``shares`` of requests by state, null without requests."""

    rows: DataFrame
    total: DataFrame
    shares: DataFrame | None


def usage(events: DataFrame, by: str, since_ms: int | None = None, until_ms: int | None = None, include_auxiliary: bool = True, zone: str = "UTC",
          sessions: DataFrame | None = None, checkouts: DataFrame | None = None, effective: DataFrame | None = None, evidence: DataFrame | None = None,
          roots: DataFrame | None = None, labels: DataFrame | None = None) -> Usage:
    """Usage over canonical events in ``[since, until)``.

    ``effective`` holds effective attributions of sessions and events; sessions that are ambiguous over
    their span are resolved for each request at its own time from ``evidence``. ``roots`` makes accounts
    canonical, ``labels`` (account_key, label) names them. Groups always add up to the total.
    """
    if by not in DIMENSIONS:
        raise ValueError(f"by must be one of {', '.join(DIMENSIONS)}")
    scope = measures.in_range(events, since_ms, until_ms, include_auxiliary)
    total = scope.agg(*measures.usage_measures())
    if by in ("harness", "provider", "model", "session", "day"):
        key = {"session": F.col("session_key"), "day": local_day(F.col("observed_at"), zone)}.get(by, F.col(by))
        grouped = scope.groupBy(key.cast("string").alias("key")).agg(*measures.usage_measures()).withColumn("state", F.lit("value"))
    elif by == "project":
        # Sums by session first: the path lookup then runs over sessions, not over requests.
        partial = scope.groupBy("session_key").agg(*measures.usage_measures())
        named = paths.longest_prefix(sessions.filter("cwd IS NOT NULL"), "cwd", ["session_key"], checkouts)
        grouped = partial.join(named, "session_key", "left").groupBy(F.col("project").alias("key")).agg(*measures.merged_measures())
        grouped = grouped.withColumn("state", F.when(F.col("key").isNull(), "unattributed").otherwise("attributed"))
    else:
        grouped = _attributed(scope, by, effective, evidence, roots)
    label = F.when(F.col("state") == "value", F.coalesce("key", F.lit("unknown"))).when(F.col("state") == "attributed", F.col("key")).otherwise(F.concat(F.lit("("), F.col("state"), F.lit(")")))
    if by == "billing_route":
        label = F.when(F.col("state") == "unattributed", "unknown").otherwise(label)
    rows = grouped.withColumn("label", label)
    if by == "account" and labels is not None:
        rows = rows.join(labels.select(F.col("account_key").alias("key"), F.col("label").alias("_l")), "key", "left").withColumn("label", F.coalesce("_l", "label")).drop("_l")
    rows = rows.select("key", "state", "label", *measures.MEASURES)
    shares = _shares(rows, total) if by == "project" or by in ATTRIBUTED else None
    return Usage(rows, total, shares)


def _attributed(scope: DataFrame, by: str, effective: DataFrame, evidence: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Measures by state and value. Events meet the state of their session in one join; only those of
    sessions that are ambiguous over their span are looked at request by request, and evidence of single
    events is joined only where there is any."""
    of = lambda rows, kind: rows.filter((F.col("subject_kind") == kind) & (F.col("dimension") == by))
    session = of(effective, "session").select(F.col("subject_id").alias("session_key"), F.col("state").alias("_ss"), F.col("value").alias("_sv"))
    told = scope.join(session, "session_key", "left").withColumn("state", F.coalesce("_ss", F.lit("unattributed"))).withColumn("value", F.col("_sv")).withColumn("_own", F.lit(False)).drop("_ss", "_sv")
    has = of(evidence, "usage_event").select(F.col("subject_id").alias("_id")).distinct()
    if not has.isEmpty():
        mine = has.join(of(effective, "usage_event").select(F.col("subject_id").alias("_id"), F.col("state").alias("_os"), F.col("value").alias("_ov")), "_id", "left").withColumn("_has", F.lit(True))
        told = told.withColumn("_id", F.col("event_key").cast("string")).join(mine, "_id", "left").withColumn("_own", F.col("_has").isNotNull())
        told = told.withColumn("state", F.when(F.col("_own"), F.coalesce("_os", F.lit("unattributed"))).otherwise(F.col("state"))).withColumn("value", F.when(F.col("_own"), F.col("_ov")).otherwise(F.col("value"))).drop("_id", "_os", "_ov", "_has")
    if by == "account":
        open_ = ~F.col("_own") & (F.col("state") == "ambiguous")
        at_time = attribution.at_request(told.filter(open_), of(evidence, "session"), roots)
        told = told.filter(~open_).unionByName(at_time.drop("confidence"))
    told = told.withColumn("value", F.when(F.col("state") == "attributed", F.col("value")))
    partial = told.groupBy("state", "value").agg(*measures.usage_measures())
    if by == "account" and roots is not None:
        partial = partial.join(roots.select(F.col("node").alias("value"), "root"), "value", "left").withColumn("value", F.coalesce("root", "value")).drop("root")
    return partial.groupBy("state", F.col("value").alias("key")).agg(*measures.merged_measures())


def _shares(rows: DataFrame, total: DataFrame) -> DataFrame:
    """Attributed, ambiguous and unattributed share of requests; null without requests."""
    counted = rows.agg(*[F.coalesce(F.sum(F.when(F.col("state") == s, F.col("requests"))), F.lit(0)).alias(s) for s in ("attributed", "ambiguous", "unattributed")])
    both = counted.crossJoin(total.select("requests"))  # one row on either side
    return both.select(*[F.when(F.col("requests") > 0, F.col(s) / F.col("requests")).alias(s) for s in ("attributed", "ambiguous", "unattributed")])


def ordered(rows: DataFrame, by: str) -> DataFrame:
    """Days in order, the unknown one last; else by state, most requests first, then by label."""
    if by == "day":
        return rows.orderBy(F.col("key").isNull(), "key")
    rank = F.when(F.col("state") == "ambiguous", 1).when(F.col("state") == "unattributed", 2).otherwise(0)
    return rows.orderBy(rank, F.desc("requests"), "label")
