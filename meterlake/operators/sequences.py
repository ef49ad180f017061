"""Ordered sequences: change points, stalls, and windows that grow while sightings go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_points(rows: DataFrame, series: list[str], order: list[str], value: str, first_from_zero: bool = False, at: str = "observed_at") -> DataFrame:
    """Rows at which a series' known value changes, valid from then; the first of a series may be
    valid from ever (0)."""
    w = Window.partitionBy(*series).orderBy(*order)
    known = rows.filter(F.col(value).isNotNull()).withColumn("_before", F.lag(value).over(w))
    start = F.when(F.col("_before").isNull() & F.lit(first_from_zero), F.lit(0).cast("long")).otherwise(F.col(at))
    return known.filter(F.col("_before").isNull() | (F.col("_before") != F.col(value))).select(*series, value, start.alias("valid_from"))


def login_switches(rows: DataFrame, lookup: DataFrame, series: list[str], order: list[str], key: str = "credential_id") -> DataFrame:
    """Where a session's login changes; credentials that the lookup (key, account) does not map are
    passed over."""
    return change_points(rows.join(lookup, key), series, order, "account")


def stalls(samples: DataFrame, pane: list[str] | None = None, pass_no: str | None = None) -> DataFrame:
    """Stalls of each pane: ``pane, onset, last_seen, error_key, pane_pid, resets_at, samples``.

    Samples of an unknown or unread (null) state neither begin nor end a stall. A new error key or
    process begins a new one; any other state ends it, and so does a pass (``pass_no``, counted without
    gaps) that has no sample of the pane, unlike one whose reading failed. The provider's own wait
    counts from the onset unless the screen states a time.
    """
    pane = pane or ["pane"]
    w = Window.partitionBy(*pane).orderBy("observed_at", "seq")
    gone = F.coalesce(F.col(pass_no) - F.lag(pass_no).over(w) > 1, F.lit(False)) if pass_no else F.lit(False)
    seen = samples.withColumn("_gone", gone.cast("int")).withColumn("_presence", F.sum("_gone").over(w))
    told = seen.filter("state IS NOT NULL AND state <> 'unknown'")
    same = F.struct("state", "error_key", "pane_pid", "_presence")
    told = told.withColumn("_before", F.lag(F.struct(same.alias("v"))).over(w))
    told = told.withColumn("_island", F.sum(F.when(F.col("_before").isNull() | ~same.eqNullSafe(F.col("_before.v")), 1).otherwise(0)).over(w))
    return told.filter("state = 'stalled'").groupBy(*pane, "_island").agg(
        F.min("observed_at").alias("onset"), F.max("observed_at").alias("last_seen"), F.first("error_key").alias("error_key"), F.first("pane_pid").alias("pane_pid"),
        F.min_by("reset_hint", F.struct("observed_at", "seq")).alias("_hint"), F.min_by("retry_after_ms", F.struct("observed_at", "seq")).alias("_wait"), F.count("*").alias("samples"),
    ).select(*pane, "onset", "last_seen", "error_key", "pane_pid", F.coalesce(F.col("_hint"), F.col("onset") + F.col("_wait")).alias("resets_at"), "samples")


def sighting_windows(sightings: DataFrame, key: list[str], pass_no: str = "pass_no", at: str = "observed_at") -> DataFrame:
    """Windows over consecutive passes in which a pair was seen: a pass without it starts anew."""
    once = sightings.groupBy(*key, pass_no).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    island = F.col(pass_no) - F.row_number().over(Window.partitionBy(*key).orderBy(pass_no))
    return once.withColumn("_island", island).groupBy(*key, "_island").agg(
        F.min("_lo").alias("first_observed_at"), F.max("_hi").alias("last_confirmed_at"), F.count("*").alias("passes")).drop("_island")


def live_pairings(sightings: DataFrame, weak_method: str = "open_session_file") -> DataFrame:
    """Pairing evidence of each pass: a pane paired by a surer method keeps no weak pairing, and a weak
    pairing counts only where it is the only one of its pane."""
    sure = sightings.filter(F.col("method") != weak_method)
    weak = sightings.filter(F.col("method") == weak_method).join(sure.select("pane", "pass_no").distinct(), ["pane", "pass_no"], "left_anti")
    single = weak.groupBy("pane", "pass_no").agg(F.countDistinct("session_key").alias("n")).filter("n = 1").drop("n")
    return sighting_windows(sure.unionByName(weak.join(single, ["pane", "pass_no"])), ["session_key", "pane", "method"])


def peak_concurrency(intervals: DataFrame, group: list[str], start: str, end: str, bucket: int = 3_600_000) -> DataFrame:
    """The most intervals of a group that hold at once, and when that was first so. Starts count before
    ends at the same time, as both bounds belong to an interval.

    Starts and ends are summed for each time, then for each ``bucket`` of time; what holds when a bucket
    begins is a running sum over buckets, so the times of one bucket are all that one task orders.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    steps = intervals.select(*group, F.col(start).alias("at"), one.alias("_in"), none.alias("_out")).unionByName(intervals.select(*group, F.col(end).alias("at"), none.alias("_in"), one.alias("_out")))
    times = steps.groupBy(*group, "at").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out")).withColumn("_bucket", F.floor(F.col("at") / bucket))
    net, before = F.col("_in") - F.col("_out"), Window.unboundedPreceding
    held = times.groupBy(*group, "_bucket").agg(F.sum(net).alias("_net")).withColumn("_held", F.sum("_net").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(before, -1)))
    inside = F.sum(net).over(Window.partitionBy(*group, "_bucket").orderBy("at").rowsBetween(before, -1))
    joined = times.withColumn("_since", inside).alias("t").join(held.alias("h"), [F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*group, "_bucket"]])
    n = F.coalesce("h._held", none) + F.coalesce("t._since", none) + F.col("t._in")
    return joined.select(*[F.col(f"t.{c}") for c in [*group, "at"]], n.alias("n")).groupBy(*group).agg(F.max("n").alias("peak"), F.min_by("at", F.struct(-F.col("n"), "at")).alias("at"))


def running_sums(rows: DataFrame, key: list[str], at: str, values: list[str], bucket_ms: int = 86_400_000) -> DataFrame:
    """``rows`` with ``<value>_so_far`` for each of ``values``: its sum over all rows of the key up to and at their time.

    Sums of whole buckets of time run over buckets; rows are ordered inside their bucket only, so a busy key
    is spread over its buckets. Rows without a time are left out; key columns must not be null."""
    n = {v: F.coalesce(F.col(v), F.lit(0)) for v in values}
    slotted = rows.filter(F.col(at).isNotNull()).withColumn("_slot", F.floor(F.col(at) / bucket_ms))
    sums = slotted.groupBy(*key, "_slot").agg(*[F.sum(x).alias(f"_{v}_sum") for v, x in n.items()])
    earlier = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*key, "_slot", *[F.sum(f"_{v}_sum").over(earlier).alias(f"_{v}_before") for v in values])
    inside = slotted.select("*", *[F.sum(x).over(Window.partitionBy(*key, "_slot").orderBy(at)).alias(f"_{v}_inside") for v, x in n.items()])
    joined = inside.join(before, [*key, "_slot"])
    return joined.select(*rows.columns, *[(F.col(f"_{v}_inside") + F.coalesce(f"_{v}_before", F.lit(0))).alias(f"{v}_so_far") for v in values])


def united(intervals: DataFrame, group: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The disjoint intervals that a group's intervals cover together; touching ones become one."""
    w = Window.partitionBy(*group).orderBy(lo, hi)
    reached = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(reached.isNull() | (F.col(lo) > reached), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def login_evidence(sightings: DataFrame, logins: DataFrame, series: str = "state_file", method: str = "state_file", source: str = "login") -> DataFrame:
    """Live, inferred account evidence of live sessions from the login that their machine shows.

    ``sightings`` (series, session_key, observed_at) are live sessions in each pass, ``logins`` (series,
    observed_at, account) what the state file held. A sighting takes the newest login at or before its
    time; without one, or where no account was logged in, it gives nothing. Evidence is valid from when
    this login was first seen for the session, and stays so while it is unchanged.
    """
    marks = logins.select(series, "observed_at", F.struct("account").alias("_login"), F.lit(None).cast("string").alias("session_key")).unionByName(
        sightings.filter("session_key IS NOT NULL").select(series, "observed_at", F.lit(None).cast("struct<account: string>").alias("_login"), "session_key"))
    w = Window.partitionBy(series).orderBy("observed_at", F.col("session_key").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    told = marks.withColumn("value", F.last("_login", ignorenulls=True).over(w)["account"]).filter("session_key IS NOT NULL AND value IS NOT NULL")
    own = Window.partitionBy("session_key").orderBy("observed_at", "value")
    turned = told.withColumn("_before", F.lag("value").over(own)).withColumn("_run", F.sum(F.when(F.col("_before").isNull() | (F.col("_before") != F.col("value")), 1).otherwise(0)).over(own))
    runs = turned.groupBy("session_key", "_run", "value").agg(F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_confirmed_at"))
    return runs.select(
        F.lit("session").alias("subject_kind"), F.col("session_key").alias("subject_id"), F.lit("account").alias("dimension"), "value", F.lit(method).alias("method"), F.lit(source).alias("source"),
        F.lit("inferred").alias("confidence"), F.lit("live").alias("validity"), F.col("first_observed_at").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), "first_observed_at", "last_confirmed_at")


def latest(rows: DataFrame, key: list[str], order: list[str | Column], value: list[str]) -> DataFrame:
    """The newest row of each key, by one aggregation."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in value])
