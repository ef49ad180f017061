"""Time-valid, confidence-ranked evidence resolved to attributed, ambiguous or unattributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scalars import confidence_rank
from meterlake.operators.sequences import running_sums, united
from meterlake.schemas import CONFIDENCE

#: Live evidence still counts so long after its last confirmation.
LIVE_GRACE_MS = 120_000
#: Behind every time.
_EVER = 2**62
_SUBJECT = ["subject_kind", "subject_id", "dimension"]


def evidence_windows(evidence: DataFrame) -> DataFrame:
    """Close evidence in arrival order.

    The same subject, dimension, method, value and start again only confirms a row. New evidence closes
    the open rows of the same subject, dimension and method with another value, at its own start or,
    if that is unbounded (0), when it was first observed. A closed row stays closed. ``evidence_id`` is
    the arrival number.
    """
    series = [*_SUBJECT, "method"]
    other = [c for c in evidence.columns if c not in (*series, "value", "valid_from", "last_confirmed_at", "arrival_seq")]
    rows = evidence.groupBy(*series, "value", "valid_from").agg(
        F.min_by(F.struct(*other), "arrival_seq").alias("_first"), F.min("arrival_seq").alias("evidence_id"), F.max("last_confirmed_at").alias("last_confirmed_at"))
    rows = rows.select(*series, "value", "valid_from", *[F.col(f"_first.{c}").alias(c) for c in other], "evidence_id", "last_confirmed_at")
    w = Window.partitionBy(*series).orderBy("evidence_id")
    close_at = F.when(F.col("valid_from") != 0, F.col("valid_from")).otherwise(F.col("first_observed_at"))
    turn = F.when(~F.col("value").eqNullSafe(F.lag("value").over(w)) | F.lag("evidence_id").over(w).isNull(), close_at)
    closed = F.first("_turn", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("_turn", turn).withColumn("valid_to", F.coalesce("valid_to", closed)).drop("_turn")


def valid_at(t: Column, bounds: str = "closed") -> Column:
    """Whether evidence holds at a time; both bounds belong to it, or only the first ("half_open").
    Live evidence also needs the time within its first and last sight."""
    end = (t <= F.col("valid_to")) if bounds == "closed" else (t < F.col("valid_to"))
    live = (F.col("validity") != "live") | t.between(F.col("first_observed_at"), F.col("last_confirmed_at"))
    return live & (t >= F.col("valid_from")) & (F.col("valid_to").isNull() | end)


def _decide(valid: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """For each key the state that the valid rows of highest confidence give. Two small aggregations;
    no set of values is collected."""
    by_rank = valid.withColumn("_rank", confidence_rank(F.col("confidence"))).groupBy(*key, "_rank").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.max("confidence").alias("confidence"),
        F.max_by("evidence_id", F.struct("last_confirmed_at", "evidence_id")).alias("_newest"))
    top = by_rank.groupBy(*key).agg(F.max_by(F.struct("_lo", "_hi", "confidence", "_newest"), "_rank").alias("t"))
    agree = F.col("t._lo") == F.col("t._hi")
    return top.select(*key, F.when(agree, "attributed").otherwise("ambiguous").alias("state"), F.when(agree, F.col("t._lo")).alias("value"),
                      F.col("t.confidence").alias("confidence"), F.when(agree, F.col("t._newest")).alias("evidence_id"))


def resolve(evidence: DataFrame, times: DataFrame, bounds: str = "closed", roots: DataFrame | None = None) -> DataFrame:
    """One row for each subject and dimension with evidence, at the ``subject_time`` of ``times``
    (subject columns and subject_time). Evidence of which none is valid then gives unattributed with a
    note. ``roots`` (node, root) makes account values canonical before they are compared."""
    rows = _canonical(evidence, roots).join(times, _SUBJECT)
    decided = _decide(rows.filter(valid_at(F.col("subject_time"), bounds)), _SUBJECT)
    every = rows.select(*_SUBJECT).distinct().join(decided, _SUBJECT, "left")
    return every.select(*_SUBJECT, F.coalesce("state", F.lit("unattributed")).alias("state"), "value", "confidence", "evidence_id",
                        F.when(F.col("state").isNull(), "no evidence valid at the subject's time").when(F.col("state") == "ambiguous", "several values valid at once").alias("note"))


def _canonical(evidence: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return evidence
    known = roots.select(F.col("node").alias("value"), F.col("root").alias("_root"))
    return evidence.join(known, "value", "left").withColumn("value", F.coalesce("_root", "value")).drop("_root")


def account_at(requests: DataFrame, evidence: DataFrame, key: str = "event_key", stored: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """The account of each request at its own ``observed_at``: ``key, state, value, confidence``.

    ``evidence`` is session evidence of one dimension; live evidence counts from first to last sight
    plus a grace, other evidence within its closed bounds. Sessions without any evidence take the
    ``stored`` effective row (session_key, state, value, confidence) if given.
    """
    asked = requests.select(key, "session_key", "observed_at")
    out = at_request(asked, evidence, roots)
    if stored is not None:
        some = evidence.select(F.col("subject_id").alias("session_key")).distinct().withColumn("_some", F.lit(True))
        own = stored.select("session_key", F.col("state").alias("_s"), F.col("value").alias("_v"), F.col("confidence").alias("_c"))
        out = out.join(some, "session_key", "left").join(own, "session_key", "left")
        for c, s in (("state", "_s"), ("value", "_v"), ("confidence", "_c")):
            out = out.withColumn(c, F.when(F.col("_some").isNull(), F.col(s)).otherwise(F.col(c)))
    return out.select(key, "session_key", F.coalesce("state", F.lit("unattributed")).alias("state"), "value", "confidence")


def at_request(requests: DataFrame, evidence: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``requests`` (with ``session_key, observed_at``) with the ``state, value, confidence`` that the evidence on their session has at
    their time. Evidence without a value says nothing.

    One sweep over requests and the edges of evidence, no join of the two: for each rank of confidence two running
    sums say how many values hold and, as the sum of their hashes, which one if it is only one. A busy
    session is spread over days."""
    columns = [c for c in requests.columns if c not in ("state", "value", "confidence")]
    live = F.col("validity") == "live"
    lo = F.when(live, F.col("first_observed_at")).otherwise(F.col("valid_from"))
    hi = F.when(live, F.col("last_confirmed_at") + LIVE_GRACE_MS).otherwise(F.coalesce("valid_to", F.lit(_EVER - 1)))
    told = _canonical(evidence, roots).filter("value IS NOT NULL AND subject_id IS NOT NULL")
    spans = told.select(F.col("subject_id").alias("session_key"), confidence_rank(F.col("confidence")).alias("_rank"), "value", lo.alias("lo"), (hi + 1).alias("hi")).filter("lo < hi")
    edges = united(spans, ["session_key", "_rank", "value"]).select(
        "session_key", "_rank", F.xxhash64("value").cast("decimal(20,0)").alias("_id"), F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("n")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("n")))).alias("_e"))
    ranks = sorted({0, *CONFIDENCE.values()}, reverse=True)
    counts = {f"_n{r}": F.when(F.col("_rank") == r, F.col("_e.n")).cast("long") for r in ranks} | {f"_s{r}": F.when(F.col("_rank") == r, F.col("_e.n") * F.col("_id")).cast("decimal(20,0)") for r in ranks}
    edges = edges.filter(F.col("_e.at") < _EVER).select("session_key", F.col("_e.at").alias("_at"), *[x.alias(c) for c, x in counts.items()])
    can = F.col("session_key").isNotNull() & F.col("observed_at").isNotNull()
    marks = requests.filter(can).select("session_key", F.col("observed_at").alias("_at"), F.struct(*columns).alias("_row"))
    swept = running_sums(marks.unionByName(edges, allowMissingColumns=True), ["session_key"], "_at", list(counts)).filter("_row IS NOT NULL")
    best = F.coalesce(*[F.when(F.col(f"_n{r}_so_far") > 0, F.struct(F.col(f"_n{r}_so_far").alias("n"), F.col(f"_s{r}_so_far").alias("id"), F.lit({v: k for k, v in CONFIDENCE.items()}.get(r)).cast("string").alias("confidence"))) for r in ranks])
    found = swept.select("_row", best.alias("_best"))
    one = F.when(F.col("_best.n") == 1, F.col("_best.id").cast("long"))
    names = spans.select(F.xxhash64("value").alias("_id"), "value").distinct()
    named = found.withColumn("_id", one).join(names, "_id", "left")
    state = F.when(F.col("_best").isNull(), "unattributed").when(F.col("_best.n") == 1, "attributed").otherwise("ambiguous")
    known = named.select("_row.*", state.alias("state"), "value", F.col("_best.confidence").alias("confidence"))
    none = requests.filter(~can).select(*columns, F.lit("unattributed").alias("state"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("confidence"))
    return known.unionByName(none)


def effective(events: DataFrame, own: DataFrame, session: DataFrame, evidence: DataFrame, dimension: str, key: str = "event_key") -> DataFrame:
    """``key, state, value`` of each event: its own attribution if it has evidence, else its session's."""
    mine = own.filter(F.col("dimension") == dimension).select(F.col("subject_id").alias(key), F.col("state").alias("_os"), F.col("value").alias("_ov"))
    theirs = session.filter(F.col("dimension") == dimension).select(F.col("subject_id").alias("session_key"), F.col("state").alias("_ss"), F.col("value").alias("_sv"))
    has = evidence.filter((F.col("subject_kind") == "usage_event") & (F.col("dimension") == dimension)).select(F.col("subject_id").alias(key)).distinct().withColumn("_has", F.lit(True))
    joined = events.select(F.col(key).cast("string").alias(key), "session_key").join(has, key, "left").join(mine, key, "left").join(theirs, "session_key", "left")
    return joined.select(key, F.when(F.col("_has"), F.coalesce("_os", F.lit("unattributed"))).otherwise(F.coalesce("_ss", F.lit("unattributed"))).alias("state"),
                         F.when(F.col("_has"), F.col("_ov")).otherwise(F.col("_sv")).alias("value"),
                         F.when(F.col("session_key").isNull() & F.col("_has").isNull(), "no-session-id").alias("note"))


def failed_attempts(attempts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unattributed rows, with their reason, of subjects that have no evidence."""
    return attempts.join(evidence.select(*_SUBJECT).distinct(), _SUBJECT, "left_anti").select(
        *_SUBJECT, F.lit("unattributed").alias("state"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("confidence"), F.col("reason").alias("note"))
