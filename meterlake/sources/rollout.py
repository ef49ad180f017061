"""Rollout logs: cumulative counters of a session, one file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scalars import epoch_ms, iso_ms, window_by_seconds
from meterlake.operators.counting import carry_forward, counter_delta, emit_on_change
from meterlake.operators.sequences import change_points
from meterlake.sources.transcript import int_at, int_of, text_at, text_of

#: A line is parsed only if it holds one of these; the most frequent is looked for first.
MUST_HOLD = ("token_count", "turn_context", "session_meta")
_COUNTERS = ["input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
#: What a line is read for, taken in one pass. Values keep their own type, but for the two types, which are only compared
#: with words that no number, object or array reads as.
_FIELDS = f"struct<type: string, timestamp: variant, payload: struct<type: string, id: variant, model: variant, info: struct<total_token_usage: struct<{', '.join(f'{c}: variant' for c in _COUNTERS)}>>>>"


def _typed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("type", text_at("$.type")).withColumn("at", iso_ms(text_at("$.timestamp"), "utc"))


def _own_session(session_id: str) -> Column:
    """The session of a line's file, from the headers' sessions: that of the first header."""
    whole = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(session_id, ignorenulls=True).over(whole)


def session_headers(rows: DataFrame, harness: str) -> DataFrame:
    """The session of each file: that of its first header. Later headers are copies of a parent's."""
    d = _typed(rows).filter("type = 'session_meta'").select("file", "line", text_at("$.payload.id").alias("session_id"), text_at("$.payload.forked_from_id").alias("parent_id"),
        text_at("$.payload.cwd").alias("cwd"), text_at("$.payload.git.branch").alias("branch"), iso_ms(text_at("$.payload.timestamp"), "utc").alias("started_at")).filter("session_id IS NOT NULL")
    one = d.groupBy("file").agg(F.min_by(F.struct("session_id", "parent_id", "cwd", "branch", "started_at"), "line").alias("h")).select("file", "h.*")
    return one.withColumn("session_key", F.concat_ws(":", F.lit(harness), "session_id")).withColumn("parent_session_key", F.when(F.col("parent_id").isNotNull(), F.concat_ws(":", F.lit(harness), "parent_id")))


def observations(rows: DataFrame, source: str, harness: str, provider: str) -> DataFrame:
    """Requests as differences of the counters, with the model that was current. A file without a
    header has no session, and its stream is a digest of its path."""
    d = rows.select("file", "line", F.try_variant_get("v", "$", _FIELDS).alias("r"))
    d = d.select("file", "line", "r.type", text_of("r.timestamp").alias("at"), "r.payload")
    told = d.select("file", "line", "type", iso_ms(F.col("at"), "utc").alias("at"), F.when(F.col("type") == "turn_context", text_of("payload.model")).alias("model"), F.col("payload.type").alias("_kind"),
                    F.when(F.col("type") == "session_meta", text_of("payload.id")).alias("_id"), *[int_of(f"payload.info.total_token_usage.{c}").alias(c) for c in _COUNTERS])
    told = carry_forward(told.withColumn("_own", _own_session("_id")).drop("_id"), "file", "line", "model")
    counted = told.filter("type = 'event_msg' AND _kind = 'token_count' AND at IS NOT NULL AND total_tokens IS NOT NULL")
    counted = counted.withColumn("total", F.col("total_tokens")).withColumn("_write", F.coalesce("cache_write_input_tokens", F.lit(0).cast("long"))).drop("cache_write_input_tokens")
    deltas = counter_delta(counted.drop("total_tokens").withColumn("_key", F.col("total")), "file", "line", ["input_tokens", "cached_input_tokens", "_write", "output_tokens", "reasoning_output_tokens"], "total")
    out = deltas.withColumn("session_key", F.when(F.col("_own").isNotNull(), F.concat_ws(":", F.lit(harness), "_own")))
    return out.select(F.lit(source).alias("source"), F.coalesce("session_key", F.substring(F.sha2("file", 256), 1, 16)).alias("stream_key"), F.concat_ws("|", "at", "_key").alias("source_request_key"),
                      F.lit(None).cast("string").alias("provider_request_key"), F.lit("authoritative").alias("confidence"), F.col("at").alias("observed_at"), F.lit(harness).alias("harness"),
                      F.lit(provider).alias("provider"), "model", "session_key", (F.col("input_tokens") - F.col("cached_input_tokens")).alias("uncached_input_tokens"),
                      F.col("cached_input_tokens").alias("cache_read_input_tokens"), F.col("_write").alias("cache_write_input_tokens"), "output_tokens", "reasoning_output_tokens",
                      F.lit(False).alias("auxiliary"))


def capacity(rows: DataFrame, source: str) -> DataFrame:
    """Quota readings, where one differs from the window's reading before it; the slots of a line in turn."""
    d = _typed(rows).filter("at IS NOT NULL").select("file", "line", "at", F.explode(F.array(*[
        F.struct(F.lit(i).alias("slot"), F.try_variant_get("v", f"$.payload.rate_limits.{name}.used_percent", "double").alias("used_pct"),
                 (int_at(f"$.payload.rate_limits.{name}.window_minutes") * 60).alias("window_seconds"), epoch_ms(int_at(f"$.payload.rate_limits.{name}.resets_at")).alias("resets_at"))
        for i, name in enumerate(("primary", "secondary"))])).alias("r")).select("file", "line", "at", "r.*").filter("window_seconds IS NOT NULL")
    named = d.withColumn("window", window_by_seconds(F.col("window_seconds")))
    changed = emit_on_change(named, ["file", "window"], ["line", "slot"], ["used_pct", "resets_at", "window_seconds"])
    return changed.select(F.lit(source).alias("source"), F.substring(F.sha2("file", 256), 1, 16).alias("stream_key"), "window", "used_pct", "window_seconds", "resets_at",
                          F.lit("ok").alias("status"), F.lit("authoritative").alias("confidence"), F.col("at").alias("observed_at"))


def branches(rows: DataFrame, harness: str) -> DataFrame:
    """Branch evidence of a file's own session; the first branch holds from ever."""
    d = _typed(rows).filter("type = 'session_meta'").select("file", "line", F.col("at").alias("observed_at"), text_at("$.payload.id").alias("_id"), text_at("$.payload.git.branch").alias("branch"))
    own = d.withColumn("_own", _own_session("_id")).filter("_id = _own AND observed_at IS NOT NULL").withColumn("session_key", F.concat_ws(":", F.lit(harness), "_own"))
    return change_points(own, ["session_key"], ["observed_at", "file", "line"], "branch", first_from_zero=True)
