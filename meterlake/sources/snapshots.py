"""Snapshots of quota readings: one JSON object each, newest reading first to count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import epoch_ms, iso_ms, window_of_limit

#: Fixed values of the formats: window and length in seconds of each key.
UTILIZATION_WINDOWS = {"five_hour": ("session", 18_000), "seven_day": ("weekly", 604_800), "seven_day_opus": ("weekly:opus", 604_800), "seven_day_sonnet": ("weekly:sonnet", 604_800),
                       "seven_day_haiku": ("weekly:haiku", 604_800), "seven_day_fable": ("weekly:fable", 604_800)}
STATUSLINE_WINDOWS = {"five_hour": ("session", 18_000), "seven_day": ("weekly", 604_800), "spend_limit": ("other:spend_limit", None)}
REPORT_PREFIX = "usage_cache:report:"
_REPORT = """struct<provider: string, fetchedAt: bigint, metadata: struct<accountId: string, orgId: string>, limits: array<struct<id: string,
    scope: struct<windowId: string, tier: string, modelId: string>, window: struct<id: string, durationMs: bigint, resetsAt: bigint>, amount: struct<usedFraction: double>, status: string>>>"""
_USED = "map<string, struct<utilization: double, resets_at: string>>"


def _columns(source: str) -> list:
    return [F.lit(source).alias("source"), "stream_key", "window", "used_pct", "window_seconds", "resets_at", "status", F.lit("authoritative").alias("confidence"), "observed_at"]


def _literal_windows(known: dict[str, tuple[str, int | None]]):
    return F.create_map(*[x for k, (w, s) in known.items() for x in (F.lit(k), F.struct(F.lit(w).alias("window"), F.lit(s).cast("long").alias("window_seconds")))])


def cached_utilization(files: DataFrame, source: str, last_fetched_ms: int | None = None) -> DataFrame:
    """Readings of a cached utilisation object (columns stream_key, value); windows that are null or
    unknown are dropped, and so are snapshots not newer than the last. ``account`` is set only if the
    snapshot's account is the login's."""
    d = files.select("stream_key", F.from_json("value", f"oauthAccount struct<accountUuid: string, organizationUuid: string>, cachedUsageUtilization struct<fetchedAtMs: bigint, accountUuid: string, utilization: {_USED}>").alias("j"))
    d = d.select("stream_key", F.col("j.cachedUsageUtilization.fetchedAtMs").alias("observed_at"), F.col("j.cachedUsageUtilization.utilization").alias("u"),
                 F.when(F.col("j.oauthAccount.accountUuid") == F.col("j.cachedUsageUtilization.accountUuid"), F.col("j.oauthAccount.accountUuid")).alias("account")).filter("observed_at IS NOT NULL")
    if last_fetched_ms is not None:
        d = d.filter(F.col("observed_at") > last_fetched_ms)
    d = d.select("stream_key", "observed_at", "account", F.explode("u").alias("key", "reading")).withColumn("w", F.try_element_at(_literal_windows(UTILIZATION_WINDOWS), F.col("key")))
    d = d.filter("w IS NOT NULL AND reading IS NOT NULL")
    return d.select("stream_key", "w.*", F.col("reading.utilization").alias("used_pct"), iso_ms(F.col("reading.resets_at")).alias("resets_at"), F.lit("ok").alias("status"), "observed_at", "account").select(*_columns(source), "account")


def statusline(files: DataFrame, source: str, last_seen: DataFrame | None = None) -> DataFrame:
    """Readings of status snapshots (columns file, value), only where a file's time moved on from
    ``last_seen`` (file, observed_at)."""
    used = "struct<used_percentage: double, resets_at: bigint>"
    d = files.select("file", F.from_json("value", f"session_id string, observed_at bigint, rate_limits map<string, {used}>").alias("j")).select("file", "j.*").filter("session_id IS NOT NULL AND observed_at IS NOT NULL")
    if last_seen is not None:
        d = d.join(last_seen.select("file", F.col("observed_at").alias("_last")), "file", "left").filter("_last IS NULL OR observed_at > _last").drop("_last")
    d = d.select(F.col("session_id").alias("stream_key"), "observed_at", F.explode("rate_limits").alias("key", "reading")).withColumn("w", F.try_element_at(_literal_windows(STATUSLINE_WINDOWS), F.col("key")))
    d = d.filter("w IS NOT NULL AND reading IS NOT NULL AND (reading.used_percentage IS NOT NULL OR reading.resets_at IS NOT NULL)")
    return d.select("stream_key", "w.*", F.col("reading.used_percentage").alias("used_pct"), epoch_ms(F.col("reading.resets_at")).alias("resets_at"), F.lit("ok").alias("status"), "observed_at").select(*_columns(source))


def usage_reports(cache: DataFrame, source: str) -> DataFrame:
    """Readings of cached reports (columns key, value): of each key the newest, with or without an
    envelope ``value`` around it."""
    d = cache.filter(F.col("key").startswith(REPORT_PREFIX))
    d = d.select("key", F.coalesce(F.from_json(F.get_json_object("value", "$.value"), _REPORT), F.from_json("value", _REPORT)).alias("r")).filter("r.fetchedAt IS NOT NULL")
    newest = d.groupBy("key").agg(F.max_by("r", F.col("r.fetchedAt")).alias("r"))
    limits = newest.select(F.col("key").alias("stream_key"), F.col("r.fetchedAt").alias("observed_at"), F.explode("r.limits").alias("l"))
    window = window_of_limit(F.col("l.window.durationMs"), F.coalesce("l.window.id", "l.scope.windowId"), F.coalesce("l.scope.modelId", "l.scope.tier"))
    out = limits.select("stream_key", "observed_at", window.alias("window"), (F.col("l.amount.usedFraction") * 100).alias("used_pct"), F.expr("l.window.durationMs div 1000").alias("window_seconds"),
                        epoch_ms(F.col("l.window.resetsAt")).alias("resets_at"), F.coalesce("l.status", F.lit("ok")).alias("status"))
    return out.select(*_columns(source))
