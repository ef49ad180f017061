"""Transcript logs: one JSON object a line, requests written several times while they grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.scalars import epoch_ms, iso_ms, keyed_hash, next_wall_clock
from meterlake.operators.sequences import change_points

#: Fixed values of the format.
RATE_LIMIT_WINDOWS = {"five_hour": "session", "seven_day": "weekly"}
SYNTHETIC_MODEL = "<synthetic>"
NOTICE_HIT = r"(?i)\blimit reached\b|\bhit your\b[^·]*\blimit\b"
NOTICE_RESET = r"(?i)\blimit (?:has )?reset\b"
NOTICE_AT = r"(?i)\b(?:at|resets)\s+(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\b"


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Lines of every file below a path whose name fits ``glob``, with file and line order. The order is taken on the
    scan itself, before any shuffle: a file's splits in turn, then the rows of a split."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"),
                      F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"))


def parsed(lines: DataFrame, must_hold: tuple[str, ...] = ()) -> DataFrame:
    """Lines that are JSON objects, as VARIANT ``v``; the others are skipped. ``must_hold``: a line is
    parsed only if it holds one of these strings."""
    rows = lines.filter(F.trim("value") != "")
    if must_hold:
        hit = F.lit(False)
        for text in must_hold:
            hit = hit | F.col("value").contains(text)
        rows = rows.filter(hit)
    # A row generator, so that filters on fields are not moved below the parsing, each with a parsing of its own.
    one = F.explode(F.array(F.try_parse_json("value"))).alias("v")
    return rows.filter(F.col("value").rlike(r"^\s*\{")).select(*[c for c in rows.columns if c != "value"], one).filter("v IS NOT NULL")


def text_at(path: str) -> Column:
    """A JSON string; null for any other type and for the empty string."""
    kind = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    return F.when(kind == "STRING", F.nullif(F.try_variant_get("v", path, "string"), F.lit("")))


def int_at(path: str) -> Column:
    """A JSON integer; null for booleans, fractions and strings."""
    kind = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    return F.when(kind == "BIGINT", F.try_variant_get("v", path, "long"))


def text_of(value: str) -> Column:
    """As ``text_at``, of a VARIANT column that holds the value alone."""
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))


def int_of(value: str) -> Column:
    """As ``int_at``, of a VARIANT column that holds the value alone."""
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "long"))


def with_session(rows: DataFrame) -> DataFrame:
    return rows.withColumn("session_id", text_at("$.sessionId")).filter("session_id IS NOT NULL")


def observations(rows: DataFrame, source: str, harness: str, provider: str, secret: bytes) -> DataFrame:
    """Requests of assistant lines, collapsed: of the snapshots of one request the largest output counts,
    and the session stays the first."""
    d = with_session(rows).filter(text_at("$.type") == "assistant").select(
        "file", "line", F.concat_ws(":", F.lit(harness), "session_id").alias("session_key"), iso_ms(text_at("$.timestamp")).alias("observed_at"),
        text_at("$.message.id").alias("_id"), text_at("$.requestId").alias("_request"), text_at("$.message.model").alias("model"),
        F.schema_of_variant(F.try_variant_get("v", "$.message.usage", "variant")).startswith("OBJECT").alias("_usage"),
        int_at("$.message.usage.input_tokens").alias("uncached_input_tokens"), int_at("$.message.usage.cache_read_input_tokens").alias("cache_read_input_tokens"),
        int_at("$.message.usage.cache_creation_input_tokens").alias("cache_write_input_tokens"), int_at("$.message.usage.output_tokens").alias("output_tokens"),
        int_at("$.message.usage.output_tokens_details.thinking_tokens").alias("reasoning_output_tokens"))
    d = d.filter("observed_at IS NOT NULL AND _id IS NOT NULL AND _usage AND coalesce(model, '') <> '" + SYNTHETIC_MODEL + "'")
    d = d.withColumn("source_request_key", F.concat(F.col("_id"), F.lit("+"), F.coalesce("_request", F.lit(""))))
    ranked = _first_of_largest(d.withColumn("_order", F.struct("file", "line")).drop("_id", "_usage", "file", "line"))
    out = ranked.withColumn("provider_request_key", keyed_hash(secret, f"request:{provider}", F.col("_request"))).drop("_request")
    return out.select(F.lit(source).alias("source"), F.lit(source).alias("stream_key"), "source_request_key", "provider_request_key", F.lit("authoritative").alias("confidence"), "observed_at",
                      F.lit(harness).alias("harness"), F.lit(provider).alias("provider"), "model", "session_key", "uncached_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens",
                      "output_tokens", "reasoning_output_tokens", F.lit(False).alias("auxiliary"))


def _first_of_largest(rows: DataFrame) -> DataFrame:
    """Snapshot collapse over the file order, in one aggregation."""
    value = [c for c in rows.columns if c not in ("source_request_key", "_order", "session_key")]
    best = F.struct((-F.coalesce("output_tokens", F.lit(-1))).alias("o"), "_order")
    out = rows.groupBy("source_request_key").agg(F.min_by(F.struct(*value), best).alias("_v"), F.min_by("session_key", "_order").alias("session_key"))
    return out.select("source_request_key", "session_key", "_v.*")


def limit_events(rows: DataFrame, source: str, zone: str) -> DataFrame:
    """Limit hits of error records, and hits and resets that system notices tell of."""
    d = with_session(rows).withColumn("observed_at", iso_ms(text_at("$.timestamp"))).withColumn("source_key", text_at("$.uuid")).filter("observed_at IS NOT NULL AND source_key IS NOT NULL")
    kind = text_at("$.quotaLimits.rateLimitType")
    window = F.when(kind == "five_hour", RATE_LIMIT_WINDOWS["five_hour"]).when(kind == "seven_day", RATE_LIMIT_WINDOWS["seven_day"])
    errors = d.filter(text_at("$.error") == "rate_limit").select("session_id", "source_key", F.lit("hit").alias("kind"), "observed_at", window.alias("window"), epoch_ms(int_at("$.quotaLimits.resetsAt")).alias("resets_at"))
    told = d.filter((text_at("$.type") == "system") & (text_at("$.subtype") == "informational")).withColumn("_t", text_at("$.content"))
    what = F.when(F.col("_t").rlike(NOTICE_HIT), "hit").when(F.col("_t").rlike(NOTICE_RESET), "reset")
    which = F.when(F.col("_t").rlike(r"(?i)\bsession limit\b"), "session").when(F.col("_t").rlike(r"(?i)\bweekly limit\b"), "weekly")
    part = lambda i: F.regexp_extract("_t", NOTICE_AT, i)
    at = next_wall_clock(part(1).try_cast("int"), F.coalesce(part(2).try_cast("int"), F.lit(0)), part(3), F.col("observed_at"), zone)
    notices = told.withColumn("kind", what).filter("kind IS NOT NULL").select("session_id", "source_key", "kind", "observed_at", which.alias("window"), F.when(F.col("kind") == "hit", at).alias("resets_at"))
    return errors.unionByName(notices).select(F.lit(source).alias("source"), F.col("session_id").alias("stream_key"), "source_key", "kind", F.lit("authoritative").alias("confidence"), "observed_at", "window", "resets_at")


def sessions(rows: DataFrame, harness: str) -> DataFrame:
    """First and last time and last folder of each session, the folder from its own file if it has one."""
    d = with_session(rows).select("session_id", "file", "line", iso_ms(text_at("$.timestamp")).alias("at"), text_at("$.cwd").alias("cwd")).withColumn("_order", F.struct("file", "line"))
    own = F.col("cwd").isNotNull() & F.contains(F.col("file"), F.concat(F.lit("/"), F.col("session_id"), F.lit(".jsonl")))
    out = d.groupBy("session_id").agg(F.min("at").alias("started_at"), F.max("at").alias("last_seen_at"), F.max_by("cwd", F.when(own, F.col("_order"))).alias("_own"), F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("_order"))).alias("_any"))
    return out.select(F.concat_ws(":", F.lit(harness), "session_id").alias("session_key"), F.lit(harness).alias("harness"), "session_id", F.lit(None).cast("string").alias("parent_session_key"), "started_at", "last_seen_at", F.coalesce("_own", "_any").alias("cwd"))


def branch_changes(rows: DataFrame, harness: str) -> DataFrame:
    """Branch evidence: valid from each change of a session's branch."""
    d = with_session(rows).select(F.concat_ws(":", F.lit(harness), "session_id").alias("session_key"), iso_ms(text_at("$.timestamp")).alias("observed_at"), text_at("$.gitBranch").alias("branch"), "file", "line")
    return change_points(d.filter("observed_at IS NOT NULL"), ["session_key"], ["observed_at", "file", "line"], "branch")


def owners(rows: DataFrame, harness: str, provider: str, secret: bytes) -> DataFrame:
    """Owner evidence of bridged sessions: hashed account and organisation, as historical evidence."""
    d = with_session(rows).filter(text_at("$.type") == "bridge-session")
    pair = F.concat_ws("/", text_at("$.ownerAccountUuid"), text_at("$.ownerOrganizationUuid"))
    return d.select(F.concat_ws(":", F.lit(harness), "session_id").alias("session_key"), F.concat(F.lit(f"alias:{provider}:owner:"), keyed_hash(secret, f"alias:{provider}", F.when(text_at("$.ownerAccountUuid").isNotNull(), pair))).alias("value")).filter("value IS NOT NULL").distinct()

