"""Session logs: a header, messages with usage, and side calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import iso_ms, keyed_hash
from meterlake.operators.sequences import login_switches
from meterlake.sources.transcript import int_at, text_at

#: A line is parsed only if it holds one of these.
MUST_HOLD = ('"session"', '"message"', '"model_usage"')
_TOKENS = {"uncached_input_tokens": "input", "cache_read_input_tokens": "cacheRead", "cache_write_input_tokens": "cacheWrite", "output_tokens": "output", "reasoning_output_tokens": "reasoningTokens"}


def headers(rows: DataFrame, harness: str) -> DataFrame:
    """Sessions with their parents: a header names its parent by the parent's file, whose own header has
    the parent's id."""
    d = rows.filter(text_at("$.type") == "session").select("file", "line", text_at("$.id").alias("session_id"), text_at("$.cwd").alias("cwd"), text_at("$.parentSession").alias("_parent"), iso_ms(text_at("$.timestamp"), "UTC").alias("started_at"))
    own = d.filter("session_id IS NOT NULL").groupBy("file").agg(F.min_by(F.struct("session_id", "cwd", "_parent", "started_at"), "line").alias("h")).select("file", "h.*")
    parents = own.select(F.regexp_replace("file", "^file:(//)?", "").alias("_parent"), F.col("session_id").alias("_parent_id"))
    out = own.join(parents, "_parent", "left")
    return out.select("file", F.concat_ws(":", F.lit(harness), "session_id").alias("session_key"), F.lit(harness).alias("harness"), "session_id",
                      F.when(F.col("_parent_id").isNotNull(), F.concat_ws(":", F.lit(harness), "_parent_id")).alias("parent_session_key"), "started_at", F.lit(None).cast("long").alias("last_seen_at"), "cwd")


def _mapped(provider: Column, names: dict[str, str]) -> Column:
    out = provider
    for name, plain in names.items():
        out = F.when(provider == name, plain).otherwise(out)
    return out


def observations(rows: DataFrame, source: str, harness: str, providers: dict[str, str] | None = None, zone: str = "UTC") -> DataFrame:
    """Requests of assistant messages, and side calls as auxiliary requests under ``aux:`` keys."""
    def tokens(at: str) -> list[Column]:
        return [int_at(f"{at}.{name}").alias(column) for column, name in _TOKENS.items()]

    def native(at: str) -> Column:
        keys = ["input", "output", "cacheRead", "cacheWrite", "totalTokens", "reasoningTokens", *(f"cost.{k}" for k in ("input", "output", "cacheRead", "cacheWrite", "total"))]
        return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.try_variant_get("v", f"{at}.{k}", "double") for k in keys])), lambda k, v: v.isNotNull())

    written = iso_ms(text_at("$.timestamp"), zone)
    kind = text_at("$.type")
    messages = rows.filter((kind == "message") & (text_at("$.message.role") == "assistant") & F.try_variant_get("v", "$.message.usage", "variant").isNotNull()).select(
        "file", "line", text_at("$.id").alias("_id"), F.coalesce(int_at("$.message.timestamp"), written).alias("observed_at"), text_at("$.message.provider").alias("provider"),
        text_at("$.message.model").alias("model"), *tokens("$.message.usage"), native("$.message.usage").alias("native"), F.lit(False).alias("auxiliary"))
    calls = rows.filter((kind == "model_usage") & F.try_variant_get("v", "$.usage", "variant").isNotNull()).select(
        "file", "line", text_at("$.id").alias("_id"), written.alias("observed_at"), text_at("$.provider").alias("provider"), text_at("$.model").alias("model"),
        *tokens("$.usage"), native("$.usage").alias("native"), F.lit(True).alias("auxiliary"))
    both = messages.unionByName(calls).filter("_id IS NOT NULL AND observed_at IS NOT NULL")
    both = both.join(headers(rows, harness).select("file", "session_key"), "file", "left")
    key = F.when(F.col("auxiliary"), F.concat(F.lit("aux:"), F.col("_id"))).otherwise(F.col("_id"))
    return both.select(F.lit(source).alias("source"), F.coalesce("session_key", F.substring(F.sha2("file", 256), 1, 16)).alias("stream_key"), key.alias("source_request_key"),
                       F.lit(None).cast("string").alias("provider_request_key"), F.lit("authoritative").alias("confidence"), "observed_at", F.lit(harness).alias("harness"),
                       _mapped(F.col("provider"), providers or {}).alias("provider"), "model", "session_key", *_TOKENS, "native", "auxiliary")


def account_evidence(rows: DataFrame, harness: str, credentials: DataFrame, secret: bytes) -> DataFrame:
    """Account evidence at each login switch. ``credentials`` (id, provider, identity_key) is the whole
    lookup: other columns are never read. Only mapped credentials count."""
    known = credentials.select(F.col("id").alias("credential_id"), "provider", "identity_key").filter("identity_key IS NOT NULL")
    known = known.select("credential_id", F.concat(F.lit("alias:"), F.col("provider"), F.lit(":login:"), keyed_hash(secret, "alias:login", F.col("identity_key"))).alias("account"))
    used = rows.filter(text_at("$.type") == "message").select("file", "line", int_at("$.message.credentialId").alias("credential_id"), F.coalesce(int_at("$.message.timestamp"), iso_ms(text_at("$.timestamp"), "UTC")).alias("observed_at"))
    used = used.filter("credential_id IS NOT NULL AND observed_at IS NOT NULL").join(headers(rows, harness).select("file", "session_key"), "file")
    return login_switches(used, known, ["session_key"], ["observed_at", "file", "line"])
