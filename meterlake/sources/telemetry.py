"""Telemetry events as secondary observations: they support counted requests and never count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import keyed_hash

#: Attribute of each token field; the first that is there counts.
TOKEN_ATTRIBUTES = {
    "uncached_input_tokens": ("input_tokens", "gen_ai.usage.input_tokens"), "cache_read_input_tokens": ("cache_read_tokens", "gen_ai.usage.cache_read_input_tokens"),
    "cache_write_input_tokens": ("cache_creation_tokens", "gen_ai.usage.cache_creation_input_tokens"), "output_tokens": ("output_tokens", "gen_ai.usage.output_tokens"),
    "reasoning_output_tokens": ("reasoning_tokens", "gen_ai.usage.reasoning_tokens")}


def observations(events: DataFrame, source: str, provider: str, secret: bytes) -> DataFrame:
    """Secondary observations of request events and spans (columns event_id, name, observed_at,
    attributes map<string,string>). Rows without a request id, and aggregate token metrics, give none."""
    at = lambda *names: F.coalesce(*[F.try_element_at("attributes", F.lit(n)) for n in names])
    rows = events.filter("kind <> 'metric'").withColumn("_request", at("request_id", "gen_ai.response.id")).filter("coalesce(_request, '') <> ''")
    return rows.select(F.lit(source).alias("source"), F.lit(source).alias("stream_key"), F.col("event_id").cast("string").alias("source_request_key"),
                       keyed_hash(secret, f"request:{provider}", F.col("_request")).alias("provider_request_key"), F.lit("observed").alias("confidence"), "observed_at",
                       at("model", "gen_ai.request.model").alias("model"), *[at(*names).try_cast("long").alias(c) for c, names in TOKEN_ATTRIBUTES.items()], F.lit(False).alias("primary"))
