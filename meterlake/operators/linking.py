"""Primary observations count; secondary ones only support them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.schemas import TOKEN_FIELDS


def usage_events(observations: DataFrame) -> DataFrame:
    """One event for each primary observation, under a key made of its identity."""
    identity = F.sha2(F.concat_ws("\x1f", "source", "stream_key", "source_request_key"), 256)
    return observations.filter("primary").withColumn("event_key", identity)


def refreshed_events(stored: DataFrame, recomputed: DataFrame, key: str = "event_key") -> DataFrame:
    """Recomputed events; time and session stay as they were when the event was first seen."""
    frozen = stored.select(key, F.col("observed_at").alias("_at"), F.col("session_key").alias("_session"), F.lit(True).alias("_old"))
    out = recomputed.join(frozen, key, "left")
    return out.withColumn("observed_at", F.when(F.col("_old"), F.col("_at")).otherwise(F.col("observed_at"))).withColumn(
        "session_key", F.when(F.col("_old"), F.col("_session")).otherwise(F.col("session_key"))).drop("_at", "_session", "_old")


def link_secondary(observations: DataFrame, key: str = "observation_id", existing: DataFrame | None = None) -> DataFrame:
    """``key, event_key`` of each secondary observation whose request key a primary one of another
    source shares: the least event. Existing links (key, event_key) never move."""
    first = observations.filter("primary AND provider_request_key IS NOT NULL").groupBy("provider_request_key", "source").agg(F.min("event_key").alias("event_key"))
    targets = first.select("provider_request_key", F.col("source").alias("_source"), "event_key")
    second = observations.filter("NOT primary AND provider_request_key IS NOT NULL")
    if existing is not None:
        second = second.join(existing.select(key), key, "left_anti")
    links = second.select(key, "source", "provider_request_key").join(targets, "provider_request_key").filter("source <> _source").groupBy(key).agg(F.min("event_key").alias("event_key"))
    return links if existing is None else existing.select(key, "event_key").unionByName(links)


def disagreement(observations: DataFrame, links: DataFrame, key: str = "observation_id") -> DataFrame:
    """``event_key`` and, for each token field, the largest difference between the counted observation
    and those that support it; a null on either side says nothing. Null where nothing differs, and no
    row where no field does."""
    counted = observations.filter("primary").select("event_key", *[F.col(c).alias(f"_{c}") for c in TOKEN_FIELDS])
    support = observations.filter("NOT primary").select(key, *TOKEN_FIELDS).join(links, key)
    found = support.join(counted, "event_key").groupBy("event_key").agg(*[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(c) for c in TOKEN_FIELDS])
    found = found.select("event_key", *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in TOKEN_FIELDS])
    return found.filter(F.coalesce(*TOKEN_FIELDS).isNotNull())


def orphan_counts(observations: DataFrame, links: DataFrame, key: str = "observation_id") -> DataFrame:
    """Secondary observations without a link, by source; sources with none are absent."""
    return observations.filter("NOT primary").join(links.select(key), key, "left_anti").groupBy("source").agg(F.count("*").alias("orphans"))


def link_state(observations: DataFrame, links: DataFrame, key: str = "observation_id") -> DataFrame:
    """``primary``, ``linked`` or ``orphan`` of every observation."""
    out = observations.join(links.select(key, F.col("event_key").alias("_linked")), key, "left")
    return out.select(key, F.when(F.col("primary"), "primary").when(F.col("_linked").isNotNull(), "linked").otherwise("orphan").alias("link_state"))


def metadata_links(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each event and non-token field the observation that supplies it (the first), and the
    candidates of another source, which are refused."""
    chosen = candidates.groupBy("event_key", "field").agg(F.min_by(F.struct("source", "observation_id"), F.struct("seq", "observation_id")).alias("c")).select("event_key", "field", "c.source", "c.observation_id")
    refused = candidates.join(chosen.select("event_key", "field", F.col("source").alias("_kept")), ["event_key", "field"]).filter("source <> _kept").drop("_kept")
    return chosen, refused


def below_version(events: DataFrame, version: int) -> DataFrame:
    """Events that an older rule made: to be recomputed under their own keys."""
    return events.filter(F.coalesce(F.col("rule_version"), F.lit(0)) < version)


def disagreement_by_pair(observations: DataFrame, links: DataFrame, key: str = "observation_id") -> DataFrame:
    """For each pair of counted and supporting source the links, and those that differ in output."""
    counted = observations.filter("primary").select("event_key", F.col("source").alias("counted_source"), F.col("output_tokens").alias("_output"))
    support = observations.filter("NOT primary").select(key, F.col("source").alias("supporting_source"), "output_tokens").join(links, key)
    return support.join(counted, "event_key").groupBy("counted_source", "supporting_source").agg(
        F.count("*").alias("links"), F.count_if(F.col("output_tokens") != F.col("_output")).alias("differing"))


def coverage_gaps(observations: DataFrame) -> DataFrame:
    """Request keys that only secondary sources saw."""
    seen = observations.filter("primary AND provider_request_key IS NOT NULL").select("provider_request_key").distinct()
    return observations.filter("NOT primary AND provider_request_key IS NOT NULL").join(seen, "provider_request_key", "left_anti").groupBy("source").agg(F.countDistinct("provider_request_key").alias("uncovered"))
