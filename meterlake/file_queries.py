"""Logs written as files and read back as files, with the SQL that states the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake import bindings as b
from meterlake.lineage import shared_dir
from meterlake.registry import query
from meterlake.sources import reader

_SECRET = b"0123456789abcdef"


def _at(turn) -> object:
    return F.concat(F.lit("2026-09-01T00:00:"), F.lpad((turn % 60).cast("string"), 2, "0"), F.lit("Z"))


def _logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as logs: even ones as transcripts, whose requests are written at several turns, odd ones as session logs
    with a header and side calls. Some lines are no JSON."""
    c = b.table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND role = 'assistant'")
    turn, output = F.col("turn"), F.length("text") % 1000
    told = F.struct(F.col("conv_id").alias("input_tokens"), output.alias("output_tokens"))
    message = F.struct(F.concat_ws("-", "conv_id", F.expr("turn div 4")).alias("id"), F.lit("m").alias("model"), told.alias("usage"), F.col("text").alias("content"))
    grown = F.to_json(F.struct(F.lit("assistant").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), _at(turn).alias("timestamp"), message.alias("message")))
    transcripts = c.filter("conv_id % 2 = 0").select(grown.alias("value"), F.col("conv_id").cast("string").alias("file"), turn.alias("line"))
    usage = F.struct(output.alias("output"), F.when(turn % 2 == 0, turn).alias("cacheRead"), F.struct((output / 8).alias("total")).alias("cost"))
    own, provider = F.concat_ws("-", "conv_id", "turn"), F.when(F.col("conv_id") % 3 == 0, "acme-code").otherwise("other")
    reply = F.struct(F.lit("message").alias("type"), own.alias("id"), _at(turn).alias("timestamp"), F.struct(F.lit("assistant").alias("role"), F.lit("m").alias("model"), provider.alias("provider"), usage.alias("usage"), F.col("text").alias("content")).alias("message"))
    call = F.struct(F.lit("model_usage").alias("type"), own.alias("id"), _at(turn).alias("timestamp"), F.lit("m").alias("model"), provider.alias("provider"), usage.alias("usage"))
    odd = c.filter("conv_id % 2 = 1")
    body = odd.select(F.when(turn % 3 == 0, F.to_json(call)).otherwise(F.to_json(reply)).alias("value"), F.col("conv_id").cast("string").alias("file"), (turn + 1).alias("line"))
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("c"), "conv_id").alias("id")))
    heads = odd.select("conv_id").distinct().select(head.alias("value"), F.col("conv_id").cast("string").alias("file"), F.lit(0).cast("long").alias("line"))
    torn = heads.select(F.lit('{"type": "session", "id"').alias("value"), "file", F.lit(-1).cast("long").alias("line"))
    return transcripts, body.unionByName(heads).unionByName(torn)


@query("""WITH c AS (SELECT *, length(text) % 1000 AS output FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
    SELECT 'transcripts' AS source, conv_id || '-' || (turn // 4) || '+' AS source_request_key, 'h:c' || conv_id AS session_key, false AS auxiliary, 'p' AS provider, max(output)::BIGINT AS output_tokens, NULL::BIGINT AS cache_read_input_tokens,
           1788220800000 + arg_min(turn % 60, (-output, turn)) * 1000 AS observed_at, NULL::DOUBLE AS native_output, NULL::DOUBLE AS native_cost, true AS "primary" FROM c WHERE conv_id % 2 = 0 GROUP BY conv_id, turn // 4
    UNION ALL SELECT 'sessions', CASE WHEN turn % 3 = 0 THEN 'aux:' ELSE '' END || conv_id || '-' || turn, 'h2:c' || conv_id, turn % 3 = 0, CASE WHEN conv_id % 3 = 0 THEN 'acme' ELSE 'other' END, output::BIGINT,
           CASE WHEN turn % 2 = 0 THEN turn::BIGINT END, 1788220800000 + (turn % 60) * 1000, output::DOUBLE, output / 8.0, false FROM c WHERE conv_id % 2 = 1""")
def collect_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of logs as files in the shared folder, read by their readers as one table."""
    folder = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    transcripts, sessions = _logs(spark, sf_dir)
    reader.written_lines(transcripts, f"{folder}/transcripts")
    reader.written_lines(sessions, f"{folder}/sessions")
    found = reader.collect([
        (reader.Transcripts("transcripts", "h", "p", _SECRET), reader.read_written(spark, f"{folder}/transcripts")),
        (reader.SessionLogs("sessions", "h2", {"acme-code": "acme"}, primary=False), reader.read_written(spark, f"{folder}/sessions")),
    ])
    return found.select("source", "source_request_key", "session_key", "auxiliary", "provider", "output_tokens", "cache_read_input_tokens", "observed_at",
                        F.col("native")["output"].alias("native_output"), F.col("native")["cost.total"].alias("native_cost"), "primary")
