"""What each agent is doing now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.attribution import account_at

AGENT_WINDOW_MS = 120_000
_VALUE = ["observed_at", "harness", "session_key", "state", "model", "reset_hint", "error_key", "note"]


def agents(samples: DataFrame, now_ms: int, pairings: DataFrame | None = None, evidence: DataFrame | None = None, window_ms: int = AGENT_WINDOW_MS) -> DataFrame:
    """The latest sample of each pane within the window, its session and the account in use now.

    A sample without a session takes the pane's most recently confirmed pairing (session_key, pane,
    last_confirmed_at, valid_to) within the window; two sessions confirmed at that moment leave it
    unjoined (``ambiguous``).
    """
    since = now_ms - window_ms
    recent = samples.filter((F.col("observed_at") >= since) & (F.col("observed_at") <= now_ms))
    newest = recent.groupBy("pane").agg(F.max_by(F.struct(*_VALUE), F.struct("observed_at", "seq") if "seq" in samples.columns else F.col("observed_at")).alias("_v")).select("pane", "_v.*")
    if pairings is not None:
        live = pairings.filter((F.col("last_confirmed_at") >= since) & (F.col("valid_to").isNull() | (F.col("valid_to") >= since)))
        at = live.groupBy("pane", "last_confirmed_at").agg(F.min("session_key").alias("_lo"), F.max("session_key").alias("_hi"))
        top = at.groupBy("pane").agg(F.max_by(F.struct("_lo", "_hi"), "last_confirmed_at").alias("_p"))
        newest = newest.join(top, "pane", "left")
        one = F.col("_p._lo") == F.col("_p._hi")
        join = F.when(F.col("session_key").isNotNull(), "sample").when(F.col("_p").isNull(), F.lit(None)).when(one, "pane_evidence").otherwise("ambiguous")
        newest = newest.withColumn("session_join", join).withColumn("session_key", F.coalesce("session_key", F.when(one, F.col("_p._lo")))).drop("_p")
    else:
        newest = newest.withColumn("session_join", F.when(F.col("session_key").isNotNull(), "sample"))
    out = newest.withColumn("age_s", F.round(F.greatest(F.lit(0), F.lit(now_ms) - F.col("observed_at")) / 1000, 1))
    if evidence is None:
        return out
    asked = out.filter("session_key IS NOT NULL").select(F.col("pane").alias("event_key"), "session_key", F.lit(now_ms).alias("observed_at"))
    account = account_at(asked, evidence).select(F.col("event_key").alias("pane"), F.col("state").alias("account_state"), F.when(F.col("state") == "attributed", F.col("value")).alias("account"))
    return out.join(account, "pane", "left")


def live_sessions(sessions: DataFrame, now_ms: int, live_ms: int = 600_000) -> DataFrame:
    """Sessions with ``live``: seen within ten minutes."""
    return sessions.withColumn("live", F.coalesce(F.lit(now_ms) - F.col("last_seen_at") <= live_ms, F.lit(False)))
