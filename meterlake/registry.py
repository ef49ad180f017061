"""The registered queries, and the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query and, where SQL states it, its SQL."""

    def add(make: Callable[[SparkSession, str], DataFrame]):
        key = name or make.__name__
        QUERIES[key] = make
        if sql:
            ORACLES[key] = sql
        return make

    return add


def keyed_hash_sql(secret: bytes, namespace: str, raw: str) -> str:
    """HMAC-SHA256 of ``namespace:raw``, 16 hex digits, as SQL; for secrets of at most 64 bytes."""
    key = secret.ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in key) for pad in (0x36, 0x5C))
    return f"CASE WHEN {raw} <> '' THEN substr(sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode('{namespace}:' || {raw})))), 1, 16) END"
