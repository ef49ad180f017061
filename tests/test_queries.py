"""Every query of the library against DuckDB on the driver's small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from meterlake import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("<null>" if r[i] is None or (isinstance(r[i], float) and pd.isna(r[i])) else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    said = duck.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(said.columns)
    assert plain(found.collect(), found.columns) == plain(said.fetchall(), said.columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    from meterlake import bindings

    secret = b"0123456789abcdef0123456789abcdef"
    raw = {r.observation_id: r.provider_request_key for r in bindings.observations(spark, DATA).collect()}
    for r in queries.QUERIES["keyed_hash"](spark, DATA).limit(200).collect():
        assert r.request_hash == hmac.new(secret, f"request:p:{raw[r.observation_id]}".encode(), hashlib.sha256).hexdigest()[:16]


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert glob.glob(os.path.join(os.path.dirname(entry.__file__), "meterlake", "*.py"))
