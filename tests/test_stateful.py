"""Streams with state and timers give what the batch operators give, whatever the batches."""

import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import linking, sequences, triggers
from meterlake.streaming import stateful

PASS = 15_000


@pytest.fixture
def rocksdb(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(name) for name in names]
    stateful.configure(spark)
    spark.conf.set(names[1], "1")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def streamed(spark, folder, batches, schema, make):
    """What a stream gives that takes the batches one after the other."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "in" / f"n={n:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))
    out, checkpoint = str(folder / "out"), str(folder / "checkpoint")
    query = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def dealt(rows, late, seed, n=2):
    """Rows in ``n`` batches, in an order in which none is later than ``late`` ms behind another."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r["observed_at"] + rng.random() * late)
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


SAMPLE = "pane string, observed_at long, seq long, state string, error_key string, pane_pid long, pass_no long, reset_hint long, retry_after_ms long"


def samples(seed):
    rng, rows = random.Random(seed), []
    for pane in ("a", "b", "c", None):
        state, key, pid = "busy", None, 1
        for p in range(60):
            if rng.random() < 0.3:
                state, key, pid = rng.choice(["stalled", "stalled", "busy", "idle", "unknown", None]), rng.choice(["e1", "e2", None]), rng.choice([1, 1, 2, None])
            if rng.random() < 0.15:
                continue  # the pass does not show the pane
            at = 1_000_000 + p * PASS
            rows.append({"pane": pane, "observed_at": at, "seq": len(rows), "state": state, "error_key": key, "pane_pid": pid, "pass_no": p, "reset_hint": at + 5 if rng.random() < 0.3 else None, "retry_after_ms": rng.choice([None, 700])})
    return rows


END = 10_000_000


@pytest.mark.parametrize("late", [40_000])
def test_stalls_as_in_batch(spark, rocksdb, tmp_path, late):
    rows = samples(3)
    marks = [{"pane": "clock", "observed_at": END, "seq": 0, "state": "busy", "error_key": None, "pane_pid": None, "pass_no": 599, "reset_hint": None, "retry_after_ms": None}]
    batches = [*dealt(rows, late, 1), marks, [{**marks[0], "observed_at": END + 1, "seq": 1}]]
    versions = streamed(spark, tmp_path, batches, SAMPLE, lambda s: stateful.stalls(s, absent_ms=PASS * 3 // 2, delay="1 minute"))
    got = stateful.latest(versions, ["pane", "onset"], ["samples"])
    want = sequences.stalls(spark.createDataFrame(rows, SAMPLE), pass_no="pass_no")
    columns = ["pane", "onset", "last_seen", "error_key", "pane_pid", "resets_at", "samples"]
    assert want.count() > 10
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    assert got.filter("NOT ended").count() == 0  # timers have ended those that nothing else did


def test_a_timer_ends_a_stall_of_a_pane_that_is_gone(spark, rocksdb, tmp_path):
    row = lambda pane, at, state: {"pane": pane, "observed_at": at, "seq": 0, "state": state, "error_key": "e", "pane_pid": 1, "pass_no": at // PASS, "reset_hint": None, "retry_after_ms": None}
    gone = [row("gone", PASS * i, "stalled") for i in range(1, 4)]
    stays = [row("stays", PASS * i, "stalled") for i in range(1, 12)]
    batches = [[r for r in gone + stays if r["observed_at"] == PASS * i] for i in range(1, 12)]
    versions = streamed(spark, tmp_path, batches, SAMPLE, lambda s: stateful.stalls(s, absent_ms=PASS * 3 // 2, delay="0 seconds"))
    got = {(r.pane, r.samples, r.ended) for r in stateful.latest(versions, ["pane", "onset"], ["samples"]).collect()}
    assert ("gone", 3, True) in got and {e for p, _, e in got if p == "stays"} == {False}


SIGHTING = "pane string, observed_at long, pass_no long, session_key string, method string"


@pytest.mark.parametrize("late", [40_000])
def test_pairings_as_in_batch(spark, rocksdb, tmp_path, late):
    rng, rows = random.Random(5), []
    for pane in ("a", "b"):
        session, method = "s1", "open_session_file"
        for p in range(50):
            if rng.random() < 0.25:
                session, method = rng.choice(["s1", "s2"]), rng.choice(["open_session_file", "open_session_file", "header"])
            if rng.random() < 0.15:
                continue
            at = 1_000_000 + p * PASS
            rows.append({"pane": pane, "observed_at": at + rng.randint(0, 900), "pass_no": p, "session_key": session, "method": method})
            if rng.random() < 0.3:
                rows.append({"pane": pane, "observed_at": at + rng.randint(0, 900), "pass_no": p, "session_key": rng.choice(["s1", "s2"]), "method": rng.choice(["open_session_file", "header"])})
    clock = {"pane": "clock", "observed_at": END, "pass_no": 599, "session_key": "x", "method": "header"}
    batches = [*dealt(rows, late, 2), [clock], [{**clock, "observed_at": END + 1}]]
    versions = streamed(spark, tmp_path, batches, SIGHTING, lambda s: stateful.live_pairings(s, pass_ms=1000, absent_ms=PASS * 3 // 2, delay="1 minute"))
    got = stateful.latest(versions, ["pane", "session_key", "method", "first_observed_at"], ["passes"]).filter("pane <> 'clock'")
    want = sequences.live_pairings(spark.createDataFrame(rows, SIGHTING))
    columns = ["pane", "session_key", "method", "first_observed_at", "last_confirmed_at", "passes"]
    assert want.count() > 10
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    assert got.filter("NOT ended").count() == 0


def test_sessions_end_by_timer(spark, rocksdb, tmp_path):
    rows = [{"session_key": k, "observed_at": t} for k, times in {"a": [10, 20, 500, 510], "b": [5]}.items() for t in times]
    batches = [rows[:2], rows[2:], [{"session_key": "clock", "observed_at": 5_000}], [{"session_key": "clock", "observed_at": 5_001}]]
    versions = streamed(spark, tmp_path, batches, "session_key string, observed_at long", lambda s: stateful.sessions(s, quiet_ms=100, delay="1 second"))
    got = stateful.latest(versions, ["session_key", "started_at"], ["sightings"]).filter("session_key <> 'clock'").collect()
    assert sorted((r.session_key, r.started_at, r.last_seen_at, r.sightings, r.ended) for r in got) == [("a", 10, 20, 2, True), ("a", 500, 510, 2, True), ("b", 5, 5, 1, True)]


def test_alerts_fire_once_for_each_instance(spark, rocksdb, tmp_path):
    schema = "account string, window string, observed_at long, source string, stream_key string, remaining_pct double, resets_at long"
    left = [(1000, 30.0, 9000), (2000, 15.0, 9000), (3000, 12.0, 9000), (4000, 4.0, 9000), (5000, 4.0, 9000), (9500, 3.0, 9000), (10_000, 3.0, 20_000), (11_000, 18.0, 20_000), (12_000, None, 20_000)]
    rows = [{"account": "a", "window": "session", "observed_at": t, "source": "s", "stream_key": "k", "remaining_pct": x, "resets_at": r} for t, x, r in left]
    clock = [{**rows[0], "account": None}, {**rows[0], "account": "clock", "observed_at": 90_000}]
    got = streamed(spark, tmp_path, [rows[4:7], rows[:4], rows[7:], clock, [{**clock[1], "observed_at": 90_001}]], schema, lambda s: stateful.alerts(s, keep_ms=500_000, delay="20 seconds"))
    assert sorted((r.observed_at, r.threshold, r.resets_at) for r in got.filter("account = 'a'").collect()) == [(2000, 20, 9000), (4000, 5, 9000), (10_000, 5, 20_000)]


@pytest.mark.parametrize("hold, cooldown", [(2_000, 0), (2_000, 9_000)])
def test_triggers_as_in_batch(spark, rocksdb, tmp_path, hold, cooldown):
    rng = random.Random(7)
    rows = [{"series": s, "observed_at": 1000 * t, "holds": rng.choice([True, True, True, True, False, None])} for s in ("a", "b") for t in range(1, 80)]
    clock = {"series": "clock", "observed_at": END, "holds": False}
    batches = [*dealt(rows, 4_000, 3), [clock], [{**clock, "observed_at": END + 1}]]
    schema = "series string, observed_at long, holds boolean"
    got = streamed(spark, tmp_path, batches, schema, lambda s: stateful.firings(s, hold, cooldown, delay="10 seconds"))
    want = triggers.firings(spark.createDataFrame(rows, schema), ["series"], F.col("holds"), hold, cooldown)
    assert want.count() > 4
    assert sorted(map(tuple, got.select("series", "since", "fired_at").collect())) == sorted(map(tuple, want.select("series", "since", "fired_at").collect()))


OBSERVATION = "observation_id long, event_key long, source string, primary boolean, provider_request_key string"


def observations():
    rng, rows = random.Random(9), []
    for n in range(120):
        key = f"r{n}" if n % 10 else None
        if n % 4:
            rows.append({"observation_id": 3 * n, "event_key": 3 * n, "source": rng.choice(["log", "aux"]), "primary": True, "provider_request_key": key})
        for i in range(rng.randint(0, 2)):
            rows.append({"observation_id": 3 * n + 1 + i, "event_key": 3 * n + 1 + i, "source": rng.choice(["otel", "aux"]), "primary": False, "provider_request_key": key})
    return rows


def test_late_links_in_any_order(spark, rocksdb, tmp_path):
    rows = observations()
    want = linking.link_secondary(spark.createDataFrame(rows, OBSERVATION)).select("observation_id", F.col("event_key").cast("string")).collect()
    assert len(want) > 30
    some = random.Random(1).sample(rows, len(rows))
    batches = [some[:90], some[90:] + some[:7]]  # rows that come twice change nothing
    got = streamed(spark, tmp_path, batches, OBSERVATION, stateful.late_links).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_links_never_move(spark, rocksdb, tmp_path):
    row = lambda n, source, primary: {"observation_id": n, "event_key": n, "source": source, "primary": primary, "provider_request_key": "r"}
    batches = [[row(1, "otel", False)], [row(10, "log", True), row(9, "log", True)], [row(2, "log2", True), row(5, "otel", False), row(1, "otel", False)]]
    got = streamed(spark, tmp_path, batches, OBSERVATION, stateful.late_links)
    assert sorted(map(tuple, got.collect())) == [(1, "9"), (5, "2")]
