"""Traces, metrics, triggers, changes, calibration, exports, deletion, readers and stream status on rows that pin their rules."""

import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import calibration, deletion, metrics, traces, triggers
from meterlake.plans import export, health, investigate
from meterlake.sources import reader
from meterlake.streaming import status

SPAN = "trace_id long, span_id long, parent_id long, name string, service string, status string, start_ms long, end_ms long"


def span(trace, number, parent, start, end, status="ok"):
    return (trace, number, parent, f"n{number}", f"s{number % 3}", status, start, end)


def brute_tree(rows):
    spans = {(r[0], r[1]): r for r in rows}
    last = {}
    for r in rows:
        if (r[0], r[2]) in spans:
            end = (r[7] is None, r[7] or 0)
            best = last.get((r[0], r[2]))
            if best is None or end > best[0] or (end == best[0] and r[1] < best[1]):
                last[r[0], r[2]] = (end, r[1])
    out = {}
    for (t, s), r in spans.items():
        at, depth, critical, seen = r, 0, True, {s}
        while (t, at[2]) in spans:
            critical = critical and last[t, at[2]][1] == at[1]
            at, depth = spans[t, at[2]], depth + 1
            if at[1] in seen:
                at = None
                break
            seen.add(at[1])
        missing = r[2] is not None and (t, r[2]) not in spans
        out[t, s] = (at[1], depth, critical, missing) if at else (None, None, False, missing)
    return out


def brute_self(rows):
    spans = {(r[0], r[1]): r for r in rows}
    out = {}
    for key, r in spans.items():
        if r[7] is None:
            out[key] = (None, None, None)
            continue
        end = max(r[6], r[7])
        covered = set()
        for c in rows:
            if (c[0], c[2]) == key:
                covered.update(range(max(c[6], r[6]), min(end if c[7] is None else c[7], end)))
        out[key] = (end - r[6], len(covered), end - r[6] - len(covered))
    return out


def test_trees_and_self_times(spark):
    rng = random.Random(4)
    rows = [span(1, 1, None, 0, 400)]
    for n in range(2, 60):
        start = rng.randint(0, 350)
        rows.append(span(1, n, rng.choice([rng.randint(1, n - 1), n - 1, n - 1, 999]), start, rng.choice([None, start, start + rng.randint(1, 120), start + 40])))
    rows += [span(2, 1, 2, 0, 5), span(2, 2, 3, 0, 5), span(2, 3, 1, 0, 5), span(2, 4, 3, 0, 9), span(3, 7, None, 5, 5), span(4, 1, 1, 0, 3)]  # a cycle, a row on its own, one that is its own parent
    table = spark.createDataFrame(rows, SPAN)
    got = {(r.trace_id, r.span_id): (r.root_id, r.depth, r.critical, r.missing) for r in traces.tree(table).collect()}
    assert got == brute_tree(rows)
    for slices in (1, 64):
        found = {(r.trace_id, r.span_id): (r.duration_ms, r.child_ms, r.self_ms) for r in traces.self_times(table, slices).collect()}
        assert {k: v for k, v in found.items() if k[0] != 4} == {k: v for k, v in brute_self(rows).items() if k[0] != 4}
    whole = {r.trace_id: r for r in traces.rollup(table).collect()}
    assert set(whole) == {1, 2, 3, 4} and whole[2].root_id is None and whole[3].critical_spans == 1 and whole[1].root_name == "n1"


def test_written_logs_share_files(spark, tmp_path):
    names = ["/a/b.jsonl", "_a_b.jsonl", "a b\t%\u00e9", *map(str, range(60))]
    rows = [(f"{n}\t{name!a}", name, n) for name in names for n in (10, 9, -1, 0)] + [("x\ny\r\n\rz", "breaks", 1), (None, "breaks", 2)]
    reader.written_lines(spark.createDataFrame(rows, "value string, file string, line long"), str(tmp_path / "logs"))
    assert len(list((tmp_path / "logs").rglob("*.txt"))) <= 8
    got = {}
    for r in reader.read_written(spark, str(tmp_path / "logs")).orderBy("file", "line").collect():
        got.setdefault(r.file, []).append(r.value)
    assert got == {name: [f"{n}\t{name!a}" for n in (-1, 0, 9, 10)] for name in names} | {"breaks": ["x", "y", "", "z", ""]}


def test_rollup_computes_its_spans_once(spark):
    rows = [span(1, 1, None, 0, 50), span(1, 2, 1, 0, 40), span(1, 3, 1, 5, None, "error"), span(1, 4, 3, 6, 9), span(1, 5, 99, 2, 70), span(1, 6, 5, 3, 30), span(2, 1, 1, 0, 3)]
    made = spark.sparkContext.accumulator(0)

    def seen(end):
        made.add(1)
        return end

    table = spark.createDataFrame(rows, SPAN).withColumn("end_ms", F.udf(seen, "long")("end_ms"))
    got = {r.trace_id: r for r in traces.rollup(table).collect()}
    assert made.value == len(rows)
    one, two = got[1], got[2]
    assert (one.root_id, one.root_name, one.services, one.duration_ms, one.spans, one.errors, one.missing_parents, one.roots, one.depth) == (1, "n1", "s0,s1,s2", 70, 6, 1, 1, 2, 2)
    assert (one.critical_spans, one.critical_self_ms) == (3, 3) and (two.root_id, two.roots, two.depth, two.critical_spans) == (None, 0, None, None)


def test_traces_of_nothing(spark):
    none = spark.createDataFrame([], SPAN)
    assert traces.tree(none).count() == traces.rollup(none).count() == traces.self_times(none).count() == 0


def test_repeated_spans_keep_the_last_complete_one(spark):
    rows = [(1, 1, 10, None, 3), (1, 1, 10, 20, 1), (1, 1, 10, 30, 2), (1, 2, 5, None, 1), (1, 2, 6, None, 2)]
    got = traces.spans_once(spark.createDataFrame(rows, "trace_id long, span_id long, start_ms long, end_ms long, seq long"))
    assert sorted((r.span_id, r.start_ms, r.end_ms) for r in got.collect()) == [(1, 10, 30), (2, 6, None)]


POINT = "series string, at_ms long, start_ms long, value double, temporality string, monotonic boolean"


def test_increases_restart_at_resets(spark):
    rows = [("a", 100, 0, 5.0, "cumulative", True), ("a", 200, 0, 8.0, "cumulative", True), ("a", 300, 0, 2.0, "cumulative", True), ("a", 400, 350, 3.0, "cumulative", True), ("a", 500, 350, None, "cumulative", True),
            ("a", 600, 350, 4.0, "cumulative", True), ("b", 10, None, 9.0, "cumulative", True), ("b", 20, None, 11.0, "cumulative", True), ("c", 50, 0, 7.0, "delta", True), ("c", 90, 60, 1.0, "delta", True), ("d", 5, 0, 1.0, "cumulative", False)]
    table = spark.createDataFrame(rows, POINT)
    got = sorted(map(tuple, metrics.increases(table, ["series"]).collect()))
    assert got == [("a", 0, 100, 5.0), ("a", 100, 200, 3.0), ("a", 200, 300, 2.0), ("a", 350, 400, 3.0), ("a", 400, 600, 1.0), ("b", 10, 20, 2.0), ("c", 0, 50, 7.0), ("c", 60, 90, 1.0)]
    steps = {(r.series, r.step_ms): (round(r.increase, 9), r.covered_ms) for r in metrics.increase_by_step(table, ["series"], 40).collect()}
    assert steps["a", 0] == (2.0, 40) and steps["a", 80] == (1.6, 40) and steps["a", 440] == (0.2, 40) and steps["a", 320] == (0.6, 10)
    for name in "abc":
        assert round(sum(v for (s, _), (v, _) in steps.items() if s == name), 6) == sum(x for s, _, _, x in got if s == name)


def brute_quantile(bounds, counts, q):
    total, below = sum(counts), 0
    if not total or not bounds:
        return None
    for i, n in enumerate(counts):
        if below + n >= q * total and below + n > 0:
            if i == len(bounds):
                return bounds[-1]
            lower = bounds[i - 1] if i else min(0.0, bounds[0])
            return lower + (bounds[i] - lower) * (q * total - below) / n
        below += n


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.99, 1.0])
def test_histogram_quantiles(spark, q):
    rows = [([1.0, 2.0, 5.0], [0, 3, 1, 2]), ([1.0, 2.0], [0, 0, 0]), ([], [4]), ([-3.0, 4.0], [2, 2, 0]), ([10.0], [0, 7]), ([1.0, 2.0, 3.0, 4.0], [5, 0, 0, 5, 0])]
    got = [r[0] for r in spark.createDataFrame(rows, "b array<double>, c array<long>").coalesce(1).select(metrics.hist_quantile(F.col("b"), F.col("c"), q)).collect()]
    assert got == pytest.approx([brute_quantile(b, c, q) for b, c in rows])


def test_merged_parts_equal_the_whole(spark):
    rng = random.Random(2)
    rows = [(i % 3, i % 5, [1.0, 2.0] if i % 2 else [1.0, 4.0], [rng.randint(0, 9) for _ in range(3)] if i % 11 else [1, 2]) for i in range(90)] + [(0, 1, None, None), (0, 2, [1.0, 2.0], [1, None, 2])]
    table = spark.createDataFrame(rows, "g long, part long, bounds array<double>, counts array<long>")
    whole = metrics.merged_histograms(table, ["g"])
    parts = metrics.merged_histograms(metrics.merged_histograms(table, ["g", "part"]), ["g"])
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect())) and whole.count() == 6


def test_exponential_histograms(spark):
    rows = [(1, 2, 3, 1, [4, 0, 2]), (1, 1, 0, -1, [1, 1]), (2, 0, 0, 0, []), (3, 3, 2, 5, [])]
    table = spark.createDataFrame(rows, "g long, scale int, zero_count long, offset int, counts array<long>")
    merged = metrics.merged_exp_histograms(table, ["g"])
    got = {r["g"]: (r["scale"], r["zero_count"], [tuple(b) for b in r["buckets"]], r["count"]) for r in merged.collect()}
    assert got == {1: (1, 3, [(-1, 1), (0, 5), (1, 2)], 11), 2: (0, 0, [], 0), 3: (3, 2, [], 2)}
    values = {r["g"]: r["q"] for r in merged.select("g", metrics.exp_hist_quantile(F.col("scale"), F.col("zero_count"), F.col("buckets"), 1.0).alias("q")).collect()}
    assert values == {1: pytest.approx(2.0), 2: None, 3: 0.0}


def brute_firings(samples, hold, cooldown):
    out, since, fired_for, last = [], None, None, None
    for at, holds in samples:
        since = (at if since is None else since) if holds else None
        if holds and at - since >= hold and since != fired_for and (last is None or at - last >= cooldown):
            out.append((since, at))
            fired_for, last = since, at
    return out


@pytest.mark.parametrize("hold, cooldown", [(0, 0), (20, 0), (20, 90)])
def test_triggers(spark, hold, cooldown):
    rng = random.Random(hold + cooldown)
    rows = [(s, 10 * t, rng.choice([1, 1, 1, 1, 0, None])) for s in "abc" for t in range(200) if rng.random() < 0.8]
    got = triggers.firings(spark.createDataFrame(rows, "s string, observed_at long, v int"), ["s"], F.col("v") > 0, hold, cooldown).collect()
    assert sorted(map(tuple, got)) == sorted((s, *f) for s in "abc" for f in brute_firings([(t, bool(v)) for x, t, v in rows if x == s], hold, cooldown))


def test_contributions_add_up(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["p", None]), rng.randint(0, 5), rng.choice([None, 1, 7]), t) for t in range(400)]
    table = spark.createDataFrame(rows, "a string, b string, c long, v long, observed_at long")
    got = investigate.contributions(table, ["a", "b", "c"], "v", 250, 350).collect()
    whole = next(r for r in got if r.group == "")
    assert whole.before == sum(r[3] or 0 for r in rows if 150 <= r[4] < 250) and whole.after == sum(r[3] or 0 for r in rows if 250 <= r[4] < 350)
    groups = {r.group for r in got}
    assert groups == {"", "a", "b", "c", "a,b", "a,c", "b,c"}
    for g in groups:
        mine = sorted((r for r in got if r.group == g), key=lambda r: r["rank"])
        assert sum(r.difference for r in mine) == whole.difference and [abs(r.difference) for r in mine] == sorted((abs(r.difference) for r in mine), reverse=True)
    assert max(r["rank"] for r in investigate.contributions(table, ["a", "b", "c"], "v", 250, 350, top=2).collect()) == 2


def test_evidence_of_a_service(spark):
    spans = spark.createDataFrame([span(1, 3, None, 1000, 1900, "error"), span(1, 6, 3, 1100, 1200), span(2, 9, None, 9000, 9100, "error"), span(1, 4, 3, 1000, 5000)], SPAN)
    logs = spark.createDataFrame([(1, 0, 1500, "near"), (1, 5000, 5001, "far"), (2, 1001, 1001, "other trace")], "trace_id long, time_ms long, observed_ms long, body string")
    found = investigate.evidence(spans, logs, "s0", 0, 8000)
    assert [(r.name, r.errors) for r in found["errors"].collect()] == [("n3", 1)] and [r.body for r in found["logs"].collect()] == ["near"] and [r.span_id for r in found["slowest"].collect()] == [3, 6]


@pytest.mark.parametrize("bucket", [7, 1000])
def test_calibration(spark, bucket):
    readings = [("a", "session", 500, t, p) for t, p in ((10, 1.0), (20, 3.0), (30, 5.0), (40, 30.0), (50, 30.0))] + [("a", "session", 900, 60, 2.0), ("b", "weekly", 900, 15, 0.0), (None, "weekly", 900, 15, 0.0), ("b", "weekly", 900, 16, None)]
    usage = [("a", t, 100) for t in (5, 12, 18, 25, 30, 35, 45, 55, 70)] + [("b", 15, 7), ("b", 16, None), (None, 1, 1)]
    pairs = calibration.reading_pairs(spark.createDataFrame(readings, "account string, window string, resets_at long, observed_at long, used_pct double"), spark.createDataFrame(usage, "account string, observed_at long, tokens long"), bucket)
    got = sorted((r.account, r.resets_at, r.from_at, r.to_at or 0, r.tokens) for r in pairs.collect())
    assert got == [("a", 500, 10, 20, 200), ("a", 500, 20, 30, 200), ("a", 500, 30, 40, 100), ("a", 500, 40, 50, 100), ("a", 500, 50, 0, 200), ("a", 900, 60, 0, 100), ("b", 900, 15, 0, 0)]
    [ratio] = calibration.ratios(pairs).collect()
    assert (ratio.pct_per_token, ratio.pairs, ratio.calibrated_at) == (0.01, 3, 40)
    assert [(r.from_at, round(r.unexplained_pct, 9)) for r in calibration.jumps(pairs).collect()] == [(30, 24.0)]
    assert sorted((r.account, r.anchor_at, r.estimate_pct, r.estimator_version) for r in calibration.estimates(pairs, 600).collect()) == [("a", 60, 3.0, 1), ("b", 15, None, None)]


def test_export_keeps_totals_and_refuses(spark):
    rows = spark.createDataFrame([(f"u{i}" if i > 40 else "big", ["p", "q", None][i % 3], 100 if i <= 40 else 1) for i in range(200)], "who string, kind string, n long")
    out = export.rollup(rows, ["who", "kind"], ["n"], limit=10, heavy={"who": 0.1}).collect()
    assert {r.who for r in out} == {"big", "other"} and {r.kind for r in out} == {"p", "q", None} and sum(r.n for r in out) == 41 * 100 + 159 and sum(r.requests for r in out) == 200
    assert export.rollup(rows, ["who", "kind"], ["n"], limit=10).columns == ["kind", "n", "requests"]
    assert [(r.kind, r.requests) for r in export.rollup(rows, ["kind"], ["n"], allowed={"kind": ["p"]}, rest="drop").orderBy("kind").collect()] == [(None, 66), ("p", 67)]
    with pytest.raises(ValueError):
        export.rollup(rows.withColumn("branch", F.lit("x")), ["branch"], ["n"])
    assert export.rollup(rows.limit(0), ["who"], ["n"]).count() == 0


def test_deletion_reaches_descendants_and_tombstones_run_out(spark):
    sessions = spark.createDataFrame([("a", None, 50), ("b", "a", 60), ("c", "b", 70), ("d", None, 5), ("e", "missing", 80), ("f", "g", 80), ("g", "f", 80)], "session_key string, parent_session_key string, last_seen_at long")
    effective = spark.createDataFrame([("a", "account", "attributed", "x"), ("e", "account", "ambiguous", "x"), ("g", "project", "attributed", "p")], "subject_id string, dimension string, state string, value string")
    name = lambda v: spark.createDataFrame([(v,)], "value string")
    gone = deletion.doomed_sessions(sessions, effective, name("x"), name("p"), before_ms=10)
    assert sorted(r[0] for r in gone.collect()) == ["a", "b", "c", "d", "f", "g"]
    old = spark.createDataFrame([("session", "z", 0), ("session", "a", 40 * 86_400_000)], "kind string, value string, forgotten_at long")
    now = 95 * 86_400_000
    stones = deletion.tombstones(now, name("x"), gone, old)
    assert {(r.kind, r.value) for r in stones.collect()} == {("account", "x"), *(("session", s) for s in "abcdfg")} and stones.filter("value = 'a'").first().forgotten_at == now
    rows = spark.createDataFrame([("a",), ("e",), (None,)], "session_key string")
    assert deletion.unburied(rows, stones, now).count() == 2 and deletion.unburied(rows, stones, now + 91 * 86_400_000).count() == 3


def test_readers_are_checked(spark):
    lines = spark.createDataFrame([("{}", "f", 1)], "value string, file string, line long")
    one = reader.Transcripts("t", "h", "p", b"0" * 16)
    assert isinstance(one, reader.Reader) and reader.collect([(one, lines)]).count() == 0
    with pytest.raises(ValueError):
        reader.collect([(one, lines), (one, lines)])

    class Strange(reader.SessionLogs):
        def observations(self, lines):
            return lines.select(F.lit("s").alias("source"), F.lit(1).alias("extra"))

    with pytest.raises(ValueError):
        reader.collect([(Strange("s", "h"), lines)])


def test_error_kinds_hold_no_values():
    kind = status.error_kind
    assert kind(None) is None and kind("all went wrong with 4711") == "unknown"
    assert kind("org.x.StreamingQueryException: [STREAM_FAILED] Query terminated\nTraceback\nValueError: secret 4711") == "ValueError"
    assert kind("[CAST_INVALID_INPUT] The value 'secret' of the type \"STRING\" in column `amount` cannot be cast", frozenset({"amount"})) == "CAST_INVALID_INPUT at amount"
    assert kind("[CAST_INVALID_INPUT] in column `secret`", frozenset({"amount"})) == "CAST_INVALID_INPUT"


def test_a_failing_batch_gives_its_row(spark, tmp_path):
    for n in range(2):
        spark.range(n, n + 1).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    listener = status.StatusListener()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

        def sink(batch, number):
            batch.collect()
            if number == 1:
                raise KeyError("secret 4711")

        query = stream.writeStream.queryName("log.a").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="secret"):
            query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    records = listener.records(spark)
    [row] = health.batch_status(records).collect()
    assert (row.source, row.error_kind) == ("log.a", "KeyError") and row.last_new_data_at is not None and row.last_run_at >= row.last_success_at
    assert "4711" not in str(records.collect())
