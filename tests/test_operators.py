"""Operators on rows that pin their rules."""

from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from meterlake.functions import scalars, screens
from meterlake.operators import attribution, counting, identity, linking, paths, quality, sequences, trends, upserts
from meterlake.plans import agents, bookmarks, capacity, health, usage

EVIDENCE = "subject_kind string, subject_id string, dimension string, value string, method string, source string, confidence string, validity string, valid_from long, valid_to long, first_observed_at long, last_confirmed_at long, arrival_seq long"


def ev(value, seq, at, method="m", confidence="observed", validity="historical", start=None, end=None, last=None, subject="s"):
    return ("session", subject, "account", value, method, "src", confidence, validity, at if start is None else start, end, at, last or at, seq)


def test_collapse_keeps_largest_then_earliest_and_first_session(spark):
    rows = [("a", 2, 1, "s1"), ("a", 120, 2, "s2"), ("a", 120, 3, "s3"), ("b", None, 1, "s1"), ("b", None, 2, "s2"), ("c", 5, 1, "s1"), ("c", None, 2, "s9"), (None, 1, 1, None)]
    got = {r.k: r for r in counting.collapse_snapshots(spark.createDataFrame(rows, "k string, o long, seq long, s string"), ["k"], "o", "seq", "s").collect()}
    assert (got["a"].o, got["a"].seq, got["a"].s, got["a"].snapshots) == (120, 2, "s1", 3)
    assert (got["b"].o, got["b"].seq) == (None, 1) and got["c"].o == 5 and got[None].o == 1


def test_counter_delta_resets_and_nulls(spark):
    rows = [("f", 1, 1100, 1000, None), ("f", 2, 1100, 1000, None), ("f", 3, 3300, 3000, 5), ("f", 4, 550, 500, 0), ("f", 5, 780, 700, 10), ("f", 6, None, 9, 9), ("g", 1, 7, 7, 7)]
    got = counting.counter_delta(spark.createDataFrame(rows, "f string, n long, t long, a long, b long"), "f", "n", ["a", "b"], "t").orderBy("f", "n").collect()
    assert [(r.f, r.n, r.t, r.a, r.b) for r in got] == [("f", 1, 1100, 1000, None), ("f", 3, 2200, 2000, None), ("f", 5, 230, 200, 10), ("g", 1, 7, 7, 7)]


def test_evidence_windows_close_in_arrival_order(spark):
    rows = [ev("A", 1, 100), ev("B", 2, 200), ev("A", 3, 300), ev("A", 4, 400), ev("C", 5, 500), ev("A", 6, 600, start=100, last=650), ev("D", 7, 700, start=0), ev("Z", 8, 800, method="other")]
    got = {(r.value, r.valid_from, r.method): (r.valid_to, r.last_confirmed_at) for r in attribution.evidence_windows(spark.createDataFrame(rows, EVIDENCE)).collect()}
    assert got == {("A", 100, "m"): (200, 650), ("B", 200, "m"): (300, 200), ("A", 300, "m"): (500, 300), ("A", 400, "m"): (500, 400), ("C", 500, "m"): (700, 500), ("D", 0, "m"): (None, 700), ("Z", 800, "other"): (None, 800)}


@pytest.mark.parametrize("bounds,state", [("closed", "ambiguous"), ("half_open", "attributed")])
def test_resolution_at_a_switch(spark, bounds, state):
    closed = attribution.evidence_windows(spark.createDataFrame([ev("A", 1, 100), ev("B", 2, 200)], EVIDENCE))
    times = spark.createDataFrame([("session", "s", "account", 200)], "subject_kind string, subject_id string, dimension string, subject_time long")
    assert attribution.resolve(closed, times, bounds).first().state == state


def test_resolution_ranks_and_notes(spark):
    rows = [ev("A", 1, 100, confidence="inferred"), ev("B", 2, 100, method="n", confidence="authoritative"), ev("X", 3, 900, subject="late"), ev("A", 4, 1, subject="two"), ev("B", 5, 2, subject="two", method="n"),
            ev("L", 6, 10, subject="live", validity="live", last=20)]
    closed = attribution.evidence_windows(spark.createDataFrame(rows, EVIDENCE))
    times = spark.createDataFrame([("session", s, "account", 150) for s in ("s", "late", "two", "live", "none")], "subject_kind string, subject_id string, dimension string, subject_time long")
    got = {r.subject_id: (r.state, r.value) for r in attribution.resolve(closed, times).collect()}
    assert got == {"s": ("attributed", "B"), "late": ("unattributed", None), "two": ("ambiguous", None), "live": ("unattributed", None)}
    roots = spark.createDataFrame([("A", "R"), ("B", "R")], "node string, root string")
    assert {r.subject_id: r.value for r in attribution.resolve(closed, times, roots=roots).collect()}["two"] == "R"


def test_account_at_grace(spark):
    rows = attribution.evidence_windows(spark.createDataFrame([ev("L", 1, 1000, validity="live", last=2000)], EVIDENCE))
    asked = spark.createDataFrame([(1, "s", 999), (2, "s", 122_000), (3, "s", 122_001), (4, "other", 5), (5, None, 5)], "event_key long, session_key string, observed_at long")
    stored = spark.createDataFrame([("other", "attributed", "K", "observed")], "session_key string, state string, value string, confidence string")
    got = {r.event_key: (r.state, r.value) for r in attribution.account_at(asked, rows, stored=stored).collect()}
    assert got == {1: ("unattributed", None), 2: ("attributed", "L"), 3: ("unattributed", None), 4: ("attributed", "K"), 5: ("unattributed", None)}


def test_links_never_move_and_orphans_wait(spark):
    schema = "observation_id long, event_key long, source string, primary boolean, provider_request_key string, output_tokens long, uncached_input_tokens long, cache_read_input_tokens long, cache_write_input_tokens long, reasoning_output_tokens long"
    row = lambda i, source, primary, key, out: (i, i, source, primary, key, out, 1, None, 3, 4)
    obs = spark.createDataFrame([row(2, "a", True, "k", 10), row(1, "b", True, "k", 10), row(3, "o", False, "k", 14), row(4, "o", False, "z", 5), row(5, "a", False, "k", 1), row(6, "o", False, None, 1)], schema)
    links = linking.link_secondary(obs)
    assert sorted(map(tuple, links.collect())) == [(3, 1), (5, 1)]
    kept = spark.createDataFrame([(3, 2)], "observation_id long, event_key long")
    assert sorted(map(tuple, linking.link_secondary(obs, existing=kept).collect())) == [(3, 2), (5, 1)]
    diff = linking.disagreement(obs, links).collect()
    assert [(r.event_key, r.output_tokens, r.uncached_input_tokens, r.cache_read_input_tokens) for r in diff] == [(1, 9, None, None)]
    assert {r.source: r.orphans for r in linking.orphan_counts(obs, links).collect()} == {"o": 2}


def test_merges(spark):
    merges = spark.createDataFrame([(5, 4, None), (4, 3, None), (3, 1, None), (9, 8, 7), (8, 2, None)], "from_key long, into_key long, revoked_at long")
    assert {r.node: r.root for r in identity.canonical_accounts(merges).collect()} == {5: 1, 4: 1, 3: 1, 1: 1, 8: 2, 2: 2}
    assert identity.canonical_accounts(merges.limit(0)).count() == 0
    aliases = spark.createDataFrame([("m", "h", "a", "reported", None), ("m", "h", "b", "reported", None), ("m", "i", "a", "reported", None), ("m", "i", "b", "login", None)], "alias_kind string, alias_hash string, account_key string, asserted_by string, revoked_at long")
    none = spark.createDataFrame([], "node string, root string")
    assert [(r.alias_hash, r.accounts) for r in identity.alias_conflicts(aliases, none).collect()] == [("h", ["a", "b"])]
    seen = spark.createDataFrame([("m", "h", "new", 5), ("m", "i", "login", 9), ("m", "fresh", "reported", 3)], "alias_kind string, alias_hash string, asserted_by string, seen_at long")
    registry = aliases.withColumn("last_confirmed", F.lit(1).cast("long")).withColumn("revoked_at", F.when(F.col("asserted_by") == "login", F.lit(2)).cast("long"))
    out, refused = identity.assert_aliases(seen, registry, none, "s")
    rows = {(r.alias_hash, r.asserted_by, r.account_key if r.alias_hash != "fresh" else "*"): (r.last_confirmed, r.revoked_at) for r in out.collect()}
    assert rows[("i", "login", "b")] == (9, None) and ("fresh", "reported", "*") in rows
    assert [r.alias_hash for r in refused.collect()] == ["h"]
    again, _ = identity.assert_aliases(seen, out, none, "s")
    assert again.count() == out.count()
    bad = spark.createDataFrame([(1, 1, None, "manual"), (2, 1, None, "manual"), (2, 3, None, "evidence"), (4, 77, None, "manual")], "from_key long, into_key long, revoked_at long, evidence string")
    accounts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "account_key long")
    assert {r.problem for r in identity.merge_violations(bad, accounts).collect()} == {"equal ends", "several outgoing merges", "unknown account", "evidence merges into the larger key"}


def test_merges_of_links_are_one_for_each_account(spark):
    none = spark.createDataFrame([], "node long, root long")
    links = spark.createDataFrame([(3, 1), (3, 2), (9, 8), (8, 7), (7, 20), (5, 5), (None, 4), (30, 31)], "a long, b long")
    refused = spark.createDataFrame([(31, 30), (20, 7), (9, 7)], "from_key long, into_key long")
    got = identity.merges_of_links(links, none, refused)
    assert sorted(map(tuple, got.collect())) == [(2, 1), (3, 1), (8, 7)]
    roots = identity.canonical_accounts(got.withColumn("revoked_at", F.lit(None).cast("long")))
    assert roots.count() == roots.select("node").distinct().count() == 5
    import random

    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    least = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = {r.node: r.root for r in identity.least_connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {x: r for x, r in least.items() if x != r}


def test_login_evidence(spark):
    logins = spark.createDataFrame([("f", 10, "A"), ("f", 30, "B"), ("f", 50, None), ("f", 60, "B"), ("g", 5, "C")], "state_file string, observed_at long, account string")
    seen = spark.createDataFrame([("f", "s", 5), ("f", "s", 10), ("f", "s", 20), ("f", "s", 30), ("f", "s", 55), ("f", "s", 70), ("g", "t", 9), ("f", None, 20)], "state_file string, session_key string, observed_at long")
    got = sequences.login_evidence(seen, logins).collect()
    assert sorted((r.subject_id, r.value, r.valid_from, r.last_confirmed_at) for r in got) == [("s", "A", 10, 20), ("s", "B", 30, 70), ("t", "C", 9, 9)]
    assert {(r.confidence, r.validity, r.dimension) for r in got} == {("inferred", "live", "account")}


def test_stalls_end_where_a_pane_is_gone(spark):
    """Passes 1 to 4 read, 5 failed, 6 read; gone in 7 and 8; then again."""
    rows = [("p", n * 10, n, None if n == 5 else "stalled", "e", 1, None, None, n) for n in (1, 2, 3, 4, 5, 6, 9, 10)]
    table = spark.createDataFrame(rows, "pane string, observed_at long, seq long, state string, error_key string, pane_pid long, reset_hint long, retry_after_ms long, pass_no long")
    assert sorted((r.onset, r.last_seen, r.samples) for r in sequences.stalls(table, pass_no="pass_no").collect()) == [(10, 60, 5), (90, 100, 2)]
    assert [r.samples for r in sequences.stalls(table).collect()] == [7]


def test_peak_concurrency_over_buckets(spark):
    rows = [("a", 0, 100), ("a", 50, 60), ("a", 60, 70), ("a", 95, 300), ("b", 7, 7), (None, 1, 2), (None, 2, 3)]
    table = spark.createDataFrame(rows, "g string, lo long, hi long")
    for bucket in (1, 10, 64, 10**9):
        got = sequences.peak_concurrency(table, ["g"], "lo", "hi", bucket).collect()
        assert {(r.g, r.peak, r["at"]) for r in got} == {("a", 3, 60), ("b", 1, 7), (None, 2, 2)}


def test_usage_by_account_with_own_and_ambiguous_evidence(spark):
    e = spark.createDataFrame([(i, s, t, 1, 1, 1, 1, 0, False) for i, s, t in ((1, "s", 150), (2, "s", 250), (3, "t", 1), (4, None, 1), (5, "s", 250), (6, "u", 9))],
        "event_key long, session_key string, observed_at long, uncached_input_tokens long, cache_read_input_tokens long, cache_write_input_tokens long, output_tokens long, reasoning_output_tokens long, auxiliary boolean")
    rows = [ev("A", 1, 100), ev("B", 2, 200), ev("C", 3, 1, subject="t"), ("usage_event", "5", "account", "Z", "own", "src", "observed", "historical", 0, None, 1, 1, 4), ("usage_event", "6", "account", "Z", "own", "src", "observed", "historical", 99, None, 1, 1, 5)]
    closed = attribution.evidence_windows(spark.createDataFrame(rows, EVIDENCE))
    effective = spark.createDataFrame([("session", "s", "account", "ambiguous", None), ("session", "t", "account", "attributed", "C"), ("session", "u", "account", "attributed", "U"), ("usage_event", "5", "account", "attributed", "Z"), ("usage_event", "6", "account", "unattributed", None)],
        "subject_kind string, subject_id string, dimension string, state string, value string")
    found = usage.usage(e, "account", effective=effective, evidence=closed)
    assert sorted((r.key or "", r.state, r.requests) for r in found.rows.collect()) == [("", "unattributed", 2), ("A", "attributed", 1), ("B", "attributed", 1), ("C", "attributed", 1), ("Z", "attributed", 1)]
    roots = spark.createDataFrame([("A", "B"), ("B", "B")], "node string, root string")
    merged = usage.usage(e, "account", effective=effective, evidence=closed, roots=roots).rows.collect()
    assert {(r.key, r.requests) for r in merged if r.state == "attributed"} == {("B", 2), ("C", 1), ("Z", 1)}


def test_quality_of_parts(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None)], "k long, v string")
    assert [tuple(r) for r in quality.several(links, ["k"], "v").collect()] == [(1, 2)]
    e = spark.createDataFrame([(1, "s", 10, "m", 1, 1, None, 1, 3, False), (2, "s", 10, "m", 1, 1, 1, 4, 3, True)], "event_key long, session_key string, observed_at long, model string, uncached_input_tokens long, cache_read_input_tokens long, cache_write_input_tokens long, output_tokens long, reasoning_output_tokens long, auxiliary boolean")
    assert [tuple(r) for r in quality.violations(e, quality.usage_rules()).collect()] == [("reasoning above output", 1)]
    inner, outer = usage.usage(e, "model", include_auxiliary=False).total, usage.usage(e, "model").total
    assert quality.not_within(inner, outer).count() == 0 and quality.not_within(outer, inner).filter("measure = 'requests'").count() == 1


def test_merge_cycle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(identity, "MAX_ROUNDS", 4)
    with pytest.raises(ValueError, match="cycle"):
        identity.canonical_accounts(spark.createDataFrame([(1, 2, None), (2, 1, None)], "from_key long, into_key long, revoked_at long"))


def test_stalls(spark):
    row = lambda n, state, key, pid=1, hint=None, wait=None: ("p", n * 10, n, state, key, pid, hint, wait)
    rows = [row(1, "stalled", "a", wait=5), row(2, "stalled", "b", hint=99), row(3, "unknown", None), row(4, None, None), row(5, "stalled", "b"), row(6, "idle", None), row(7, "stalled", "b"), row(8, "stalled", "b", pid=2)]
    got = sequences.stalls(spark.createDataFrame(rows, "pane string, observed_at long, seq long, state string, error_key string, pane_pid long, reset_hint long, retry_after_ms long")).orderBy("onset").collect()
    assert [(r.onset, r.last_seen, r.error_key, r.resets_at) for r in got] == [(10, 10, "a", 15), (20, 50, "b", 99), (70, 70, "b", None), (80, 80, "b", None)]


def test_pairings(spark):
    rows = [("s1", "p", 1, 10, "sure"), ("s1", "p", 2, 20, "sure"), ("s1", "p", 4, 40, "sure"), ("s9", "p", 1, 10, "open_session_file"), ("s2", "q", 1, 10, "open_session_file"), ("s3", "q", 1, 10, "open_session_file"), ("s2", "q", 2, 20, "open_session_file")]
    got = sequences.live_pairings(spark.createDataFrame(rows, "session_key string, pane string, pass_no long, observed_at long, method string"))
    assert sorted((r.session_key, r.pane, r.first_observed_at, r.last_confirmed_at) for r in got.collect()) == [("s1", "p", 10, 20), ("s1", "p", 40, 40), ("s2", "q", 20, 20)]


def test_longest_prefix_on_boundaries(spark):
    sessions = spark.createDataFrame([("a", "/w/app/src"), ("b", "/w/application"), ("c", "/w"), ("d", "/"), ("e", None), ("f", "/w/app/")], "session_key string, cwd string")
    checkouts = spark.createDataFrame([("/w/app", "App"), ("/w/app/src/", None), ("/w", "W"), (None, "none")], "local_path string, display_name string")
    got = {r.session_key: r.project for r in paths.longest_prefix(sessions, "cwd", ["session_key"], checkouts).collect()}
    assert got == {"a": "src", "b": "W", "c": "W", "d": None, "e": None, "f": "App"}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k long, name string, live long")
    new = spark.createDataFrame([(1, None, None, 1), (2, "c", 3, 1), (2, None, 4, 2), (3, "d", None, 1)], "k long, name string, live long, seq long")
    got = {r.k: (r.name, r.live) for r in upserts.upsert_coalesce(old, new, ["k"], always=("live",)).collect()}
    assert got == {1: ("a", None), 2: ("c", 4), 3: ("d", None)}
    with pytest.raises(ValueError):
        upserts.upsert_by_rule(old, new, ["k"], "other")


def test_usage_adds_up(spark):
    e = spark.createDataFrame([(1, "s", 10, "m", 1, 1, None, 1, 0, False), (2, None, 20, None, 1, 2, 3, 4, 5, True), (3, "t", 30, "m", 5, 5, 5, None, None, False)],
        "event_key long, session_key string, observed_at long, model string, uncached_input_tokens long, cache_read_input_tokens long, cache_write_input_tokens long, output_tokens long, reasoning_output_tokens long, auxiliary boolean")
    u = usage.usage(e, "model")
    assert quality.usage_invariants(u.rows, u.total).count() == 0
    t = u.total.first()
    assert (t.requests, t.cache_write_input_tokens, t.unknown_cache_write_input_tokens, t.total_input_tokens, t.unknown_total_input, t.unknown_requests) == (3, 8, 1, 21, 1, 2)
    assert usage.usage(e, "model", 20, 30).total.first().requests == 1 and usage.usage(e, "model", include_auxiliary=False).total.first().requests == 2
    none = usage.usage(e.limit(0), "project", sessions=spark.createDataFrame([], "session_key string, cwd string"), checkouts=spark.createDataFrame([], "local_path string, display_name string"))
    assert none.rows.count() == 0 and tuple(none.shares.first()) == (None, None, None)
    with pytest.raises(ValueError):
        usage.usage(e, "nothing")


def test_capacity_views(spark):
    rows = spark.createDataFrame([("a", "1", "session", 85.0, 5000, "ok", "observed", 900), ("a", "1", "session", 10.0, 5000, "ok", "observed", 800), ("b", "2", "weekly", None, None, "ok", "observed", 100)],
        "source string, stream_key string, window string, used_pct double, resets_at long, status string, confidence string, observed_at long")
    eff = spark.createDataFrame([("a", "1", "session", 900, "attributed", "acct")], "source string, stream_key string, window string, observed_at long, state string, value string")
    got = {r.source: r for r in capacity.pools(rows, 1000, eff).collect()}
    assert (got["a"].remaining_pct, got["a"].account, got["a"].stale) == (15.0, "acct", False) and got["b"].account_label == "unattributed (b)" and got["b"].remaining_pct is None
    found = capacity.anchors(rows, 1000, 0, eff, {"a": 500})
    alerts, fired = capacity.threshold_alerts(found, 1000)
    assert [(r.account, r.threshold) for r in alerts.collect()] == [("acct", 20)]
    assert capacity.threshold_alerts(found, 1000, fired=fired)[0].count() == 0


def test_agents_pairing(spark):
    samples = spark.createDataFrame([("p", 100, 1, "h", None, "busy", "m", None, None, None), ("q", 100, 2, "h", "own", "idle", "m", None, None, None), ("r", 100, 3, "h", None, "idle", "m", None, None, None), ("old", 1, 0, "h", None, "idle", "m", None, None, None)],
        "pane string, observed_at long, seq long, harness string, session_key string, state string, model string, reset_hint long, error_key string, note string")
    pairs = spark.createDataFrame([("s1", "p", 90, None), ("s0", "p", 80, None), ("s2", "r", 90, None), ("s3", "r", 90, None)], "session_key string, pane string, last_confirmed_at long, valid_to long")
    got = {r.pane: (r.session_key, r.session_join) for r in agents.agents(samples, 110, pairs, window_ms=50).collect()}
    assert got == {"p": ("s1", "pane_evidence"), "q": ("own", "sample"), "r": (None, "ambiguous")}


def test_bookmarks_and_health(spark):
    looks = spark.createDataFrame([("me", "usage", 1, 2, 3)], "who string, view string, opened_at long, last_seen_at long, closed_at long")
    acts = spark.createDataFrame([("me", "usage", "open", 10, 1), ("me", "usage", "touch", 11, 2), ("you", "usage", "open", 5, 1), ("you", "usage", "close", 6, 2)], "who string, view string, action string, at long, seq long")
    got = {r.who: (r.since_ms, r.basis, r.assumed) for r in bookmarks.since_last_look(bookmarks.record_looks(looks, acts)).collect()}
    assert got == {"me": (11, "last_seen", True), "you": (6, "closed", False)}
    runs = spark.createDataFrame([(1, 10, 20, None), (2, 50, 60, None)], "run_id long, started_at long, heartbeat_at long, stopped_at long")
    status = spark.createDataFrame([("s", 55)], "source string, last_success_at long")
    assert health.pipeline_health(runs, status, 70).first().state == "running" and health.pipeline_health(runs, status, 90_000).first().state == "stalled"
    assert health.pipeline_health(runs.limit(0), status, 70).first().state == "never ran"


def test_costs(spark):
    costs = spark.createDataFrame([("request", "r1", "s", "list_price", "v1", 5), ("request", "r1", "s", "list_price", "v2", 7), ("session", "s", "s", "list_price", "v9", 99), ("session", "t", "t", "list_price", "v1", None)],
        "scope_kind string, scope_id string, session_key string, basis string, price_version string, cost_micro_usd long")
    r = trends.cost_rollup(costs, []).first()
    assert (r.cost_micro_usd, r.unknown_costs) == (7, 1)


SCREENS = [
    ("ruled", "talk\n────────────\n❯ \n────────────\n Opus 4.1", "idle"), ("ruled", "no box", "unknown"), ("ruled", "x\n────────────\n❯ typed\n────────────", "typing"),
    ("ruled", "✳ Working… (55s · x)\n────────────\n❯ \n────────────", "busy"), ("ruled", "You've hit your session limit · resets 3pm\n────────────\n❯ \n", "stalled"),
    ("ruled", "usage limit reached · continuing automatically at 3:30 pm\n────────────\n❯ \n", "resuming"), ("ruled", "you've reached your context limit\n────────────\n❯ \n", "idle"),
    ("arrow", "You've hit your usage limit for big-1. try again at 10:29 PM.\n› ", "stalled"), ("arrow", "• Working (esc to interrupt)\n› ", "busy"), ("arrow", "› hello", "typing"), ("arrow", "nothing", "unknown"),
    ("boxed", "Error: 429 rate_limit_error\n{\"request_id\":\"req_1\"} retry-after-ms=5000\n TODO\n╭── π > ◒ Large > x\n╰──", "stalled"), ("boxed", "Error: 429 x\nmoved on\n╭── π > ◒ Large >\n╰──", "idle"),
    ("boxed", "╭── ⠴ 18s > ◒ Large >\n╰──", "busy"), ("boxed", "╭── π > x\n│ hello │\n╰──", "typing"), ("boxed", "", "unknown"),
]


def test_screens(spark):
    table = spark.createDataFrame([(i, a, b, None) for i, (a, b, _) in enumerate(SCREENS)] + [(99, "ruled", "x\n────────────\n❯ hint\n──", "x\n❯ \x1b[2mhint\x1b[0m"), (98, "ruled", "x\n────────────\n❯ hint real\n──", "x\n❯ \x1b[2mhint\x1b[;m real")], "n long, layout string, plain string, styled string")
    got = {r.n: r.reading for r in screens.classify(table).collect()}
    assert [got[i].state for i in range(len(SCREENS))] == [s for _, _, s in SCREENS] and got[99].state == "idle" and got[98].state == "typing"
    assert got[4].reset_text == "3pm" and got[7].model == "big-1." and got[7].reset_text == "10:29 PM" and len(got[4].error_key) == 12
    assert (got[11].error_key, got[11].retry_after_ms, got[11].model) == ("req_1", 5000, "Large")


@pytest.mark.parametrize("text, expected", [
    ("10:29 PM", "2026-09-01 22:29"), ("3pm", "2026-09-01 15:00"), ("3 p.m.", "2026-09-01 15:00"), ("9:00 AM", "2026-09-02 09:00"), ("9:01am", "2026-09-01 09:01"), ("12 AM", "2026-09-02 00:00"),
    ("Oct 2, 2026 10:29 PM", "2026-10-02 22:29"), ("Feb 30, 2026 10:29 PM", None), ("Oct 2, 2026 3pm", None), ("13:00 PM", None), ("9:61 AM", None), ("soon", None), ("", None), (None, None)])
def test_clock_times(spark, text, expected):
    """The clock shows half a minute past nine; a time that is not after it is tomorrow's."""
    at = int(datetime(2026, 9, 1, 9, 0, 30, tzinfo=ZoneInfo("Europe/Berlin")).timestamp() * 1000)
    row = spark.createDataFrame([(text, at)], "text string, at long").select(scalars.next_clock_time(F.col("text"), F.col("at"), "Europe/Berlin").alias("t")).first()
    assert row.t == (int(datetime.fromisoformat(expected).replace(tzinfo=ZoneInfo("Europe/Berlin")).timestamp() * 1000) if expected else None)


def test_screen_keys_and_reset_times(spark):
    text = "You've hit your usage limit. try again at 10:29 PM.\n› "
    rows = spark.createDataFrame([("arrow", text, None, "one", 0), ("arrow", text, None, "two", 0), ("arrow", "› ", None, "one", 0)], "layout string, plain string, styled string, program string, at long")
    one, two, idle = [r.reading for r in screens.classify(rows, harness="program", at="at", zone="UTC").orderBy(F.length("plain").desc(), "program").collect()]
    assert one.state == two.state == "stalled" and one.error_key != two.error_key
    assert one.reset_hint == (22 * 60 + 29) * 60_000 and idle.state == "idle" and idle.reset_hint is None and idle.error_key is None


def test_scalars(spark):
    urls = {"git@host.com:Org/Repo.git": "host.com/org/repo", "https://u:p@Host.com:8443/org/repo/": "host.com/org/repo", "ssh://git@host/a/b.git": "host/a/b", "/local/path": None, "file:///x": None, "https://host": None, "": None}
    got = {r.u: r.n for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", scalars.normalise_remote(F.col("u")).alias("n")).collect()}
    assert got == urls
    row = spark.range(1).select(
        scalars.iso_ms(F.lit("2026-09-01T10:00:00")).alias("a"), scalars.iso_ms(F.lit("2026-09-01T10:00:00"), "utc").alias("b"), scalars.iso_ms(F.lit("2026-09-01T10:00:00"), "America/New_York").alias("c"),
        scalars.iso_ms(F.lit("2026-09-01T12:00:00+02:00")).alias("d"), scalars.iso_ms(F.lit("soon")).alias("e"), scalars.epoch_ms(F.lit(1788256800)).alias("f"), scalars.epoch_ms(F.lit(1788256800000)).alias("g"), scalars.epoch_ms(F.lit(0)).alias("h"),
        scalars.window_by_seconds(F.lit(18000)).alias("i"), scalars.window_by_seconds(F.lit(60)).alias("j"), scalars.pane_id(F.lit("main:@3.%12")).alias("k"), scalars.pane_id(F.lit("bad")).alias("l"),
        scalars.age_text(F.lit(3725)).alias("m"), scalars.account_label(F.lit(None), F.lit("p"), F.lit("abcdefgh")).alias("n"), scalars.local_day(F.lit(1788256800000), "Pacific/Auckland").alias("o"),
        scalars.redact(F.lit('at /home/me x "request_id":"r1" a.b@c.de'), "/home/me").alias("p"), scalars.model_family(F.lit("GPT-9"), {"x": "opus", "y": "gpt"}).alias("q")).first()
    ms = 1788256800000
    assert tuple(row) == (None, ms, ms + 4 * 3_600_000, ms, None, ms, ms, None, "session", "other:60s", "%12", None, "1h 2m", "p account abcdef", "2026-09-01", 'at ~ x "request_id":"req_REDACTED" user@example.com', "y")
    assert scalars.parse_since("2h", 10_000_000) == 10_000_000 - 7_200_000 and scalars.parse_since("2026-09-01T10:00:00", 0) == ms
