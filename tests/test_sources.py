"""Readers on recorded shapes of logs, with exact rows."""

import json

import pytest
from pyspark.sql import functions as F

from meterlake import queries as registered
from meterlake.sources import rollout, session_log, snapshots, telemetry, transcript

SECRET = b"s" * 32


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def say(sid, at, mid, output, request="r1", **more):
    usage = {"input_tokens": 10, "cache_read_input_tokens": 20, "cache_creation_input_tokens": 30, "output_tokens": output, **more.pop("usage", {})}
    return {"type": "assistant", "sessionId": sid, "timestamp": at, "requestId": request, "cwd": "/w", "message": {"id": mid, "model": more.pop("model", "m"), "usage": usage}, **more}


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("transcripts")
    write(folder / "p" / "s1.jsonl", [
        {"type": "user", "sessionId": "s1", "timestamp": "2026-09-01T10:00:00Z", "cwd": "/work/a", "gitBranch": "main"},
        say("s1", "2026-09-01T10:00:01Z", "a", 2), "not json", "[1, 2]", "", {"type": "assistant", "timestamp": "2026-09-01T10:00:02Z"},
        say("s1", "2026-09-01T10:00:05.500Z", "a", 120, gitBranch="feature/x", usage={"output_tokens_details": {"thinking_tokens": 7}}),
        say("s1", "2026-09-01T10:00:06Z", "a", 120), say("s1", "2026-09-01T10:00:07Z", "b", 5, request=None, usage={"input_tokens": True, "cache_read_input_tokens": 1.5, "cache_creation_input_tokens": None}),
        say("s1", "2026-09-01T10:00:08", "naive", 5), say("s1", "2026-09-01T10:00:08Z", "", 5), say("s1", "2026-09-01T10:00:09Z", "x", 5, model="<synthetic>"),
        {"type": "assistant", "sessionId": "s1", "timestamp": "2026-09-01T10:01:00Z", "error": "rate_limit", "uuid": "u1", "quotaLimits": {"rateLimitType": "five_hour", "resetsAt": 1788260400}},
        {"type": "system", "subtype": "informational", "sessionId": "s1", "timestamp": "2026-09-01T14:00:00Z", "uuid": "u2", "content": "usage limit reached · continuing automatically at 3:30 pm"},
        {"type": "system", "subtype": "informational", "sessionId": "s1", "timestamp": "2026-09-01T20:00:00Z", "uuid": "u3", "content": "weekly limit reset"},
        {"type": "bridge-session", "sessionId": "s1", "timestamp": "2026-09-01T10:00:00Z", "ownerAccountUuid": "acc", "ownerOrganizationUuid": "org"}])
    write(folder / "p" / "s1" / "subagents" / "agent-1.jsonl", [say("s2", "2026-09-01T11:00:00Z", "a", 120), say("s1", "2026-09-01T11:00:01Z", "c", None)])
    return transcript.parsed(transcript.read_lines(spark, str(folder)))


def test_transcript_requests(log):
    got = {r.source_request_key: r for r in transcript.observations(log, "t", "h", "p", SECRET).collect()}
    assert set(got) == {"a+r1", "b+", "c+r1"}
    a = got["a+r1"]
    assert (a.output_tokens, a.reasoning_output_tokens, a.session_key, a.observed_at) == (120, 7, "h:s1", 1788256805500)
    assert (a.uncached_input_tokens, a.cache_read_input_tokens, a.cache_write_input_tokens) == (10, 20, 30)
    b = got["b+"]
    assert (b.uncached_input_tokens, b.cache_read_input_tokens, b.cache_write_input_tokens, b.reasoning_output_tokens, b.provider_request_key) == (None,) * 5
    assert got["c+r1"].output_tokens is None and len(a.provider_request_key) == 16


def test_transcript_limits_branches_owners(log):
    limits = {r.source_key: r for r in transcript.limit_events(log, "t", "UTC").collect()}
    assert {k: (v.kind, v.window) for k, v in limits.items()} == {"u1": ("hit", "session"), "u2": ("hit", None), "u3": ("reset", "weekly")}
    assert limits["u1"].resets_at == 1788260400000 and limits["u2"].resets_at == 1788276600000 and limits["u3"].resets_at is None
    branches = [(r.branch, r.valid_from) for r in transcript.branch_changes(log, "h").orderBy("valid_from").collect()]
    assert branches == [("main", 1788256800000), ("feature/x", 1788256805500)]
    assert transcript.owners(log, "h", "p", SECRET).count() == 1
    sessions = {r.session_id: r for r in transcript.sessions(log, "h").collect()}
    assert sessions["s1"].cwd == "/w" and sessions["s1"].started_at == 1788256800000


def optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(1, ' \t{"type": "a", "n": 1}'), (2, '["a"]'), (3, '"a"'), (4, '{"type": "b"}'), (5, '{"type": "a"'), (6, "  "), (7, None), (8, "{}"), (9, "null")], "line long, value string")
    rows = transcript.parsed(lines)
    assert rows.columns == ["line", "v"] and sorted(r.line for r in rows.select("line").collect()) == [1, 4, 8]
    typed = rows.filter(transcript.text_at("$.type") == "a").filter(transcript.int_at("$.n").isNotNull())
    assert [r.line for r in typed.select("line").collect()] == [1] and optimized(typed).count("parseJson") == 1


def test_queries_read_written_lines(spark):
    for name in ("session_logins", "session_parents", "limit_events", "parse_roundtrip_transcript", "parse_roundtrip_session", "rollout_capacity", "rollout_roundtrip", "rollout_headers"):
        assert "to_json" not in optimized(registered.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_next_clock_time_over_midnight(spark):
    from meterlake.functions.scalars import next_wall_clock

    at = 1788276600000  # 15:30 in UTC, 11:30 in New York
    row = spark.range(1).select(*[next_wall_clock(F.lit(h), F.lit(m), F.lit(x), F.lit(at), z).alias(f"c{i}") for i, (h, m, x, z) in enumerate([(3, 30, "p", "UTC"), (3, 0, "p", "UTC"), (12, 0, "a", "UTC"), (11, 30, "A", "America/New_York"), (13, 0, "a", "UTC"), (1, 60, "a", "UTC")])]).first()
    assert tuple(row) == (at, at - 1_800_000 + 86_400_000, at + 8.5 * 3_600_000, at, None, None)


def counter(at, total, i, c, w, o, r, **more):
    usage = {"input_tokens": i, "cached_input_tokens": c, "cache_write_input_tokens": w, "output_tokens": o, "reasoning_output_tokens": r, "total_tokens": total}
    return {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {k: v for k, v in usage.items() if v is not None}}, **more}}


def test_rollout(spark, tmp_path):
    limits = lambda used: {"rate_limits": {"primary": {"used_percent": used, "window_minutes": 300, "resets_at": 1788260400}, "secondary": {"used_percent": 9.0, "window_minutes": 60, "resets_at": 1788260400}}}
    at = "2026-09-01T10:00:0%dZ"
    write(tmp_path / "2026" / "rollout-1.jsonl", [
        {"timestamp": at % 0, "type": "session_meta", "payload": {"id": "s1", "cwd": "/w", "git": {"branch": "main"}, "timestamp": at % 0}},
        {"timestamp": at % 0, "type": "session_meta", "payload": {"id": "parent", "git": {"branch": "other"}}},
        {"timestamp": at % 1, "type": "turn_context", "payload": {"model": "big"}}, {"timestamp": at % 1, "type": "response_item", "payload": {}},
        counter(at % 1, 1100, 1000, 800, 0, 100, 40, **limits(10.0)), counter(at % 2, 1100, 1000, 800, 0, 100, 40, **limits(10.0)),
        {"timestamp": at % 3, "type": "event_msg", "payload": {"type": "token_count", "info": None}}, counter(at % 4, 3300, 3000, 2500, 0, 300, 100, **limits(12.5)),
        counter(at % 5, 550, 500, 0, 0, 50, 0), {"timestamp": at % 6, "type": "turn_context", "payload": {"model": "small"}}, counter(at % 7, 780, 700, 100, None, 80, 10)])
    write(tmp_path / "2026" / "rollout-2.jsonl", [counter(at % 1, 10, 8, 0, 0, 2, 0)])
    rows = transcript.parsed(transcript.read_lines(spark, str(tmp_path)), rollout.MUST_HOLD)
    got = rollout.observations(rows, "r", "h", "p").orderBy("session_key", "observed_at").collect()
    own = [r for r in got if r.session_key]
    assert [(r.uncached_input_tokens, r.cache_read_input_tokens, r.cache_write_input_tokens, r.output_tokens, r.reasoning_output_tokens, r.model) for r in own] == [
        (200, 800, 0, 100, 40, "big"), (300, 1700, 0, 200, 60, "big"), (100, 100, 0, 30, 10, "small")]
    assert {r.session_key for r in own} == {"h:s1"} and len(got) == 4
    assert next(r for r in got if not r.session_key).stream_key != "h:s1"
    capacity = rollout.capacity(rows, "r").orderBy("observed_at", "window").collect()
    assert [(c.window, c.used_pct) for c in capacity] == [("other:3600s", 9.0), ("session", 10.0), ("session", 12.5)]
    assert [(r.branch, r.valid_from) for r in rollout.branches(rows, "h").collect()] == [("main", 0)]


def test_rollout_parses_each_line_once(spark):
    head = lambda name, branch: {"timestamp": "2026-09-01T10:00:00Z", "type": "session_meta", "payload": {"id": name, "git": {"branch": branch}}}
    at = "2026-09-01T10:00:01Z"
    odd = [{"timestamp": at, "type": "event_msg", "payload": p} for p in ("token_count", ["token_count"], {"type": "token_count", "info": 5}, {"type": "token_count", "info": {"total_token_usage": "5"}})]
    lines = [*odd, counter(at, 10, 8, "4", True, 2, 0.5), counter(at, "20", 9, 4, 0, 3, 1), {"type": "turn_context", "payload": {"model": 5}}, counter(at, 30, 9, 4, None, 3, 1), counter(5, 40, 9, 4, 0, 3, 1), head(7, "no"), head("s1", "main"), head("s2", "other"), head("s1", "next")]
    rows = transcript.parsed(spark.createDataFrame([("a", i, json.dumps(x)) for i, x in enumerate(lines)] + [("b", 0, json.dumps(counter(at, 1, 1, 1, 0, 1, 1)))], "file string, line long, value string"), rollout.MUST_HOLD)
    found = rollout.observations(rows, "r", "h", "p")
    got = [(r.session_key, r.source_request_key.split("|")[1], r.model, r.uncached_input_tokens, r.cache_read_input_tokens, r.output_tokens, r.reasoning_output_tokens) for r in found.collect()]
    assert sorted(got, key=lambda r: int(r[1])) == [(None, "1", None, 0, 1, 1, 1), ("h:s1", "10", None, None, None, 2, None), ("h:s1", "30", None, None, None, 1, None)]
    branches = rollout.branches(rows, "h")
    assert sorted((r.session_key, r.branch) for r in branches.collect()) == [("h:s1", "main"), ("h:s1", "next")]
    for df in (found, branches):
        assert optimized(df).count("parseJson") == 1 and "Join" not in optimized(df)


def test_session_log(spark, tmp_path):
    usage = {"input": 1, "output": 2, "cacheRead": 3, "cacheWrite": 4, "totalTokens": 10, "reasoningTokens": None, "cost": {"total": 0.5}}
    at = "2026-09-01T10:00:0%dZ"
    parent = tmp_path / "proj" / "a.jsonl"
    say = lambda i, n, cred: {"type": "message", "id": i, "timestamp": at % n, "message": {"role": "assistant", "provider": "openai-x", "model": "m", "timestamp": 1788256800000 + n, "credentialId": cred, "usage": usage, "content": "private"}}
    write(parent, [{"type": "session", "id": "p1", "timestamp": at % 0, "cwd": "/w"}, say("e1", 1, 7), say("e2", 2, 7), say("e3", 3, 8), say("e4", 4, 9), {"type": "model_usage", "id": "e5", "timestamp": at % 5, "provider": "q", "model": "n", "usage": usage},
                   {"type": "message", "id": "e6", "message": {"role": "user"}}])
    write(tmp_path / "proj" / "a" / "0-Task.jsonl", [{"type": "session", "id": "c1", "parentSession": str(parent), "timestamp": at % 0}, say("e7", 6, None)])
    rows = transcript.parsed(transcript.read_lines(spark, str(tmp_path)), session_log.MUST_HOLD)
    heads = {r.session_id: r.parent_session_key for r in session_log.headers(rows, "h").collect()}
    assert heads == {"p1": None, "c1": "h:p1"}
    got = {r.source_request_key: r for r in session_log.observations(rows, "s", "h", {"openai-x": "openai"}).collect()}
    assert set(got) == {"e1", "e2", "e3", "e4", "aux:e5", "e7"} and got["aux:e5"].auxiliary and not got["e1"].auxiliary
    e = got["e1"]
    assert (e.uncached_input_tokens, e.output_tokens, e.reasoning_output_tokens, e.provider, e.observed_at, e.session_key) == (1, 2, None, "openai", 1788256800001, "h:p1")
    assert e.native["cost.total"] == 0.5 and "reasoningTokens" not in e.native and got["e7"].session_key == "h:c1"
    assert "private" not in json.dumps([r.asDict() for r in got.values()])
    logins = spark.createDataFrame([(7, "openai", "mail:a", "secret"), (8, "openai", None, "secret"), (9, "openai", "mail:b", "secret")], "id long, provider string, identity_key string, token string")
    evidence = session_log.account_evidence(rows, "h", logins, SECRET).orderBy("valid_from").collect()
    assert [r.valid_from - 1788256800000 for r in evidence] == [1, 4] and evidence[0].account.startswith("alias:openai:login:") and "mail" not in str(evidence)


def test_snapshots(spark):
    one = json.dumps({"oauthAccount": {"accountUuid": "a"}, "cachedUsageUtilization": {"fetchedAtMs": 5, "accountUuid": "a", "utilization": {"five_hour": {"utilization": 12.0, "resets_at": "2026-09-01T10:00:00Z"}, "seven_day": {"utilization": None}, "seven_day_sonnet": {"utilization": 3.0}, "odd": {"utilization": 1.0}, "seven_day_opus": None}}})
    got = {r.window: r for r in snapshots.cached_utilization(spark.createDataFrame([("k", one)], "stream_key string, value string"), "c").collect()}
    assert set(got) == {"session", "weekly", "weekly:sonnet"} and got["session"].used_pct == 12.0 and got["session"].account == "a" and got["session"].resets_at == 1788256800000
    assert snapshots.cached_utilization(spark.createDataFrame([("k", one)], "stream_key string, value string"), "c", 5).count() == 0
    two = json.dumps({"session_id": "s", "observed_at": 9, "rate_limits": {"five_hour": {"used_percentage": 5.0, "resets_at": 1788256800}, "spend_limit": {"used_percentage": 1.0}, "new": {"used_percentage": 2.0}}})
    files = spark.createDataFrame([("f", two)], "file string, value string")
    assert {(r.window, r.used_pct, r.resets_at) for r in snapshots.statusline(files, "l").collect()} == {("session", 5.0, 1788256800000), ("other:spend_limit", 1.0, None)}
    assert snapshots.statusline(files, "l", spark.createDataFrame([("f", 9)], "file string, observed_at long")).count() == 0
    limit = lambda d, used, **scope: {"id": "x", "scope": scope, "window": {"id": "w", "durationMs": d, "resetsAt": 1788256800000}, "amount": {"usedFraction": used}, "status": "ok"}
    report = lambda at: {"provider": "p", "fetchedAt": at, "limits": [limit(18_000_000, 0.25), limit(604_800_000, 0.5, tier="Fable"), limit(1, 1.0)]}
    cache = [("usage_cache:report:a", json.dumps({"value": report(7), "expiresAt": 1})), ("usage_cache:report:a", json.dumps(report(8))), ("other:b", json.dumps(report(9)))]
    got = {(r.window, r.used_pct, r.observed_at) for r in snapshots.usage_reports(spark.createDataFrame(cache, "key string, value string"), "u").collect()}
    assert got == {("session", 25.0, 8), ("weekly:fable", 50.0, 8), ("other:w", 100.0, 8)}


def test_telemetry_never_counts_metrics(spark):
    rows = [(1, "span", 5, {"request_id": "r", "input_tokens": "3", "model": "m"}), (2, "metric", 5, {"request_id": "r", "input_tokens": "99"}), (3, "event", 5, {"input_tokens": "1"}), (4, "event", 5, None)]
    got = telemetry.observations(spark.createDataFrame(rows, "event_id long, kind string, observed_at long, attributes map<string,string>"), "otel", "p", SECRET).collect()
    assert [(r.source_request_key, r.uncached_input_tokens, r.output_tokens, r.primary) for r in got] == [("1", 3, None, False)]
