"""Canonical tables. Times are UTC milliseconds; an absent count is null, never 0."""

from __future__ import annotations

TOKEN_FIELDS = ("uncached_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")
#: A request is unknown if any of these is; reasoning is part of output already.
COMPONENTS = TOKEN_FIELDS[:4]
INPUT_PARTS = TOKEN_FIELDS[:3]

USAGE_OBSERVATIONS = (
    "source string, stream_key string, source_request_key string, provider_request_key string, confidence string, observed_at long, "
    "harness string, provider string, model string, session_key string, uncached_input_tokens long, cache_read_input_tokens long, "
    "cache_write_input_tokens long, output_tokens long, reasoning_output_tokens long, native map<string,double>, auxiliary boolean")
ATTRIBUTION_EVIDENCE = (
    "subject_kind string, subject_id string, dimension string, value string, method string, source string, confidence string, validity string, "
    "valid_from long, valid_to long, first_observed_at long, last_confirmed_at long, arrival_seq long")
EFFECTIVE_ATTRIBUTIONS = "subject_kind string, subject_id string, dimension string, state string, value string, confidence string, evidence_id long, note string"
CAPACITY_SAMPLES = "source string, stream_key string, window string, used_pct double, window_seconds long, resets_at long, status string, confidence string, observed_at long"
LIMIT_EVENTS = "source string, stream_key string, source_key string, kind string, confidence string, observed_at long, window string, resets_at long"
STATE_SAMPLES = "pane string, observed_at long, harness string, session_key string, state string, model string, reset_hint long, error_key string, note string, source string"
SESSIONS = "session_key string, harness string, session_id string, parent_session_key string, started_at long, last_seen_at long, cwd string"
CHECKOUTS = "checkout_id string, repository_id string, display_name string, local_path string, non_repo boolean"

#: Higher is surer.
CONFIDENCE = {"authoritative": 3, "observed": 2, "inferred": 1}
STATES = ("busy", "idle", "stalled", "resuming", "typing", "unknown")
WINDOW_PATTERN = r"^(session|weekly|weekly:.+|other:.+)$"
#: Longest age, in ms, at which a reading is still shown as current; the default is for other sources.
DISPLAY_AGE_MS: dict[str, int] = {}
DEFAULT_DISPLAY_AGE_MS = 15 * 60_000
