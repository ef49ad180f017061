"""Scalar column functions: all of them expressions that stay in the JVM."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.schemas import CONFIDENCE, INPUT_PARTS

_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def keyed_hash(secret: bytes, namespace: str, raw: Column) -> Column:
    """First 16 hex digits of HMAC-SHA256 of ``namespace:raw``; null for null or empty input. A colon
    in the namespace's own part would make keys ambiguous, so it is refused."""
    if not secret or namespace.count(":") > 1:
        raise ValueError("a secret is needed, and a namespace of at most two parts")
    key = secret if len(secret) <= 64 else __import__("hashlib").sha256(secret).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    message = F.encode(F.concat(F.lit(f"{namespace}:"), raw), "utf-8")
    digest = F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)
    return F.when(raw != "", F.substring(digest, 1, 16))


def normalise_remote(url: Column) -> Column:
    """``host/path`` of a repository URL, lower case, without scheme, credentials, port and ``.git``;
    null where there is no host or no path. ``user@host:path`` equals ``https://host/path``."""
    text = F.trim(url)
    schemed = text.contains("://")
    authority = F.regexp_extract(text, r"^[^:/?#]+://([^/?#]*)", 1)
    host = F.when(schemed, F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:@]*)(?::\d*)?$", 1)).otherwise(F.regexp_extract(text, r"^(?:[^@/]+@)?([^/:]+):", 1))
    path = F.when(schemed, F.regexp_extract(text, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(text, r"^(?:[^@/]+@)?[^/:]+:(.*)$", 1))
    path = F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"(?i)/*\.git$", "")
    return F.when((host != "") & (path != ""), F.lower(F.concat(host, F.lit("/"), path)))


def iso_ms(text: Column, naive: str = "reject") -> Column:
    """Milliseconds of an ISO time. Without a zone it is null ("reject"), UTC ("utc") or of a named
    zone (any other value)."""
    zoned = text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    aware = F.unix_millis(F.try_to_timestamp(text))
    if naive == "reject":
        return F.when(zoned, aware)
    plain = F.unix_millis(F.try_to_timestamp(F.concat(text, F.lit("Z"))))
    if naive != "utc":
        plain = F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(plain), naive))
    return F.when(zoned, aware).otherwise(plain)


def epoch_ms(number: Column) -> Column:
    """Seconds or milliseconds as milliseconds: below 1e11 it is seconds; zero and less is null."""
    n = number.cast("long")
    return F.when(n <= 0, F.lit(None)).when(n < 100_000_000_000, n * 1000).otherwise(n)


def local_time(ms: Column, zone: str) -> Column:
    """What a clock in ``zone`` shows at a time, as a timestamp without zone: independent of the session's."""
    utc = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_ms(shown: Column, zone: str) -> Column:
    """The time at which a clock in ``zone`` shows this."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), shown)
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), utc)


def local_day(ms: Column, zone: str) -> Column:
    return F.to_date(local_time(ms, zone)).cast("string")


def next_wall_clock(hour12: Column, minute: Column, half: Column, at_ms: Column, zone: str) -> Column:
    """First time at or after the minute of ``at_ms`` that a clock in ``zone`` shows ``hour12:minute
    half`` (a or p); null outside 1-12 and 0-59."""
    hour = hour12 % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)
    local = local_time(at_ms, zone)
    midnight = F.to_date(local).cast("timestamp_ntz")
    wanted = (hour * 60 + minute).cast("int")
    now = F.floor(F.timestamp_diff("SECOND", midnight, local) / 60)
    shown = F.timestamp_add("MINUTE", wanted, F.timestamp_add("DAY", F.when(wanted < now, 1).otherwise(0), midnight))
    return F.when(hour12.between(1, 12) & minute.between(0, 59), local_ms(shown, zone))


def next_clock_time(text: Column, at_ms: Column, zone: str) -> Column:
    """The time that a text such as ``10:29 PM``, ``3 p.m.`` or ``Oct 2, 2026 10:29 PM`` names in ``zone``:
    without a date the next one after ``at_ms``; null for any other text."""
    shown = F.upper(F.replace(F.trim(text), F.lit("."), F.lit("")))
    pattern = r"^(?:([A-Z]{3})\s+(\d{1,2}),\s+(\d{4})\s+(?=\d{1,2}:\d{2}\s+[AP]M$))?(\d{1,2})(?::(\d{2}))?\s*([AP])M$"
    part = lambda i: F.regexp_extract(shown, pattern, i)
    hour12, minute = part(4).try_cast("int"), F.coalesce(part(5).try_cast("int"), F.lit(0))
    minutes = F.when(hour12.between(1, 12) & minute.between(0, 59), (hour12 % 12 + F.when(part(6) == "P", 12).otherwise(0)) * 60 + minute)
    months = F.array(*[F.lit(m) for m in ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")])
    day = F.try_make_timestamp_ntz(part(3).try_cast("int"), F.array_position(months, part(1)).cast("int"), part(2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    local = local_time(at_ms, zone)
    midnight = F.to_date(local).cast("timestamp_ntz")
    next_day = F.when(F.timestamp_add("MINUTE", minutes, midnight) > local, 0).otherwise(1)
    begin = F.when(part(1) != "", day).otherwise(F.timestamp_add("DAY", next_day, midnight))
    return local_ms(F.timestamp_add("MINUTE", minutes, begin), zone)


def window_by_seconds(seconds: Column) -> Column:
    """``session`` for five hours, ``weekly`` for seven days, else ``other:<seconds>s``."""
    return F.when(seconds == 18_000, "session").when(seconds == 604_800, "weekly").otherwise(F.concat(F.lit("other:"), seconds.cast("string"), F.lit("s")))


def window_of_limit(duration_ms: Column, window_id: Column, model: Column) -> Column:
    """The window a limit is of: by its length, else its own name; a model is a suffix."""
    named = F.when(window_id != "", F.concat(F.lit("other:"), window_id)).otherwise(F.lit("other:unstated"))
    base = F.when(duration_ms == 18_000_000, "session").when(duration_ms == 604_800_000, "weekly").otherwise(named)
    return F.when(model != "", F.concat_ws(":", base, F.lower(model))).otherwise(base)


def window_by_key(key: Column, known: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, window in known.items():
        out = F.when(key == name, window).otherwise(out)
    return out


def session_key(harness: Column, session_id: Column) -> Column:
    return F.concat_ws(":", harness, F.when(session_id != "", session_id))


def subject_key(*parts: Column) -> Column:
    """Parts joined by a bar; null if any is null."""
    return F.concat(*[x for p in parts for x in (F.lit("|"), p)][1:])


def total_input() -> Column:
    """Sum of the three input parts, null if any is."""
    a, b, c = map(F.col, INPUT_PARTS)
    return a + b + c


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(0)
    for name, rank in CONFIDENCE.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def redact(text: Column, home: str | None = None) -> Column:
    """Home folder, request identifiers and mail addresses made neutral."""
    out = F.replace(text, F.lit(home), F.lit("~")) if home else text
    out = F.regexp_replace(out, r'"request_id":"[^"]+"', '"request_id":"req_REDACTED"')
    return F.regexp_replace(out, r"[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+", "user@example.com")


def key_of(*parts: Column) -> Column:
    """Twelve hex digits of SHA-1 over the parts, a line each."""
    return F.substring(F.sha1(F.encode(F.concat_ws("\n", *parts), "utf-8")), 1, 12)


def model_family(model: Column, families: dict[str, str]) -> Column:
    """The first family whose pattern the lower-case name holds."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(families.items()):
        out = F.when(F.lower(model).rlike(pattern), name).otherwise(out)
    return out


def pane_id(field: Column) -> Column:
    """``%N`` of a multiplexer field ``name:@N.%N``; null for any other form."""
    found = F.regexp_extract(field, r"^[^:]*:@\d+\.(%\d+)$", 1)
    return F.when(found != "", found)


def account_label(label: Column, provider: Column, key: Column) -> Column:
    """The account's label, else its provider and the first six digits of its key."""
    return F.coalesce(label, F.concat(F.coalesce(provider, F.lit("unknown")), F.lit(" account "), F.substring(key, 1, 6)))


def age_text(seconds: Column) -> Column:
    """An age as people say it: seconds, minutes, hours and minutes, days and hours."""
    s = F.floor(seconds).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm", F.floor(s / 60).cast("long")))
        .when(s < 86_400, F.format_string("%dh %dm", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")))
        .otherwise(F.format_string("%dd %dh", F.floor(s / 86_400).cast("long"), F.floor(s % 86_400 / 3600).cast("long")))
    )


def until_text(ms: Column, now: Column) -> Column:
    """How long until a time: days and hours, hours and minutes, minutes; ``now`` if it has come, empty if it is unknown."""
    s = F.floor((ms - now) / 1000).cast("long")
    minutes, hours = F.floor(s / 60).cast("long") % 60, F.floor(s / 3600).cast("long")
    return (
        F.when(ms.isNull(), "").when(s <= 0, "now").when(hours >= 24, F.format_string("%dd%dh", F.floor(hours / 24).cast("long"), hours % 24))
        .when(hours > 0, F.format_string("%dh%02dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))
    )


def clock_text(ms: Column, now: Column, zone: str = "UTC") -> Column:
    """A time on a zone's clock, with the day of the week if it is not today; ``-`` if it is unknown."""
    at = local_time(ms, zone)
    here = F.to_date(at) == F.to_date(local_time(now, zone))
    return F.when(ms.isNull(), "-").when(here, F.date_format(at, "HH:mm")).otherwise(F.date_format(at, "EEE HH:mm"))


def parse_since(text: str, now_ms: int) -> int:
    """``24h``, ``7d``, ``30m``, ``90s``, ``2w`` before now, or an ISO time, as milliseconds."""
    if found := re.fullmatch(r"(\d+)([smhdw])", text.strip()):
        return now_ms - int(found[1]) * _MS[found[2]]
    at = datetime.fromisoformat(text.strip())
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def ancestors(path: Column) -> Column:
    """A path and every folder above it, longest first, without the root."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.filter(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda p: p != "")
