"""The status of streams from the streams themselves: a record for each batch, and for each failure its kind, never a value."""

from __future__ import annotations

import re
import threading
from collections import deque
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: What :func:`meterlake.plans.health.batch_status` reads.
RECORDS = "source string, at long, batch long, items long, error_kind string"
_CLASS = re.compile(r"([A-Za-z_][\w.]*(?:Error|Exception|Failure|Warning|Interrupt))\b(?=\s*(?::|\(|$|\n))")
_CONDITION = re.compile(r"\[([A-Z][A-Z0-9_]*(?:\.[A-Z0-9_]+)*)\]")
_FIELD = re.compile(r"(?i:\bcolumn\b|\bfield\b|\battribute\b)[^\n`\"']{0,40}[`\"']([A-Za-z_]\w*)[`\"']")


def error_kind(message: str | None, fields: frozenset[str] = frozenset()) -> str | None:
    """``kind`` or ``kind at field`` of an error's text: the innermost exception's class, else the error condition, and the field only
    if it is among the known ``fields``. Nothing else of the text is kept, as it may hold values."""
    if message is None:
        return None
    classes = [c.rsplit(".", 1)[-1] for c in _CLASS.findall(message)]
    plain = [c for c in classes if c not in ("Py4JException", "Py4JJavaError", "StreamingQueryException", "SparkException", "PythonException", "ForeachBatchUserFuncException")]
    conditions = [c for c in _CONDITION.findall(message) if c not in ("STREAM_FAILED", "FOREACH_BATCH_USER_FUNCTION_ERROR")]
    kind = plain[-1] if plain else conditions[-1] if conditions else classes[-1] if classes else "unknown"
    field = next((f for f in _FIELD.findall(message) if f in fields), None)
    return f"{kind} at {field}" if field else kind


class StatusListener(StreamingQueryListener):
    """Keeps the last ``keep`` records of the session's named streams; :meth:`records` gives them as a table."""

    def __init__(self, keep: int = 10_000, fields: frozenset[str] = frozenset()) -> None:
        self._rows: deque[tuple] = deque(maxlen=keep)
        self._names: dict[str, str] = {}
        self._lock, self._fields = threading.Lock(), fields

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        with self._lock:
            self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        at = int(datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp() * 1000)
        with self._lock:
            self._rows.append((p.name or str(p.id), at, int(p.batchId), int(p.numInputRows), None))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        """An idle stream runs, and has nothing new."""

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self._lock:
            name = self._names.pop(str(event.runId), str(event.id))
            if event.exception is not None:
                now = int(datetime.now(timezone.utc).timestamp() * 1000)
                self._rows.append((name, now, None, 0, error_kind(event.exception, self._fields)))

    def records(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), RECORDS)
