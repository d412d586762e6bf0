"""Spans of the work of a driver: nested, timed, with their errors, exported as rows like those of trace_spans."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

ROWS = "span_no long, parent_no long, depth int, trace_id string, span_name string, started_at timestamp_ntz, duration_ms double, attributes string, error string"


@dataclass
class Span:
    span_no: int
    parent_no: int | None
    depth: int
    trace_id: str
    span_name: str
    started: float
    duration_ms: float = 0.0
    attributes: dict = field(default_factory=dict)
    error: str | None = None

    def row(self) -> tuple:
        at = datetime.fromtimestamp(self.started, UTC).replace(tzinfo=None)
        return self.span_no, self.parent_no, self.depth, self.trace_id, self.span_name, at, self.duration_ms, json.dumps(self.attributes, sort_keys=True), self.error


class Tracer:
    """Spans nest by thread. An error is noted in every span that it leaves and raised again; an exporter that fails
    never fails the work, and is counted in ``export_failures``. The last ``keep`` spans are kept."""

    def __init__(self, *exporters: Callable[[Span], None], keep: int = 10_000, clock: Callable[[], float] = time.time):
        self.exporters, self.keep, self.clock = exporters, keep, clock
        self.finished: list[Span] = []
        self.export_failures = 0
        self._lock, self._local, self._next = threading.Lock(), threading.local(), 0

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[Span]:
        stack = self._local.__dict__.setdefault("stack", [])
        with self._lock:
            number, self._next = self._next, self._next + 1
        parent = stack[-1] if stack else None
        span = Span(number, parent.span_no if parent else None, len(stack), parent.trace_id if parent else uuid.uuid4().hex, name, self.clock(), attributes=attributes)
        stack.append(span)
        try:
            yield span
        except BaseException as e:
            span.error = f"{type(e).__name__}: {e}"
            raise
        finally:
            stack.pop()
            span.duration_ms = (self.clock() - span.started) * 1000
            with self._lock:
                self.finished.append(span)
                del self.finished[: -self.keep]
            for export in self.exporters:
                try:
                    export(span)
                except Exception:  # noqa: BLE001 - an exporter is no part of the work
                    self.export_failures += 1

    def rows(self, spark: SparkSession) -> DataFrame:
        """The finished spans."""
        return spark.createDataFrame([s.row() for s in self.finished], ROWS)
