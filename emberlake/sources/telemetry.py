"""The engine's own measurements, kept as explicit histograms and given out as an OTLP/JSON metrics document."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

# Name, unit and attribute of each instrument.
INSTRUMENTS = {
    "emberlake.ingest.duration": ("ms", "signal", "Time spent writing one batch to the store."),
    "emberlake.rpc.duration": ("ms", "method", "Time spent serving one method call."),
    "emberlake.rpc.response_bytes": ("By", "method", "Encoded size of one response body."),
    "emberlake.retention.duration": ("ms", "", "Time spent in one retention pass."),
}
BOUNDS = (0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0)


class Telemetry:
    """Counts since the start, by instrument and attribute value. A disabled one records nothing."""

    def __init__(self, enabled: bool = True):
        self.enabled = enabled
        self.start = time.time_ns()
        self._lock = threading.Lock()
        self._cells: dict[tuple[str, str], list] = {}  # counts by bucket, sum, least, greatest

    def record(self, name: str, value: float, attribute: str = "") -> None:
        if name not in INSTRUMENTS:
            raise KeyError(name)
        if not self.enabled:
            return
        with self._lock:
            cell = self._cells.setdefault((name, attribute), [[0] * (len(BOUNDS) + 1), 0.0, value, value])
            cell[0][bisect_left(BOUNDS, value)] += 1
            cell[1:] = [cell[1] + value, min(cell[2], value), max(cell[3], value)]

    @contextmanager
    def timed(self, name: str, attribute: str = "") -> Iterator[None]:
        """Record how long the body took, whether it raises or not."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(name, (time.perf_counter() - began) * 1000, attribute)

    def document(self, now: int | None = None) -> dict:
        """All instruments as one export document, cumulative from the start."""
        with self._lock:
            cells = {k: [list(v[0]), *v[1:]] for k, v in self._cells.items()}
        metrics = []
        for name, (unit, attribute, description) in INSTRUMENTS.items():
            points = []
            for (of, value), (counts, total, low, high) in sorted(cells.items()):
                if of == name:
                    labels = [{"key": attribute, "value": {"stringValue": value}}] if attribute else []
                    points.append({"attributes": labels, "startTimeUnixNano": str(self.start), "timeUnixNano": str(now or time.time_ns()), "count": str(sum(counts)), "sum": total, "min": low, "max": high, "bucketCounts": list(map(str, counts)), "explicitBounds": list(BOUNDS)})
            if points:
                metrics.append({"name": name, "unit": unit, "description": description, "histogram": {"aggregationTemporality": 2, "dataPoints": points}})
        resource = {"attributes": [{"key": "service.name", "value": {"stringValue": "emberlake"}}]}
        return {"resourceMetrics": [{"resource": resource, "scopeMetrics": [{"scope": {"name": "emberlake"}, "metrics": metrics}]}]}
