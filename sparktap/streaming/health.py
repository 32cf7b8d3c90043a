"""Health of running streams: counters that the queries themselves report, with no second pass over their rows."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: The name of watched() in a query's progress.
COUNTERS = "sparktap"


def watched(rows: DataFrame, malformed: Column | None = None, parse_error: Column | None = None, name: str = COUNTERS) -> DataFrame:
    """The rows as they are; each batch of a stream that runs over them reports events, bytes, closes, malformed packets and
    parse errors. Columns that the rows lack count as 0. A null condition counts as false."""
    has = set(rows.columns)
    hits = lambda c: F.count_if(F.coalesce(c, F.lit(False)) if c is not None else F.lit(False))
    aggs = {
        "events": F.count(F.lit(1)), "bytes_captured": F.coalesce(F.sum("payload_len" if "payload_len" in has else F.lit(0)), F.lit(0)),
        "close_events": hits(F.col("direction") == 3 if "direction" in has else None), "malformed_events": hits(malformed), "parse_errors": hits(parse_error),
    }
    return rows.observe(name, *[c.cast("long").alias(k) for k, c in aggs.items()])


class Health(StreamingQueryListener):
    """Add it with spark.streams.addListener(). snapshot() gives counters by query; they start anew with each run."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._queries: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._queries[str(event.runId)] = {"name": event.name or str(event.id), "active": True, "error": None, "batches": 0, "input_rows": 0, "rows_per_second": 0.0, "state_rows": 0, "late_rows": 0, "sink_rows": None, "counters": defaultdict(int)}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            q = self._queries.get(str(p.runId))
            if q is None:
                return
            q["batches"] += 1
            q["input_rows"] += p.numInputRows
            q["rows_per_second"] = p.processedRowsPerSecond
            q["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)
            q["late_rows"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            if p.sink.numOutputRows >= 0:
                q["sink_rows"] = (q["sink_rows"] or 0) + p.sink.numOutputRows
            for row in p.observedMetrics.values():
                for k, v in row.asDict().items():
                    q["counters"][k] += v or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            q = self._queries.get(str(event.runId))
            if q is not None:
                q["active"], q["error"] = False, event.exception

    def snapshot(self) -> list[dict]:
        with self._lock:
            return [q | {"counters": dict(q["counters"])} for q in self._queries.values()]

    def totals(self) -> dict[str, int]:
        """Counters of all queries together, for sinks.prometheus()."""
        out: dict[str, int] = defaultdict(int)
        for q in self.snapshot():
            for k, v in q["counters"].items():
                out[k] += v
        return dict(out)
