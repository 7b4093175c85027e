"""What running streams report: rows, rates, state and durations of each trigger, as a table."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, batch long, input_rows long, input_rate double, processed_rate double, state_rows long, trigger_ms long"
#: Triggers that are kept; older ones are forgotten.
KEPT = 10_000


class QueryMetrics(StreamingQueryListener):
    """Register with ``spark.streams.addListener``; then ``table()``."""

    def __init__(self, kept: int = KEPT):
        self.rows, self.started, self.ended = deque(maxlen=kept), 0, 0

    def onQueryStarted(self, event):
        self.started += 1

    def onQueryProgress(self, event):
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        rates = (float(r) if r == r else None for r in (p.inputRowsPerSecond, p.processedRowsPerSecond))
        self.rows.append((p.name or str(p.id), p.batchId, p.numInputRows, *rates, state, p.durationMs.get("triggerExecution")))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended += 1

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), PROGRESS)
