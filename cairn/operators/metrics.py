"""Metrics of a job that are gathered while it runs, without a pass of their own.

watched() adds aggregates to a DataFrame of a batch or a stream; a batch tells
them once through its Observation, a stream for each of its batches to a
MetricsListener.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def tile_metrics(height: str, phase: str | None = None) -> list[Column]:
    """What a debug view of tiles shows: rows, valid heights and their range, and how many are in each phase."""
    h = F.col(height)
    valid = h.isNotNull() & ~F.isnan(h)
    found = [F.count("*").alias("rows"), F.count_if(valid).alias("valid"), F.min(F.when(valid, h)).alias("low"), F.max(F.when(valid, h)).alias("high")]
    return found + ([F.count_if(F.col(phase) == p).alias(p) for p in ("idle", "loading", "ready", "failed")] if phase else [])


def watched(rows: DataFrame, metrics: list[Column], name: str = "metrics") -> tuple[DataFrame, Observation]:
    """rows, and the observation that has the metrics once an action over them is done; take one for each action."""
    seen = Observation(name)
    return rows.observe(seen, *metrics), seen


class MetricsListener(StreamingQueryListener):
    """The metrics of each batch of the streams whose rows were given to observe(name, ...): by name, in order, as dictionaries.

    Keeps the last `most` of a name.
    """

    def __init__(self, most: int = 1000):
        self.most, self.seen = most, defaultdict(list)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in (event.progress.observedMetrics or {}).items():
            self.seen[name] = [*self.seen[name], {"batch": event.progress.batchId, **row.asDict()}][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def json(self, name: str) -> str:
        """The last metrics of a name as JSON; {} before the first."""
        return json.dumps(self.seen[name][-1] if self.seen[name] else {})
