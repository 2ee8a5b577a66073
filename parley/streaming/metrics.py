"""Metrics of a run while it runs (A2, A4, R6): counters that ride along with the rows that are written, without a second pass.

``channel_counters`` are aggregates for ``observe()``: messages and batches of each of the channels that a fetch was asked for (a
list that the caller gives, so their number is bounded by it). A batch write yields them when it ends, a stream with every
micro-batch; :class:`LiveProgress` collects the latter as they come and says how far a load is (A4).

Messages of channels that were not asked for count as ``other``; no channel is a channel, if it is in the list.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

TOTALS = "channel_id string, total_messages bigint, batch_count bigint"


def channel_counters(channels: Sequence[str | None], channel_col: str = "channel_id", page_col: str | None = "page") -> list[Column]:
    """``n<i>`` and (with ``page_col``) ``b<i>`` for the i-th channel, ``other`` for the rest, ``all``."""
    out, known = [F.count(F.lit(1)).alias("all")], F.lit(False)
    for i, name in enumerate(channels):
        mine = F.col(channel_col).eqNullSafe(F.lit(name))
        known = known | mine
        out.append(F.count_if(mine).alias(f"n{i}"))
        if page_col is not None:
            out.append(F.max(F.when(mine, F.col(page_col))).cast("bigint").alias(f"b{i}"))
    return [*out, F.count_if(~known).alias("other")]


def write_with_totals(paged: DataFrame, path: str, channels: Sequence[str | None], *, channel_col: str = "channel_id",
                      page_col: str = "page") -> DataFrame:
    """Write ``paged`` partitioned by channel; the totals of its channels (A2), observed by the write itself."""
    seen = Observation()
    (paged.observe(seen, *channel_counters(channels, channel_col, page_col)).write.partitionBy(channel_col).parquet(path))
    got = seen.get
    rows = [(c, got[f"n{i}"], got[f"b{i}"]) for i, c in enumerate(channels) if got[f"n{i}"]]
    return paged.sparkSession.createDataFrame(rows, TOTALS)


class LiveProgress(StreamingQueryListener):
    """Counters of streaming queries that observe :func:`channel_counters` under ``name``, summed over their micro-batches."""

    def __init__(self, name: str, channels: Sequence[str | None], expected: int | None = None):
        super().__init__()
        self.metric, self.channels, self.expected = name, list(channels), expected
        self._lock, self._batches = threading.Lock(), {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.metric in p.observedMetrics:
            with self._lock:  # a micro-batch that is reported again replaces itself
                self._batches[p.id, p.batchId] = p.observedMetrics[self.metric].asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def messages(self) -> dict[str | None, int]:
        with self._lock:
            return {c: sum(b[f"n{i}"] for b in self._batches.values()) for i, c in enumerate(self.channels)}

    def percent_complete(self) -> float | None:
        """A3 of all messages so far against ``expected``."""
        if self.expected is None:
            return None
        with self._lock:
            done = sum(b["all"] for b in self._batches.values())
        return min(100.0, done / self.expected * 100.0) if self.expected else 0.0
