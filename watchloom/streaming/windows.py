"""The exact trailing count of a key's events on a stream, with state that ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_LONG = T.LongType()


class TrailingCount(StatefulProcessor):
    """Events of one key in the window that ends at each event, peers included.

    An event waits until the watermark has passed its time, so late ones count where they belong. State: ``waiting``
    lists the events that are still open, ``counts`` the events per millisecond of the last window before the
    watermark. Timers close events and, one window after the last of them, clear the key.
    """

    def __init__(self, window_ms: int, grain_ms: int = 1000):
        self.window_ms, self.grain_ms = window_ms, grain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("ms", _LONG), T.StructField("row", T.StringType())]))
        self.counts = handle.getListState("counts", T.StructType([T.StructField("ms", _LONG), T.StructField("n", _LONG)]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for pdf in rows:
            self.waiting.appendList(list(zip(pdf["ms"].astype(int).tolist(), pdf["row"].tolist(), strict=True)))
            # One timer for all times up to the next multiple of the grain.
            for at in set((-(-pdf["ms"].to_numpy(np.int64) // self.grain_ms) * self.grain_ms).tolist()) - known:
                self.handle.registerTimer(at)
                known.add(at)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        open_ = [(int(r[0]), r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        past = [(int(r[0]), int(r[1])) for r in self.counts.get()] if self.counts.exists() else []
        closed = [r for r in open_ if r[0] <= now]
        fresh = np.array([r[0] for r in closed], np.int64)
        times, place = np.unique(np.concatenate([np.array([m for m, _ in past], np.int64), fresh]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([np.array([n for _, n in past], float), np.ones(len(fresh))]), len(times)).astype(np.int64)
        so_far = np.concatenate([[0], np.cumsum(counts)])
        inside = so_far[np.searchsorted(times, fresh, "right")] - so_far[np.searchsorted(times, fresh - self.window_ms)]
        self._keep(self.waiting, [r for r in open_ if r[0] > now])
        # The next event is later than the watermark, so it reaches back to one window before it at most.
        kept = times > now - self.window_ms
        self._keep(self.counts, list(zip(times[kept].tolist(), counts[kept].tolist(), strict=True)))
        if kept.any():
            self.handle.registerTimer(int(times[-1]) + self.window_ms)
        if not closed:
            return iter(())
        return iter([pd.DataFrame({"row": [r[1] for r in closed], "window_count": inside})])

    @staticmethod
    def _keep(state: Any, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def stream_trailing_count(
    events: DataFrame, window_sec: int, keys: Sequence[str] = ("device_id", "category"), ts: str = "timestamp_ms", late: str = "10 minutes",
) -> DataFrame:
    """The rows of ``sliding_count`` from a stream whose events come up to ``late`` behind the newest one.

    Older ones are dropped. Rows come out once the watermark has passed them. A key holds one window and the late
    span of its events, and nothing once it has been silent for a window; rows without a time are dropped.
    """
    dealt = events.filter(F.col(ts).isNotNull()).select(
        *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col(ts).cast("long").alias("ms"), F.to_json(F.struct("*")).alias("row"),
    ).withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    output = T.StructType([T.StructField("row", T.StringType()), T.StructField("window_count", _LONG)])
    found = dealt.groupBy(*[f"key{i}" for i in range(len(keys))]).transformWithStateInPandas(
        statefulProcessor=TrailingCount(window_sec * 1000), outputStructType=output, outputMode="Append", timeMode="EventTime")
    return found.select(F.from_json("row", events.schema).alias("_r"), "window_count").select("_r.*", "window_count")
