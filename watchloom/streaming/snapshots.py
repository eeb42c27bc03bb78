"""Snapshot changes on a stream: the items of a device as keyed state, snapshots closed by event time.

A snapshot's rows and headers may come in any order and over several micro-batches. It is closed when the watermark
has passed its time; then it is compared with the items held, which it replaces. A device's items are dealt to
buckets by a hash of their keys, each with a state of its own, so a device with a large part of all items is many
keys; a header goes to all buckets, which is how a bucket learns that its items have gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchloom.operators.snapshots import Inventory

_TEXT = T.StringType()
Row = tuple  # the values of an item, as text or None


def _texts(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, _TEXT) for n in names]


class SnapshotChanges(StatefulProcessor):
    """Changes of one bucket of one device.

    State: ``held`` maps an item to its values in the last closed snapshot, ``pending`` lists the rows of snapshots
    that are still open, ``last`` is the time of the last closed one. Where no snapshot came for ``forget_ms`` after
    it, everything is cleared and the next snapshot is a baseline.
    """

    def __init__(self, inventory: Inventory, forget_ms: int):
        self.keys, self.values, self.forget_ms = list(inventory.keys), list(inventory.values), forget_ms
        self.compare = [self.values.index(c) for c in inventory.compare]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", T.StructType(_texts(self.keys)), T.StructType(_texts(self.values)))
        pending = [T.StructField("ms", T.LongType()), T.StructField("head", T.BooleanType()), *_texts(self.keys), *_texts(self.values)]
        self.pending = handle.getListState("pending", T.StructType(pending))
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for pdf in rows:
            columns = [pdf["timestamp_ms"].tolist(), pdf["head"].tolist()]
            columns += [[None if v is None else str(v) for v in pdf[c].where(pdf[c].notna(), None)] for c in (*self.keys, *self.values)]
            self.pending.appendList([(int(ms), bool(head), *rest) for ms, head, *rest in zip(*columns, strict=True)])
            for ms in set(columns[0]) - known:
                self.handle.registerTimer(int(ms))
                known.add(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        waiting = list(self.pending.get()) if self.pending.exists() else []
        rows = [tuple(r) for r in waiting]
        times = sorted({r[0] for r in rows if r[0] <= now})
        if not times:
            if last is not None and now >= last + self.forget_ms:
                self.held.clear(), self.last.clear()
            return iter(())
        before = {tuple(k): tuple(v) for k, v in self.held.iterator()} if last is not None else {}
        held, out, first = dict(before), [], len(self.keys) + 2
        for ms in times:
            found: dict[Row, Row] = {}
            for r in rows:
                if r[0] == ms and not r[1]:
                    item, value = r[2:first], r[first:]
                    if item not in found or self._rank(found[item]) < self._rank(value):
                        found[item] = value
            if last is not None:
                nothing = (None,) * len(self.values)
                out += [(ms, *k, "added", *nothing, *v) for k, v in found.items() if k not in held]
                out += [(ms, *k, "gone", *v, *nothing) for k, v in held.items() if k not in found]
                out += [(ms, *k, "changed", *held[k], *v) for k, v in found.items() if k in held and any(held[k][c] != v[c] for c in self.compare)]
            held, last = found, ms
        for item in before.keys() - held.keys():
            self.held.removeKey(item)
        for item, value in held.items():
            if before.get(item) != value:
                self.held.updateValue(item, value)
        rest = [r for r in rows if r[0] > now]
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        self.last.update((last,))
        self.handle.registerTimer(last + self.forget_ms)
        if not out:
            return iter(())
        names = ["timestamp_ms", *self.keys, "change", *[f"old_{v}" for v in self.values], *[f"new_{v}" for v in self.values]]
        made = pd.DataFrame(out, columns=names)
        made.insert(0, "device_id", key[0])
        return iter([made])

    @staticmethod
    def _rank(value: Row) -> tuple:
        return tuple((v is not None, v or "") for v in value)

    def close(self) -> None:
        pass


def stream_snapshot_changes(snapshots: DataFrame, headers: DataFrame, inventory: Inventory, late: str = "10 minutes", buckets: int = 64,
                            forget_ms: int = 366 * 86_400_000) -> DataFrame:
    """The rows of ``snapshot_changes`` from streams of items and of headers (device_id, timestamp_ms), one per snapshot.

    Snapshots up to ``late`` behind the newest one take their place in time; older ones are dropped. A bucket holds
    its share of a device's items, in state and, one bucket at a time, in a task's memory.
    """
    keys, values = list(inventory.keys), list(inventory.values)
    types = {c: snapshots.schema[c].dataType for c in (*keys, *values)}
    texts = [*keys, *values]
    items = snapshots.select(
        "device_id", "timestamp_ms", F.lit(False).alias("head"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"),
        *[F.col(c).cast("string").alias(c) for c in texts])
    heads = headers.select(
        "device_id", "timestamp_ms", F.lit(True).alias("head"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"),
        *[F.lit(None).cast("string").alias(c) for c in texts])
    both = items.unionByName(heads).withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", late)
    output = T.StructType([
        T.StructField("device_id", T.LongType()), T.StructField("timestamp_ms", T.LongType()), *_texts(keys), T.StructField("change", _TEXT),
        *_texts([f"old_{v}" for v in values]), *_texts([f"new_{v}" for v in values])])
    found = both.groupBy("device_id", "bucket").transformWithStateInPandas(
        statefulProcessor=SnapshotChanges(inventory, forget_ms), outputStructType=output, outputMode="Append", timeMode="EventTime")
    typed = lambda c, v: F.col(c).cast(types[v]).alias(c)
    return found.select(
        "device_id", "timestamp_ms", *[typed(k, k) for k in keys], "change", *[typed(f"{s}_{v}", v) for s in ("old", "new") for v in values])
