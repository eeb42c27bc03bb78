"""Trailing counts and sketches of devices: the stream gives the rows of the batch, whatever the micro-batches."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from watchloom.operators.presence import device_sketches, error_bound, online_from_sketches, online_trend
from watchloom.operators.windows import sliding_count
from watchloom.streaming.windows import stream_trailing_count

SCHEMA = "event_id long, device_id long, category string, timestamp_ms long, note string"
#: Later than everything, so that its micro-batch closes the rest.
_END = 50_000_000


def _files(spark, rows, schema, parts, path):
    """One file per micro-batch, in the order of the list."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        for n in os.listdir(path):
            if n.startswith("part-") and os.path.getmtime(os.path.join(path, n)) > 1_600_000_100:
                os.utime(os.path.join(path, n), (1_600_000_000 + i, 1_600_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(stream, tmp_path):
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(out), query


def _events(seed=4, n=240):
    draw = random.Random(seed)
    rows = [(i, draw.choice([1, 2, None]), draw.choice(["a", "b"]), 1_000_000 + draw.randrange(0, 900, 7) * 1000 + draw.randrange(3), draw.choice(["x", None])) for i in range(n)]
    # In order of arrival: up to 200 seconds late.
    return sorted(rows, key=lambda r: r[3] + draw.randrange(200_000))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_trailing_count_with_late_rows(spark, tmp_path, parts):
    rows = _events()
    ends = [(1000, 9, "z", _END, None), (1001, 9, "z", _END + 10_000_000, None)]
    stream = _files(spark, rows, SCHEMA, parts, str(tmp_path / "in"))
    for i, end in enumerate(ends):
        spark.createDataFrame([end], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for n in os.listdir(tmp_path / "in"):
            if n.startswith("part-") and os.path.getmtime(tmp_path / "in" / n) > 1_600_000_100:
                os.utime(tmp_path / "in" / n, (1_600_000_050 + i, 1_600_000_050 + i))
    got, query = _drain(stream_trailing_count(stream, 60, late="300 seconds"), tmp_path)
    want = {r: sum(1 for o in rows if (o[1], o[2]) == (r[1], r[2]) and r[3] - 60_000 <= o[3] <= r[3]) for r in rows}
    assert {tuple(r)[:5]: r.window_count for r in got.where("device_id is null or device_id <> 9").collect()} == want
    # Keys that are silent for a window leave nothing behind.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 10
    batch = sliding_count(spark.createDataFrame(rows, SCHEMA).where("device_id is not null"), 60)
    assert {r.event_id: r.window_count for r in batch.collect()} == {r[0]: n for r, n in want.items() if r[1] is not None}


def test_sketches_add_up(spark):
    seen = spark.range(200_000).select((F.col("id") % 30_000).alias("device_id"), (F.col("id") * 18 + 1).alias("timestamp_ms"))
    parts = device_sketches(seen, 300)
    assert parts.count() == 12
    total = online_from_sketches(parts, 3_600_000, 3600).first().devices_online
    assert abs(total - 30_000) <= 30_000 * error_bound()
    whole = online_from_sketches(device_sketches(seen, 3600), 3_600_000, 3600, 3600).first().devices_online
    assert abs(whole - 30_000) <= 30_000 * error_bound()
    for window in (300, 900):
        exact = seen.where(f"timestamp_ms > {1_800_000 - window * 1000} and timestamp_ms <= 1800000").select("device_id").distinct().count()
        about = online_from_sketches(parts, 1_800_000, window).first().devices_online
        assert abs(about - exact) <= max(1, exact * error_bound())
        assert online_trend(parts, window).where("end_ms = 1800000").first().devices_online == about
    assert online_from_sketches(parts, 360_000_000, 300).first().devices_online == 0
    with pytest.raises(ValueError):
        online_from_sketches(parts, 1_800_001, 300)
    with pytest.raises(ValueError):
        online_trend(parts, 400)


def test_sketches_on_a_stream(spark, tmp_path):
    schema = "device_id long, timestamp_ms long"
    draw = random.Random(8)
    rows = sorted([(draw.randrange(50), draw.randrange(1, 3_000_000)) for _ in range(900)], key=lambda r: r[1] + draw.randrange(100_000))
    rows += [(None, _END), (None, _END + 1)]
    got, _ = _drain(device_sketches(_files(spark, rows, schema, 4, str(tmp_path / "in")), 300, late="200 seconds"), tmp_path)
    count = lambda df: {r.end_ms: r.devices_online for r in online_trend(df, 900).where("end_ms <= 3000000").collect()}
    exact = {e: len({d for d, t in rows if d is not None and e - 900_000 < t <= e}) for e in range(300_000, 3_000_001, 300_000)}
    assert count(got) == count(device_sketches(spark.createDataFrame(rows, schema), 300)) == exact
