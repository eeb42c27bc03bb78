"""Changes along snapshots: pair by pair, from a stream in any number of micro-batches, and per report."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from watchloom.operators import snapshots as chain
from watchloom.operators.diffs import connection_summary, fim_alerts
from watchloom.operators.network import connection_anomalies
from watchloom.streaming.snapshots import stream_snapshot_changes

MINUTE = 60_000
FILES = "device_id long, timestamp_ms long, path string, sha256 string, size_bytes long, mtime_epoch long"


def _trees() -> tuple[list[tuple], list[tuple]]:
    """Rows and headers of two devices: files come, change, go and come back, a tree is emptied and filled again."""
    rows, heads = [], []
    for device in (1, 2):
        for k in range(8):
            ms = MINUTE * (10 + k) + device
            heads.append((device, ms))
            if device == 2 and k in (3, 4):
                continue
            for f in range(60):
                if (f + k) % 7 and not (f % 5 == 0 and k % 2):
                    rows.append((device, ms, f"/etc/f{f}", f"h{(f * k) // 40}", f + k // 3, None if f == 9 else 1000 + k))
    return rows, heads


def _plainly(rows, heads, key, compare):
    """Changes by comparing each snapshot with the one before."""
    out = []
    for device in {h[0] for h in heads}:
        times = sorted({h[1] for h in heads if h[0] == device} | {r[1] for r in rows if r[0] == device})
        trees = [{r[key]: r for r in rows if r[0] == device and r[1] == t} for t in times]
        for t, old, new in zip(times[1:], trees[:-1], trees[1:], strict=True):
            out += [(device, t, k, "added") for k in new.keys() - old.keys()] + [(device, t, k, "gone") for k in old.keys() - new.keys()]
            out += [(device, t, k, "changed") for k in new.keys() & old.keys() if old[k][compare] != new[k][compare]]
    return sorted(out)


def test_intervals(spark):
    rows, heads = _trees()
    got = chain.snapshot_changes(spark.createDataFrame(rows, FILES), chain.FILES, spark.createDataFrame(heads, "device_id long, timestamp_ms long"))
    want = _plainly(rows, heads, 2, 3)
    assert sorted(map(tuple, got.select("device_id", "timestamp_ms", "path", "change").collect())) == want
    assert {c for *_, c in want} == {"added", "gone", "changed"}
    assert chain.snapshot_changes(spark.createDataFrame([], FILES), chain.FILES).count() == 0


def test_same_as_alerts(spark):
    rows, heads = _trees()
    df, headers = spark.createDataFrame(rows, FILES), spark.createDataFrame(heads, "device_id long, timestamp_ms long")
    a = chain.file_changes(chain.snapshot_changes(df, chain.FILES, headers))
    b = fim_alerts(df, headers=headers)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_one_row_stands_for_an_item(spark):
    """Repeated rows of an item are one change, nulls are values, keys that are null are items of their own."""
    rows = [(1, 10, "a", "1", None), (1, 20, "a", "2", "x"), (1, 20, "a", "3", "y"), (1, 20, None, "1", "z"), (1, 30, "a", None, "x"), (1, 30, "a", None, "x")]
    df = spark.createDataFrame(rows, "device_id long, timestamp_ms long, name string, version string, publisher string")
    got = chain.software_changes(chain.snapshot_changes(df, chain.SOFTWARE)).collect()
    assert sorted((r.timestamp_ms, str(r.name), r.change_type, r.version, r.old_version) for r in got) == [
        (20, "None", "installed", "1", ""), (20, "a", "updated", "3", "1"), (30, "None", "removed", "1", ""), (30, "a", "updated", None, "3")]


def test_one_shuffle_of_the_items(spark, folder):
    from watchloom.plans.catalog_chains import process_chain

    plan = process_chain(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the list of snapshots only


def _stream(spark, df, tmp_path, parts, name):
    """``df`` (with ``batch``, the micro-batch of each row) as a stream of that many files."""
    path = str(tmp_path / name)
    for k in range(parts):
        df.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(path)
        for n in os.listdir(path):
            file = os.path.join(path, n)
            if n.startswith("part-") and os.path.getmtime(file) > 1_700_000_000:
                os.utime(file, (1_600_000_000 + k, 1_600_000_000 + k))
    return spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_stream_is_batch(spark, tmp_path, parts):
    """Snapshots over micro-batches, one that comes late, an emptied tree; a last header of another device moves time on."""
    rows, heads = _trees()
    df, headers = spark.createDataFrame(rows, FILES), spark.createDataFrame(heads, "device_id long, timestamp_ms long")
    # Snapshot k is in the batch of its time, but the sixth of device 1 comes one batch late.
    step = F.floor((F.col("timestamp_ms") - 10 * MINUTE) / MINUTE)
    late = F.when((F.col("device_id") == 1) & (step == 5), 1).otherwise(0)
    batch = F.least(F.floor(step * parts / 8) + late, F.lit(parts - 1))
    closing = spark.createDataFrame([(99, MINUTE * 500, parts - 1)], "device_id long, timestamp_ms long, batch long")
    a = _stream(spark, df.withColumn("batch", batch), tmp_path, parts, "rows")
    b = _stream(spark, headers.withColumn("batch", batch).unionByName(closing), tmp_path, parts, "heads")
    found = chain.file_changes(stream_snapshot_changes(a, b, chain.FILES, late="4 minutes", buckets=3))
    query = (found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
             .trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    want = fim_alerts(df, headers=headers)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_connections_per_report(spark):
    """Three reports of 40 connections each are no flood; one of 120 is."""
    small = [(1, ms, "tcp", "SYN_SENT") for ms in (1, 2, 3) for _ in range(40)]
    large = [(2, 1, "tcp", "SYN_SENT")] * 120
    df = spark.createDataFrame(small + large, "device_id long, timestamp_ms long, protocol string, state string")
    assert [(r.device_id, r.timestamp_ms, r.category) for r in connection_anomalies(df).collect()] == [(2, 1, "syn_flood")]
    assert connection_anomalies(df.drop("timestamp_ms")).count() == 2
    assert sorted((r.device_id, r.total_tcp) for r in connection_summary(df).collect()) == [(1, 40)] * 3 + [(2, 120)]
