"""Replaying files as a stream gives the rows of the batch operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from watchloom.operators.cooldown import cooldown, threshold_alerts
from watchloom.operators.correlate import correlate
from watchloom.operators.rule_scan import scan_rules
from watchloom.operators.telemetry import event_counts, ewma_baseline, telemetry_features
from watchloom.plans.views import view
from watchloom.streaming import drivers


def _replay(spark, df, tmp_path, order: str, parts: int = 3):
    """Write ``df`` as files in event order and read them back one per micro-batch."""
    path = str(tmp_path / "in")
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(path)
    # File sources take files by modification time, which the tasks do not order; one batch per file name.
    import os

    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    for i, n in enumerate(names):
        os.utime(os.path.join(path, n), (1_600_000_000 + i, 1_600_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(stream, tmp_path):
    out = str(tmp_path / "out")
    query = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(out)


def _set(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cooldown(spark, folder, tmp_path):
    det = view(spark, folder, "det").select("device_id", "timestamp_ms", "event_id")
    got = _drain(drivers.stream_cooldown(_replay(spark, det, tmp_path, "timestamp_ms"), ["device_id"], 600), tmp_path)
    assert _set(got, det.columns) == _set(cooldown(det, ["device_id"], 600), det.columns)


def test_threshold_alerts(spark, folder, tmp_path):
    logs = view(spark, folder, "sec_log")
    got = _drain(drivers.stream_threshold_alerts(scan_rules(_replay(spark, logs, tmp_path, "timestamp_ms"))), tmp_path)
    columns = ["device_id", "category", "timestamp_ms", "event_id", "rule_name", "event_count"]
    assert _set(got, columns) == _set(threshold_alerts(scan_rules(logs)), columns)


def test_correlate(spark, folder, tmp_path):
    det = view(spark, folder, "det").select("device_id", "timestamp_ms", "source", "category", "severity")
    got = _drain(drivers.stream_correlate(_replay(spark, det, tmp_path, "timestamp_ms")), tmp_path)
    columns = ["rule_name", "scope", "first_seen_ms", "event_count"]
    assert _set(got, columns) == _set(correlate(det), columns)


def test_baselines(spark, folder, tmp_path):
    tel = view(spark, folder, "tel")
    counts = scan_rules(view(spark, folder, "chunk"))
    reports = event_counts(tel, counts, on=["event_id"])
    got = _drain(drivers.stream_baselines(_replay(spark, reports, tmp_path, "timestamp_ms")), tmp_path)
    want = ewma_baseline(event_counts(telemetry_features(tel, "event_id"), counts, on=["event_id"]))
    stats = ["net_in_mean", "net_in_sd", "cpu_z", "ram_mean", "auth_failures_z", "interval_sd"]
    both = got.alias("a").join(want.alias("b"), "event_id")
    worst = both.select(*[F.max(F.abs(F.col(f"a.{s}") - F.col(f"b.{s}")) / (1 + F.abs(F.col(f"b.{s}")))).alias(s) for s in stats]).first()
    assert both.count() == tel.count() == got.count()
    assert all(v < 1e-9 for v in worst), worst


def test_detect_batches(spark, folder, tmp_path):
    logs = view(spark, folder, "sec_log")
    feed = lambda s: view(s, folder, "ioc_feed")
    drivers.detect_batches(_replay(spark, logs, tmp_path, "timestamp_ms"), str(tmp_path / "tables"), feed).awaitTermination(240)
    events = spark.read.parquet(str(tmp_path / "tables" / "security_events"))
    assert events.count() == scan_rules(logs).count()
    assert {"date", "received_at"} <= set(events.columns)
    assert spark.read.parquet(str(tmp_path / "tables" / "ioc_matches")).count() > 0
