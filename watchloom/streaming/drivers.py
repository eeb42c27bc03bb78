"""Streaming forms of the stateful operators, and the micro-batch drivers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from watchloom.operators.anomaly import as_threats, observe
from watchloom.operators.correlate import _stage_events
from watchloom.operators.intel import match_indicators, report_indicators
from watchloom.operators.network import inspect_logs
from watchloom.operators.rule_scan import scan_rules
from watchloom.operators.traffic import classify_logs
from watchloom.rules.correlation import DEFAULT_CORRELATION_RULES, INCIDENT_COOLDOWN_SEC, CorrelationRule
from watchloom.rules.detection import DEFAULT_THRESHOLDS, Threshold
from watchloom.session import checkpoint_dir
from watchloom.sinks.tables import write_table
from watchloom.streaming.processors import Correlate, DeviceBaseline, Suppress, ThresholdAlerts, baseline_output


def _keyed(df: DataFrame, keys: Sequence[str], processor, output: T.StructType) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="None")


def _fields(df: DataFrame, columns: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in columns]


def stream_cooldown(df: DataFrame, keys: Sequence[str], seconds: int, tiebreak: str = "event_id") -> DataFrame:
    return _keyed(df, keys, Suppress(seconds * 1000, df.columns, tiebreak=tiebreak), df.schema)


def stream_threshold_alerts(
    events: DataFrame, thresholds: Sequence[Threshold] = tuple(DEFAULT_THRESHOLDS),
    tiebreak: Sequence[str] = ("event_id", "line_no", "rule_no"),
) -> DataFrame:
    limits = {t.category: (t.count, t.window_sec * 1000, t.cooldown_sec * 1000) for t in thresholds}
    columns = ["device_id", "category", "timestamp_ms", *tiebreak, "machine_ip", "severity", "rule_name", "matched_text"]
    output = T.StructType([*_fields(events, columns), T.StructField("event_count", T.LongType())])
    return _keyed(events, ["device_id", "category"], ThresholdAlerts(limits, columns, ["timestamp_ms", *tiebreak]), output)


def stream_baselines(reports: DataFrame, keep: Sequence[str] = ("device_id", "timestamp_ms", "event_id"),
                     alpha: float = 0.05, warmup: int = 20) -> DataFrame:
    """Reports (telemetry with event_count and auth_failures) with late drop, features and baselines."""
    return _keyed(reports, ["device_id"], DeviceBaseline(keep, alpha, warmup), baseline_output(_fields(reports, keep)))


def stream_correlate(events: DataFrame, rules: Sequence[CorrelationRule] = tuple(DEFAULT_CORRELATION_RULES)) -> DataFrame:
    stages = max(len(r.stages) for r in rules)
    known = {r.name: (r.window_seconds * 1000, r.min_events, len(r.stages)) for r in rules}
    output = T.StructType([
        T.StructField("rule_name", T.StringType()), T.StructField("scope", T.StringType()),
        T.StructField("first_seen_ms", T.LongType()), T.StructField("event_count", T.LongType()),
    ])
    matched = _stage_events(events, rules, stages).select("rule_name", "scope", "timestamp_ms", *[f"s{i}" for i in range(stages)])
    return _keyed(matched, ["rule_name", "scope"], Correlate(known, stages, INCIDENT_COOLDOWN_SEC * 1000), output)


def stream_sliding_count(events: DataFrame, window: str = "300 seconds", slide: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events per device and category in overlapping windows; state ends with the watermark."""
    return (
        events.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", late)
        .groupBy(F.window("ts", window, slide), "device_id", "category").agg(F.count("*").alias("events"))
    )


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str, once: bool = True) -> StreamingQuery:
    """Start a query that hands micro-batches to a function; progress lives in the shared checkpoint folder."""
    folder = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/{name}"
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", folder)
    return (writer.trigger(availableNow=True) if once else writer).start()


def detect_batches(logs: DataFrame, root: str, feed: Callable[[SparkSession], DataFrame], name: str = "detect") -> StreamingQuery:
    """Write rule hits, log detections, findings and indicator matches of a log stream.

    The feed is read anew for every micro-batch, so changes apply from the next
    batch on.
    """
    keep = ("device_id", "timestamp_ms", "machine_ip")

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            write_table(scan_rules(batch.select(*keep, "raw_log")), "security_events", root, batch=number)
            threats = classify_logs(batch, keep=keep)
            findings = inspect_logs(batch.select(*keep, "raw_log")).withColumnRenamed("indicator", "sub_type")
            write_table(threats.unionByName(findings, allowMissingColumns=True), "threat_detections", root, batch=number)
            found = report_indicators(batch, keep=keep)
            write_table(match_indicators(found, feed(batch.sparkSession)), "ioc_matches", root, batch=number)
        finally:
            batch.unpersist()

    return run_batches(logs, handle, name)


def score_batches(features: DataFrame, pool: Callable[[SparkSession], DataFrame], root: str, name: str = "score", **options) -> StreamingQuery:
    """Findings of a stream of telemetry features, each micro-batch judged with the stored rows before it.

    ``pool`` reads the rows of earlier micro-batches, or the latest of them (see ``observe``); with it a micro-batch
    of any size, the first included, gives the rows that one batch over everything gives.
    """

    def handle(batch: DataFrame, number: int) -> None:
        write_table(as_threats(observe(batch, history=pool(batch.sparkSession), **options)), "threat_detections", root, batch=number)

    return run_batches(features, handle, name)
