"""Roll-ups behind status pages and compliance reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchloom.functions.columns import case_of
from watchloom.operators.fleet import fleet_status
from watchloom.rules.reference_lists import FRAMEWORK_CONTROLS


def one_row(parts: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Aggregates of different tables side by side.

    Every table is aggregated to (name, value) and the tiny results are
    pivoted, so no tables are crossed.
    """
    groups: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, agg) in parts.items():
        groups.setdefault(id(df), (df, []))[1].append((name, agg))
    long = []
    for df, aggs in groups.values():
        totals = df.agg(*[agg.cast("long").alias(name) for name, agg in aggs])
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n, _ in aggs])
        long.append(totals.select(F.inline(pairs)))
    stacked = reduce(lambda a, b: a.unionByName(b), long)
    return stacked.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in parts])


_STATS = [
    ("total_threats", "threat_detections"), ("total_events", "security_events"),
    ("total_ioc_hits", "ioc_matches"), ("total_fim_changes", "fim_events"), ("iocs_loaded", "ioc_feed"),
    ("ir_incidents", "ir_incidents"), ("ir_actions_executed", "ir_actions"), ("corr_incidents", "correlations_view"),
    ("net_inspections", "inspected"), ("ml_observed", "observed"),
]


def system_stats(tables: Mapping[str, DataFrame], as_of_ms: int) -> DataFrame:
    """Counters of all present tables in one row."""
    parts: dict[str, tuple[DataFrame, Column]] = {
        name: (tables[t], F.count("*")) for name, t in _STATS if t in tables
    }
    if "telemetry" in tables:
        ts = F.col("timestamp_ms")
        live = tables["telemetry"].filter((ts > as_of_ms - 300_000) & (ts <= as_of_ms))
        parts["devices_online"] = (live, F.count_distinct("device_id"))
    if "ioc_feed" in tables:
        parts["feeds_loaded"] = (tables["ioc_feed"], F.count_distinct("feed_source"))
    if "threat_detections" in tables:
        of = lambda c: F.count_if(F.col("category") == c)
        parts["sigma_hits"] = (tables["threat_detections"], of("sigma"))
        parts["ml_findings"] = (tables["threat_detections"], of("ml_anomaly"))
    if "correlations_view" in tables:
        parts["corr_active"] = (tables["correlations_view"], F.count_if("is_active"))
    if "ir_actions" in tables:
        kind = F.col("action_type")
        parts["ir_blocked_ips"] = (tables["ir_actions"], F.count_distinct(F.when(kind == "block_ip", F.col("target"))))
        parts["ir_quarantined"] = (tables["ir_actions"], F.count_distinct(F.when(kind == "quarantine", F.col("device_id"))))
    if "fleet" in tables:
        devices = fleet_status(tables["fleet"], as_of_ms)
        parts["fleet_total"] = (devices, F.count("*"))
        for status in ("online", "stale", "offline"):
            parts[f"fleet_{status}"] = (devices, F.count_if(F.col("status") == status))
        parts["fleet_quarantined"] = (devices, F.count_if("quarantined"))
    return one_row(parts)


def _period(df: DataFrame, start_ms: int, end_ms: int, ts: str = "timestamp_ms") -> DataFrame:
    return df.filter((F.col(ts) >= start_ms) & (F.col(ts) < end_ms))


def report_rollup(tables: Mapping[str, DataFrame], start_ms: int, end_ms: int) -> DataFrame:
    """Counts of a reporting period; the period filter reaches every scan."""
    parts: dict[str, tuple[DataFrame, Column]] = {}
    if "threat_detections" in tables:
        threats = _period(tables["threat_detections"], start_ms, end_ms)
        parts["threats_total"] = (threats, F.count("*"))
        for s in ("critical", "high", "medium"):
            parts[f"threats_{s}"] = (threats, F.count_if(F.col("severity") == s))
    for name, table, ts in [
        ("ioc_hits_total", "ioc_matches", "timestamp_ms"), ("fim_events_total", "fim_events", "timestamp_ms"),
        ("correlated_incidents", "correlations_view", "first_seen_ms"), ("ir_incidents", "ir_incidents", "timestamp_ms"),
    ]:
        if table in tables:
            parts[name] = (_period(tables[table], start_ms, end_ms, ts), F.count("*"))
    if "ir_actions" in tables:
        actions = _period(tables["ir_actions"], start_ms, end_ms)
        kind = F.col("action_type")
        parts["ir_actions_executed"] = (actions, F.count("*"))
        parts["ir_blocked_ips"] = (actions, F.count_distinct(F.when(kind == "block_ip", F.col("target"))))
        parts["ir_quarantines"] = (actions, F.count_distinct(F.when(kind == "quarantine", F.col("device_id"))))
    if "fleet" in tables:
        devices = fleet_status(tables["fleet"], end_ms)
        parts["devices_total"] = (devices, F.count("*"))
        parts["devices_online"] = (devices, F.count_if(F.col("status") == "online"))
        parts["devices_offline"] = (devices, F.count_if(F.col("status") == "offline"))
        parts["devices_quarantined"] = (devices, F.count_if("quarantined"))
    return one_row(parts)


def threats_by_category(threats: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return _period(threats, start_ms, end_ms).groupBy("category").agg(F.count("*").alias("threats"))


def top_threats(threats: DataFrame, n: int = 10) -> DataFrame:
    keys = ["device_id", "category", "mitre_id"]
    return threats.groupBy(*keys).agg(F.count("*").alias("events")).orderBy(F.desc("events"), *keys).limit(n)


def top_devices(threats: DataFrame, n: int = 10) -> DataFrame:
    return threats.groupBy("device_id").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "device_id").limit(n)


def top_indicators(matches: DataFrame, n: int = 10) -> DataFrame:
    keys = ["ioc_type", "ioc_value"]
    return matches.groupBy(*keys).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), *keys).limit(n)


def control_coverage(
    spark: SparkSession, framework: str, notes: DataFrame | None = None, product: str = "watchloom"
) -> DataFrame:
    """Controls of a framework with their note; an unknown framework has none.

    ``notes``: (control, note). Controls are at most a dozen literals.
    """
    controls = FRAMEWORK_CONTROLS.get(framework.lower(), [])
    default = f"Monitored by {product} baseline controls (see detection/telemetry rollups above)."
    numbers = {c: i for i, c in enumerate(controls, 1)}
    listed = spark.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in controls]).cast("array<string>")).alias("control"))
    if numbers:
        listed = listed.withColumn("position", case_of("control", numbers, 0))
    else:
        listed = listed.withColumn("position", F.lit(0))
    if notes is None:
        return listed.withColumn("note", F.lit(default))
    return listed.join(notes, "control", "left").withColumn("note", F.coalesce("note", F.lit(default)))
