"""Fleet inventory: one row per device."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Seconds without contact until a device is stale or offline.
STALE_AFTER_S = 300
OFFLINE_AFTER_S = 900

COUNTERS = ["alerts", "threats", "ioc_hits", "fim_changes"]


def fleet(
    telemetry: DataFrame,
    counted: Mapping[str, DataFrame] | None = None,
    fim_scans: DataFrame | None = None,
    quarantine: DataFrame | None = None,
    tiebreak: str = "timestamp_ms",
) -> DataFrame:
    """Latest identity, first and last contact, report count and detection counters.

    ``counted`` maps ``alerts``, ``threats``, ``ioc_hits`` and ``fim_changes``
    to detection tables. All inputs are reduced to (device, counter, n) by map-side
    combining aggregates and meet in a single final aggregate.
    """
    latest = F.max(F.struct("timestamp_ms", tiebreak, "machine_name", "machine_ip"))
    base = telemetry.groupBy("device_id").agg(
        latest.alias("_l"), F.min("timestamp_ms").alias("first_seen_ms"),
        F.max("timestamp_ms").alias("last_seen_ms"), F.count("*").alias("total_reports"),
    ).select(
        F.col("device_id").cast("long").alias("device_id"), F.col("_l.machine_name").alias("hostname"),
        F.col("_l.machine_ip").alias("machine_ip"), "first_seen_ms", "last_seen_ms",
        F.col("last_seen_ms").alias("last_telemetry_ms"), "total_reports",
    )
    marks = [
        df.select(F.col("device_id").cast("long").alias("device_id"), F.lit(name).alias("_what"), F.lit(1).cast("long").alias("_n"))
        for name, df in (counted or {}).items()
    ]
    if fim_scans is not None:
        marks.append(fim_scans.select(F.col("device_id").cast("long").alias("device_id"), F.lit("scan").alias("_what"),
                                      F.col("timestamp_ms").cast("long").alias("_n")))
    if quarantine is not None:
        marks.append(quarantine.select(F.col("device_id").cast("long").alias("device_id"), F.lit("quarantine").alias("_what"),
                                       F.lit(1).cast("long").alias("_n")))
    def total(name: str) -> Column:
        return F.sum(F.when(F.col("_what") == name, F.col("_n")).otherwise(0))

    if not marks:
        marks = [base.select("device_id", F.lit("").alias("_what"), F.lit(0).cast("long").alias("_n"))]
    sums = reduce(lambda a, b: a.unionByName(b), marks).groupBy("device_id").agg(
        *[total(name).alias(f"total_{name}") for name in COUNTERS],
        F.max(F.when(F.col("_what") == "scan", F.col("_n"))).alias("last_fim_scan_ms"),
        (total("quarantine") > 0).alias("quarantined"),
    )
    joined = base.join(sums, "device_id", "left")
    return joined.fillna(0, [f"total_{n}" for n in COUNTERS] + ["last_fim_scan_ms"]).fillna(False, ["quarantined"])


def _age_s(as_of_ms: int) -> Column:
    return (F.lit(as_of_ms) - F.col("last_seen_ms")) / 1000


def fleet_status(devices: DataFrame, as_of_ms: int, stale_s: int = STALE_AFTER_S, offline_s: int = OFFLINE_AFTER_S) -> DataFrame:
    """Add ``status``: online, stale or offline by whole seconds since the last contact."""
    age = F.floor(_age_s(as_of_ms))
    seen = F.coalesce(F.col("last_seen_ms"), F.lit(0)) != 0
    return devices.withColumn(
        "status", F.when(seen & (age < stale_s), "online").when(seen & (age < offline_s), "stale").otherwise("offline")
    )


def fleet_health(devices: DataFrame, as_of_ms: int, stale_s: int = STALE_AFTER_S, offline_s: int = OFFLINE_AFTER_S) -> DataFrame:
    """Add ``health_score`` in [0, 1]; a device never seen starts from 0."""
    age = _age_s(as_of_ms)
    minus = lambda test, amount: F.when(test, F.lit(amount)).otherwise(F.lit(0.0))
    score = F.when(
        F.coalesce(F.col("last_seen_ms"), F.lit(0)) > 0,
        1.0 - minus(age > stale_s, 0.3) - minus(age > offline_s, 0.4),
    ).otherwise(F.lit(0.0)) - minus(F.col("quarantined"), 0.2) - minus(F.col("total_threats") > 10, 0.1)
    return devices.withColumn("health_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6))


def fleet_summary(devices: DataFrame, as_of_ms: int) -> DataFrame:
    rows = fleet_status(devices, as_of_ms)
    return rows.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("online", "stale", "offline")],
        F.count_if("quarantined").alias("quarantined"),
    )


def devices_by_status(devices: DataFrame, status: str, as_of_ms: int) -> DataFrame:
    return fleet_status(devices, as_of_ms).filter(F.col("status") == status)


def devices_by_group(devices: DataFrame, group: str, column: str = "device_group") -> DataFrame:
    return devices.filter(F.col(column) == group)


def with_tag(devices: DataFrame, tag: str) -> DataFrame:
    return devices.filter(F.array_contains("tags", tag))


def add_tag(devices: DataFrame, tag: str, where: Column | None = None) -> DataFrame:
    changed = F.array_sort(F.array_union("tags", F.array(F.lit(tag))))
    return devices.withColumn("tags", changed if where is None else F.when(where, changed).otherwise(F.col("tags")))


def remove_tag(devices: DataFrame, tag: str, where: Column | None = None) -> DataFrame:
    changed = F.array_except("tags", F.array(F.lit(tag)))
    return devices.withColumn("tags", changed if where is None else F.when(where, changed).otherwise(F.col("tags")))


def online_devices(telemetry: DataFrame, as_of_ms: int, window_s: int = 300, approximate: bool = False) -> DataFrame:
    """Distinct devices heard in the last ``window_s`` seconds, one at least."""
    window_s = max(1, window_s)
    recent = telemetry.filter((F.col("timestamp_ms") > as_of_ms - window_s * 1000) & (F.col("timestamp_ms") <= as_of_ms))
    count = F.approx_count_distinct("device_id") if approximate else F.count_distinct("device_id")
    return recent.agg(count.alias("devices_online"))
