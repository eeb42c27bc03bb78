"""Explicit schemas of the stored and incoming tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _struct(spec: str) -> T.StructType:
    """Schema of ``name type, name type`` text; needs no session, unlike ``fromDDL``."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


TELEMETRY = _struct(
    "device_id int, timestamp_ms bigint, machine_name string, machine_ip string, os_user string, "
    "cpu_idle_ticks bigint, cpu_kernel_ticks bigint, cpu_user_ticks bigint, ram_total_bytes bigint, "
    "ram_avail_bytes bigint, disk_total_bytes bigint, disk_free_bytes bigint, net_bytes_in bigint, "
    "net_bytes_out bigint, raw_log string"
)

# Stored tables; received_at and the partition column are added when written.
TABLES = {
    "telemetry": _struct(
        "device_id int, timestamp_ms bigint, machine_name string, machine_ip string, os_user string, "
        "cpu_usage_pct double, ram_total_bytes bigint, ram_avail_bytes bigint, disk_total_bytes bigint, "
        "disk_free_bytes bigint, net_bytes_in bigint, net_bytes_out bigint"
    ),
    "security_events": _struct(
        "device_id int, timestamp_ms bigint, machine_ip string, rule_name string, severity string, "
        "category string, matched_text string"
    ),
    "threat_detections": _struct(
        "device_id int, timestamp_ms bigint, machine_ip string, category string, sub_type string, severity string, "
        "confidence double, mitre_id string, mitre_name string, mitre_tactic string, description string, evidence string"
    ),
    "ioc_matches": _struct(
        "device_id int, timestamp_ms bigint, machine_ip string, ioc_type string, ioc_value string, severity string, "
        "feed_source string, matched_in string, mitre_id string, description string, tags string"
    ),
    "fim_events": _struct(
        "device_id int, timestamp_ms bigint, machine_ip string, change_type string, file_path string, "
        "old_hash string, new_hash string, old_size bigint, new_size bigint, severity string, mitre_id string, "
        "description string"
    ),
    "correlations_view": _struct(
        "incident_id string, rule_name string, severity string, mitre_tactic string, mitre_technique string, "
        "description string, first_seen_ms bigint, last_seen_ms bigint"
    ),
    "audit_log": _struct(
        "timestamp_ms bigint, username string, tenant_id string, action string, success boolean, source_ip string, "
        "detail string"
    ),
}

SYSLOG_RAW = _struct("raw string, source_ip string")
