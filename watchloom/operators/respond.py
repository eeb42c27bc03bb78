"""Incident response: which actions to take, and their bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import case_of, compact, explode_once
from watchloom.functions.severity import RANKS, at_least, severity_rank
from watchloom.operators.cooldown import cooldown
from watchloom.rules.correlation import CATEGORY_ALIASES
from watchloom.rules.playbooks import DEFAULT_PLAYBOOKS, Playbook

IR_COLUMNS = ["device_id", "timestamp_ms", "machine_ip", "source", "category", "severity", "mitre_id",
              "description", "ioc_value", "file_path"]


def _incident(df: DataFrame, source: str, **columns: Column | str) -> DataFrame:
    have = set(df.columns)
    out = []
    for name in IR_COLUMNS:
        if name == "source":
            value = F.lit(source)
        elif name in columns:
            value = columns[name] if isinstance(columns[name], Column) else F.col(columns[name])
        else:
            value = F.col(name) if name in have else F.lit("")
        out.append(value.cast("long" if name in ("device_id", "timestamp_ms") else "string").alias(name))
    return df.select(*out)


def ir_incidents(
    *,
    threats: DataFrame | None = None,
    iocs: DataFrame | None = None,
    network: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    security_events: DataFrame | None = None,
    fim: DataFrame | None = None,
    processes: DataFrame | None = None,
    usb: DataFrame | None = None,
    correlations: DataFrame | None = None,
    sigma: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Everything that may trigger a playbook, in one schema.

    ``event_id`` is a hash of the row: it orders incidents of equal time the
    same way in every run.
    """
    high = lambda df: df.filter(at_least("severity", "high"))
    parts = []
    if threats is not None:
        category = F.col("category") if strict else F.coalesce(
            case_of("category", CATEGORY_ALIASES, None), F.col("category"))
        parts.append(_incident(threats, "traffic_classifier", category=category))
    if iocs is not None:
        parts.append(_incident(iocs, "threat_intel", category=F.lit("ioc_match")))
    if network is not None:
        parts.append(_incident(network, "network_inspector", ioc_value="indicator"))
    if anomalies is not None:
        parts.append(_incident(high(anomalies), "ml_anomaly", category="detector"))
    if security_events is not None:
        parts.append(_incident(high(security_events), "alert_engine", category="rule_name", description="matched_text"))
    if fim is not None:
        parts.append(_incident(fim, "fim", category=F.concat(F.lit("fim_"), F.col("change_type")), file_path="path"))
    if processes is not None:
        parts.append(_incident(processes, "process_monitor", category=F.lit("suspicious_process"),
                               severity=F.lit("high"), description=F.concat_ws(": ", "reason", "name")))
    if usb is not None:
        rows = usb.filter("change_type = 'unauthorized'")
        what = F.concat(F.lit("Unauthorised USB device: "), F.concat_ws(":", "vendor_id", "product_id"))
        if "product_name" in usb.columns:
            named = F.coalesce(F.col("product_name"), F.lit("")) != ""
            what = F.when(named, F.concat(what, F.lit(" ("), F.col("product_name"), F.lit(")"))).otherwise(what)
        parts.append(_incident(rows, "usb_monitor", category=F.lit("usb_unauthorized"), severity=F.lit("high"),
                               description=what))
    if correlations is not None:
        parts.append(_incident(correlations, "correlation", device_id="first_device", timestamp_ms="first_seen_ms",
                               category="rule_name", mitre_id="mitre_technique"))
    if sigma is not None:
        parts.append(_incident(sigma, "sigma", category="rule_title"))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.withColumn("event_id", F.xxhash64(*IR_COLUMNS))


def _playbook_match(p: Playbook) -> Column:
    tests = [severity_rank("severity") >= RANKS.get(p.min_severity, 0)]
    if p.source:
        tests.append(F.col("source") == p.source)
    if p.category:
        tests.append(F.col("category") == p.category)
    return reduce(lambda a, b: a & b, tests)


def _actions(p: Playbook) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(a.type).alias("action_type"), F.lit(a.target).alias("target"),
                 F.lit(a.params).alias("params"), F.lit(a.duration_s).alias("duration_s"))
        for i, a in enumerate(p.actions)
    ])


def plan_actions(
    incidents: DataFrame,
    playbooks: Sequence[Playbook] = tuple(DEFAULT_PLAYBOOKS),
    *,
    tiebreak: str = "event_id",
    webhook_url: str = "",
) -> DataFrame:
    """One row per action of every playbook an incident triggers.

    Playbooks are literals of one projection; a playbook rests for its
    cooldown per device and category. ``tiebreak`` orders incidents of equal
    time and is unique among them.
    """
    matches = compact(*[
        F.when(_playbook_match(p), F.struct(
            F.lit(p.name).alias("playbook"), F.lit(i).alias("playbook_order"), F.lit(p.cooldown_seconds).cast("long").alias("_gap"),
            _actions(p).alias("_actions")))
        for i, p in enumerate(playbooks) if p.enabled
    ])
    matched = explode_once(incidents, ["*"], matches, "_p").select(*incidents.columns, "_p.*")
    fired = cooldown(matched, ["device_id", "category", "playbook"], "_gap", tiebreak=tiebreak)
    target = (
        F.when(F.col("_a.target") != "", F.col("_a.target"))
        .when(F.col("_a.action_type") == "block_ip",
              F.when(F.coalesce(F.col("ioc_value"), F.lit("")) == "", F.col("machine_ip")).otherwise(F.col("ioc_value")))
        .when(F.col("_a.action_type") == "quarantine", F.col("device_id").cast("string"))
        .when(F.col("_a.action_type") == "webhook", F.lit(webhook_url))
        .otherwise("")
    )
    return (
        fired.select("*", F.explode("_actions").alias("_a"))
        .select("device_id", "timestamp_ms", tiebreak, F.col("source").alias("incident_source"),
                F.col("category").alias("incident_category"), "severity", "description", "playbook", "playbook_order",
                F.col("_a.step").alias("step"), F.col("_a.action_type").alias("action_type"),
                target.alias("target"), F.col("_a.params").alias("params"), F.col("_a.duration_s").alias("duration_s"))
    )


def action_results(actions: DataFrame) -> DataFrame:
    """Audit row per action: whether it can be carried out, and a detail text."""
    kind, target = F.col("action_type"), F.col("target")
    success = (
        F.when(kind == "webhook", target != "")
        .when(kind == "script", (target != "") & ~target.contains(".."))
        .otherwise(F.lit(True))
    )
    text = lambda head, tail: F.concat(F.lit(head), tail)
    device = F.col("device_id").cast("string")
    detail = (
        F.when(kind == "log", text("Incident logged: ", F.col("description")))
        .when(kind == "block_ip", text("IP blocked: ", target))
        .when(kind == "quarantine", text("Device quarantined: ", device))
        .when((kind == "webhook") & success, text("Webhook queued: ", target))
        .when(kind == "webhook", "No webhook URL")
        .when((kind == "script") & success, text("Script queued: ", target))
        .when(kind == "script", "Invalid script path")
        .when(kind == "rate_limit", text("Rate limit applied: ", target))
        .when(kind == "disable_user", text("User flagged from device ", device))
    )
    return actions.withColumn("success", success).withColumn("detail", detail)


def blocklist(actions: DataFrame, as_of_ms: int | Column, *, tiebreak: str = "event_id") -> DataFrame:
    """Latest block of every address; 0 expiry is permanent.

    A maximum over ordered structs combines on the map side, so one address
    blocked over and over costs one row per task.
    """
    as_of = F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms
    blocks = actions.filter("action_type = 'block_ip'")
    expiry = F.when(F.col("duration_s") > 0, F.col("timestamp_ms") + F.col("duration_s") * 1000).otherwise(0).cast("long")
    latest = blocks.groupBy(F.col("target").alias("ip")).agg(F.max(F.struct(
        "timestamp_ms", tiebreak, "playbook_order", expiry.alias("expires_at_ms"),
        F.col("description").alias("reason"), "device_id")).alias("_b"))
    return latest.select(
        "ip", F.col("_b.timestamp_ms").alias("blocked_at_ms"), F.col("_b.expires_at_ms").alias("expires_at_ms"),
        F.col("_b.reason").alias("reason"), F.col("_b.device_id").alias("device_id"),
    ).withColumn("active", (F.col("expires_at_ms") == 0) | (as_of <= F.col("expires_at_ms")))


def quarantined(actions: DataFrame) -> DataFrame:
    return actions.filter("action_type = 'quarantine'").select("device_id").distinct()


SOAR_COLUMNS = ["type", "severity", "title", "description", "mitre_id", "source", "device_id", "timestamp_ms", "fields"]


def _export(df: DataFrame, source: str, kind: str, title: Column, fields: dict[str, Column | str],
            severity: Column | None = None, description: Column | None = None) -> DataFrame:
    pairs = []
    for name, value in fields.items():
        value = F.col(value) if isinstance(value, str) else value
        pairs += [F.lit(name), F.coalesce(value.cast("string"), F.lit(""))]
    mitre = F.col("mitre_id") if "mitre_id" in df.columns else F.lit("")
    return df.select(
        F.lit(kind).alias("type"), (severity if severity is not None else F.col("severity")).alias("severity"),
        title.alias("title"), (description if description is not None else F.col("description")).alias("description"),
        mitre.alias("mitre_id"), F.lit(source).alias("source"), F.col("device_id").cast("long").alias("device_id"),
        F.col("timestamp_ms").cast("long").alias("timestamp_ms"), F.create_map(*pairs).alias("fields"),
    )


def soar_route(
    *,
    threats: DataFrame | None = None,
    iocs: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    fim: DataFrame | None = None,
    sigma: DataFrame | None = None,
    usb: DataFrame | None = None,
) -> DataFrame:
    """Detections worth exporting: high and critical ones, and unauthorized USB devices."""
    high = lambda df: df.filter(at_least("severity", "high"))
    c = F.col
    parts = []
    if threats is not None:
        parts.append(_export(high(threats), "traffic_classifier", "alert", F.concat_ws("/", "category", "sub_type"),
                             {"category": "category", "sub_type": "sub_type", "machine_ip": "machine_ip"}))
    if iocs is not None:
        parts.append(_export(high(iocs), "threat_intel", "observable", F.concat(F.lit("IoC hit: "), c("ioc_type")),
                             {"ioc_type": "ioc_type", "ioc_value": "ioc_value", "feed": "feed_source",
                              "machine_ip": "machine_ip"}))
    if anomalies is not None:
        parts.append(_export(high(anomalies), "ml_anomaly", "alert", F.concat(F.lit("ML anomaly: "), c("detector")),
                             {"detector": "detector", "score": F.format_string("%.6f", c("score")),
                              "machine_ip": "machine_ip"}))
    if fim is not None:
        parts.append(_export(high(fim), "fim", "incident",
                             F.concat(F.lit("FIM "), c("change_type"), F.lit(": "), c("path")),
                             {"path": "path", "change": "change_type", "machine_ip": "machine_ip"}))
    if sigma is not None:
        parts.append(_export(high(sigma), "sigma", "alert", F.concat(F.lit("Sigma: "), c("rule_title")),
                             {"rule_id": "rule_id", "machine_ip": "machine_ip"}))
    if usb is not None:
        pair = F.concat_ws(":", "vendor_id", "product_id")
        parts.append(_export(usb.filter("change_type = 'unauthorized'"), "usb_monitor", "incident",
                             F.lit("Unauthorised USB device"),
                             {"vid_pid": pair, "serial": "serial", "device_class": "device_class",
                              "machine_ip": "machine_ip"},
                             severity=F.lit("high"),
                             description=F.concat(pair, F.lit(" on "), c("machine_ip"))))
    return reduce(lambda a, b: a.unionByName(b), parts)


def soar_inbound(messages: DataFrame, body: str = "body", ts: str = "timestamp_ms") -> DataFrame:
    """Inbound action messages (JSON) as incidents; messages without an action are rejected."""
    fields = F.from_json(body, "action string, target string, reason string, request_id string")
    rows = messages.withColumn("_j", fields).filter(F.coalesce(F.col("_j.action"), F.lit("")) != "")
    text = lambda name: F.coalesce(F.col(f"_j.{name}"), F.lit(""))
    return _incident(
        rows, "soar", device_id=F.lit(0), timestamp_ms=ts, category=F.lit("soar_action"), severity=F.lit("high"),
        machine_ip=F.lit(""), mitre_id=F.lit(""),
        description=F.concat(text("action"), F.lit(" -> "), text("target"), F.lit(" ("), text("reason"), F.lit(")")),
        ioc_value=F.lit(""), file_path=F.lit(""),
    )
