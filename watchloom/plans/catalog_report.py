"""Fleet, hunting and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators import fleet as fl
from watchloom.operators.hunt import Hunt, recent, recent_anomalies, recent_audit
from watchloom.operators.report import (
    control_coverage, report_rollup, system_stats, threats_by_category, top_devices, top_indicators, top_threats,
)
from watchloom.plans.catalog import query
from watchloom.plans.catalog_respond import _PLAN_SQL, planned
from watchloom.plans.sql import quote, values
from watchloom.plans.views import table, view, with_views
from watchloom.rules.reference_lists import FRAMEWORK_CONTROLS

_AS_OF = 1706659200000
_START, _END = 1704067200000 + 200_000, 1704067200000 + 900_000

# ----- fleet -----

_FLEET_SQL = """q as (select distinct device_id from det where source = 'fim' and severity = 'critical' and value > 200),
 fleet as materialized (select t.device_id, hostname, machine_ip, first_seen_ms, last_seen_ms, last_seen_ms as last_telemetry_ms, total_reports, coalesce(al, 0) as total_alerts, coalesce(th, 0) as total_threats, coalesce(io, 0) as total_ioc_hits, coalesce(fi, 0) as total_fim_changes,
  coalesce(last_fim, 0) as last_fim_scan_ms, q.device_id is not null as quarantined from
 (select device_id, arg_max(machine_name, (timestamp_ms, event_id)) as hostname, arg_max(machine_ip, (timestamp_ms, event_id)) as machine_ip, min(timestamp_ms) as first_seen_ms, max(timestamp_ms) as last_seen_ms, count(*) as total_reports from tel group by device_id) t
 left join (select device_id, count(*) filter (source = 'session') as al, count(*) filter (source = 'traffic') as th, count(*) filter (source = 'ioc') as io, count(*) filter (source = 'fim') as fi, max(timestamp_ms) filter (source = 'fim') as last_fim from det group by device_id) c on c.device_id = t.device_id
 left join q on q.device_id = t.device_id)"""


def devices(spark, d):
    det = view(spark, d, "det")
    of = lambda s: det.filter(F.col("source") == s)
    return fl.fleet(
        view(spark, d, "tel"), {"alerts": of("session"), "threats": of("traffic"), "ioc_hits": of("ioc"), "fim_changes": of("fim")},
        fim_scans=of("fim"), quarantine=of("fim").filter("severity = 'critical' and value > 200").select("device_id").distinct(),
        tiebreak="event_id",
    )


# The last reports of the fleet end near this time, so all three states occur.
_NOW = 1706659155261 + 240_000


def _status_sql(tail: str) -> str:
    return with_views(["tel", "det"], f"""{_FLEET_SQL}, st as (select *, case when ({_NOW} - last_seen_ms) // 1000 < 300 then 'online' when ({_NOW} - last_seen_ms) // 1000 < 900 then 'stale' else 'offline' end as status,
 round(greatest(0.0, least(1.0, 1.0 - case when ({_NOW} - last_seen_ms) / 1000.0 > 300 then 0.3 else 0 end - case when ({_NOW} - last_seen_ms) / 1000.0 > 900 then 0.4 else 0 end - case when quarantined then 0.2 else 0 end - case when total_threats > 10 then 0.1 else 0 end)), 6) as health_score from fleet) {tail}""")


@query("fleet", with_views(["tel", "det"], f"{_FLEET_SQL} select * from fleet"))
def q_fleet(spark, d):
    return devices(spark, d)


@query("fleet_status", _status_sql("select device_id, status from st"))
def q_fleet_status(spark, d):
    return fl.fleet_status(devices(spark, d), _NOW).select("device_id", "status")


@query("fleet_health", _status_sql("select device_id, cast(health_score as double) as health_score from st"))
def q_fleet_health(spark, d):
    return fl.fleet_health(devices(spark, d), _NOW).select("device_id", "health_score")


@query("fleet_summary", _status_sql("select count(*) as total, count(*) filter (status = 'online') as online, count(*) filter (status = 'stale') as stale, count(*) filter (status = 'offline') as offline, count(*) filter (quarantined) as quarantined from st"))
def q_fleet_summary(spark, d):
    return fl.fleet_summary(devices(spark, d), _NOW)


@query("devices_by_status", _status_sql("select device_id, hostname, status from st where status = 'offline'"))
def q_devices_by_status(spark, d):
    return fl.devices_by_status(devices(spark, d), "offline", _NOW).select("device_id", "hostname", "status")


@query("devices_by_group", """select c_custkey as device_id, c_name as hostname from customer where c_mktsegment = 'BUILDING'""")
def q_devices_by_group(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey as device_id", "c_name as hostname", "c_mktsegment as device_group")
    return fl.devices_by_group(rows, "BUILDING").select("device_id", "hostname")


@query("device_tags", """select c_custkey as device_id, 'prod' as tag from customer where c_acctbal > 0 union all select c_custkey, c_mktsegment from customer where c_acctbal > 0 and c_mktsegment <> 'MACHINERY'""")
def device_tags(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey as device_id", "array(c_mktsegment) as tags", "c_acctbal")
    tagged = fl.add_tag(fl.add_tag(rows, "prod"), "prod", F.col("c_acctbal") > 0)
    tagged = fl.remove_tag(fl.remove_tag(tagged, "MACHINERY"), "prod", F.col("c_acctbal") <= 0)
    return fl.with_tag(tagged, "prod").select("device_id", F.explode("tags").alias("tag"))


@query("online_devices", with_views(["tel"], f"select count(distinct device_id) as devices_online from tel where timestamp_ms > {_AS_OF} - 604800000 and timestamp_ms <= {_AS_OF}"))
def q_online_devices(spark, d):
    return fl.online_devices(view(spark, d, "tel"), _AS_OF, 604_800)


# ----- hunting -----

_THREATS_SQL = """th as materialized (select device_id, timestamp_ms, machine_ip, category, concat(source, '_x') as sub_type, severity, value as confidence, mitre_id, '' as mitre_name, '' as mitre_tactic, description, timestamp_ms + event_id % 100 as received_at from det)"""


def threats(spark, d):
    return view(spark, d, "det").selectExpr(
        "device_id", "timestamp_ms", "machine_ip", "category", "concat(source, '_x') as sub_type", "severity", "value as confidence",
        "mitre_id", "'' as mitre_name", "'' as mitre_tactic", "description", "timestamp_ms + event_id % 100 as received_at")


def _hunt(spark, d):
    return Hunt(spark, {"threat_detections": threats(spark, d)}).search("threats")


def _th_sql(tail: str) -> str:
    return with_views(["det"], f"{_THREATS_SQL} {tail}")


_REST = "device_id, timestamp_ms, machine_ip, category, sub_type, severity, confidence, mitre_id, mitre_name, mitre_tactic, description, received_at"


@query("hunt_where", _th_sql(f"select device_id, timestamp_ms, severity, mitre_id, description from (select * from th where (severity = 'critical' and mitre_id ilike '%t100_%') or device_id < 5 order by received_at desc, {_REST} limit 20000)"))
def hunt_where(spark, d):
    return (_hunt(spark, d).where("severity", "=", "critical").where("mitre_id", "~", "t100_").where("device_id", "<", 5, "OR")
            .head(20000).fields("device_id", "timestamp_ms", "severity", "mitre_id", "description").run())


@query("hunt_sort", _th_sql(f"select * from th where confidence >= 100.5 and category <> 'dns_tunnel' order by confidence asc, {_REST} limit 200"))
def hunt_sort(spark, d):
    return _hunt(spark, d).where("confidence", ">=", 100.5).where("category", "!=", "dns_tunnel").sort("confidence", "asc").limit(200).run()


@query("hunt_default", _th_sql(f"select * from th order by received_at desc, {_REST} limit 50"))
def hunt_default(spark, d):
    return _hunt(spark, d).run()


@query("hunt_stats", _th_sql("select category, count(*) as count from th where device_id > 3 group by category order by count desc, category"))
def hunt_stats(spark, d):
    return _hunt(spark, d).where("device_id", ">", 3).stats_count("category").run()


@query("hunt_stats_total", _th_sql("select count(*) as count from th where severity = 'high'"))
def hunt_stats_total(spark, d):
    return _hunt(spark, d).where("severity", "=", "high").sort("severity").stats_count().run()


@query("hunt_audit", with_views(["audit"], "select username, count(*) as count from audit where success = false and tenant_id = 'tenant2' group by username order by count desc, username"))
def hunt_audit(spark, d):
    return Hunt(spark, {"audit_log": view(spark, d, "audit")}).search("audit").where("success", "=", False).where("tenant_id", "=", "tenant2").stats_count("username").run()


@query("hunt_audit_default", with_views(["audit"], "select username, action, source_ip from audit order by timestamp_ms desc, username, tenant_id, action, source_ip, success limit 50"))
def hunt_audit_default(spark, d):
    return Hunt(spark, {"audit_log": view(spark, d, "audit")}).search("audit").fields("username", "action", "source_ip").run()


@query("hunt_correlations", with_views(["det"], """c as (select cast(event_id as varchar) as incident_id, category as rule_name, severity, '' as mitre_tactic, mitre_id as mitre_technique, description, timestamp_ms as first_seen_ms, timestamp_ms + 5 as last_seen_ms from det)
 select * from c where severity = 'critical' order by first_seen_ms desc, incident_id limit 300"""))
def hunt_correlations(spark, d):
    rows = view(spark, d, "det").selectExpr(
        "cast(event_id as string) as incident_id", "category as rule_name", "severity", "'' as mitre_tactic", "mitre_id as mitre_technique",
        "description", "timestamp_ms as first_seen_ms", "timestamp_ms + 5 as last_seen_ms")
    return Hunt(spark, {"correlations_view": rows}).search("correlations").where("severity", "=", "critical").head(300).run()


@query("hunt_backslash", with_views(["det"], r"""select event_id as device_id, concat('C:\Windows\x', event_id, ' 50%') as description from det where event_id % 3 = 0"""))
def hunt_backslash(spark, d):
    path = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("C:\\Windows\\x"), F.col("event_id").cast("string"), F.lit(" 50%"))).otherwise("C:/Windows")
    rows = view(spark, d, "det").select(F.col("event_id").alias("device_id"), path.alias("description"), F.lit(0).alias("received_at"))
    found = Hunt(spark, {"threat_detections": rows}).search("threats").where("description", "~", "c:\\windows\\")
    return found.head(1_000_000).fields("device_id", "description").run()


_RECENT = "device_id, timestamp_ms, machine_ip, category, sub_type, severity, confidence, mitre_id, mitre_name, description"


@query("recent", _th_sql(f"select {_RECENT} from th where device_id = 7 order by received_at desc, {_RECENT} limit 5000"))
def q_recent(spark, d):
    return recent(threats(spark, d), "threat_detections", 5000, 7)


@query("recent_anomalies", _th_sql("""select device_id, timestamp_ms, machine_ip, sub_type as detector, confidence as score, severity, mitre_id, description, evidence from
 (select *, 'e' as evidence from th where category = 'c2_beacon') order by received_at desc, device_id, timestamp_ms, machine_ip, detector, score, severity, mitre_id, description, evidence limit 50"""))
def q_recent_anomalies(spark, d):
    rows = threats(spark, d).withColumn("evidence", F.lit("e")).withColumn(
        "category", F.when(F.col("category") == "c2_beacon", "ml_anomaly").otherwise(F.col("category")))
    return recent_anomalies(rows)


@query("recent_audit", with_views(["audit"], "select * from audit order by timestamp_ms desc, username, action, tenant_id, source_ip, detail limit 100"))
def q_recent_audit(spark, d):
    return recent_audit(view(spark, d, "audit"))


# ----- reports -----

def _tables(spark, d):
    det = view(spark, d, "det")
    return {
        "threat_detections": threats(spark, d), "ioc_matches": det.filter("source = 'ioc'"),
        "fim_events": det.filter("source = 'fim'"), "ioc_feed": view(spark, d, "ioc_feed"),
        "telemetry": view(spark, d, "tel"), "ir_actions": planned(spark, d), "fleet": devices(spark, d),
    }


@query("system_stats", with_views(["det", "tel", "ioc_feed"], f"""{_THREATS_SQL}, {_PLAN_SQL}, {_FLEET_SQL},
 st as (select *, case when ({_NOW} - last_seen_ms) // 1000 < 300 then 'online' when ({_NOW} - last_seen_ms) // 1000 < 900 then 'stale' else 'offline' end as status from fleet)
 select (select count(*) from th) as total_threats, (select count(*) from det where source = 'ioc') as total_ioc_hits, (select count(*) from det where source = 'fim') as total_fim_changes, (select count(*) from ioc_feed) as iocs_loaded,
 (select count(*) from plan) as ir_actions_executed, (select count(distinct device_id) from tel where timestamp_ms > {_NOW} - 300000 and timestamp_ms <= {_NOW}) as devices_online, (select count(distinct feed_source) from ioc_feed) as feeds_loaded,
 cast(0 as bigint) as sigma_hits, cast(0 as bigint) as ml_findings, (select count(distinct target) from plan where action_type = 'block_ip') as ir_blocked_ips, (select count(distinct device_id) from plan where action_type = 'quarantine') as ir_quarantined,
 (select count(*) from st) as fleet_total, (select count(*) from st where status = 'online') as fleet_online, (select count(*) from st where status = 'stale') as fleet_stale, (select count(*) from st where status = 'offline') as fleet_offline,
 (select count(*) from st where quarantined) as fleet_quarantined""", recursive=True))
def q_system_stats(spark, d):
    return system_stats(_tables(spark, d), _NOW)


_IN = f"timestamp_ms >= {_START} and timestamp_ms < {_END}"


@query("report_rollup", with_views(["det", "tel"], f"""{_THREATS_SQL}, {_PLAN_SQL}, {_FLEET_SQL}, st as (select *, case when ({_END} - last_seen_ms) // 1000 < 300 then 'online' when ({_END} - last_seen_ms) // 1000 < 900 then 'stale' else 'offline' end as status from fleet)
 select (select count(*) from th where {_IN}) as threats_total, (select count(*) from th where {_IN} and severity = 'critical') as threats_critical, (select count(*) from th where {_IN} and severity = 'high') as threats_high,
 (select count(*) from th where {_IN} and severity = 'medium') as threats_medium, (select count(*) from det where source = 'ioc' and {_IN}) as ioc_hits_total, (select count(*) from det where source = 'fim' and {_IN}) as fim_events_total,
 (select count(*) from plan where {_IN}) as ir_actions_executed, (select count(distinct target) from plan where {_IN} and action_type = 'block_ip') as ir_blocked_ips, (select count(distinct device_id) from plan where {_IN} and action_type = 'quarantine') as ir_quarantines,
 (select count(*) from st) as devices_total, (select count(*) from st where status = 'online') as devices_online, (select count(*) from st where status = 'offline') as devices_offline, (select count(*) from st where quarantined) as devices_quarantined""", recursive=True))
def q_report_rollup(spark, d):
    return report_rollup(_tables(spark, d), _START, _END)


@query("threats_by_category", _th_sql(f"select category, count(*) as threats from th where {_IN} group by category"))
def q_threats_by_category(spark, d):
    return threats_by_category(threats(spark, d), _START, _END)


@query("top_threats", _th_sql("select device_id, category, mitre_id, count(*) as events from th group by all order by events desc, device_id, category, mitre_id limit 10"))
def q_top_threats(spark, d):
    return top_threats(threats(spark, d))


@query("top_devices", _th_sql("select device_id, count(*) as events from th group by device_id order by events desc, device_id limit 10"))
def q_top_devices(spark, d):
    return top_devices(threats(spark, d))


@query("top_indicators", with_views(["det"], "select 'ip' as ioc_type, ioc_value, count(*) as hits from det where ioc_value <> '' group by all order by hits desc, ioc_type, ioc_value limit 10"))
def q_top_indicators(spark, d):
    return top_indicators(view(spark, d, "det").filter("ioc_value <> ''").withColumn("ioc_type", F.lit("ip")))


_CONTROLS = [(fw, c, i) for fw, controls in FRAMEWORK_CONTROLS.items() for i, c in enumerate(controls, 1)]
_NOTED = "A.9 Access control"
_DEFAULT_NOTE = "Monitored by watchloom baseline controls (see detection/telemetry rollups above)."


@query("control_coverage", with_views(["audit"], f"""{values('k', ['framework', 'control', 'position'], _CONTROLS)}
 select framework, control, position, case when control = {quote(_NOTED)} then (select concat(count(*), ' failed logins audited') from audit where action = 'login' and not success) else {quote(_DEFAULT_NOTE)} end as note from k"""))
def q_control_coverage(spark, d):
    audit = view(spark, d, "audit").filter("action = 'login' and not success")
    notes = audit.agg(F.concat(F.count("*").cast("string"), F.lit(" failed logins audited")).alias("note")).select(F.lit(_NOTED).alias("control"), "note")
    out = None
    for framework in [*FRAMEWORK_CONTROLS, "unknown"]:
        part = control_coverage(spark, framework, notes).select(F.lit(framework).alias("framework"), "control", "position", "note")
        out = part if out is None else out.unionByName(part)
    return out
