"""Rule scan, alerts, telemetry and traffic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators.auth import failed_logins, linux_auth_events
from watchloom.operators.cooldown import cooldown, threshold_alerts
from watchloom.operators.rule_scan import scan_rules
from watchloom.operators.telemetry import (
    baseline_snapshot, default_metrics, event_counts, ewma_baseline, monotonic, telemetry_features,
)
from watchloom.operators.traffic import SIGNATURES, classify_logs, classify_traffic
from watchloom.operators.windows import sliding_count
from watchloom.plans.catalog import query
from watchloom.plans.sql import MITRE, MITRE_COLUMNS, quote, rule_hits, stable
from watchloom.plans.views import view, with_views
from watchloom.rules.detection import DEFAULT_THRESHOLDS, Threshold
from watchloom.sinks.tables import telemetry_csv

_HIT = ["event_id", "device_id", "timestamp_ms", "machine_ip", "rule_name", "severity", "category", "matched_text"]


@query("rule_scan", with_views(["sec_log"], f"{rule_hits('sec_log')} select {', '.join(_HIT)} from hits"))
def rule_scan(spark, d):
    return scan_rules(view(spark, d, "sec_log")).select(*_HIT)


@query("rule_scan_chunks", with_views(["chunk"], rule_hits("chunk", carry="event_id, device_id, timestamp_ms")
                                      + " select event_id, rule_name, matched_text, count(*) as hits from hits group by all"))
def rule_scan_chunks(spark, d):
    hits = scan_rules(view(spark, d, "chunk"))
    return hits.groupBy("event_id", "rule_name", "matched_text").agg(F.count("*").alias("hits"))


@query("rule_counts", with_views(["chunk"], rule_hits("chunk", carry="event_id, device_id, timestamp_ms") + """
 select c.event_id, c.device_id, count(h.rule_name) as event_count, count(h.rule_name) filter (h.category = 'auth_failure') as auth_failures
 from chunk c left join hits h on h.event_id = c.event_id group by c.event_id, c.device_id"""))
def rule_counts(spark, d):
    logs = view(spark, d, "chunk")
    counts = event_counts(logs, scan_rules(logs), on=["event_id"])
    return counts.select("event_id", "device_id", "event_count", "auth_failures")


@query("sliding_count", with_views(["sec_log"], rule_hits("sec_log") + """
 select event_id, device_id, category, timestamp_ms, rule_name, count(*) over (partition by device_id, category order by timestamp_ms
  range between 300000 preceding and current row) as window_count from hits"""))
def q_sliding_count(spark, d):
    events = scan_rules(view(spark, d, "sec_log"))
    return sliding_count(events, 300).select("event_id", "device_id", "category", "timestamp_ms", "rule_name", "window_count")


@query("cooldown", with_views(["det"], """r as (select *, row_number() over (partition by device_id order by timestamp_ms, event_id) as rn from det),
 g as (select device_id, rn, timestamp_ms as last_ms, true as kept from r where rn = 1
  union all select r.device_id, r.rn, case when r.timestamp_ms - g.last_ms >= 600000 then r.timestamp_ms else g.last_ms end, r.timestamp_ms - g.last_ms >= 600000
  from g join r on r.device_id = g.device_id and r.rn = g.rn + 1)
 select r.event_id, r.device_id, r.timestamp_ms, r.severity from g join r using (device_id, rn) where kept""", recursive=True))
def q_cooldown(spark, d):
    kept = cooldown(view(spark, d, "det"), ["device_id"], 600)
    return kept.select("event_id", "device_id", "timestamp_ms", "severity")


def _alert_sql(thresholds: list[Threshold]) -> str:
    rows = ", ".join(f"({quote(t.category)}, {t.count}, {t.window_sec}, {t.cooldown_sec})" for t in thresholds)
    return with_views(["sec_log"], rule_hits("sec_log") + f""",
 th(category, need, window_sec, cooldown_sec) as (values {rows}),
 r as (select h.*, need, window_sec, cooldown_sec, row_number() over k as rn, list(timestamp_ms) over (partition by device_id, h.category order by timestamp_ms, event_id, rule_no rows between unbounded preceding and current row) as seen
  from hits h join th on th.category = h.category window k as (partition by device_id, h.category order by timestamp_ms, event_id, rule_no)),
 g as (select device_id, category, cast(0 as bigint) as rn, cast(null as bigint) as last_ms, cast(0 as bigint) as cleared, false as fired, cast(0 as bigint) as n from r where rn = 1
  union all select device_id, category, rn, case when fires then timestamp_ms else last_ms end, case when fires then rn else cleared end, fires, n from
   (select *, n >= need and (last_ms is null or timestamp_ms - last_ms >= cooldown_sec * 1000) as fires from
    (select r.device_id, r.category, r.rn, r.timestamp_ms, r.need, r.cooldown_sec, g.last_ms, g.cleared,
      cast(len([x for x in list_slice(r.seen, g.cleared + 1, r.rn) if x >= r.timestamp_ms - r.window_sec * 1000]) as bigint) as n
     from g join r on r.device_id = g.device_id and r.category = g.category and r.rn = g.rn + 1)))
 select r.event_id, r.device_id, r.timestamp_ms, r.machine_ip, r.category, r.severity, r.rule_name, g.n as event_count, cast(r.need as bigint) as threshold, cast(r.window_sec as bigint) as window_sec,
  concat('[', strftime(make_timestamp(r.timestamp_ms // 1000 * 1000000), '%Y-%m-%d %H:%M:%S'), '] [ALERT] device=', r.device_id, ' ip=', r.machine_ip, ' category=', r.category, ' severity=', r.severity,
   ' rule=', r.rule_name, ' count=', g.n, '/', r.need, ' window=', r.window_sec, 's | ', r.matched_text) as alert_line
 from g join r using (device_id, category, rn) where g.fired""", recursive=True)


_ALERT = ["event_id", "device_id", "timestamp_ms", "machine_ip", "category", "severity", "rule_name", "event_count",
          "threshold", "window_sec", "alert_line"]
# Overrides whose cooldown does not outlast the window, so cleared history matters.
_COUPLED = [Threshold("auth_failure", 3, 7200, 60), Threshold("firewall", 2, 3600, 600)]


@query("threshold_alerts", _alert_sql(DEFAULT_THRESHOLDS))
def q_threshold_alerts(spark, d):
    return threshold_alerts(scan_rules(view(spark, d, "sec_log"))).select(*_ALERT)


@query("threshold_alerts_coupled", _alert_sql(_COUPLED))
def q_threshold_alerts_coupled(spark, d):
    return threshold_alerts(scan_rules(view(spark, d, "sec_log")), _COUPLED).select(*_ALERT)


@query("monotonic", with_views(["arrivals"], """select arrival, device_id, timestamp_ms, value from (select *, max(timestamp_ms) over (partition by device_id order by arrival
  rows between unbounded preceding and 1 preceding) as newest from arrivals) where newest is null or timestamp_ms > newest"""))
def q_monotonic(spark, d):
    return monotonic(view(spark, d, "arrivals"), "arrival", segment=1000).select("arrival", "device_id", "timestamp_ms", "value")


_FEATURES_SQL = """feat as (select event_id, device_id, timestamp_ms, machine_ip, row_number() over w as seq,
 case when lag(timestamp_ms) over w is null then 0.0 when (cpu_user_ticks + cpu_idle_ticks) - lag(cpu_user_ticks + cpu_idle_ticks) over w > 0
  then 100.0 * (1.0 - (cpu_idle_ticks - lag(cpu_idle_ticks) over w) / ((cpu_user_ticks + cpu_idle_ticks) - lag(cpu_user_ticks + cpu_idle_ticks) over w)) else 0.0 end as cpu_pct,
 100.0 * (1.0 - ram_avail_bytes / ram_total_bytes) as ram_pct, 100.0 * disk_free_bytes / disk_total_bytes as disk_free_pct,
 case when lag(timestamp_ms) over w is not null then greatest(0, net_bytes_in - lag(net_bytes_in) over w) end as net_in_delta,
 case when lag(timestamp_ms) over w is not null then greatest(0, net_bytes_out - lag(net_bytes_out) over w) end as net_out_delta,
 timestamp_ms - lag(timestamp_ms) over w as interval_ms from tel window w as (partition by device_id order by timestamp_ms, event_id))"""


@query("telemetry_features", with_views(["tel"], _FEATURES_SQL + """ select event_id, device_id, timestamp_ms, seq, round(cpu_pct, 6) as cpu_pct,
 round(ram_pct, 6) as ram_pct, round(disk_free_pct, 6) as disk_free_pct, cast(net_in_delta as bigint) as net_in_delta, cast(net_out_delta as bigint) as net_out_delta, interval_ms from feat"""))
def q_telemetry_features(spark, d):
    rows = telemetry_features(view(spark, d, "tel"), "event_id")
    return rows.select("event_id", "device_id", "timestamp_ms", "seq",
                       *[F.round(c, 6).alias(c) for c in ["cpu_pct", "ram_pct", "disk_free_pct"]],
                       "net_in_delta", "net_out_delta", "interval_ms")


_METRIC_SQL = {  # name -> (value, leading reports without a value)
    "net_in": ("cast(net_in_delta as double)", 1),
    "net_out": ("cast(net_out_delta as double)", 1),
    "in_out_ratio": ("case when net_out_delta > 1 then net_in_delta / net_out_delta else 0.0 end", 1),
    "cpu": ("cpu_pct", 1),
    "ram": ("ram_pct", 0),
    "auth_failures": ("cast(auth_failures as double)", 1),
    "events": ("cast(event_count as double)", 1),
    "interval": ("greatest(1.0, cast(interval_ms as double))", 1),
}


def _ewma_sql() -> str:
    """CTEs up to ``base``: every report with the state of the eight recurrences."""
    counts = """, counted as (select f.*, coalesce(c.n, 0) as event_count, coalesce(c.a, 0) as auth_failures, coalesce(c.users, 0) as auth_users, raw_log from feat f join chunk using (event_id)
 left join (select event_id, count(*) as n, count(*) filter (category = 'auth_failure') as a,
  count(distinct case when category = 'auth_failure' then nullif(regexp_extract(matched_text, 'for\\s+(\\S+)\\s+from', 1, 'i'), '') end) as users from hits group by event_id) c using (event_id))"""
    xs = ", ".join(f"{v} as x_{m}" for m, (v, _) in _METRIC_SQL.items())
    start = ", ".join(
        f"{'x_' + m if skip == 0 else 'cast(0.0 as double)'} as m_{m}, cast(0.0 as double) as v_{m}" for m, (_, skip) in _METRIC_SQL.items())
    steps = ", ".join(
        (f"case when x.seq = {skip + 1} then x_{m} else m_{m} + 0.05 * (x_{m} - m_{m}) end, "
         f"case when x.seq = {skip + 1} then 0.0 else 0.95 * (v_{m} + 0.05 * (x_{m} - m_{m}) * (x_{m} - m_{m})) end")
        for m, (_, skip) in _METRIC_SQL.items())
    scores = ", ".join(
        (f"greatest(0, x.seq - {skip}) as {m}_n, greatest(0, x.seq - {skip}) >= 20 as {m}_ready, m_{m} as {m}_mean, sqrt(greatest(0.0, v_{m})) as {m}_sd, "
         f"case when greatest(0, x.seq - {skip}) >= 20 and sqrt(v_{m}) >= 1e-9 then (x_{m} - m_{m}) / sqrt(v_{m}) else 0.0 end as {m}_z")
        for m, (_, skip) in _METRIC_SQL.items())
    return (
        f"{rule_hits('chunk', carry='event_id, device_id, timestamp_ms')}, {_FEATURES_SQL}{counts}, "
        f"x as materialized (select *, {xs} from counted), "
        f"g as (select device_id, seq, {start} from x where seq = 1 union all select x.device_id, x.seq, {steps} from g join x on x.device_id = g.device_id and x.seq = g.seq + 1), "
        f"base as (select x.*, {scores} from g join x using (device_id, seq))"
    )


_EWMA = _ewma_sql()


def _features(spark, d):
    """Telemetry features with event counts, failed-login users and the log chunk."""
    logs = view(spark, d, "chunk").select("event_id", "raw_log")
    hits = scan_rules(view(spark, d, "chunk"))
    rows = telemetry_features(view(spark, d, "tel"), "event_id")
    return event_counts(rows, hits, on=["event_id"]).join(logs, "event_id")


_STATS = ", ".join(f"{stable(f'{m}_{s}')} as {m}_{s}" for m in _METRIC_SQL for s in ("mean", "sd", "z"))


def _stable(name: str):
    """Spark side of ``sql.stable``."""
    return F.when(F.abs(name) < 1e-6, 0.0).otherwise(F.col(name).cast("float").cast("double")).alias(name)


@query("ewma_rows", with_views(["tel", "chunk"], _EWMA + f" select event_id, device_id, seq, {_STATS} from base", recursive=True))
def ewma_rows(spark, d):
    rows = ewma_baseline(_features(spark, d))
    stats = [_stable(f"{m.name}_{s}") for m in default_metrics() for s in ("mean", "sd", "z")]
    return rows.select("event_id", "device_id", "seq", *stats)


@query("baseline_snapshot", with_views(["tel", "chunk"], _EWMA + " select device_id, seq as reports, " + ", ".join(
    f"cast({m}_n as bigint) as {m}_n, {m}_ready, {stable(m + '_mean')} as {m}_mean, {stable(m + '_sd')} as {m}_sd" for m in _METRIC_SQL)
    + " from base qualify row_number() over (partition by device_id order by seq desc) = 1", recursive=True))
def q_baseline_snapshot(spark, d):
    rows = baseline_snapshot(_features(spark, d))
    cols = []
    for m in default_metrics():
        cols += [f"{m.name}_n", f"{m.name}_ready", _stable(f"{m.name}_mean"), _stable(f"{m.name}_sd")]
    return rows.select("device_id", "reports", *cols)


@query("telemetry_csv", with_views(["tel", "chunk"], _EWMA.split(", g as (")[0] + """ select cast(timestamp_ms as varchar) as ts, cast(device_id as varchar) as device,
 printf('%.1f', cpu_pct) as cpu, cast(auth_failures as varchar) as fails from x where seq > 1"""))
def q_telemetry_csv(spark, d):
    return telemetry_csv(_features(spark, d).filter("seq > 1"))


# ----- traffic classifier -----

_THREAT = ["event_id", "device_id", "timestamp_ms", "sub_type", "severity", "confidence", "mitre_id", "mitre_name",
           "mitre_tactic", "description", "evidence"]


def _threat_sql(views: list[str], body: str, found: str, recursive: bool = False) -> str:
    """Wrap a SELECT of detections (named columns of ``found``) with the technique lookup."""
    head = f"{body}, " if body else ""
    return with_views(views, f"""{head}{MITRE}, t as ({found}) select event_id, device_id, timestamp_ms, t.sub_type, t.severity, round(confidence, 6) as confidence, {MITRE_COLUMNS},
 description, evidence from t left join mitre on mitre.sub_type = t.sub_type""", recursive)


def _shape(df):
    return df.withColumn("confidence", F.round("confidence", 6)).select(*_THREAT)


def _first(sig: str) -> str:
    return f"regexp_extract(raw_log, {quote('(?i)' + SIGNATURES[sig])}, 0)"


def _log_match(sig: str, sub: str, severity: str, confidence: float, description: str) -> str:
    return (f"select event_id, device_id, timestamp_ms, {quote(sub)} as sub_type, {quote(severity)} as severity, cast({confidence} as double) as confidence, "
            f"{quote(description)} as description, {_first(sig)} as evidence from sec_log where regexp_matches(raw_log, {quote(SIGNATURES[sig])}, 'i')")


def _matches(sig: str) -> str:
    return f"len(regexp_extract_all(raw_log, {quote('(?i)' + SIGNATURES[sig])}))"


def _log_query(name: str, found: str, *, subs: list[str], severity: str | None = None):
    """Register a query on the log detectors that keeps the given sub-types."""

    @query(name, _threat_sql(["sec_log"], "", found))
    def run(spark, d):
        rows = classify_logs(view(spark, d, "sec_log"), keep=("event_id", "device_id", "timestamp_ms", "machine_ip"))
        rows = rows.filter(F.col("sub_type").isin(subs))
        return _shape(rows if severity is None else rows.filter(F.col("severity") == severity))


_log_query("traffic_ddos_logs", " union all ".join([
    _log_match("syn_flood", "ddos_syn_flood", "critical", 0.85, "SYN flood indicators detected in system logs"),
    _log_match("conn_table_full", "ddos_application_layer", "high", 0.75, "Connection table exhaustion -- possible application-layer DDoS"),
    _log_match("amplification", "ddos_amplification", "critical", 0.8, "Amplification/reflection attack indicators in logs"),
]), subs=["ddos_syn_flood", "ddos_application_layer", "ddos_amplification"])
_log_query("traffic_portscan_tool", _log_match(
    "scan_tool", "portscan_sequential", "high", 0.9, "Port scanning tool signature detected (nmap/masscan/zmap)"),
    subs=["portscan_sequential"], severity="high")
_log_query("traffic_portscan_refused", f"""select event_id, device_id, timestamp_ms, 'portscan_sequential' as sub_type, 'medium' as severity, least(0.9, 0.5 + (n - 10) * 0.05) as confidence,
 concat('High rate of refused connections (', n, ') -- possible port scan') as description, concat('connection_refused_count=', n) as evidence from (select *, {_matches('conn_refused')} as n from sec_log) where n >= 10""",
    subs=["portscan_sequential"], severity="medium")
_log_query("traffic_portscan_stealth", f"""select event_id, device_id, timestamp_ms, 'portscan_stealth' as sub_type, 'medium' as severity, least(0.85, 0.5 + (n - 8) * 0.05) as confidence,
 concat('High RST rate (', n, ') -- possible stealth scan') as description, concat('reset_count=', n) as evidence from (select *, {_matches('conn_reset')} as n from sec_log) where n >= 8""",
    subs=["portscan_stealth"])
_log_query("traffic_portscan_service_enum", _log_match(
    "service_probe", "portscan_service_enum", "medium", 0.7, "Service enumeration / banner grabbing detected"),
    subs=["portscan_service_enum"])
_log_query("traffic_exfil_dns_tunneling", _log_match(
    "dns_tunnel", "exfil_dns_tunneling", "critical", 0.85, "DNS tunneling tool or pattern detected in logs"),
    subs=["exfil_dns_tunneling"])
_log_query("traffic_c2_signatures", " union all ".join([
    _log_match("cobalt_strike", "c2_known_framework", "critical", 0.9, "Cobalt Strike beacon signature detected"),
    _log_match("meterpreter", "c2_known_framework", "critical", 0.9, "Meterpreter / reverse shell signature detected"),
    _log_match("beacon_pattern", "c2_http_beacon", "high", 0.7, "C2 beacon communication pattern in logs"),
    _log_match("dns_txt_query", "c2_dns_beacon", "high", 0.8, "DNS-based C2 channel indicators (TXT queries / tunneling tool)"),
]), subs=["c2_known_framework", "c2_http_beacon", "c2_dns_beacon"])
_log_query("traffic_lateral_internal_scan", f"""select event_id, device_id, timestamp_ms, 'lateral_internal_scan' as sub_type, 'high' as severity, least(0.9, 0.5 + n * 0.08) as confidence,
 concat('Internal subnet scanning detected (', n, ' indicators)') as description, {_first('internal_scan')} as evidence from (select *, {_matches('internal_scan')} as n from sec_log) where n >= 5""",
    subs=["lateral_internal_scan"])
_log_query("traffic_lateral_pass", " union all ".join([
    _log_match("pass_the_hash", "lateral_pass_the_hash", "critical", 0.85, "Pass-the-Hash attack indicators (NTLM relay / mimikatz)"),
    _log_match("pass_the_ticket", "lateral_pass_the_ticket", "critical", 0.85, "Pass-the-Ticket / Golden Ticket attack indicators"),
]), subs=["lateral_pass_the_hash", "lateral_pass_the_ticket"])
_log_query("traffic_lateral_smb", f"""select event_id, device_id, timestamp_ms, 'lateral_smb' as sub_type, 'high' as severity, cast(0.75 as double) as confidence,
 'SMB-based lateral movement indicators (PsExec/admin shares)' as description, concat_ws(' ', nullif({_first('smb_lateral')}, ''), nullif({_first('psexec')}, '')) as evidence from sec_log where {_matches('smb_lateral')} + {_matches('psexec')} >= 3""",
    subs=["lateral_smb"])
_log_query("traffic_lateral_rdp_wmi", " union all ".join([
    _log_match("rdp_lateral", "lateral_rdp", "medium", 0.6, "RDP connection to internal host detected"),
    _log_match("wmi_exec", "lateral_wmi", "high", 0.75, "WMI remote execution detected"),
]), subs=["lateral_rdp", "lateral_wmi"])


def _conf(z: str) -> str:
    return f"case when abs({z}) < 2.0 then 0.0 else least(0.95, 0.3 + (abs({z}) - 2.0) / 1.0 * 0.6) end"


def _baseline_query(name: str, found: str, *, subs: list[str], warmup: bool | None = None):
    """Register a query on the baseline detectors that keeps the given sub-types."""

    @query(name, _threat_sql(["tel", "chunk"], _EWMA, found, recursive=True))
    def run(spark, d):
        rows = classify_traffic(ewma_baseline(_features(spark, d)), keep=("event_id", "device_id", "timestamp_ms", "machine_ip"))
        rows = rows.filter(F.col("sub_type").isin(subs))
        if warmup is not None:
            cold = F.col("description").endswith("(baseline warming up)")
            rows = rows.filter(cold if warmup else ~cold)
        return _shape(rows)


_baseline_query("traffic_ddos_volumetric", f"""select event_id, device_id, timestamp_ms, 'ddos_volumetric' as sub_type, case when conf >= 0.7 then 'critical' else 'high' end as severity, conf as confidence,
 'Anomalous inbound traffic volume -- possible volumetric DDoS' as description,
 concat('inbound_delta=', printf('%.0f', x_net_in), 'B z=', printf('%.2f', net_in_z), ' mean=', printf('%.0f', net_in_mean), ' cpu=', printf('%.1f', cpu_pct), '%') as evidence
 from (select *, case when cpu_z >= 2.5 then least(c1 + 0.15, 0.95) else c1 end as conf from (select *, case when x_net_in >= 1e8 then greatest({_conf('net_in_z')}, 0.7) else {_conf('net_in_z')} end as c1 from base
  where seq > 1 and net_in_ready and (net_in_z >= 3.0 or x_net_in >= 1e8)))""", subs=["ddos_volumetric"])
_baseline_query("traffic_exfil_volume_anomaly", f"""select event_id, device_id, timestamp_ms, 'exfil_volume_anomaly' as sub_type, 'high' as severity,
 case when x_net_out >= 5e7 then greatest({_conf('net_out_z')}, 0.65) else {_conf('net_out_z')} end as confidence, 'Anomalous outbound data volume -- possible data exfiltration' as description,
 concat('outbound_delta=', printf('%.0f', x_net_out), 'B z=', printf('%.2f', net_out_z), ' mean=', printf('%.0f', net_out_mean)) as evidence from base
 where seq > 1 and net_out_ready and (net_out_z >= 3.0 or x_net_out >= 5e7)""", subs=["exfil_volume_anomaly"])
_baseline_query("traffic_exfil_large_transfer", f"""select event_id, device_id, timestamp_ms, 'exfil_large_transfer' as sub_type, 'medium' as severity, {_conf('in_out_ratio_z')} as confidence,
 'Network in/out ratio anomaly -- outbound surge relative to inbound' as description, concat('ratio_z=', printf('%.6f', in_out_ratio_z)) as evidence from base
 where seq > 1 and in_out_ratio_ready and in_out_ratio_z <= -2.5""", subs=["exfil_large_transfer"])
_BRUTE = ["bruteforce_standard", "bruteforce_password_spray", "bruteforce_credential_stuffing"]
_baseline_query("traffic_bruteforce_baseline", f"""select event_id, device_id, timestamp_ms,
 case when regexp_matches(raw_log, {quote(SIGNATURES['password_spray'])}, 'i') then 'bruteforce_password_spray' when regexp_matches(raw_log, {quote(SIGNATURES['credential_stuffing'])}, 'i') then 'bruteforce_credential_stuffing'
  when auth_users >= 3 then 'bruteforce_password_spray' else 'bruteforce_standard' end as sub_type, case when auth_failures >= 10 then 'critical' else 'high' end as severity, {_conf('auth_failures_z')} as confidence,
 'Brute force attack detected -- auth failure rate anomaly' as description,
 concat('auth_failures=', auth_failures, ' z=', printf('%.2f', auth_failures_z), ' baseline_mean=', printf('%.1f', auth_failures_mean)) as evidence from base
 where seq > 1 and auth_failures_ready and auth_failures_z >= 2.5 and auth_failures >= 5""", subs=_BRUTE, warmup=False)
_baseline_query("traffic_bruteforce_warmup", """select event_id, device_id, timestamp_ms, 'bruteforce_standard' as sub_type, 'high' as severity, cast(0.6 as double) as confidence,
 concat('High auth failure count (', auth_failures, ') -- possible brute force (baseline warming up)') as description, concat('auth_failures=', auth_failures) as evidence from base
 where seq > 1 and not auth_failures_ready and auth_failures >= 5""", subs=_BRUTE, warmup=True)


_PERIODIC_SQL = """, pr as (select *, row_number() over (partition by device_id order by event_id) as seq, cast(interval_ms as double) as x from beacon),
 pg as (select device_id, seq, x as m, cast(0.0 as double) as v from pr where seq = 1 union all select pr.device_id, pr.seq, m + 0.05 * (x - m), 0.95 * (v + 0.05 * (x - m) * (x - m)) from pg join pr on pr.device_id = pg.device_id and pr.seq = pg.seq + 1)"""


@query("traffic_c2_periodic_beacon", _threat_sql(["beacon"], _PERIODIC_SQL.removeprefix(", "), """select event_id, device_id, event_id as timestamp_ms, 'c2_periodic_beacon' as sub_type, 'high' as severity,
 0.4 + (0.15 - sqrt(v) / m) / 0.15 * 0.4 as confidence, 'Periodic callback pattern detected -- low jitter interval (possible C2 beacon)' as description,
 concat('interval_mean=', printf('%.0f', m), 'ms stddev=', printf('%.0f', sqrt(v)), 'ms CoV=', printf('%.4f', sqrt(v) / m)) as evidence
 from pg join pr using (device_id, seq) where seq >= 20 and sqrt(v) / m < 0.15 and sqrt(v) / m > 0.001""", recursive=True))
def c2_periodic_beacon(spark, d):
    from watchloom.operators.sequence import sequence
    from watchloom.operators.telemetry import Metric
    from watchloom.operators.traffic import beacon_detector, classify

    rows = sequence(view(spark, d, "beacon"), ["device_id"], ["event_id"], segment=100)
    rows = ewma_baseline(rows, [Metric("interval", F.col("interval_ms").cast("double"), skip=0)])
    rows = rows.withColumn("timestamp_ms", F.col("event_id"))
    return _shape(classify(rows, [beacon_detector()], keep=("event_id", "device_id", "timestamp_ms")))


@query("failed_logins", with_views(["chunk"], """select event_id, device_id, timestamp_ms, count(*) as failed_logins from (select *, unnest(string_split(raw_log, chr(10))) as line from chunk)
 where contains(line, 'Failed password') group by all"""))
def q_failed_logins(spark, d):
    return failed_logins(linux_auth_events(view(spark, d, "chunk")), ("event_id", "device_id", "timestamp_ms"))
