"""Correlation, response and export queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from watchloom.operators.correlate import (
    active_incidents, corr_events, correlate, incident_json, incident_members, recent_incidents,
)
from watchloom.operators.diffs import suspicious_connections, suspicious_processes
from watchloom.operators.auth import linux_auth_events
from watchloom.operators.respond import (
    action_results, blocklist, ir_incidents, plan_actions, quarantined, soar_inbound, soar_route,
)
from watchloom.operators.rule_scan import scan_rules
from watchloom.plans.catalog import query
from watchloom.plans.catalog_inventory import (
    _ALERTS_SQL, _AUTH_PARTS, _NAMES, USB_SEVERITY_SQL, file_alerts, usb_changes,
)
from watchloom.plans.sql import RANK, quote, rule_hits, values
from watchloom.plans.views import table, view, with_views
from watchloom.rules.correlation import DEFAULT_CORRELATION_RULES
from watchloom.rules.playbooks import DEFAULT_PLAYBOOKS, Action, Playbook
from watchloom.rules.reference_lists import SUSPICIOUS_REMOTE_PORTS
from watchloom.functions.severity import RANKS
from watchloom.sinks.formats import format_cef, format_leef, format_rfc5424, soar_payload
from watchloom.sinks.tables import shape_table

# ----- correlation -----

_RULE_ROWS = values(
    "crules",
    ["rule_name", "descr", "rsev", "tactic", "technique", "win", "need", "wide", "s0_source", "s0_category", "s0_rank", "s1_source", "s1_category", "s1_rank"],
    [(r.name, r.description, r.severity, r.mitre_tactic, r.mitre_technique, r.window_seconds * 1000, r.min_events, r.cross_device,
      *[x for s in r.stages for x in (s.source, s.category, RANKS.get(s.min_severity, 0))]) for r in DEFAULT_CORRELATION_RULES],
)


def _stage(i: int) -> str:
    return f"(s{i}_source = '' or s{i}_source = source) and (s{i}_category = '' or s{i}_category = category) and {RANK} >= s{i}_rank"


def _window(column: str) -> str:
    frames = {r.window_seconds * 1000 for r in DEFAULT_CORRELATION_RULES}
    arms = " ".join(
        f"when {w} then sum({column}) over (partition by rule_name, scope order by timestamp_ms range between {w} preceding and current row)" for w in sorted(frames))
    return f"case win {arms} end"


_INCIDENTS = f"""{_RULE_ROWS}, mt as materialized (select * from (select r.*, device_id, timestamp_ms, source, category, case when wide then 'global' else cast(device_id as varchar) end as scope,
  cast(({_stage(0)}) as bigint) as a, cast(({_stage(1)}) as bigint) as b from det cross join crules r) where a + b > 0),
 sat as (select distinct rule_name, scope, timestamp_ms, wa + wb as matches from (select *, {_window('a')} as wa, {_window('b')} as wb from mt) where wa > 0 and wb > 0 and wa + wb >= need),
 sr as materialized (select *, row_number() over (partition by rule_name, scope order by timestamp_ms) as rn from sat),
 g as (select rule_name, scope, rn, timestamp_ms as last_ms, true as kept from sr where rn = 1 union all
  select sr.rule_name, sr.scope, sr.rn, case when sr.timestamp_ms - g.last_ms >= 300000 then sr.timestamp_ms else g.last_ms end, sr.timestamp_ms - g.last_ms >= 300000
  from g join sr on sr.rule_name = g.rule_name and sr.scope = g.scope and sr.rn = g.rn + 1),
 fired as (select sr.rule_name, sr.scope, sr.timestamp_ms as first_seen_ms, cast(sr.matches as bigint) as matches, concat(sr.rule_name, ':', sr.scope, ':', sr.timestamp_ms) as incident_id from sr join g using (rule_name, scope, rn) where kept),
 mem as (select f.incident_id, f.rule_name, mt.device_id, mt.source, mt.category, cast(sum(a + b) as bigint) as matches from fired f join mt on mt.rule_name = f.rule_name and mt.scope = f.scope
  and mt.timestamp_ms between f.first_seen_ms - mt.win and f.first_seen_ms group by all),
 inc as (select f.incident_id, f.rule_name, f.scope, r.rsev as severity, r.tactic as mitre_tactic, r.technique as mitre_technique, first_seen_ms, first_seen_ms as last_seen_ms, f.matches as event_count,
  m.device_count, m.first_device, least(1.0, 0.5 + f.matches * 0.1) as confidence, concat(r.descr, ' | ', m.device_count, ' device(s), ', f.matches, ' events in ', r.win // 1000, 's window') as description, true as is_active
  from fired f join crules r using (rule_name) join (select incident_id, count(distinct device_id) as device_count, min(device_id) as first_device from mem group by incident_id) m using (incident_id))"""
_INC = ["incident_id", "rule_name", "scope", "severity", "mitre_tactic", "mitre_technique", "first_seen_ms", "last_seen_ms",
        "event_count", "device_count", "first_device", "round(confidence, 6) as confidence", "description", "is_active"]


def _incident_sql(tail: str) -> str:
    return with_views(["det"], f"{_INCIDENTS} {tail}", recursive=True)


def _incidents(df):
    return df.withColumn("confidence", F.round("confidence", 6))


@query("correlate_device", _incident_sql(f"select {', '.join(_INC)} from inc where scope <> 'global'"))
def correlate_device(spark, d):
    rules = [r for r in DEFAULT_CORRELATION_RULES if not r.cross_device]
    return _incidents(correlate(view(spark, d, "det"), rules))


@query("correlate_global", _incident_sql(f"select {', '.join(_INC)} from inc where scope = 'global'"))
def correlate_global(spark, d):
    rules = [r for r in DEFAULT_CORRELATION_RULES if r.cross_device]
    return _incidents(correlate(view(spark, d, "det"), rules))


# Stages in order: the twin walks the milliseconds of a rule and scope, carrying the latest start that reached each stage.
_ORDERED = _INCIDENTS.replace(" sr as materialized", """ per_ms as materialized (select *, row_number() over (partition by rule_name, scope order by timestamp_ms) as k from
  (select rule_name, scope, timestamp_ms, any_value(win) as win, sum(a) as a, sum(b) as b from mt group by rule_name, scope, timestamp_ms)),
 walk as (select rule_name, scope, timestamp_ms, win, k, case when a > 0 then timestamp_ms end as one, case when a > 0 and b > 0 then timestamp_ms end as two from per_ms where k = 1 union all
  select p.rule_name, p.scope, p.timestamp_ms, p.win, p.k, case when p.a > 0 then p.timestamp_ms else w.one end, case when p.b > 0 then greatest(w.two, case when p.a > 0 then p.timestamp_ms else w.one end) else w.two end
  from walk w join per_ms p on p.rule_name = w.rule_name and p.scope = w.scope and p.k = w.k + 1),
 sr as materialized""").replace("as rn from sat)", "as rn from sat semi join (select * from walk where two >= timestamp_ms - win) using (rule_name, scope, timestamp_ms))")


@query("correlate_ordered", with_views(["det"], f"{_ORDERED} select {', '.join(_INC)} from inc", recursive=True))
def correlate_ordered(spark, d):
    return _incidents(correlate(view(spark, d, "det"), [replace(r, ordered=True) for r in DEFAULT_CORRELATION_RULES]))


# Devices of the window, counted for each candidate anew.
_SEVERAL = 4
_CAMPAIGN = _INCIDENTS.replace("as rn from sat)", f"""as rn from (select s.* from sat s where
  (select count(distinct m.device_id) from mt m where m.rule_name = s.rule_name and m.scope = s.scope and m.timestamp_ms between s.timestamp_ms - m.win and s.timestamp_ms) >= {_SEVERAL}))""")


@query("correlate_min_devices", with_views(["det"], f"{_CAMPAIGN} select {', '.join(_INC)} from inc where scope = 'global'", recursive=True))
def correlate_min_devices(spark, d):
    rules = [replace(r, min_devices=_SEVERAL) for r in DEFAULT_CORRELATION_RULES if r.cross_device]
    return _incidents(correlate(view(spark, d, "det"), rules))


@query("incident_members", _incident_sql("select incident_id, rule_name, device_id, source, category, matches, concat(source, '/', category, ' from device ', device_id) as event from mem"))
def q_incident_members(spark, d):
    return incident_members(view(spark, d, "det"))


@query("recent_incidents", _incident_sql(f"select {', '.join(_INC)} from inc order by first_seen_ms desc, incident_id limit 50"))
def q_recent_incidents(spark, d):
    return _incidents(recent_incidents(active_incidents(correlate(view(spark, d, "det")))))


@query("incident_json", _incident_sql("""select inc.incident_id, cast(first_seen_ms as varchar) as first_seen, cast(device_count as varchar) as device_count, cast(event_count as varchar) as event_count,
 (select string_agg(x, ',') from (select distinct cast(device_id as varchar) as x, device_id from mem where mem.incident_id = inc.incident_id order by device_id)) as devices from inc"""))
def q_incident_json(spark, d):
    events = view(spark, d, "det")
    rows = incident_json(correlate(events), incident_members(events))
    get = lambda path: F.get_json_object("json", path)
    devices = F.regexp_replace(get("$.devices"), r"[\[\]]", "")
    return rows.select("incident_id", get("$.first_seen_ms").alias("first_seen"), get("$.device_count").alias("device_count"),
                       get("$.event_count").alias("event_count"), devices.alias("devices"))


_CORR = ["device_id", "timestamp_ms", "source", "category", "severity", "machine_ip", "target_user", "indicator", "detail"]
_CORR_SQL = with_views(["det", "sec_log", "snap_a", "snap_b", "proc_b", "conn_a", "usb_a", "usb_b"], f"""{USB_SEVERITY_SQL}, alerts as (with {_ALERTS_SQL}), auth as ({_AUTH_PARTS})
 select device_id, timestamp_ms, 'traffic' as source, case category when 'bruteforce' then 'brute_force' else category end as category, severity, machine_ip, '' as target_user, '' as indicator, description as detail from det where source = 'traffic'
 union all select device_id, timestamp_ms, 'ioc', 'ioc_match', severity, machine_ip, '', ioc_value, description from det where source = 'ioc'
 union all select device_id, timestamp_ms, 'network_inspector', category, severity, machine_ip, '', '', description from det where source = 'network_inspector'
 union all select device_id, timestamp_ms, 'fim', concat('fim_', change_type), severity, '', '', path, description from alerts
 union all select device_id, timestamp_ms, 'process', 'suspicious', 'high', machine_ip, '', name, concat('Matches suspicious name: ', hit) from (select *, case {_NAMES} end as hit from proc_b) where hit is not null
 union all select device_id, 5, 'connection', 'suspicious_connection', 'medium', '', '', remote_addr, concat('Suspicious remote port: ', cast(remote_port as varchar)) from conn_a where state <> 'LISTEN' and remote_port in ({', '.join(map(str, SUSPICIOUS_REMOTE_PORTS))})
 union all select device_id, timestamp_ms, 'session', event_type, case event_type when 'login_failed' then 'medium' when 'priv_escalation' then 'high' else 'low' end, '', username, source_ip, detail from auth
 union all select device_id, 6, 'usb', change_type, severity, machine_ip, '', concat(vendor_id, ':', product_id), reason from usb""")


@query("corr_events", _CORR_SQL)
def q_corr_events(spark, d):
    det = view(spark, d, "det")
    of = lambda s: det.filter(F.col("source") == s)
    at = lambda df, ms: df.withColumn("timestamp_ms", F.lit(ms).cast("long"))
    # Auth events take their address from the log, not from the reporting host.
    auth = linux_auth_events(view(spark, d, "sec_log")).drop("machine_ip")
    return corr_events(
        threats=of("traffic"), iocs=of("ioc"), network=of("network_inspector"), fim=file_alerts(spark, d),
        processes=suspicious_processes(view(spark, d, "proc_b")), connections=at(suspicious_connections(view(spark, d, "conn_a")), 5),
        auth=auth, usb=at(usb_changes(spark, d), 6),
    ).select(*_CORR)


# ----- response -----

_IR = ["device_id", "timestamp_ms", "machine_ip", "source", "category", "severity", "mitre_id", "description", "ioc_value", "file_path"]


@query("ir_incidents", with_views(["det", "sec_log", "snap_a", "snap_b", "proc_b", "usb_a", "usb_b"], f"""{rule_hits('sec_log')}, {USB_SEVERITY_SQL}, alerts as (with {_ALERTS_SQL})
 select device_id, timestamp_ms, machine_ip, 'traffic_classifier' as source, category, severity, mitre_id, description, ioc_value, file_path from det where source = 'traffic'
 union all select device_id, timestamp_ms, machine_ip, 'threat_intel', 'ioc_match', severity, mitre_id, description, ioc_value, file_path from det where source = 'ioc'
 union all select device_id, timestamp_ms, machine_ip, 'alert_engine', rule_name, severity, '', matched_text, '', '' from hits where severity in ('high', 'critical')
 union all select device_id, timestamp_ms, '', 'fim', concat('fim_', change_type), severity, mitre_id, description, '', path from alerts
 union all select device_id, timestamp_ms, machine_ip, 'process_monitor', 'suspicious_process', 'high', '', concat('Matches suspicious name: ', hit, ': ', name), '', '' from (select *, case {_NAMES} end as hit from proc_b) where hit is not null
 union all select device_id, 6, machine_ip, 'usb_monitor', 'usb_unauthorized', 'high', '', concat('Unauthorised USB device: ', vendor_id, ':', product_id, ' (', product_name, ')'), '', '' from usb where change_type = 'unauthorized'"""))
def q_ir_incidents(spark, d):
    det = view(spark, d, "det")
    return ir_incidents(
        threats=det.filter("source = 'traffic'"), iocs=det.filter("source = 'ioc'"),
        security_events=scan_rules(view(spark, d, "sec_log")), fim=file_alerts(spark, d),
        processes=suspicious_processes(view(spark, d, "proc_b").drop("path")),
        usb=usb_changes(spark, d).withColumn("timestamp_ms", F.lit(6).cast("long")),
    ).select(*_IR)


_PLAYBOOKS = [*DEFAULT_PLAYBOOKS,
              Playbook("notify", (Action("webhook"), Action("script", target="../x.sh"), Action("script", target="fix.sh"), Action("disable_user")),
                       source="ioc", min_severity="high", cooldown_seconds=900)]
_PB = values("pb", ["playbook", "po", "psource", "pcategory", "prank", "gap"],
             [(p.name, i, p.source, p.category, RANKS.get(p.min_severity, 0), p.cooldown_seconds * 1000) for i, p in enumerate(_PLAYBOOKS)])
_ACT = values("act", ["playbook", "step", "action_type", "given", "duration_s"],
              [(p.name, i, a.type, a.target, a.duration_s) for p in _PLAYBOOKS for i, a in enumerate(p.actions)])
_PLAN_SQL = f"""{_PB}, {_ACT}, pm as materialized (select d.*, pb.playbook, po, gap, row_number() over (partition by device_id, category, pb.playbook order by timestamp_ms, event_id) as rn from det d join pb
  on (psource = '' or psource = source) and (pcategory = '' or pcategory = category) and {RANK} >= prank),
 g as (select device_id, category, playbook, rn, timestamp_ms as last_ms, true as kept from pm where rn = 1 union all
  select pm.device_id, pm.category, pm.playbook, pm.rn, case when pm.timestamp_ms - g.last_ms >= gap then pm.timestamp_ms else g.last_ms end, pm.timestamp_ms - g.last_ms >= gap
  from g join pm on pm.device_id = g.device_id and pm.category = g.category and pm.playbook = g.playbook and pm.rn = g.rn + 1),
 plan as materialized (select pm.event_id, pm.device_id, pm.timestamp_ms, pm.source as incident_source, pm.category as incident_category, pm.severity, pm.description, pm.playbook, po, step, action_type, duration_s,
  case when given <> '' then given when action_type = 'block_ip' then case when ioc_value = '' then machine_ip else ioc_value end when action_type = 'quarantine' then cast(pm.device_id as varchar) else '' end as target
  from pm join g using (device_id, category, playbook, rn) join act on act.playbook = pm.playbook where kept)"""
_PLAN = ["event_id", "device_id", "timestamp_ms", "incident_source", "incident_category", "severity", "playbook", "step", "action_type", "target", "duration_s"]


def _plan_sql(tail: str) -> str:
    return with_views(["det"], f"{_PLAN_SQL} {tail}", recursive=True)


def planned(spark, d):
    return plan_actions(view(spark, d, "det"), _PLAYBOOKS)


@query("plan_actions", _plan_sql(f"select {', '.join(_PLAN)} from plan"))
def q_plan_actions(spark, d):
    return planned(spark, d).select(*_PLAN)


@query("action_results", _plan_sql("""select event_id, playbook, step, action_type, case action_type when 'webhook' then target <> '' when 'script' then target <> '' and not contains(target, '..') else true end as success,
 case action_type when 'log' then concat('Incident logged: ', description) when 'block_ip' then concat('IP blocked: ', target) when 'quarantine' then concat('Device quarantined: ', device_id)
  when 'webhook' then case when target <> '' then concat('Webhook queued: ', target) else 'No webhook URL' end when 'script' then case when contains(target, '..') then 'Invalid script path' else concat('Script queued: ', target) end
  when 'rate_limit' then concat('Rate limit applied: ', target) else concat('User flagged from device ', device_id) end as detail from plan"""))
def q_action_results(spark, d):
    return action_results(planned(spark, d)).select("event_id", "playbook", "step", "action_type", "success", "detail")


_AS_OF = 1704067200000 + 1_000_000


@query("blocklist", _plan_sql(f"""select ip, blocked_at_ms, expires_at_ms, reason, device_id, expires_at_ms = 0 or {_AS_OF} <= expires_at_ms as active from
 (select target as ip, timestamp_ms as blocked_at_ms, case when duration_s > 0 then timestamp_ms + duration_s * 1000 else 0 end as expires_at_ms, description as reason, device_id,
  row_number() over (partition by target order by timestamp_ms desc, event_id desc, po desc) as rn from plan where action_type = 'block_ip') where rn = 1"""))
def q_blocklist(spark, d):
    return blocklist(planned(spark, d), _AS_OF)


@query("quarantined", _plan_sql("select distinct device_id from plan where action_type = 'quarantine'"))
def q_quarantined(spark, d):
    return quarantined(planned(spark, d))


_ROUTE_SQL = f"""{USB_SEVERITY_SQL}, alerts as (with {_ALERTS_SQL}),
 rt as (select 'alert' as type, severity, concat(category, '/', 'st') as title, description, mitre_id, 'traffic_classifier' as source, device_id, timestamp_ms, concat('category=', category, ';machine_ip=', machine_ip, ';sub_type=st') as fields from det where source = 'traffic' and severity in ('high', 'critical')
 union all select 'observable', severity, 'IoC hit: ip', description, mitre_id, 'threat_intel', device_id, timestamp_ms, concat('feed=f;ioc_type=ip;ioc_value=', ioc_value, ';machine_ip=', machine_ip) from det where source = 'ioc' and severity in ('high', 'critical')
 union all select 'incident', severity, concat('FIM ', change_type, ': ', path), description, mitre_id, 'fim', device_id, timestamp_ms, concat('change=', change_type, ';machine_ip=;path=', path) from alerts where severity in ('high', 'critical')
 union all select 'incident', 'high', 'Unauthorised USB device', concat(vendor_id, ':', product_id, ' on ', machine_ip), '', 'usb_monitor', device_id, 6, concat('device_class=', device_class, ';machine_ip=', machine_ip, ';serial=', serial, ';vid_pid=', vendor_id, ':', product_id) from usb where change_type = 'unauthorized')"""
_ROUTE_VIEWS = ["det", "snap_a", "snap_b", "usb_a", "usb_b"]


def routed(spark, d):
    det = view(spark, d, "det")
    return soar_route(
        threats=det.filter("source = 'traffic'").withColumn("sub_type", F.lit("st")),
        iocs=det.filter("source = 'ioc'").withColumn("ioc_type", F.lit("ip")).withColumn("feed_source", F.lit("f")),
        fim=file_alerts(spark, d).withColumn("machine_ip", F.lit("")),
        usb=usb_changes(spark, d).withColumn("timestamp_ms", F.lit(6).cast("long")),
    )


@query("soar_route", with_views(_ROUTE_VIEWS, f"{_ROUTE_SQL} select * from rt"))
def q_soar_route(spark, d):
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return routed(spark, d).withColumn("fields", F.array_join(pairs, ";"))


@query("soar_inbound", """select 0 as device_id, cast(event_id as bigint) as timestamp_ms, '' as machine_ip, 'soar' as source, 'soar_action' as category, 'high' as severity, '' as mitre_id,
 concat(event_type, ' -> t', cast(user_id as varchar), ' (', case when event_type = 'view' then '' else 'why' end, ')') as description, '' as ioc_value, '' as file_path from events where event_type <> 'error'""")
def q_soar_inbound(spark, d):
    messages = table(spark, d, "events").selectExpr(
        "event_id as timestamp_ms",
        "case event_type when 'error' then '{\"target\":\"x\"}' when 'view' then concat('{\"action\":\"view\",\"target\":\"t', cast(user_id as string), '\"}') "
        "else concat('{\"action\":\"', event_type, '\",\"target\":\"t', cast(user_id as string), '\",\"reason\":\"why\"}') end as body")
    return soar_inbound(messages).select(*_IR)


# ----- exports -----

_EXPORT = "event_id, category as sub_type, description, severity, device_id, machine_ip, timestamp_ms, mitre_id, source as category"
_ESC = lambda c: f"regexp_replace(cast({c} as varchar), '([|\\\\=])', '\\\\\\1', 'g')"


def _export(spark, d):
    return view(spark, d, "det").selectExpr("event_id", "category as sub_type", "description", "severity", "device_id",
                                            "machine_ip", "timestamp_ms", "mitre_id", "source as category")


@query("format_cef", with_views(["det"], f"""x as (select {_EXPORT} from det) select event_id, concat('CEF:0|watchloom|watchloom|1.0|', {_ESC('sub_type')}, '|', {_ESC('description')}, '|',
 case severity when 'critical' then 10 when 'high' then 7 when 'medium' then 5 when 'low' then 3 else 1 end, '|deviceExternalId=', device_id, ' src=', {_ESC('machine_ip')}, ' rt=', timestamp_ms, ' mitre=', {_ESC('mitre_id')}, ' cat=', {_ESC('category')}, ' act=', {_ESC("concat('a=', event_id)")}) as line from x"""))
def q_format_cef(spark, d):
    rows = _export(spark, d).withColumn("extra", F.create_map(F.lit("act"), F.concat(F.lit("a="), F.col("event_id").cast("string"))))
    return format_cef(rows).select("event_id", "line")


@query("format_leef", with_views(["det"], f"""x as (select {_EXPORT} from det) select event_id, concat('LEEF:2.0|watchloom|watchloom|1.0|', sub_type, '|cat=', category, chr(9), 'severity=', severity, chr(9), 'devTime=', timestamp_ms, chr(9), 'mitre=', mitre_id, chr(9), 'src=', machine_ip, chr(9), 'devId=', device_id, chr(9), 'msg=', description) as line from x"""))
def q_format_leef(spark, d):
    return format_leef(_export(spark, d)).select("event_id", "line")


@query("format_rfc5424", with_views(["det"], f"""x as (select {_EXPORT} from det) select event_id, concat('<', 128 + case severity when 'critical' then 2 when 'high' then 3 when 'medium' then 4 else 5 end, '>1 - watchloom ', category, ' ', device_id, ' ', sub_type,
 ' [ss@32473 mitre="', mitre_id, '" severity="', severity, '" ip="', machine_ip, '"] ', description) as line from x"""))
def q_format_rfc5424(spark, d):
    return format_rfc5424(_export(spark, d)).select("event_id", "line")


_JS = lambda c: f"concat('\"', replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), '\"')"
_SEV = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
_BODIES = {
    "generic": f"""concat('{{"type":', {_JS('type')}, ',"severity":', {_JS('severity')}, ',"title":', {_JS('title')}, ',"description":', {_JS('description')}, ',"mitre_id":', {_JS('mitre_id')}, ',"source":', {_JS('source')}, ',"device_id":', device_id, ',"timestamp_ms":', timestamp_ms,
 ',"fields":{{"', replace(replace(fields, '=', '":"'), ';', '","'), '"}}}}')""",
    "splunk_soar": f"""concat('{{"name":', {_JS('title')}, ',"label":"events","severity":', {_JS('severity')}, ',"description":', {_JS('description')}, ',"source_data_identifier":"ss-', timestamp_ms, '-', device_id, '","sensitivity":"amber"}}')""",
    "xsoar": f"""concat('{{"name":', {_JS('title')}, ',"type":"watchloom","severity":', {_SEV}, ',"details":', {_JS('description')}, ',"labels":[{{"type":"mitre","value":', {_JS('mitre_id')}, '}},{{"type":"device","value":"', device_id, '"}}]}}')""",
    "thehive": f"""concat('{{"title":', {_JS('title')}, ',"description":', {_JS('description')}, ',"type":"external","source":"watchloom","sourceRef":"ss-', timestamp_ms, '-', device_id, '","severity":', {_SEV}, ',"tlp":2,"tags":[', {_JS('mitre_id')}, ',"watchloom"]}}')""",
}


def _payload_query(backend: str):
    @query(f"soar_payload_{backend}", with_views(_ROUTE_VIEWS, f"{_ROUTE_SQL} select {_BODIES[backend]} as body from rt"))
    def run(spark, d):
        return soar_payload(routed(spark, d), backend).select("body")


for _backend in _BODIES:
    _payload_query(_backend)


@query("stored_events", with_views(["chunk"], rule_hits("chunk", carry="event_id, device_id, timestamp_ms")
       + " select cast(device_id as int) as device_id, timestamp_ms, cast(null as varchar) as machine_ip, rule_name, severity, category, matched_text from hits"))
def stored_events(spark, d):
    return shape_table(scan_rules(view(spark, d, "chunk")), "security_events").drop("received_at")


@query("stored_iocs", """select cast(page_id as int) as device_id, page_id as timestamp_ms, 'ip' as machine_ip, 'url' as ioc_type, html as ioc_value, 'low' as severity, 'f' as feed_source, 'log' as matched_in, '' as mitre_id, html as description, '' as tags from pages""")
def stored_iocs(spark, d):
    rows = table(spark, d, "pages").selectExpr(
        "page_id as device_id", "page_id as timestamp_ms", "'ip' as machine_ip", "'url' as ioc_type", "html as ioc_value",
        "'low' as severity", "'f' as feed_source", "'log' as matched_in", "'' as mitre_id", "html as description", "'' as tags")
    return shape_table(rows, "ioc_matches").drop("received_at")


@query("stored_threats", with_views(["det"], """select cast(device_id as int) as device_id, timestamp_ms, machine_ip, category, cast(null as varchar) as sub_type, severity, value as confidence, mitre_id,
 cast(null as varchar) as mitre_name, cast(null as varchar) as mitre_tactic, description, cast(null as varchar) as evidence from det"""))
def stored_threats(spark, d):
    return shape_table(view(spark, d, "det").withColumn("confidence", F.col("value")), "threat_detections").drop("received_at")


@query("stored_fim", with_views(["snap_a", "snap_b"], _ALERTS_SQL.rsplit(" select device_id", 1)[0] + """ select cast(device_id as int) as device_id, cast(timestamp_ms as bigint) as timestamp_ms,
 cast(null as varchar) as machine_ip, change_type, path as file_path, old_hash, new_hash, old_size, new_size, severity from s"""))
def stored_fim(spark, d):
    rows = shape_table(file_alerts(spark, d).withColumnRenamed("path", "file_path"), "fim_events")
    return rows.drop("received_at", "mitre_id", "description")


@query("stored_audit", with_views(["audit"], "select timestamp_ms, username, tenant_id, action, success, source_ip, detail from audit"))
def stored_audit(spark, d):
    return shape_table(view(spark, d, "audit"), "audit_log").drop("received_at")


@query("stored_correlations", with_views(["det"], """select cast(event_id as varchar) as incident_id, category as rule_name, severity, cast(null as varchar) as mitre_tactic, mitre_id as mitre_technique, description,
 timestamp_ms as first_seen_ms, timestamp_ms + 5 as last_seen_ms from det"""))
def stored_correlations(spark, d):
    rows = view(spark, d, "det").selectExpr(
        "event_id as incident_id", "category as rule_name", "severity", "mitre_id as mitre_technique", "description",
        "timestamp_ms as first_seen_ms", "timestamp_ms + 5 as last_seen_ms")
    return shape_table(rows, "correlations_view").drop("received_at")
