"""Inventory reports, snapshot differences and authentication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators.auth import linux_auth_events, windows_auth_events
from watchloom.operators.diffs import (
    connection_diff, connection_summary, fim_alerts, fim_diff, process_diff, software_dedupe, software_diff,
    suspicious_connections, suspicious_processes, tamper_check, usb_diff, usb_severity,
)
from watchloom.plans.catalog import query
from watchloom.plans.catalog_functions import path_severity_sql
from watchloom.plans.sql import quote
from watchloom.plans.views import table, view, with_views
from watchloom.rules.reference_lists import SUSPICIOUS_PROCESS_NAMES, SUSPICIOUS_REMOTE_PORTS
from watchloom.sources.feeds import parse_audit_log
from watchloom.sources.reports import (
    parse_connection_reports, parse_fim_reports, parse_process_reports, parse_session_reports, parse_software_reports,
    parse_usb_reports,
)
from watchloom.sources.syslog import parse_syslog

# ----- snapshot differences -----

_FIM_SQL = """select coalesce(a.device_id, b.device_id) as device_id, coalesce(a.path, b.path) as path,
 case when a.path is null then 'added' when b.path is null then 'deleted' else 'modified' end as change_type, coalesce(a.sha256, '') as old_hash, coalesce(b.sha256, '') as new_hash,
 coalesce(a.size_bytes, 0) as old_size, coalesce(b.size_bytes, 0) as new_size, coalesce(a.mtime_epoch, 0) as old_mtime, coalesce(b.mtime_epoch, 0) as new_mtime
 from snap_a a full join snap_b b on a.device_id = b.device_id and a.path = b.path where a.path is null or b.path is null or a.sha256 <> b.sha256"""


@query("fim_diff", with_views(["snap_a", "snap_b"], _FIM_SQL))
def q_fim_diff(spark, d):
    return fim_diff(view(spark, d, "snap_a"), view(spark, d, "snap_b"))


def snapshots(spark, d):
    """Snapshots per device: a, then b, then a again; then, in the headers only, an empty one."""
    a, b = view(spark, d, "snap_a"), view(spark, d, "snap_b")
    at = lambda df, ms: df.withColumn("timestamp_ms", F.lit(ms).cast("long"))
    return at(a, 1000).unionByName(at(b, 2000)).unionByName(at(a, 3000))


def file_alerts(spark, d):
    rows = snapshots(spark, d)
    emptied = rows.filter("device_id % 7 = 3").select("device_id", F.lit(4000).cast("long").alias("timestamp_ms")).distinct()
    return fim_alerts(rows, headers=emptied)


_ALERTS_SQL = f"""two as ({_FIM_SQL}), ch as (select 2000 as timestamp_ms, * from two union all select 3000, device_id, path, case change_type when 'added' then 'deleted' when 'deleted' then 'added' else 'modified' end,
 new_hash, old_hash, new_size, old_size, new_mtime, old_mtime from two
 union all select 4000, device_id, path, 'deleted', sha256, '', size_bytes, 0, mtime_epoch, 0 from snap_a where device_id % 7 = 3),
 s as (select *, {path_severity_sql('path')} as severity from ch)
 select device_id, cast(timestamp_ms as bigint) as timestamp_ms, path, change_type, old_hash, new_hash, old_size, new_size, severity,
 case when change_type = 'added' and severity = 'critical' then 'T1505.003' when change_type = 'added' then 'T1074' when change_type = 'modified' and severity = 'critical' then 'T1565.001' when change_type = 'modified' then 'T1027' else 'T1070.004' end as mitre_id,
 case when change_type = 'added' and severity = 'critical' then 'Persistence' when change_type = 'added' then 'Collection' when change_type = 'modified' and severity = 'critical' then 'Impact' else 'Defense Evasion' end as mitre_tactic,
 concat('File ', change_type, ': ', path, case change_type when 'modified' then concat(' (hash changed, size ', old_size, ' -> ', new_size, ')') when 'added' then concat(' (new file, ', new_size, ' bytes)') else concat(' (was ', old_size, ' bytes)') end) as description from s"""


@query("fim_alerts", with_views(["snap_a", "snap_b"], _ALERTS_SQL))
def q_fim_alerts(spark, d):
    return file_alerts(spark, d).drop("old_mtime", "new_mtime")


@query("tamper_check", with_views(["snap_a", "snap_b"], """select a.device_id, a.path, a.sha256 as expected_hash, b.sha256 as actual_hash,
 case when b.sha256 is null then 'MISSING' when b.sha256 <> a.sha256 then 'CHANGED' else 'OK' end as status from snap_a a left join snap_b b on a.device_id = b.device_id and a.path = b.path"""))
def q_tamper_check(spark, d):
    return tamper_check(view(spark, d, "snap_a"), view(spark, d, "snap_b"))


@query("process_diff", with_views(["proc_a", "proc_b"], """select device_id, pid, name, 'new' as change_type, 'New process started' as reason from proc_b where not exists (select 1 from proc_a a where a.device_id = proc_b.device_id and a.pid = proc_b.pid)
 union all select device_id, pid, name, 'terminated', 'Process terminated' from proc_a where not exists (select 1 from proc_b b where b.device_id = proc_a.device_id and b.pid = proc_a.pid)"""))
def q_process_diff(spark, d):
    return process_diff(view(spark, d, "proc_a"), view(spark, d, "proc_b")).select("device_id", "pid", "name", "change_type", "reason")


_NAMES = " ".join(f"when contains(lower(name), {quote(n)}) then {quote(n)}" for n in SUSPICIOUS_PROCESS_NAMES)


@query("process_suspicious", with_views(["proc_b"], f"select device_id, pid, name, concat('Matches suspicious name: ', hit) as reason from (select *, case {_NAMES} end as hit from proc_b) where hit is not null"))
def process_suspicious(spark, d):
    return suspicious_processes(view(spark, d, "proc_b")).select("device_id", "pid", "name", "reason")


_CONN = ["device_id", "protocol", "local_addr", "local_port", "remote_addr", "remote_port"]
_CONN_ON = " and ".join(f"x.{c} = y.{c}" for c in _CONN)


@query("connection_diff", with_views(["conn_a", "conn_b"], f"""select {', '.join(_CONN)}, state, 'new' as change_type, 'New connection' as reason from conn_b y where not exists (select 1 from conn_a x where {_CONN_ON})
 union all select distinct {', '.join(_CONN)}, '', 'closed', 'Connection closed' from conn_a x where not exists (select 1 from conn_b y where {_CONN_ON})"""))
def q_connection_diff(spark, d):
    return connection_diff(view(spark, d, "conn_a"), view(spark, d, "conn_b"))


@query("connection_suspicious", with_views(["conn_a"], f"""select *, concat('Suspicious remote port: ', cast(remote_port as varchar)) as reason from conn_a where state <> 'LISTEN' and remote_addr not in ('', '0.0.0.0', '::')
 and remote_port in ({', '.join(map(str, SUSPICIOUS_REMOTE_PORTS))})"""))
def connection_suspicious(spark, d):
    return suspicious_connections(view(spark, d, "conn_a"))


@query("connection_summary", with_views(["conn_a"], """select device_id, count(*) filter (protocol = 'tcp') as total_tcp, count(*) filter (protocol = 'udp') as total_udp,
 count(*) filter (state = 'LISTEN') as listening_ports from conn_a group by device_id"""))
def q_connection_summary(spark, d):
    return connection_summary(view(spark, d, "conn_a"))


@query("software_dedupe", with_views(["sw_a", "sw_b"], """select device_id, name, version, min(publisher) as publisher from (select * from sw_a union all select * from sw_b) group by device_id, name, version"""))
def q_software_dedupe(spark, d):
    return software_dedupe(view(spark, d, "sw_a").unionByName(view(spark, d, "sw_b")))


@query("software_diff", with_views(["sw_a", "sw_b"], """select coalesce(b.device_id, a.device_id) as device_id, coalesce(b.name, a.name) as name, case when a.name is null then 'installed' when b.name is null then 'removed' else 'updated' end as change_type,
 coalesce(b.version, a.version) as version, coalesce(b.publisher, a.publisher) as publisher, case when a.name is not null and b.name is not null then a.version else '' end as old_version
 from (select device_id, name, unnest(max(struct_pack(version := version, publisher := publisher))) from sw_a group by device_id, name) a
 full join (select device_id, name, unnest(max(struct_pack(version := version, publisher := publisher))) from sw_b group by device_id, name) b on a.device_id = b.device_id and a.name = b.name where a.name is null or b.name is null or a.version <> b.version"""))
def q_software_diff(spark, d):
    return software_diff(view(spark, d, "sw_a"), view(spark, d, "sw_b"))


_USB_ON = "a.device_id = b.device_id and a.vendor_id = b.vendor_id and a.product_id = b.product_id and a.serial = b.serial"
_ALLOWED = ["0101:0102", "0104:0109", "0100:0101:Supplier#000000001"]
_USB_SQL = f"""ins as (select * from usb_b b where not exists (select 1 from usb_a a where {_USB_ON})), rem as (select * from usb_a a where not exists (select 1 from usb_b b where {_USB_ON})),
 ch as (select *, 'inserted' as change_type, 'Device inserted' as reason from ins union all select *, 'removed', 'Device removed' from rem
 union all select *, 'unauthorized', concat('VID:PID not in whitelist: ', vendor_id, ':', product_id) from ins where concat(vendor_id, ':', product_id) not in ('0101:0102', '0104:0109')
  and upper(concat(vendor_id, ':', product_id, ':', serial)) <> '0100:0101:SUPPLIER#000000001')"""
_USB_COLUMNS = ["device_id", "vendor_id", "product_id", "serial", "device_class", "change_type", "reason"]


def usb_changes(spark, d):
    return usb_severity(usb_diff(view(spark, d, "usb_a"), view(spark, d, "usb_b"), _ALLOWED))


@query("usb_diff", with_views(["usb_a", "usb_b"], f"{_USB_SQL} select {', '.join(_USB_COLUMNS)} from ch"))
def q_usb_diff(spark, d):
    return usb_diff(view(spark, d, "usb_a"), view(spark, d, "usb_b"), _ALLOWED).select(*_USB_COLUMNS)


USB_SEVERITY_SQL = f"""{_USB_SQL}, usb as (select *, case when change_type = 'unauthorized' then 'high' when change_type = 'inserted' and device_class = 'storage' then 'medium' else 'low' end as severity from ch)"""


@query("usb_severity", with_views(["usb_a", "usb_b"], f"{USB_SEVERITY_SQL} select {', '.join(_USB_COLUMNS)}, severity from usb"))
def q_usb_severity(spark, d):
    return usb_changes(spark, d).select(*_USB_COLUMNS, "severity")


# ----- authentication -----

_AUTH = ["event_id", "device_id", "timestamp_ms", "event_type", "username", "source_ip", "session_type", "detail"]
_AUTH_PARTS = """select event_id, device_id, timestamp_ms, 'login_failed' as event_type, regexp_extract(raw_log, '(?i)Failed password for (?:invalid user )?(\\S+) from (\\S+)', 1) as username,
 regexp_extract(raw_log, '(?i)Failed password for (?:invalid user )?(\\S+) from (\\S+)', 2) as source_ip, 'ssh' as session_type, 'SSH failed password' as detail from sec_log where contains(raw_log, 'Failed password')
 union all select event_id, device_id, timestamp_ms, 'login_success', regexp_extract(raw_log, '(?i)Accepted \\S+ for (\\S+) from (\\S+)', 1), regexp_extract(raw_log, '(?i)Accepted \\S+ for (\\S+) from (\\S+)', 2), 'ssh', 'SSH login accepted' from sec_log
  where contains(raw_log, 'Accepted') and (contains(raw_log, 'password') or contains(raw_log, 'publickey'))
 union all select event_id, device_id, timestamp_ms, 'priv_escalation', regexp_extract(raw_log, '(\\S+)\\s*:\\s*.*COMMAND=(.+)', 1), '', 'sudo', concat('sudo: ', regexp_extract(raw_log, '(\\S+)\\s*:\\s*.*COMMAND=(.+)', 2)) from sec_log
  where contains(raw_log, 'sudo') and contains(raw_log, 'COMMAND')
 union all select event_id, device_id, timestamp_ms, 'priv_escalation', '', '', 'su', 'su session opened' from sec_log
  where (contains(raw_log, 'su[') or contains(raw_log, 'su:')) and (contains(raw_log, 'Successful') or contains(raw_log, 'session opened'))"""


@query("linux_auth", with_views(["sec_log"], _AUTH_PARTS))
def linux_auth(spark, d):
    return linux_auth_events(view(spark, d, "sec_log")).select(*_AUTH)


@query("windows_auth", with_views(["sec_log"], """select event_id, device_id, timestamp_ms, 'login_failed' as event_type, '' as username, '' as source_ip, '' as session_type, 'Failed authentication attempt detected in event log' as detail from sec_log
  where contains(raw_log, '4625') or contains(raw_log, 'failed')
 union all select event_id, device_id, timestamp_ms, 'priv_escalation', '', '', '', 'Special privileges assigned (EventID 4672)' from sec_log where contains(raw_log, '4672') or contains(raw_log, 'special privileges')"""))
def windows_auth(spark, d):
    return windows_auth_events(view(spark, d, "sec_log")).select(*_AUTH)


# ----- report payloads: one small report per order -----

_DEV, _MS, _KEY = "cast(o_custkey % 50 as string)", "cast(1704067200000 + o_orderkey as string)", "cast(o_orderkey as string)"
_NL = "chr(10)"
_IDS = "o_orderkey, cast(o_custkey % 50 as bigint) as device_id, 1704067200000 + o_orderkey as timestamp_ms"


def _orders_payload(spark, d, expr: str):
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{expr} as payload")


def _unnest(parts: list[str]) -> str:
    return " union all ".join(f"select {_IDS}, {p} from orders" for p in parts)


@query("parse_fim", _unnest([
    "concat('/etc/f', cast(o_orderkey as varchar)) as path, md5(cast(o_orderkey as varchar)) as sha256, o_orderkey * 3 as size_bytes, o_custkey as mtime_epoch",
    "'/var/b c' as path, '' as sha256, cast(0 as bigint) as size_bytes, cast(-5 as bigint) as mtime_epoch",
]))
def parse_fim(spark, d):
    expr = (f"concat('FIM|', {_DEV}, '|', {_MS}, '|3', {_NL}, '/etc/f', {_KEY}, '|', md5({_KEY}), '|', cast(o_orderkey * 3 as string), '|', cast(o_custkey as string), {_NL}, "
            f"'too|few', {_NL}, '/bad|h|x|1', {_NL}, {_NL}, '/var/b c||0|-5', {_NL}, 'FIM_END', {_NL}, 'late|h|1|1')")
    return parse_fim_reports(_orders_payload(spark, d, expr), keep=["o_orderkey"])


_PROC = (f"concat('PROC|', {_DEV}, '|', {_MS}, '|2', {_NL}, {_KEY}, '|1|app|/bin/app|u', cast(o_custkey % 7 as string), '|4096|1|run --x ', {_KEY}, {_NL}, 'x|y|sh', {_NL}, "
         f"'PROC_CHANGES|2', {_NL}, 'new|', {_KEY}, '|app|started', {_NL}, 'suspicious|9|nc|bad name', {_NL}, 'PROC_END', {_NL})")


@query("parse_process", _unnest([
    "o_orderkey as pid, cast(1 as bigint) as ppid, 'app' as name, '/bin/app' as path, concat('u', cast(o_custkey % 7 as varchar)) as \"user\", cast(4096 as bigint) as memory_bytes, true as is_elevated, concat('run --x ', cast(o_orderkey as varchar)) as cmdline",
    "cast(0 as bigint), cast(0 as bigint), 'sh', '', '', cast(0 as bigint), false, ''",
]))
def parse_process(spark, d):
    return parse_process_reports(_orders_payload(spark, d, _PROC), keep=["o_orderkey"])[0]


@query("parse_process_changes", _unnest([
    "'new' as change_type, o_orderkey as pid, 'app' as name, 'started' as reason", "'suspicious', cast(9 as bigint), 'nc', 'bad name'"]))
def parse_process_changes(spark, d):
    return parse_process_reports(_orders_payload(spark, d, _PROC), keep=["o_orderkey"])[1]


_CONN_PAYLOAD = (f"concat('CONN|', {_DEV}, '|', {_MS}, '|2|1', {_NL}, 'tcp|10.0.0.1|', cast(o_orderkey % 60000 as string), '|1.2.3.4|443|ESTABLISHED|', {_KEY}, '|curl', {_NL}, "
                 f"'udp|0.0.0.0|53|||LISTEN', {_NL}, 'CONN_CHANGES', {_NL}, 'closed|tcp|1.2.3.4|', cast(o_custkey % 60000 as string), '|gone', {_NL}, 'CONN_END', {_NL})")


@query("parse_connections", _unnest([
    "'tcp' as protocol, '10.0.0.1' as local_addr, cast(o_orderkey % 60000 as int) as local_port, '1.2.3.4' as remote_addr, 443 as remote_port, 'ESTABLISHED' as state, o_orderkey as owning_pid, 'curl' as process_name",
    "'udp', '0.0.0.0', 53, '', 0, 'LISTEN', cast(0 as bigint), ''"]))
def parse_connections(spark, d):
    return parse_connection_reports(_orders_payload(spark, d, _CONN_PAYLOAD), keep=["o_orderkey"])[0]


@query("parse_connection_changes", _unnest(["'closed' as change_type, 'tcp' as protocol, '1.2.3.4' as remote_addr, cast(o_custkey % 60000 as int) as remote_port, 'gone' as reason"]))
def parse_connection_changes(spark, d):
    return parse_connection_reports(_orders_payload(spark, d, _CONN_PAYLOAD), keep=["o_orderkey"])[1]


_SESS = (f"concat('SESS|', {_DEV}, '|', {_MS}, '|1|2|', cast(o_orderkey % 9 as string), {_NL}, 'root|ssh|9.9.9.9|pts/0|', {_MS}, '|1|0', {_NL}, 'SESS_AUTH', {_NL}, "
         f"'login_failed|', {_MS}, '|u', cast(o_custkey % 7 as string), '|8.8.8.8|ssh|no key', {_NL}, 'logout|77|x|||', {_NL}, 'SESS_END')")


@query("parse_sessions", _unnest(["o_orderkey % 9 as failed_logins, 'root' as username, 'ssh' as session_type, '9.9.9.9' as source_ip, 'pts/0' as terminal, 1704067200000 + o_orderkey as login_time_ms, true as is_active, false as is_elevated"]))
def parse_sessions(spark, d):
    return parse_session_reports(_orders_payload(spark, d, _SESS), keep=["o_orderkey"])[0]


@query("parse_session_events", _unnest([
    "'login_failed' as event_type, 1704067200000 + o_orderkey as event_ms, concat('u', cast(o_custkey % 7 as varchar)) as username, '8.8.8.8' as source_ip, 'ssh' as session_type, 'no key' as detail",
    "'logout', cast(77 as bigint), 'x', '', '', ''"]))
def parse_session_events(spark, d):
    return parse_session_reports(_orders_payload(spark, d, _SESS), keep=["o_orderkey"])[1]


_SW = (f"concat('SWRPT|', {_DEV}, '|', {_MS}, '|2|1', {_NL}, 'pkg', {_KEY}, '|1.', cast(o_custkey % 9 as string), '|acme|20240101|', cast(o_orderkey * 2 as string), {_NL}, 'bare|2', {_NL}, "
       f"'SW_CHANGES', {_NL}, 'updated|pkg', {_KEY}, '|1.1|1.0', {_NL}, 'SW_END', {_NL})")


@query("parse_software", _unnest([
    "concat('pkg', cast(o_orderkey as varchar)) as name, concat('1.', cast(o_custkey % 9 as varchar)) as version, 'acme' as publisher, '20240101' as install_date, o_orderkey * 2 as size_bytes",
    "'bare', '2', '', '', cast(0 as bigint)"]))
def parse_software(spark, d):
    return parse_software_reports(_orders_payload(spark, d, _SW), keep=["o_orderkey"])[0]


@query("parse_software_changes", _unnest(["'updated' as change_type, concat('pkg', cast(o_orderkey as varchar)) as name, '1.1' as version, '1.0' as old_version"]))
def parse_software_changes(spark, d):
    return parse_software_reports(_orders_payload(spark, d, _SW), keep=["o_orderkey"])[1]


_USB_PAYLOAD = (f"concat('USB|', {_DEV}, '|', {_MS}, '|1|1', {_NL}, '04F9|0042|Brother|HL|', {_KEY}, '|storage|/mnt/', {_KEY}, '|', cast(o_orderkey * 512 as string), '|1', {_NL}, "
                f"'USB_CHANGES', {_NL}, 'unauthorized|04F9|0042|', {_KEY}, '|HL|not listed', {_NL}, 'USB_END', {_NL})")


@query("parse_usb", _unnest(["'04F9' as vendor_id, '0042' as product_id, 'Brother' as manufacturer, 'HL' as product_name, cast(o_orderkey as varchar) as serial, 'storage' as device_class, concat('/mnt/', cast(o_orderkey as varchar)) as mount_point, o_orderkey * 512 as capacity_bytes, true as is_removable"]))
def parse_usb(spark, d):
    return parse_usb_reports(_orders_payload(spark, d, _USB_PAYLOAD), keep=["o_orderkey"])[0]


@query("parse_usb_changes", _unnest(["'unauthorized' as change_type, '04F9' as vendor_id, '0042' as product_id, cast(o_orderkey as varchar) as serial, 'HL' as product_name, 'not listed' as reason"]))
def parse_usb_changes(spark, d):
    return parse_usb_reports(_orders_payload(spark, d, _USB_PAYLOAD), keep=["o_orderkey"])[1]


_SYSLOG_LINE = """case event_type
 when 'error' then concat('<', cast(event_id % 192 as string), '>1 2024-01-01T00:00:00Z host', cast(user_id as string), ' app ', cast(event_id as string), ' ID47 [a@1 k="v"][b@2 x="y"] failed login ', cast(event_id as string))
 when 'view' then concat('<', cast(event_id % 192 as string), '>1 2024-01-01T00:00:00Z host', cast(user_id as string), ' app - - - plain text ', cast(event_id as string))
 when 'click' then concat('<', cast(event_id % 192 as string), '>Jan  1 00:00:00 host', cast(user_id as string), ' sshd[', cast(event_id as string), ']: closed by peer')
 when 'signup' then concat('Jan 12 10:20:30 host', cast(user_id as string), ' cron: job ', cast(event_id as string))
 else concat('free text ', cast(event_id as string)) end"""


@query("parse_syslog", """select event_id, case when event_type in ('error', 'view', 'click') then cast((event_id % 192) // 8 as int) else 1 end as facility, case when event_type in ('error', 'view', 'click') then cast((event_id % 192) % 8 as int) else 6 end as severity,
 case event_type when 'purchase' then '' else concat('host', cast(user_id as varchar)) end as hostname, case event_type when 'error' then 'app' when 'view' then 'app' when 'click' then 'sshd' when 'signup' then 'cron' else '' end as app_name,
 case event_type when 'error' then cast(event_id as varchar) when 'view' then '-' else '' end as proc_id, case event_type when 'error' then 'ID47' when 'view' then '-' else '' end as msg_id,
 case event_type when 'error' then concat('failed login ', cast(event_id as varchar)) when 'view' then concat('plain text ', cast(event_id as varchar)) when 'click' then 'closed by peer' when 'signup' then concat('job ', cast(event_id as varchar)) else concat('free text ', cast(event_id as varchar)) end as message from events""")
def q_parse_syslog(spark, d):
    lines = table(spark, d, "events").selectExpr("event_id", f"{_SYSLOG_LINE} as raw")
    return parse_syslog(lines).drop("raw")


@query("parse_audit", with_views(["audit"], "select timestamp_ms, username, tenant_id, action, success, source_ip, concat(detail, ' | more') as detail from audit"))
def parse_audit(spark, d):
    lines = view(spark, d, "audit").selectExpr(
        "concat_ws('|', cast(timestamp_ms as string), username, tenant_id, action, case when success then 'ok' else 'fail' end, source_ip, concat(detail, ' | more')) as value")
    return parse_audit_log(lines)
