"""Changes along several snapshots of a device, and reports judged one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchloom.operators import snapshots as chain
from watchloom.operators.diffs import CONNECTION_KEY, connection_summary, usb_severity
from watchloom.operators.network import connection_anomalies
from watchloom.plans.catalog import query
from watchloom.plans.catalog_inventory import _ALLOWED
from watchloom.plans.sql import quote
from watchloom.plans.views import view, with_views

#: Devices whose last snapshot is empty, and those whose third one is missing.
_EMPTIED, _SKIPPED = "device_id % 7 = 3", "device_id % 5 = 1"


def snapshot_rows(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots a, b, a, b of each device, the third one not of all; and the headers, of an empty fifth one too."""
    a, b = view(spark, d, f"{name}_a"), view(spark, d, f"{name}_b")
    at = lambda df, ms: df.withColumn("timestamp_ms", F.lit(ms).cast("long"))
    rows = at(a, 1000).unionByName(at(b, 2000)).unionByName(at(a.where(f"not ({_SKIPPED})"), 3000)).unionByName(at(b, 4000))
    emptied = at(a.where(_EMPTIED).select("device_id"), 5000).distinct()
    return rows, rows.select("device_id", "timestamp_ms").distinct().unionByName(emptied)


def _chain_sql(name: str, columns: str, keys: list[str], entry: str, differs: str, body: str) -> str:
    """CTEs rows, times (with the time before) and ch (kind, at, old and new entry), and what ``body`` makes of them.

    Each snapshot is compared with the one before it, pair by pair.
    """
    same = " and ".join(f"o.{k} = n.{k}" for k in keys)
    item = ", ".join(keys)
    pick = lambda side: ", ".join(f"{side}.{k}" for k in keys)
    return with_views([f"{name}_a", f"{name}_b"], f"""raw as (select 1000 as ms, {columns} from {name}_a union all select 2000, {columns} from {name}_b
 union all select 3000, {columns} from {name}_a where not ({_SKIPPED}) union all select 4000, {columns} from {name}_b),
 snap as (select device_id, ms, {item}, max({entry}) as e from raw group by device_id, ms, {item}),
 heads as (select distinct device_id, ms from raw union select device_id, 5000 from {name}_a where {_EMPTIED}),
 pairs as (select * from (select device_id, ms, lag(ms) over (partition by device_id order by ms) as before from heads) where before is not null),
 ch as (select p.device_id, p.ms, {pick('n')}, 'added' as kind, null as o, n.e as n from pairs p join snap n on n.device_id = p.device_id and n.ms = p.ms
   where not exists (select 1 from snap o where o.device_id = p.device_id and o.ms = p.before and {same})
  union all select p.device_id, p.ms, {pick('o')}, 'gone', o.e, null from pairs p join snap o on o.device_id = p.device_id and o.ms = p.before
   where not exists (select 1 from snap n where n.device_id = p.device_id and n.ms = p.ms and {same})
  union all select p.device_id, p.ms, {pick('n')}, 'changed', o.e, n.e from pairs p join snap n on n.device_id = p.device_id and n.ms = p.ms
   join snap o on o.device_id = p.device_id and o.ms = p.before and {same} where {differs})
 {body}""")


def _kinds(**names: str) -> str:
    return "case kind " + " ".join(f"when '{k}' then {quote(v)}" for k, v in names.items()) + " end"


@query("process_chain", _chain_sql("proc", "device_id, pid, name", ["pid"], "struct_pack(name := name)", "false", f"""select device_id, cast(ms as bigint) as timestamp_ms, pid, coalesce(n.name, o.name) as name,
 {_kinds(added='new', gone='terminated')} as change_type, {_kinds(added='New process started', gone='Process terminated')} as reason from ch"""))
def process_chain(spark, d):
    rows, headers = snapshot_rows(spark, d, "proc")
    return chain.process_changes(chain.snapshot_changes(rows, chain.PROCESSES, headers))


@query("connection_chain", _chain_sql("conn", f"device_id, {', '.join(CONNECTION_KEY[1:])}, state", CONNECTION_KEY[1:], "struct_pack(state := state)", "false",
 f"""select device_id, cast(ms as bigint) as timestamp_ms, {', '.join(CONNECTION_KEY[1:])}, coalesce(n.state, '') as state,
 {_kinds(added='new', gone='closed')} as change_type, {_kinds(added='New connection', gone='Connection closed')} as reason from ch"""))
def connection_chain(spark, d):
    rows, headers = snapshot_rows(spark, d, "conn")
    return chain.connection_changes(chain.snapshot_changes(rows, chain.CONNECTIONS, headers))


@query("software_chain", _chain_sql("sw", "device_id, name, version, publisher", ["name"], "struct_pack(version := version, publisher := publisher)", "o.e.version <> n.e.version",
 f"""select device_id, cast(ms as bigint) as timestamp_ms, name, {_kinds(added='installed', gone='removed', changed='updated')} as change_type, case when kind = 'gone' then o.version else n.version end as version,
 case when kind = 'gone' then o.publisher else n.publisher end as publisher, case when kind = 'changed' then o.version else '' end as old_version from ch"""))
def software_chain(spark, d):
    rows, headers = snapshot_rows(spark, d, "sw")
    return chain.software_changes(chain.snapshot_changes(rows, chain.SOFTWARE, headers))


_USB_KINDS = """kinds as (select *, case kind when 'added' then 'inserted' else 'removed' end as change_type from ch union all select *, 'unauthorized' from ch where kind = 'added'
  and concat(vendor_id, ':', product_id) not in ('0101:0102', '0104:0109') and upper(concat(vendor_id, ':', product_id, ':', serial)) <> '0100:0101:SUPPLIER#000000001')"""


@query("usb_chain", _chain_sql("usb", "device_id, vendor_id, product_id, serial, device_class", ["vendor_id", "product_id", "serial"], "struct_pack(device_class := device_class)", "false",
 f""", {_USB_KINDS} select device_id, cast(ms as bigint) as timestamp_ms, vendor_id, product_id, serial, coalesce(n.device_class, o.device_class) as device_class, change_type,
 case change_type when 'inserted' then 'Device inserted' when 'removed' then 'Device removed' else concat('VID:PID not in whitelist: ', vendor_id, ':', product_id) end as reason,
 case when change_type = 'unauthorized' then 'high' when change_type = 'inserted' and coalesce(n.device_class, o.device_class) = 'storage' then 'medium' else 'low' end as severity from kinds"""))
def usb_chain(spark, d):
    rows, headers = snapshot_rows(spark, d, "usb")
    return usb_severity(chain.usb_changes(chain.snapshot_changes(rows, chain.USB, headers), _ALLOWED))


_REPORTS = "raw as (select 1000 as ms, * from conn_a union all select 2000, * from conn_b union all select 3000, * from conn_a where not (device_id % 5 = 1) union all select 4000, * from conn_b)"


@query("connection_reports", with_views(["conn_a", "conn_b"], f"""{_REPORTS} select device_id, cast(ms as bigint) as timestamp_ms, count(*) filter (protocol = 'tcp') as total_tcp,
 count(*) filter (protocol = 'udp') as total_udp, count(*) filter (state = 'LISTEN') as listening_ports from raw group by device_id, ms"""))
def connection_reports(spark, d):
    return connection_summary(snapshot_rows(spark, d, "conn")[0])


@query("connection_report_anomalies", with_views(["conn_a", "conn_b"], f"""{_REPORTS}, s as (select device_id, ms, count(*) as total, count(*) filter (state in ('SYN_SENT', 'SYN_RECV')) / count(*) as hr,
  count(*) filter (starts_with(state, 'CLOSE')) / count(*) as rr from raw group by device_id, ms)
 select device_id, cast(ms as bigint) as timestamp_ms, 'syn_flood' as category, 'high' as severity, round(least(1.0, hr), 6) as confidence from s where total > 100 and hr > 0.5
 union all select device_id, cast(ms as bigint), 'proto_anomaly', 'medium', round(least(1.0, rr), 6) from s where total > 50 and rr > 0.4"""))
def connection_report_anomalies(spark, d):
    found = connection_anomalies(snapshot_rows(spark, d, "conn")[0])
    return found.select("device_id", "timestamp_ms", "category", "severity", F.round("confidence", 6).alias("confidence"))
