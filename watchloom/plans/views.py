"""Security-shaped inputs derived from the test tables.

Each view is one SELECT over whole tables that Spark and DuckDB both run; only
the expression for epoch milliseconds differs. The events' month is compressed
2000-fold where minute-scale windows must hold several events.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from watchloom.session import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

_START = 1704067200000

DIALECTS = {
    "spark": {
        "ms": "unix_millis(cast(ts as timestamp))",
        "ms_fast": f"{_START} + (unix_millis(cast(ts as timestamp)) - {_START}) div 2000",
        "b64": "translate(base64(", "b64_end": "), chr(13) || chr(10), '')",
    },
    "duckdb": {
        "ms": "epoch_us(ts) // 1000",
        "ms_fast": f"{_START} + (epoch_us(ts) // 1000 - {_START}) // 2000",
        "b64": "to_base64(", "b64_end": ")",
    },
}

_LOG_TEXT = """case event_type
  when 'error' then concat('sshd[', cast(event_id as string), ']: Failed password for u', cast(event_id % 7 as string), ' from 203.0.113.', cast(event_id % 50 as string), ' port 22')
  when 'signup' then concat('sshd[', cast(event_id as string), ']: Accepted password for u', cast(event_id % 7 as string), ' from 10.0.0.', cast(event_id % 50 as string), ' port 22')
  when 'purchase' then concat('sudo: u', cast(event_id % 7 as string), ' : TTY=pts/0 ; COMMAND=/bin/ls')
  when 'click' then concat('kernel: [UFW BLOCK] SRC=198.51.100.', cast(event_id % 80 as string), ' ', repeat('connection refused ', cast(event_id % 20 as int)), 'query: h', cast(event_id % 90 as string), 'q7zkx9w3vb5t.example.xyz')
  else (case event_id % 26
   when 0 then 'nmap port scan detected' when 1 then 'kernel: possible syn flooding on port 80' when 2 then 'mimikatz hash dump seen'
   when 3 then 'psexec run; psexec again; admin$ share' when 4 then 'iodine dns tunnel' when 5 then 'app: segfault at 7f00aa'
   when 6 then 'kernel: Out of memory: Kill process 12'
   when 7 then concat('sshd: Connection reset by 203.0.113.', cast(event_id % 50 as string), ' port 22 [preauth]')
   when 8 then concat('GET /', repeat('a', 320), ' HTTP/1.1') when 9 then concat('GET /x?d=', repeat('QUJD', 20), ' HTTP/1.1')
   when 10 then 'TRACE /x HTTP/1.1' when 11 then concat('lookup ', repeat('ab1.', 7), 'example.com')
   when 12 then 'nf_conntrack: connection table full' when 13 then 'dns amplification seen, reflected attack'
   when 14 then 'banner grab on port 21' when 15 then repeat('connection reset by peer; ', 12)
   when 16 then 'beacon.dll loaded by rundll32' when 17 then 'meterpreter reverse_tcp session' when 18 then 'callback at interval 60'
   when 19 then repeat('scanning 10.1.2.3; ', 6) when 20 then 'golden ticket exported' when 21 then 'rdp lateral hop to 10.0.0.9'
   when 22 then 'wmiexec of cmd' when 23 then concat('event id: ', '4625', ' audit failure at logon, 4672 special privileges')
   when 24 then 'su[81]: session opened for user root by u3' else concat('GET /v?id=', cast(event_id as string), ' HTTP/1.1 User-Agent: curl/8') end) end"""

_PATH = """concat(case o_orderkey % 4 when 0 then '/etc/passwd.' when 1 then '/var/www/' when 2 then '/home/' else '/boot/' end, cast(o_orderkey as string), case when o_orderkey % {rename} = 0 then '{suffix}' else '' end)"""
_CONNECTION = """select cast(l_suppkey % 50 as bigint) as device_id, case when l_linenumber % 3 = 0 then 'udp' else 'tcp' end as protocol, '10.0.0.5' as local_addr,
 cast(1024 + l_partkey % 60000 as int) + case when l_orderkey % {moved} = 0 then {by} else 0 end as local_port, concat('198.51.100.', cast(l_orderkey % 200 as string)) as remote_addr,
 cast(case l_linenumber when 1 then 443 when 2 then 4444 when 3 then 6667 when 4 then 80 else 8443 end as int) as remote_port,
 case when l_suppkey % 5 = 0 and l_returnflag = 'N' then 'SYN_RECV' when l_suppkey % 5 = 1 and l_returnflag = 'N' then 'CLOSE_WAIT' when l_returnflag = 'A' then 'ESTABLISHED' when l_returnflag = 'R' then 'SYN_SENT' else 'LISTEN' end as state from lineitem"""
_SOFTWARE = """select cast(p_partkey % 50 as bigint) as device_id, concat(p_name, '-', cast(p_partkey as string), case when p_partkey % {rename} = 0 then '{suffix}' else '' end) as name,
 concat('1.', cast(p_size + case when p_partkey % {bump} = 0 then 1 else 0 end as string)) as version, p_brand as publisher from part
 union all select cast(p_partkey % 50 as bigint), concat(p_name, '-', cast(p_partkey as string)), concat('0.', cast(p_size as string)), p_type from part where p_partkey % 4 = 0"""
_USB = """select cast(s_suppkey % 20 as bigint) as device_id, concat('0', cast(100 + s_nationkey as string)) as vendor_id, concat('0', cast(100 + s_suppkey % 40 as string)) as product_id,
 concat(s_name, case when s_suppkey % {moved} = 0 then '{suffix}' else '' end) as serial, case when s_suppkey % 3 = 0 then 'storage' else 'hid' end as device_class, s_name as product_name, '10.0.0.7' as machine_ip from supplier"""
_PROCESS = """select cast(o_custkey % 50 as bigint) as device_id, o_orderkey + case when o_orderkey % {moved} = 0 then {by} else 0 end as pid, cast(1704067200000 as bigint) as timestamp_ms,
 case o_orderkey % 9 when 0 then 'Mimikatz.exe' when 1 then 'ncat' when 2 then 'svchost.exe' when 3 then 'RUNDLL32.EXE' else concat('app', cast(o_orderkey % 100 as string)) end as name,
 concat('/usr/bin/', o_orderpriority) as path, concat('u', cast(o_custkey % 7 as string)) as user_name, concat('run --order ', cast(o_orderkey as string)) as cmdline, '10.0.0.6' as machine_ip from orders"""

VIEWS = {
    "sec_log": f"""select event_id, user_id as device_id, {{ms_fast}} as timestamp_ms,
 concat('10.0.', cast(user_id % 8 as string), '.', cast(user_id % 250 as string)) as machine_ip, {_LOG_TEXT} as raw_log from events""",
    "tel": """select event_id, user_id as device_id, {ms} as timestamp_ms,
 concat('host', cast(user_id as string)) as machine_name, concat('10.0.', cast(user_id % 8 as string), '.', cast(user_id % 250 as string)) as machine_ip,
 cast((sum(1000 + cast(floor(value * case when event_id % 50 = 0 then 2000000 else 1000 end) as bigint)) over w) + (case when event_id % 41 = 0 then -900000 else 0 end) as bigint) as net_bytes_in,
 cast(sum(500 + cast(floor(value * case when event_id % 60 = 0 then 1000000 else 100 end) as bigint)) over w as bigint) as net_bytes_out,
 cast(sum(case when event_id % 30 = 0 then 2000 else event_id % 100 end) over w as bigint) as cpu_user_ticks, cast(0 as bigint) as cpu_kernel_ticks,
 cast(sum(100 - event_id % 100) over w as bigint) as cpu_idle_ticks,
 cast(16000000000 as bigint) as ram_total_bytes, cast(16000000000 - (event_id % 90) * 100000000 as bigint) as ram_avail_bytes,
 cast(500000000000 as bigint) as disk_total_bytes, cast(500000000000 - (event_id % 80) * 1000000000 as bigint) as disk_free_bytes
 from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""",
    "arrivals": """select event_id as arrival, user_id as device_id, {ms} - case when event_id % 5 = 0 then 86400000 * 4 else 0 end as timestamp_ms, value from events""",
    "chunk": """select event_id, user_id as device_id, {ms} as timestamp_ms, case
  when event_type = 'error' then concat(repeat(concat('sshd: Failed password for u', cast(event_id % 3 as string), ' from 203.0.113.9 port 22', chr(10)), cast(event_id % 9 as int)), case event_id % 4 when 0 then 'password spray' when 1 then 'credential stuffing' when 2 then concat('Failed password for a from 1.1.1.1', chr(10), 'Failed password for b from 1.1.1.1', chr(10), 'Failed password for c from 1.1.1.1') else 'ok' end)
  when event_type = 'view' then 'sshd: Failed password for root from 203.0.113.9 port 22'
  else 'all quiet' end as raw_log from events""",
    "snap_a": f"""select cast(o_custkey % 50 as bigint) as device_id, {_PATH.format(rename=11, suffix='.old')} as path,
 md5(cast(o_orderkey as string)) as sha256, cast(floor(o_totalprice) as bigint) as size_bytes, cast(o_orderkey as bigint) as mtime_epoch from orders""",
    "snap_b": f"""select cast(o_custkey % 50 as bigint) as device_id, {_PATH.format(rename=17, suffix='.new')} as path,
 md5(concat(cast(o_orderkey as string), case when o_orderkey % 13 = 0 then 'x' else '' end)) as sha256, cast(floor(o_totalprice) + o_orderkey % 13 as bigint) as size_bytes, cast(o_orderkey + 9 as bigint) as mtime_epoch from orders""",
    "conn_a": _CONNECTION.format(moved=5, by=70000),
    "conn_b": _CONNECTION.format(moved=7, by=140000),
    "sw_a": _SOFTWARE.format(rename=9, suffix=' (a)', bump=1000003),
    "sw_b": _SOFTWARE.format(rename=8, suffix=' (b)', bump=6),
    "usb_a": _USB.format(moved=5, suffix='-a'),
    "usb_b": _USB.format(moved=4, suffix='-b'),
    "proc_a": _PROCESS.format(moved=5, by=100000000),
    "proc_b": _PROCESS.format(moved=7, by=200000000),
    "det": """select event_id, user_id as device_id, {ms_fast} as timestamp_ms, concat('10.0.', cast(user_id % 8 as string), '.', cast(user_id % 250 as string)) as machine_ip,
 case event_type when 'error' then 'traffic' when 'signup' then 'session' when 'click' then 'ioc' when 'view' then 'fim' else 'network_inspector' end as source,
 case event_type when 'error' then (case (event_id div 4) % 4 when 0 then 'brute_force' when 1 then 'c2_beacon' when 2 then 'data_exfiltration' else 'port_scan' end) when 'signup' then 'priv_escalation' when 'click' then 'ioc_match' when 'view' then 'fim_modified' else 'dns_tunnel' end as category,
 case event_id % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as severity,
 concat('T', cast(1000 + event_id % 9 as string)) as mitre_id, concat('seen | a=b \\ ', event_type, ' ', cast(event_id as string)) as description,
 case when event_type = 'click' then concat('203.0.113.', cast(event_id % 60 as string)) else '' end as ioc_value, '' as file_path, value from events""",
    "ioc_feed": """select 'ip' as type, concat('203.0.113.', cast(n_nationkey as string)) as value, 'high' as severity, 'feed_ip' as feed_source, n_nationkey as load_order from nation
 union all select 'cidr', concat('198.51.100.', cast(r_regionkey * 16 as string), '/', cast(26 + r_regionkey as string)), 'medium', 'feed_net', r_regionkey from region
 union all select 'cidr', '203.0.113.40/29', 'high', 'feed_net', 10 + r_regionkey from region
 union all select 'domain', case r_regionkey when 0 then 'example.xyz' when 1 then 'example.com' when 2 then 'xyz' when 3 then 'ab1.example.com' else 'h5q7zkx9w3vb5t.example.xyz' end, 'high', 'feed_dom', r_regionkey from region
 union all select 'useragent', case r_regionkey when 0 then 'curl' when 1 then 'curl/8' when 2 then 'go' when 3 then 'x' else 'shodan' end, 'low', 'feed_ua', r_regionkey from region
 union all select 'url', lower(url), 'medium', 'feed_url', cast(page_id as int) from pages
 union all select 'email', concat('u', cast(c_custkey as string), '@example.org'), 'medium', 'feed_mail', cast(c_custkey as int) from customer""",
    "beacon": """select o_orderkey as event_id, cast(floor(o_orderkey / 250) as bigint) as device_id, cast(60000 + 50 * (o_orderkey % 40) + case when o_orderkey % 2000 < 700 then (o_orderkey * 7919) % 40000 else 0 end as bigint) as interval_ms from orders""",
    "audit": """select 1704067200000 + o_orderkey * 1000 as timestamp_ms, concat('user', cast(o_custkey % 40 as string)) as username, concat('tenant', cast(o_custkey % 5 as string)) as tenant_id,
 case o_orderstatus when 'F' then 'login' when 'O' then 'api_request' else 'role_denied' end as action, o_orderpriority <> '1-URGENT' as success, concat('10.9.', cast(o_custkey % 250 as string), '.1') as source_ip, concat('order ', cast(o_orderkey as string)) as detail from orders""",
    "payloads": """select event_id, user_id as device_id, {ms} as timestamp_ms, concat('POST /u data: ', {b64}unhex(concat(md5(concat(cast(event_id as string), 'a')), md5(concat(cast(event_id as string), 'b')), md5(concat(cast(event_id as string), 'c')), md5(concat(cast(event_id as string), 'd')), md5(concat(cast(event_id as string), 'e')), md5(concat(cast(event_id as string), 'f')), md5(concat(cast(event_id as string), 'g')), md5(concat(cast(event_id as string), 'h')), md5(concat(cast(event_id as string), 'i')), md5(concat(cast(event_id as string), 'j')),
 case when event_id % 3 = 0 then '' else concat(md5(concat(cast(event_id as string), 'k')), md5(concat(cast(event_id as string), 'l')), md5(concat(cast(event_id as string), 'm')), md5(concat(cast(event_id as string), 'n')), md5(concat(cast(event_id as string), 'o')), md5(concat(cast(event_id as string), 'p')), md5(concat(cast(event_id as string), 'q'))) end)){b64_end}, ' end') as raw_log from events""",
}


def view_sql(name: str, dialect: str) -> str:
    text = VIEWS[name]
    for key, value in DIALECTS[dialect].items():
        text = text.replace("{" + key + "}", value)
    if dialect == "duckdb":
        text = text.replace(" div 4)", " // 4)").replace("as string)", "as varchar)")
    else:
        # A backslash in a Spark string literal escapes the next character.
        text = text.replace("\\ ", "\\\\ ")
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the Parquet tables of a folder."""
    text = view_sql(name, "spark")
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"from {t}" in text}
    for t, df in used.items():
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **used)


def with_views(names: Iterable[str], body: str, recursive: bool = False) -> str:
    """DuckDB statement with the named views, each evaluated once, in front of ``body``.

    ``body`` either starts with further CTEs ("name as (…), … select") or is a SELECT.
    """
    heads = ", ".join(f"{n} as materialized ({view_sql(n, 'duckdb')})" for n in names)
    joint = "" if body.lstrip().lower().startswith("select") else ","
    return f"with {'recursive ' if recursive else ''}{heads}{joint} {body}"
