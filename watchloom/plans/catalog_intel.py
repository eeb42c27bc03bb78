"""Indicator matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.text import DOMAIN_PATTERN, EMAIL_PATTERN, HASH_PATTERN, IP_PATTERN, URL_PATTERN
from watchloom.operators.intel import (
    ioc_stats, latest_entries, match_cidr, match_domain, match_exact, match_indicators, match_user_agent,
    report_indicators,
)
from watchloom.plans.catalog import query
from watchloom.plans.sql import quote
from watchloom.plans.views import table, view, with_views
from watchloom.sources.feeds import parse_feed_lines, parse_rules

_OUT = ["event_id", "type", "value", "matched_in", "ioc_type", "ioc_value", "severity", "feed_source"]


def _indicator_sql(view_name: str, text: str, ip: str) -> str:
    found = lambda kind, where, pattern, group="": (
        f"select distinct event_id, {quote(kind)} as type, lower(unnest(regexp_extract_all({text}, {quote(pattern)}{group}))) as value, {quote(where)} as matched_in from {view_name}")
    parts = [
        f"select event_id, 'ip' as type, lower({ip}) as value, 'client_ip' as matched_in from {view_name} where {ip} is not null",
        f"select * from ({found('ip', 'log_chunk_ip', IP_PATTERN, ', 1')}) where not starts_with(value, '127.') and value not in ('0.0.0.0', '255.255.255.255')",
        f"select * from ({found('domain', 'log_chunk_domain', DOMAIN_PATTERN, ', 1')}) where not regexp_matches(value, '^[0-9.]*$')",
        found("hash", "log_chunk_hash", HASH_PATTERN, ", 1"),
        found("url", "log_chunk_url", URL_PATTERN),
        found("email", "log_chunk_email", EMAIL_PATTERN),
    ]
    return f"ind as materialized ({' union all '.join(parts)})"


_LOG_IND = _indicator_sql("sec_log", "raw_log", "machine_ip")
_IP = "(" + " + ".join(f"try_cast(split_part({{0}}, '.', {i + 1}) as bigint) * {256 ** (3 - i)}" for i in range(4)) + ")"
_EXACT = "select i.event_id, i.type, i.value, matched_in, f.type as ioc_type, f.value as ioc_value, severity, feed_source from ind i join ioc_feed f on f.type = i.type and f.value = i.value"
_CIDR = f"""select event_id, type, value, matched_in, 'cidr' as ioc_type, cidr as ioc_value, severity, feed_source from
 (select i.*, f.value as cidr, f.severity, f.feed_source, row_number() over (partition by i.event_id, i.value, i.matched_in order by f.load_order, f.value) as rn
  from (select *, {_IP.format('value')} as ip from ind where type = 'ip') i join (select *, cast(pow(2, 32 - cast(split_part(value, '/', 2) as int)) as bigint) as size, {_IP.format("split_part(value, '/', 1)")} as base from ioc_feed where type = 'cidr') f
  on i.ip // f.size = f.base // f.size where ip <> 0 and not exists (select 1 from ioc_feed x where x.type = 'ip' and x.value = i.value)) where rn = 1"""
_DOMAIN = """select event_id, type, value, matched_in, 'domain' as ioc_type, dom as ioc_value, severity, feed_source from
 (select i.*, f.value as dom, f.severity, f.feed_source, row_number() over (partition by i.event_id, i.value order by length(f.value) desc) as rn from ind i join ioc_feed f
  on f.type = 'domain' and (i.value = f.value or ends_with(i.value, concat('.', f.value))) where i.type = 'domain') where rn = 1"""


def _indicators(spark, d):
    return report_indicators(view(spark, d, "sec_log"), keep=["event_id"])


@query("ioc_indicators", with_views(["sec_log"], f"{_LOG_IND} select event_id, type, value, matched_in from ind"))
def ioc_indicators(spark, d):
    return _indicators(spark, d).select("event_id", "type", "value", "matched_in")


@query("ioc_exact", with_views(["sec_log", "ioc_feed"], f"{_LOG_IND} {_EXACT}"))
def ioc_exact(spark, d):
    return match_exact(_indicators(spark, d), view(spark, d, "ioc_feed")).select(*_OUT)


@query("ioc_cidr", with_views(["sec_log", "ioc_feed"], f"{_LOG_IND} {_CIDR}"))
def ioc_cidr(spark, d):
    return match_cidr(_indicators(spark, d), view(spark, d, "ioc_feed")).select(*_OUT)


@query("ioc_domain", with_views(["sec_log", "ioc_feed"], f"{_LOG_IND} {_DOMAIN}"))
def ioc_domain(spark, d):
    return match_domain(_indicators(spark, d), view(spark, d, "ioc_feed")).select(*_OUT)


@query("ioc_match_all", with_views(["sec_log", "ioc_feed"], f"{_LOG_IND} {_EXACT} where i.type <> 'domain' union all {_CIDR} union all {_DOMAIN}"))
def ioc_match_all(spark, d):
    return match_indicators(_indicators(spark, d), view(spark, d, "ioc_feed")).select(*_OUT)


@query("ioc_pages", with_views(["ioc_feed"], f"""src as (select page_id as event_id, concat(url, ' ', html) as body, cast(null as varchar) as ip from pages),
 {_indicator_sql('src', 'body', 'ip')} {_EXACT} where i.type in ('url', 'email', 'hash')"""))
def ioc_pages(spark, d):
    pages = table(spark, d, "pages").select(
        F.col("page_id").alias("event_id"), F.concat_ws(" ", "url", "html").alias("body"), F.lit(None).cast("string").alias("ip"))
    found = report_indicators(pages, keep=["event_id"], text="body", ip="ip").filter(F.col("type").isin("url", "email", "hash"))
    return match_exact(found, view(spark, d, "ioc_feed")).select(*_OUT)


_AGENT = "case event_type when 'click' then concat('Mozilla/5.0 (X', cast(event_id % 90 as string), ')') when 'view' then 'curl/8.1' when 'error' then 'CURL/7' when 'signup' then 'Go-http-client/2' else 'wget' end"


@query("ioc_user_agent", with_views(["ioc_feed"], f"""a as (select event_id, {_AGENT.replace('as string', 'as varchar')} as user_agent from events)
 select event_id, user_agent, ioc_value, severity, feed_source from (select a.*, f.value as ioc_value, severity, feed_source,
  row_number() over (partition by event_id order by length(f.value) desc, f.value desc) as rn from a join ioc_feed f on f.type = 'useragent' and contains(lower(user_agent), f.value)) where rn = 1"""))
def ioc_user_agent(spark, d):
    agents = table(spark, d, "events").selectExpr("event_id", f"{_AGENT} as user_agent")
    return match_user_agent(agents, view(spark, d, "ioc_feed")).select("event_id", "user_agent", "ioc_value", "severity", "feed_source")


@query("ioc_stats", with_views(["ioc_feed"], """select 'type' as scope, case when type = 'cidr' then 'ip' else type end as name, count(*) as entries from ioc_feed group by 2
 union all select 'feed', feed_source, count(*) from ioc_feed group by 2 union all select 'total', 'all', count(*) from ioc_feed"""))
def q_ioc_stats(spark, d):
    return ioc_stats(view(spark, d, "ioc_feed"))


_FEED_LINE = """concat(case o_orderkey % 6 when 0 then 'IPv4' when 1 then ' fqdn ' when 2 then 'sha256' when 3 then 'cidr' when 4 then '# comment' else 'email' end, '|', case when o_orderkey % 10 = 9 then '' else concat('V', cast(o_custkey as string)) end, '| ',
 case when o_orderkey % 4 = 0 then '' else 'low' end, '|desc ', cast(o_orderkey as string), '|T1', case when o_orderkey % 5 = 0 then '|a,b # tail' else '' end)"""


@query("parse_feed_lines", f"""with l as (select o_orderkey as line_no, concat('feed', cast(o_orderkey % 3 as varchar)) as feed_source, o_orderkey, o_custkey from orders),
 e as (select * from (select case o_orderkey % 6 when 0 then 'ip' when 1 then 'domain' when 2 then 'hash' when 3 then 'cidr' when 5 then 'email' end as type, case when o_orderkey % 10 < 9 then concat('v', cast(o_custkey as varchar)) end as value,
  case when o_orderkey % 4 = 0 then 'high' else 'low' end as severity, feed_source, concat('desc ', cast(o_orderkey as varchar)) as description, 'T1' as mitre_id, case when o_orderkey % 5 = 0 then 'a,b' else '' end as tags, line_no from l) where type is not null and value is not null)
 select * from e where type = 'cidr' union all select * from (select * from e where type <> 'cidr' qualify row_number() over (partition by type, value order by feed_source desc, line_no desc) = 1)""")
def q_parse_feed_lines(spark, d):
    lines = table(spark, d, "orders").selectExpr(
        "o_orderkey as line_no", "concat('feed', cast(o_orderkey % 3 as string)) as feed_source", f"{_FEED_LINE} as line")
    return latest_entries(parse_feed_lines(lines))


_RULE_LINE = """case o_orderkey % 5 when 0 then concat(' name', cast(o_custkey as string), ' | high | cat | (a|b)', cast(o_orderkey as string), ' ') when 1 then '# comment' when 2 then '   '
 when 3 then concat('bad', cast(o_orderkey as string), '|severe|cat|x') else concat('n', cast(o_orderkey as string), '|low|c|', cast(o_orderkey as string), '+') end"""


@query("parse_rules", """select line_no, name, severity, category, pattern from (select o_orderkey as line_no,
 case o_orderkey % 5 when 0 then concat('name', cast(o_custkey as varchar)) when 4 then concat('n', cast(o_orderkey as varchar)) end as name, case o_orderkey % 5 when 0 then 'high' else 'low' end as severity,
 case o_orderkey % 5 when 0 then 'cat' else 'c' end as category, case o_orderkey % 5 when 0 then concat('(a|b)', cast(o_orderkey as varchar)) else concat(cast(o_orderkey as varchar), '+') end as pattern from orders) where name is not null""")
def q_parse_rules(spark, d):
    lines = table(spark, d, "orders").selectExpr("o_orderkey as line_no", f"{_RULE_LINE} as line")
    return parse_rules(lines)
