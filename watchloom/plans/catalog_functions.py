"""Queries on the scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.mitre import fim_mitre_id, fim_mitre_tactic, mitre_tag
from watchloom.functions.network import cidr_bounds, ioc_type_alias, ipv4_long
from watchloom.functions.severity import severity_rank, syslog_level, z_confidence, z_severity
from watchloom.functions.text import (
    DOMAIN_PATTERN, EMAIL_PATTERN, HASH_PATTERN, IP_PATTERN, URL_PATTERN, consonant_ratio, extract_domains,
    extract_emails, extract_hashes, extract_ips, extract_urls, fmt_ts, label_count, match_count, max_label_len,
    path_severity, shannon_entropy,
)
from watchloom.plans.catalog import query
from watchloom.plans.sql import MITRE, MITRE_COLUMNS, RANK, case, quote
from watchloom.plans.views import table, view, with_views
from watchloom.rules.mitre import TECHNIQUES
from watchloom.rules.reference_lists import CRITICAL_PATHS, HIGH_PATHS


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))


@query("severity_rank", with_views(["det"], f"select event_id, severity, {RANK} as severity_rank from det"))
def q_severity_rank(spark, d):
    return view(spark, d, "det").select("event_id", "severity", severity_rank("severity").alias("severity_rank"))


@query("extract_ips", f"""select doc_id, ip from (select distinct doc_id, unnest(regexp_extract_all(text, {quote(IP_PATTERN)}, 1)) as ip from documents)
 where not starts_with(ip, '127.') and ip not in ('0.0.0.0', '255.255.255.255')""")
def q_extract_ips(spark, d):
    return _documents(spark, d).select("doc_id", F.explode(extract_ips("text")).alias("ip"))


@query("extract_hashes", f"select distinct doc_id, lower(unnest(regexp_extract_all(text, {quote(HASH_PATTERN)}, 1))) as hash from documents")
def q_extract_hashes(spark, d):
    return _documents(spark, d).select("doc_id", F.explode(extract_hashes("text")).alias("hash"))


@query("extract_emails", f"select distinct doc_id, lower(unnest(regexp_extract_all(text, {quote(EMAIL_PATTERN)}))) as email from documents")
def q_extract_emails(spark, d):
    return _documents(spark, d).select("doc_id", F.explode(extract_emails("text")).alias("email"))


@query("extract_domains", f"""select * from (select distinct doc_id, lower(unnest(regexp_extract_all(text, {quote(DOMAIN_PATTERN)}, 1))) as domain from documents)
 where not regexp_matches(domain, '^[0-9.]*$')""")
def q_extract_domains(spark, d):
    return _documents(spark, d).select("doc_id", F.explode(extract_domains("text")).alias("domain"))


@query("extract_urls", f"select distinct page_id, lower(unnest(regexp_extract_all(concat(url, ' ', html), {quote(URL_PATTERN)}))) as url from pages")
def q_extract_urls(spark, d):
    return _pages(spark, d).select("page_id", F.explode(extract_urls("text")).alias("url"))


@query("ipv4_long", with_views(["sec_log"], """select event_id, machine_ip, cast(split_part(machine_ip, '.', 1) as bigint) * 16777216 + cast(split_part(machine_ip, '.', 2) as bigint) * 65536
 + cast(split_part(machine_ip, '.', 3) as bigint) * 256 + cast(split_part(machine_ip, '.', 4) as bigint) as ip from sec_log"""))
def q_ipv4_long(spark, d):
    return view(spark, d, "sec_log").select("event_id", "machine_ip", ipv4_long("machine_ip").alias("ip"))


@query("cidr_bounds", """select o_orderkey, o_orderkey % 34 as prefix_given, case when p <= 32 then p else 32 end as prefix, lo, lo + size - 1 as hi from
 (select *, (ip // size) * size as lo from (select *, cast(pow(2, 32 - case when p <= 32 then p else 32 end) as bigint) as size from
 (select o_orderkey, o_orderkey % 34 as p, 167772160 + (o_orderkey * 7919) % 16777216 as ip from orders)))""")
def q_cidr_bounds(spark, d):
    ip = F.lit(167772160) + (F.col("o_orderkey") * 7919) % 16777216
    octet = lambda n: F.shiftright(ip, n).bitwiseAND(F.lit(255)).cast("string")
    text = F.concat(F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)), F.lit("/"), (F.col("o_orderkey") % 34).cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", cidr_bounds(text).alias("b"))
    return rows.select("o_orderkey", (F.col("o_orderkey") % 34).alias("prefix_given"), "b.prefix", "b.lo", "b.hi")


_ENTROPY = """(select coalesce(-sum(p * log2(p)), 0.0) from (select count(*) / sum(count(*)) over () as p from (select unnest(string_split({0}, '')) as ch) group by ch))"""


@query("shannon_entropy", f"""select doc_id, round({_ENTROPY.format('text')}, 6) as entropy from documents""")
def q_shannon_entropy(spark, d):
    return _documents(spark, d).select("doc_id", F.round(shannon_entropy("text"), 6).alias("entropy"))


@query("name_statistics", """select page_id, host, round(case when length(letters) > 0 then length(regexp_replace(letters, '[aeiou]', '', 'gi')) / length(letters) else 0.0 end, 6) as consonant_ratio,
 len(string_split(host, '.')) as label_count, list_max([length(x) for x in string_split(host, '.')]) as max_label_len from
 (select page_id, url as host, regexp_replace(url, '[^a-zA-Z]', '', 'g') as letters from pages)""")
def name_statistics(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("host"))
    return rows.select("page_id", "host", F.round(consonant_ratio("host"), 6).alias("consonant_ratio"),
                       label_count("host").alias("label_count"), max_label_len("host").alias("max_label_len"))


_TYPE_WORD = "case o_orderkey % 9 when 0 then 'IPv4' when 1 then 'fqdn' when 2 then 'SHA1' when 3 then 'ua' when 4 then 'url' when 5 then 'email' when 6 then 'cidr' when 7 then 'hostname' else 'odd' end"


@query("ioc_type_alias", f"""select o_orderkey, case o_orderkey % 9 when 0 then 'ip' when 1 then 'domain' when 2 then 'hash' when 3 then 'useragent' when 4 then 'url' when 5 then 'email' when 6 then 'cidr' when 7 then 'domain' else 'ip' end as ioc_type from orders""")
def q_ioc_type_alias(spark, d):
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", ioc_type_alias(F.expr(_TYPE_WORD)).alias("ioc_type"))


@query("z_tiers", """select l_orderkey, l_linenumber, z, case when abs(z) >= 3 then 'critical' when abs(z) >= 2.5 then 'high' when abs(z) >= 2 then 'medium' else '' end as z_severity,
 round(case when abs(z) < 2 then 0.0 else least(0.95, 0.3 + 0.6 * (abs(z) - 2.0)) end, 6) as z_confidence from (select l_orderkey, l_linenumber, (l_quantity - 25) / 6 as z from lineitem)""")
def z_tiers(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25) / 6).alias("z"))
    return rows.select("*", z_severity("z").alias("z_severity"), F.round(z_confidence("z"), 6).alias("z_confidence"))


_SUB_TYPES = [*TECHNIQUES, "made_up"]


@query("mitre_tag", f"""with {MITRE}, k as (select event_id, list_extract([{', '.join(quote(s) for s in _SUB_TYPES)}], cast(event_id % {len(_SUB_TYPES)} + 1 as int)) as sub_type from events)
 select event_id, k.sub_type, {MITRE_COLUMNS}, case when mitre.mitre_id is null then '' else concat('https://attack.mitre.org/techniques/', replace(mitre.mitre_id, '.', '/'), '/') end as mitre_url
 from k left join mitre on mitre.sub_type = k.sub_type""")
def q_mitre_tag(spark, d):
    names = F.array(*[F.lit(s) for s in _SUB_TYPES])
    place = (F.col("event_id") % len(_SUB_TYPES) + 1).cast("int")
    rows = table(spark, d, "events").select("event_id", F.element_at(names, place).alias("sub_type"))
    return mitre_tag(rows, url=True)


@query("match_count", "select doc_id, len(regexp_extract_all(text, '(?i)th|en')) as matches from documents")
def q_match_count(spark, d):
    return _documents(spark, d).select("doc_id", match_count("text", "th|en").alias("matches"))


def path_severity_sql(path: str) -> str:
    crit, high = quote("|".join(CRITICAL_PATHS)), quote("|".join(HIGH_PATHS))
    return (f"case when regexp_matches(lower({path}), {crit}, 'i') then 'critical' "
            f"when regexp_matches(lower({path}), {high}, 'i') then 'high' else 'medium' end")


@query("path_severity", with_views(["snap_a"], f"select device_id, path, {path_severity_sql('path')} as severity from snap_a"))
def q_path_severity(spark, d):
    return view(spark, d, "snap_a").select("device_id", "path", path_severity("path").alias("severity"))


@query("fim_mitre", """select o_orderkey, change_type, severity, case when change_type = 'added' and severity = 'critical' then 'T1505.003' when change_type = 'added' then 'T1074'
 when change_type = 'modified' and severity = 'critical' then 'T1565.001' when change_type = 'modified' then 'T1027' else 'T1070.004' end as mitre_id,
 case when change_type = 'added' and severity = 'critical' then 'Persistence' when change_type = 'added' then 'Collection' when change_type = 'modified' and severity = 'critical' then 'Impact' else 'Defense Evasion' end as mitre_tactic
 from (select o_orderkey, case o_orderkey % 3 when 0 then 'added' when 1 then 'modified' else 'deleted' end as change_type, case o_orderkey % 2 when 0 then 'critical' else 'high' end as severity from orders)""")
def fim_mitre(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey", "case o_orderkey % 3 when 0 then 'added' when 1 then 'modified' else 'deleted' end as change_type",
        "case o_orderkey % 2 when 0 then 'critical' else 'high' end as severity")
    return rows.select("*", fim_mitre_id("change_type", "severity").alias("mitre_id"),
                       fim_mitre_tactic("change_type", "severity").alias("mitre_tactic"))


@query("syslog_level", f"select event_id, {case('event_id % 10', {0: 'emerg', 1: 'alert', 2: 'crit', 3: 'err', 4: 'warning', 5: 'notice', 6: 'info', 7: 'debug'}, 'info')} as level from events")
def q_syslog_level(spark, d):
    return table(spark, d, "events").select("event_id", syslog_level((F.col("event_id") % 10).cast("int")).alias("level"))


@query("fmt_ts", """select o_orderkey, case when o_orderkey % 7 = 0 then 'n/a' else concat(strftime(make_timestamp((1704067200000 + o_orderkey * 61007) // 1000 * 1000000), '%Y-%m-%d %H:%M:%S'), ' UTC') end as shown from orders""")
def q_fmt_ts(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 7 = 0 then 0 else 1704067200000 + o_orderkey * 61007 end as ms")
    return rows.select("o_orderkey", fmt_ts("ms").alias("shown"))
