"""Network inspection, Sigma and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators import network as net
from watchloom.operators.anomaly import (
    BeaconLimits, anomaly_features, beacon_score, forest_findings, observe, past_pools, score_forest, train_forest, tree_samples,
)
from watchloom.operators.rule_scan import scan_rules
from watchloom.operators.sigma import (
    Match, SigmaRule, sigma_events, sigma_match, sigma_process_events, sigma_syslog_events, sigma_telemetry_events,
)
from watchloom.operators.telemetry import event_counts, telemetry_features
from watchloom.plans.catalog import ORACLES, query
from watchloom.plans.catalog_telemetry import _EWMA
from watchloom.plans.sql import quote, stable
from watchloom.plans.views import table, view, with_views
from watchloom.rules.reference_lists import SUSPICIOUS_TLDS
from watchloom.session import cut

_OUT = ["event_id", "category", "severity", "confidence", "mitre_id", "indicator", "description", "evidence"]


def _logs(spark, d, name="sec_log"):
    return view(spark, d, name).select("event_id", "raw_log")


def _shape(df):
    return df.withColumn("confidence", F.round("confidence", 6)).select(*_OUT)


_NAMES_SQL = f"""names as materialized (select distinct event_id, unnest(regexp_extract_all(raw_log, {quote(net.DNS_QUERY_PATTERN)}, 1)) as domain from sec_log),
 m as materialized (select *, (select -sum(p * log2(p)) from (select count(*) / sum(count(*)) over () as p from (select unnest(string_split(replace(lower(domain), '.', ''), '')) as ch) group by ch)) as h,
  length(regexp_replace(domain, '[^a-zA-Z]', '', 'g')) as letters, length(regexp_replace(regexp_replace(domain, '[^a-zA-Z]', '', 'g'), '[aeiouAEIOU]', '', 'g')) as consonants,
  len(string_split(domain, '.')) as labels, list_max([length(x) for x in string_split(domain, '.')]) as longest from names where length(domain) >= 4)"""


@query("dns_queries", with_views(["sec_log"], f"select distinct event_id, unnest(regexp_extract_all(raw_log, {quote(net.DNS_QUERY_PATTERN)}, 1)) as domain from sec_log"))
def q_dns_queries(spark, d):
    return net.dns_queries(_logs(spark, d))


@query("dga", with_views(["sec_log"], f"""{_NAMES_SQL}, f as (select *, case when letters > 0 then consonants / letters else 0.0 end as cr from m),
 c as (select *, least(1.0, (h - 3.0) * 0.3 + (cr - 0.5) * 0.5) as conf from f where h > 3.5 and cr > 0.7 and longest > 12)
 select event_id, 'dga' as category, case when conf > 0.7 then 'high' else 'medium' end as severity, round(conf, 6) as confidence, 'T1568.002' as mitre_id, domain as indicator,
 concat('Possible DGA domain detected (entropy=', printf('%.2f', h), ' consonant_ratio=', printf('%.2f', cr), ')') as description, '' as evidence from c"""))
def q_dga(spark, d):
    return _shape(net.dga(net.dns_queries(_logs(spark, d))))


@query("dns_tunnel", with_views(["sec_log"], f"""{_NAMES_SQL}, c as (select *, case when labels > 7 then 0.9 when longest > 50 then 0.8 else 0.5 end as conf from m where labels > 5 or longest > 40 or length(domain) > 80)
 select event_id, 'dns_tunnel' as category, case when conf > 0.7 then 'high' else 'medium' end as severity, cast(conf as double) as confidence, 'T1071.004' as mitre_id, domain as indicator,
 concat('Possible DNS tunneling (labels=', labels, ' max_label_len=', longest, ' total_len=', length(domain), ')') as description, '' as evidence from c"""))
def q_dns_tunnel(spark, d):
    return _shape(net.dns_tunnel(net.dns_queries(_logs(spark, d))))


@query("suspicious_tld", with_views(["sec_log"], f"""{_NAMES_SQL}, c as (select *, list_extract(string_split(lower(domain), '.'), -1) as tld from m)
 select event_id, 'dga' as category, 'medium' as severity, cast(0.5 as double) as confidence, 'T1568.002' as mitre_id, domain as indicator, concat('Suspicious TLD with high entropy: .', tld) as description, '' as evidence
 from c where h > 3.0 and tld in ({', '.join(quote(t) for t in SUSPICIOUS_TLDS)})"""))
def q_suspicious_tld(spark, d):
    return _shape(net.suspicious_tld(net.dns_queries(_logs(spark, d))))


def _found(pattern: str, group: int) -> str:
    return f"unnest(regexp_extract_all(raw_log, {quote(pattern)}, {group}))"


@query("http_methods", with_views(["sec_log"], f"""select event_id, 'proto_anomaly' as category, 'medium' as severity, cast(0.6 as double) as confidence, 'T1190' as mitre_id, m as indicator, concat('Unusual HTTP method: ', m) as description, w as evidence
 from (select event_id, {_found(net.HTTP_METHOD_PATTERN, 1)} as m, {_found(net.HTTP_METHOD_PATTERN, 0)} as w from sec_log)"""))
def q_http_methods(spark, d):
    return _shape(net.http_methods(_logs(spark, d)))


@query("tool_user_agents", with_views(["sec_log"], f"""select event_id, 'proto_anomaly' as category, 'medium' as severity, cast(0.5 as double) as confidence, 'T1071.001' as mitre_id, a as indicator, concat('Suspicious user agent in logs: ', a) as description, '' as evidence
 from (select event_id, {_found(net.TOOL_AGENT_PATTERN, 1)} as a from sec_log)"""))
def q_tool_user_agents(spark, d):
    return _shape(net.tool_user_agents(_logs(spark, d)))


@query("base64_params", with_views(["sec_log"], f"""select event_id, 'proto_anomaly' as category, 'high' as severity, cast(0.65 as double) as confidence, 'T1132.001' as mitre_id, p as indicator,
 'Base64-encoded data in URL parameter (possible data encoding)' as description, '' as evidence from (select event_id, {_found(net.BASE64_PARAM_PATTERN, 0)} as p from sec_log)"""))
def q_base64_params(spark, d):
    return _shape(net.base64_params(_logs(spark, d)))


@query("long_urls", with_views(["sec_log"], f"""select event_id, 'proto_anomaly' as category, 'high' as severity, cast(0.7 as double) as confidence, 'T1190' as mitre_id, u as indicator,
 concat('Unusually long URL (', length(u), ' chars) -- possible injection attempt') as description, '' as evidence from (select event_id, {_found(net.LONG_URL_PATTERN, 2)} as u from sec_log)"""))
def q_long_urls(spark, d):
    return _shape(net.long_urls(_logs(spark, d)))


@query("connection_anomalies", with_views(["conn_a"], """s as (select device_id, count(*) as total, count(*) filter (state in ('SYN_SENT', 'SYN_RECV')) / count(*) as hr, count(*) filter (starts_with(state, 'CLOSE')) / count(*) as rr from conn_a group by device_id)
 select device_id, 'syn_flood' as category, 'high' as severity, round(least(1.0, hr), 6) as confidence, 'T1498.001' as mitre_id, concat('High half-open connection ratio (', printf('%.1f', hr * 100), '%)') as description from s where total > 100 and hr > 0.5
 union all select device_id, 'proto_anomaly', 'medium', round(least(1.0, rr), 6), 'T1046', concat('High RST ratio (', printf('%.1f', rr * 100), '%) -- possible scan activity') from s where total > 50 and rr > 0.4"""))
def q_connection_anomalies(spark, d):
    rows = net.connection_anomalies(view(spark, d, "conn_a"))
    return rows.withColumn("confidence", F.round("confidence", 6)).select("device_id", "category", "severity", "confidence", "mitre_id", "description")


@query("payload_entropy", with_views(["payloads"], f"""b as materialized (select event_id, run, from_base64(run) as body from (select event_id, {_found(net.BASE64_RUN_PATTERN, 0)} as run from payloads)),
 f as (select event_id, any_value(run) as run, any_value(octet_length(body)) as size, -sum(p * log2(p)) as h from (select event_id, run, body, count(*) / sum(count(*)) over (partition by event_id, run) as p from
  (select event_id, run, body, hex(body) as hx, unnest([substr(hex(body), i, 2) for i in range(1, 2 * octet_length(body), 2)]) as byte from b) group by event_id, run, body, byte) group by event_id, run),
 c as (select *, h > 7.2 and size > 128 as enc from f where size >= 32 and ((h > 7.2 and size > 128) or (h > 6.5 and size > 256)))
 select event_id, 'entropy' as category, case when enc then 'high' else 'medium' end as severity, round(least(1.0, case when enc then (h - 6.5) * 0.5 else (h - 6.0) * 0.3 end), 6) as confidence,
 case when enc then 'T1573.001' else 'T1132' end as mitre_id, run as indicator,
 case when enc then concat('High payload entropy (', printf('%.2f', h), ' bits/byte, ', size, ' bytes) -- possible encrypted C2 channel') else concat('Elevated payload entropy (', printf('%.2f', h), ' bits/byte) -- possible data encoding') end as description,
 run as evidence from c"""))
def q_payload_entropy(spark, d):
    return _shape(net.payload_entropy(_logs(spark, d, "payloads")))


# No base64 run of these logs decodes to high-entropy bytes, so the payload part stays empty.
@query("inspect_logs", " union all ".join(f"select * from ({ORACLES[n]})" for n in [
    "dga", "dns_tunnel", "suspicious_tld", "http_methods", "tool_user_agents", "base64_params", "long_urls"]))
def inspect_logs(spark, d):
    return _shape(net.inspect_logs(_logs(spark, d)))


# ----- Sigma -----

RULES = [
    SigmaRule("r1", "Failed ssh", {"selection": [Match("Message", ("failed password", "invalid user"), "contains")]},
              lambda s: s["selection"], level="high", tags=("attack.t1110", "attack.credential_access"), description="ssh"),
    SigmaRule("r2", "Kernel noise", {"sel_a": [Match("Message", ("kernel:",), "startswith")], "sel_b": [Match("Message", ("80",), "endswith")]},
              lambda s: s.all_of("sel_*"), level="", tags=("attack.T1499.001",)),
    SigmaRule("r3", "Tools", {"sel_a": [Match("Message", (r"nmap|mimikatz", r"hash\s+dump"), "re", all_values=True)],
                              "sel_b": [Match("Message", ("TRACE",), "contains", cased=True)], "filter": [Match("User", ("root",))]},
              lambda s: s.one_of("sel_*") & ~s["filter"], level="critical", category="log"),
    SigmaRule("r4", "Busy host", {"selection": [Match("CpuPct", ("9",), "startswith"), Match("NetDeltaIn", ("0",))]}, level="low"),
    SigmaRule("r5", "Absent field", {"selection": [Match("Nope", ("",), "endswith"), Match("EventCount", ("0", "1"))]},
              lambda s: s["selection"] & ~s.all_of("none*"), level="medium", product="telemetry"),
    SigmaRule("r6", "Other source", {"selection": [Match("Message", ("",), "contains")]}, category="process_creation"),
    SigmaRule("r7", "Switched off", {"selection": [Match("Message", ("",), "contains")]}, enabled=False),
]

_SIGMA_SQL = _EWMA.split(", g as (")[0].replace("from chunk)", "from sec_log)").replace("from feat f join chunk using", "from feat f join sec_log using")


def _telemetry(spark, d, name="sec_log"):
    logs = view(spark, d, name)
    rows = event_counts(telemetry_features(view(spark, d, "tel"), "event_id"), scan_rules(logs), on=["event_id"])
    return rows.join(logs.select("event_id", "raw_log"), "event_id")


def _hit(rule: SigmaRule, test: str, field: str, value: str) -> str:
    mitre = rule.mitre_id
    return (f"select event_id, {quote(rule.id)} as rule_id, {quote(rule.title)} as rule_title, {quote(rule.severity)} as severity, {quote(mitre)} as mitre_id, "
            f"{field} as matched_field, {value} as matched_value from x where {test}")


_LOW = "lower(raw_log)"
_R3A = f"(regexp_matches(raw_log, 'nmap|mimikatz', 'i') and regexp_matches(raw_log, 'hash\\s+dump', 'i'))"


@query("sigma_match", with_views(["tel", "sec_log"], f"{_SIGMA_SQL} " + " union all ".join([
    _hit(RULES[0], f"contains({_LOW}, 'failed password') or contains({_LOW}, 'invalid user')", "'Message'", "raw_log"),
    _hit(RULES[1], f"starts_with({_LOW}, 'kernel:') and ends_with({_LOW}, '80')", "'Message'", "raw_log"),
    _hit(RULES[2], f"{_R3A} or contains(raw_log, 'TRACE')", "'Message'", "raw_log"),
    _hit(RULES[3], "starts_with(cast(cast(trunc(cpu_pct) as bigint) as varchar), '9') and net_in_delta = 0", "'CpuPct'", "cast(cast(trunc(cpu_pct) as bigint) as varchar)"),
    _hit(RULES[4], "event_count in (0, 1)", "'Nope'", "''"),
])))
def q_sigma_match(spark, d):
    hits = sigma_match(sigma_telemetry_events(_telemetry(spark, d), keep=["event_id"]), RULES)
    return hits.select("event_id", "rule_id", "rule_title", "severity", "mitre_id", "matched_field", "matched_value")


@query("sigma_events", with_views(["proc_b"], """select 'process' as source, 'process_creation' as category, device_id, timestamp_ms, machine_ip, path as image, cmdline, '' as message from proc_b
 union all select 'syslog', 'app', 0, event_id, '1.1.1.1', '', '', concat('m ', cast(event_id as varchar)) from events"""))
def q_sigma_events(spark, d):
    processes = sigma_process_events(view(spark, d, "proc_b"))
    lines = table(spark, d, "events").selectExpr(
        "event_id as received_ms", "'app' as app_name", "'h' as hostname", "'1.1.1.1' as source_ip",
        "concat('m ', cast(event_id as string)) as message")
    events = sigma_events(processes, sigma_syslog_events(lines))
    get = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    return events.select("source", "category", "device_id", "timestamp_ms", "machine_ip", get("Image").alias("image"),
                         get("CommandLine").alias("cmdline"), get("Message").alias("message"))


# ----- anomaly -----

@query("beacon_score", with_views(["beacon"], f"""l as (select event_id, device_id, list(cast(interval_ms as double)) over (partition by device_id order by event_id rows between 63 preceding and current row) as b from beacon),
 s as (select *, len(b) as n, list_avg(b) as m from l), v as (select *, list_sum([(x - m) * (x - m) for x in b]) as ss, list_sum([(b[i] - m) * (b[i - 1] - m) for i in range(2, len(b) + 1)]) as pp from s where n >= 12),
 f as (select *, sqrt(ss / n) / m as cov, case when ss > 1e-9 then pp / ss else 0.0 end as ac from v),
 c as (select *, least(1.0, (0.15 - cov) / 0.15 * 0.5 + ac * 0.5) as conf from f where m >= 1 and cov < 0.15 and ac >= 0.35)
 select event_id, device_id, n as samples, {stable('1.0 - cov')} as score, {stable('conf')} as confidence, case when conf >= 0.75 then 'high' else 'medium' end as severity, {stable('m / 1000.0')} as beacon_period_s, {stable('cov')} as beacon_jitter, {stable('ac')} as autocorr from c"""))
def q_beacon_score(spark, d):
    from watchloom.plans.catalog_telemetry import _stable

    rows = beacon_score(view(spark, d, "beacon"), order=["event_id"], segment=100, limits=BeaconLimits())
    return rows.select("event_id", "device_id", "samples", _stable("score"), _stable("confidence"), "severity",
                       _stable("beacon_period_s"), _stable("beacon_jitter"), _stable("autocorr"))


@query("anomaly_features", with_views(["tel", "sec_log"], f"""{_SIGMA_SQL} select event_id, round(cpu_pct, 6) as f0, round(ram_pct, 6) as f1, cast(net_in_delta as double) as f2, cast(net_out_delta as double) as f3, cast(event_count as double) as f4,
 cast(auth_failures as double) as f5, cast(interval_ms as double) as f6 from x where seq > 1"""))
def q_anomaly_features(spark, d):
    rows = anomaly_features(_telemetry(spark, d))
    return rows.select("event_id", *[F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(7)])


@query("forest_train_score")
def forest_train_score(spark, d):
    # Counted, drawn from and scored.
    rows = cut(anomaly_features(_telemetry(spark, d)).select("event_id", "device_id", "timestamp_ms", "machine_ip", "features"))
    found = forest_findings(score_forest(rows, train_forest(rows)), threshold=0.55)
    return found.select("event_id", "device_id", "score", "confidence", "severity", "mitre_id", "mitre_tactic", "description", "evidence")


@query("observe")
def q_observe(spark, d):
    return observe(_telemetry(spark, d))


# Draws: each tree's affine map of a digest of the row, the hex digits read by hand.
def _hex(text: str, first: int, digits: int) -> str:
    return " + ".join(f"(strpos('0123456789abcdef', substr({text}, {first + i}, 1)) - 1) * {16 ** (digits - 1 - i)}" for i in range(digits))


_DRAWS = f"""rows as (select event_id, {{ts}} as timestamp_ms, md5(concat({{ts}}, ':', event_id)) as d from {{source}}),
 maps as (select t, md5(concat('7:', t)) as d from range(16) r(t)),
 drawn as (select t as tree_id, event_id, ((({_hex('rows.d', 1, 8)}) * (({_hex('maps.d', 1, 7)}) + 1) + {_hex('maps.d', 8, 7)}) % 2147483647) as h, timestamp_ms from rows cross join maps)"""


@query("forest_draws", with_views(["tel"], _DRAWS.format(ts="timestamp_ms", source="tel") + """
 select cast(tree_id as int) as tree_id, event_id, cast(place as int) as place from (select *, row_number() over (partition by tree_id order by h, timestamp_ms, event_id) as place from drawn) where place <= 64"""))
def forest_draws(spark, d):
    rows = view(spark, d, "tel").select("timestamp_ms", "event_id", F.array(F.lit(0.0)).alias("features"))
    return tree_samples(rows, 16, 64, 7).select("tree_id", "event_id", F.col("_place").alias("place"))


#: Eight full trees of four levels, by a rule that both sides write down: the normal of inner node n of tree t in dimension j.
_NORMAL = "((t * 7 + n * 3 + j * 5) % 11 - 5)"


@query("forest_fixed", with_views(["tel", "sec_log"], f"""{_SIGMA_SQL}, f as (select event_id, [cpu_pct, ram_pct, net_in_delta, net_out_delta, event_count, auth_failures, interval_ms] as v from x where seq > 1),
 walk as (select event_id, v, t, 0 as n, 0 as depth from f cross join range(8) r(t) union all
  select event_id, v, t, case when list_sum([v[j + 1] * {_NORMAL} for j in range(0, 7)]) < (t + n) * 1000 - 3000 then 2 * n + 1 else 2 * n + 2 end, depth + 1 from walk where n < 7),
 ends as (select event_id, t, max(n) as n from walk group by event_id, t),
 sized as (select *, (t + n) % 9 + 1 as size from ends),
 paths as (select event_id, avg(3 + case when size <= 1 then 0 else 2 * (ln(size - 1) + 0.5772156649) - 2.0 * (size - 1) / size end) as p from sized group by event_id)
 select event_id, {stable('pow(2, -p / (2 * (ln(255) + 0.5772156649) - 2.0 * 255 / 256))')} as score from paths""", recursive=True))
def forest_fixed(spark, d):
    from watchloom.plans.catalog_telemetry import _stable

    nodes = spark.range(8).selectExpr("cast(id as int) as t", "explode(sequence(0, 14)) as n").selectExpr(
        "t as tree_id", "n as node_id", "if(n < 7, 2 * n + 1, -1) as left_id", "if(n < 7, 2 * n + 2, -1) as right_id", "(t + n) % 9 + 1 as rows",
        "cast((t + n) * 1000 - 3000 as double) as intercept", f"if(n < 7, transform(sequence(0, 6), j -> cast({_NORMAL} as double)), array()) as normal")
    scored = score_forest(anomaly_features(_telemetry(spark, d)).select("event_id", "features"), nodes)
    return scored.select("event_id", _stable("score"))


_POOLS = """b as (select timestamp_ms // 86400000 as block, row_number() over (order by timestamp_ms, event_id) - 1 as rank, event_id from {source}),
 starts as (select block, min(rank) as before from b group by block)
 select s.block, cast(count(*) as bigint) as pool, min(b.rank) as first_rank, min(b.event_id) as least_id, cast(sum(b.event_id) as bigint) as ids from starts s join b on b.rank < s.before and b.rank >= s.before - 300 where s.before >= 128 group by s.block"""


@query("observe_pools", with_views(["tel"], _POOLS.format(source="tel")))
def observe_pools(spark, d):
    rows = view(spark, d, "tel").select("timestamp_ms", "event_id", F.array(F.lit(0.0)).alias("features"))
    blocks, pools = past_pools(rows, 86_400_000, window=300)
    sizes = pools.groupBy("block").agg(F.count("*").alias("pool"), F.min("event_id").alias("least_id"), F.sum("event_id").alias("ids"))
    return sizes.join(blocks, "block").select("block", "pool", (F.col("before") - F.col("pool")).alias("first_rank"), "least_id", "ids")
