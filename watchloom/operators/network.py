"""Deep inspection of log text and connection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import explode_once, fixed, held
from watchloom.functions.text import (
    byte_entropy, consonant_ratio, label_count, max_label_len, shannon_entropy,
)
from watchloom.operators.diffs import per_report
from watchloom.rules.reference_lists import SUSPICIOUS_TLDS

# Extraction patterns.
DNS_QUERY_PATTERN = (
    r"(?i)(?:query|lookup|resolve[ds]?|DNS)[^a-z]*([a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)+)"
)
HTTP_METHOD_PATTERN = r"(?i)\b(CONNECT|TRACE|PROPFIND|MKCOL|COPY|MOVE|LOCK|UNLOCK|PATCH)\s+\S+\s+HTTP"
TOOL_AGENT_PATTERN = r"(?i)User-Agent:\s*(python-requests|curl|wget|powershell|certutil|bitsadmin|Go-http-client)"
BASE64_PARAM_PATTERN = r"[?&=][A-Za-z0-9+/]{40,}={0,2}"
LONG_URL_PATTERN = r"(?i)(GET|POST)\s+(\S{300,})\s+HTTP"
BASE64_RUN_PATTERN = r"[A-Za-z0-9+/]{64,}={0,2}"

_FINDING = ["category", "severity", "confidence", "mitre_id", "indicator", "description", "evidence"]


def _found(text: str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))


def _others(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if c != text]


def dns_queries(logs: DataFrame, text: str = "raw_log") -> DataFrame:
    """Names looked up in a log chunk, each once per chunk."""
    names = F.array_distinct(_found(text, DNS_QUERY_PATTERN, 1))
    return explode_once(logs, _others(logs, text), names, "domain")


def _finding(df: DataFrame, category: str, severity: Column | str, confidence: Column | float, mitre_id: str,
             indicator: Column | str, description: Column, evidence: Column | str = "") -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(
        *keep, F.lit(category).alias("category"), lit(severity).alias("severity"),
        lit(confidence).cast("double").alias("confidence"), F.lit(mitre_id).alias("mitre_id"),
        lit(indicator).alias("indicator"), description.alias("description"), lit(evidence).alias("evidence"),
    )


def _measured(names: DataFrame) -> DataFrame:
    """Lower-cased name and its statistics for names of at least four characters."""
    lower = F.lower("domain")
    return held(
        names.filter(F.length("domain") >= 4), _lower=lower, _labels=label_count(lower),
        _longest=max_label_len(lower), _cr=consonant_ratio(lower),
    ).withColumn("_h", shannon_entropy("_lower", skip="."))


def dga(names: DataFrame) -> DataFrame:
    """Names that look generated: high entropy, few vowels, a long label."""
    rows = _measured(names).filter("_h > 3.5 and _cr > 0.7 and _longest > 12")
    conf = F.least(F.lit(1.0), (F.col("_h") - 3.0) * 0.3 + (F.col("_cr") - 0.5) * 0.5)
    return _finding(
        rows, "dga", F.when(conf > 0.7, "high").otherwise("medium"), conf, "T1568.002", F.col("domain"),
        F.concat(F.lit("Possible DGA domain detected (entropy="), fixed(F.col("_h"), 2),
                 F.lit(" consonant_ratio="), fixed(F.col("_cr"), 2), F.lit(")")))


def dns_tunnel(names: DataFrame) -> DataFrame:
    """Names deep or long enough to carry data."""
    size = F.length("_lower")
    rows = _measured(names).filter((F.col("_labels") > 5) | (F.col("_longest") > 40) | (size > 80))
    conf = F.when(F.col("_labels") > 7, 0.9).when(F.col("_longest") > 50, 0.8).otherwise(0.5)
    return _finding(
        rows, "dns_tunnel", F.when(conf > 0.7, "high").otherwise("medium"), conf, "T1071.004", F.col("domain"),
        F.concat(F.lit("Possible DNS tunneling (labels="), F.col("_labels").cast("string"),
                 F.lit(" max_label_len="), F.col("_longest").cast("string"),
                 F.lit(" total_len="), size.cast("string"), F.lit(")")))


def suspicious_tld(names: DataFrame) -> DataFrame:
    tld = F.substring_index("_lower", ".", -1)
    rows = _measured(names).filter(F.col("_lower").contains(".") & tld.isin(*SUSPICIOUS_TLDS) & (F.col("_h") > 3.0))
    return _finding(rows, "dga", "medium", 0.5, "T1568.002", F.col("domain"),
                    F.concat(F.lit("Suspicious TLD with high entropy: ."), tld))


def http_methods(logs: DataFrame, text: str = "raw_log") -> DataFrame:
    """Unusual HTTP methods, one finding per occurrence."""
    both = F.arrays_zip(_found(text, HTTP_METHOD_PATTERN, 1).alias("method"),
                        _found(text, HTTP_METHOD_PATTERN, 0).alias("whole"))
    rows = explode_once(logs, _others(logs, text), both, "_m")
    method = F.col("_m.method")
    return _finding(rows, "proto_anomaly", "medium", 0.6, "T1190", method,
                    F.concat(F.lit("Unusual HTTP method: "), method), F.col("_m.whole"))


def tool_user_agents(logs: DataFrame, text: str = "raw_log") -> DataFrame:
    rows = explode_once(logs, _others(logs, text), _found(text, TOOL_AGENT_PATTERN, 1), "_a")
    return _finding(rows, "proto_anomaly", "medium", 0.5, "T1071.001", F.col("_a"),
                    F.concat(F.lit("Suspicious user agent in logs: "), F.col("_a")))


def base64_params(logs: DataFrame, text: str = "raw_log") -> DataFrame:
    rows = explode_once(logs, _others(logs, text), _found(text, BASE64_PARAM_PATTERN, 0), "_p")
    return _finding(rows, "proto_anomaly", "high", 0.65, "T1132.001", F.col("_p"),
                    F.lit("Base64-encoded data in URL parameter (possible data encoding)"))


def long_urls(logs: DataFrame, text: str = "raw_log") -> DataFrame:
    rows = explode_once(logs, _others(logs, text), _found(text, LONG_URL_PATTERN, 2), "_u")
    return _finding(rows, "proto_anomaly", "high", 0.7, "T1190", F.col("_u"),
                    F.concat(F.lit("Unusually long URL ("), F.length("_u").cast("string"),
                             F.lit(" chars) -- possible injection attempt")))


def connection_anomalies(connections: DataFrame, half_open: str = "SYN_SENT", reset: str = "CLOSE") -> DataFrame:
    """SYN floods and reset storms from the connection states of each report.

    The limits hold for the connections of one report: rows with timestamp_ms are judged by device and time.
    """
    keys = per_report(connections)
    stats = connections.groupBy(*keys).agg(
        F.count("*").alias("_total"),
        F.count_if(F.col("state").isin(half_open, "SYN_RECV")).alias("_half"),
        F.count_if(F.col("state").startswith(reset)).alias("_resets"),
    ).withColumns({"_hr": F.col("_half") / F.col("_total"), "_rr": F.col("_resets") / F.col("_total")})
    flood = _finding(
        stats.filter("_total > 100 and _hr > 0.5"), "syn_flood", "high", F.least(F.lit(1.0), F.col("_hr")),
        "T1498.001", "",
        F.concat(F.lit("High half-open connection ratio ("), fixed(F.col("_hr") * 100, 1), F.lit("%)")))
    storm = _finding(
        stats.filter("_total > 50 and _rr > 0.4"), "proto_anomaly", "medium", F.least(F.lit(1.0), F.col("_rr")),
        "T1046", "",
        F.concat(F.lit("High RST ratio ("), fixed(F.col("_rr") * 100, 1), F.lit("%) -- possible scan activity")))
    return flood.unionByName(storm)


def entropy_findings(payloads: DataFrame, payload: str = "payload", indicator: str | None = None) -> DataFrame:
    """Encrypted or encoded content in a binary column of at least 32 bytes."""
    rows = payloads.withColumn("_size", F.length(payload)).filter("_size >= 32")
    rows = rows.withColumn("_h", byte_entropy(payload))
    h, size = F.col("_h"), F.col("_size")
    encrypted = (h > 7.2) & (size > 128)
    rows = rows.filter(encrypted | ((h > 6.5) & (size > 256)))
    shown = F.col(indicator) if indicator else F.lit("")
    bits = F.concat(fixed(h, 2), F.lit(" bits/byte"))
    out = _finding(
        rows, "entropy", F.when(encrypted, "high").otherwise("medium"),
        F.least(F.lit(1.0), F.when(encrypted, (h - 6.5) * 0.5).otherwise((h - 6.0) * 0.3)), "", shown,
        F.when(encrypted, F.concat(F.lit("High payload entropy ("), bits, F.lit(", "), size.cast("string"),
                                   F.lit(" bytes) -- possible encrypted C2 channel")))
        .otherwise(F.concat(F.lit("Elevated payload entropy ("), bits, F.lit(") -- possible data encoding"))))
    return out.withColumn("mitre_id", F.when(F.col("severity") == "high", "T1573.001").otherwise("T1132"))


def payload_entropy(logs: DataFrame, text: str = "raw_log") -> DataFrame:
    """Entropy of the bytes behind long base64 runs in log text."""
    others = _others(logs, text)
    runs = explode_once(logs, others, _found(text, BASE64_RUN_PATTERN, 0), "_run")
    decoded = runs.withColumn("_payload", F.try_to_binary("_run", F.lit("base64"))).filter(F.col("_payload").isNotNull())
    found = entropy_findings(decoded.withColumn("indicator_text", F.col("_run")), "_payload", "indicator_text")
    return found.withColumn("evidence", F.col("indicator_text")).select(*others, *_FINDING)


def inspect_logs(logs: DataFrame, text: str = "raw_log") -> DataFrame:
    """All log findings of a chunk: names, protocol oddities and payloads."""
    names = dns_queries(logs, text)
    parts = [dga(names), dns_tunnel(names), suspicious_tld(names)]
    keep = _others(logs, text) + _FINDING
    out = None
    for part in parts + [f(logs, text) for f in (http_methods, tool_user_agents, base64_params, long_urls, payload_entropy)]:
        part = part.select(*keep)
        out = part if out is None else out.unionByName(part)
    return out
