"""Syslog lines, RFC 5424 and RFC 3164."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Header patterns.
PRI_PATTERN = r"^<\s*([+-]?\d+)[^>]*>"
RFC3164_PATTERN = r"^[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}\s+(\S+)\s+([^\s:\[]+)(?:\[[^\]]*\])?:?\s+(.*)$"
RFC5424_PATTERN = r"^\s*(\S+)\s*(\S*)\s*(\S*)\s*(\S*)\s*(\S*)(.*)$"
STRUCTURED_PATTERN = r"^(?:\[[^\]]*\])+ *(.*)$"


def parse_syslog(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add facility, severity, hostname, app_name, proc_id, msg_id and message."""
    c = F.col
    pri = F.regexp_extract(c(raw), PRI_PATTERN, 1).try_cast("int")
    rest = F.regexp_replace(c(raw), r"^<[^>]*>", "")
    modern = rest.startswith("1 ") & (F.length(rest) > 2)
    body = F.substr(rest, F.lit(3))
    new = lambda i: F.regexp_extract(body, RFC5424_PATTERN, i)
    old_ok = rest.rlike(RFC3164_PATTERN)
    old = lambda i: F.when(old_ok, F.regexp_extract(rest, RFC3164_PATTERN, i))
    tail = F.ltrim(new(6))
    message = (
        F.when(tail.startswith("-"), F.substr(tail, F.lit(3)))
        .when(tail.startswith("["), F.regexp_extract(tail, STRUCTURED_PATTERN, 1))
        .otherwise(tail)
    )
    pick = lambda i_new, i_old: F.when(modern, new(i_new)).otherwise(
        F.coalesce(old(i_old), F.lit("")) if i_old else F.lit(""))
    return df.withColumns({
        "facility": F.coalesce((pri / 8).cast("int"), F.lit(1)),
        "severity": F.coalesce(F.pmod(pri, F.lit(8)), F.lit(6)),
        "hostname": pick(2, 1),
        "app_name": pick(3, 2),
        "proc_id": pick(4, 0),
        "msg_id": pick(5, 0),
        "message": F.when(modern, message).otherwise(F.when(old_ok, F.regexp_extract(rest, RFC3164_PATTERN, 3)).otherwise(rest)),
    })
