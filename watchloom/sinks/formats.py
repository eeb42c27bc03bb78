"""Text formats for exporting detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import as_column, case_of
from watchloom.functions.severity import RANKS, cef_severity, syslog_severity

VENDOR, PRODUCT, VERSION = "watchloom", "watchloom", "1.0"


def _escape(value: Column | str) -> Column:
    """Escape bars, backslashes and equal signs."""
    return F.regexp_replace(F.coalesce(as_column(value).cast("string"), F.lit("")), r"([|\\=])", r"\\$1")


def _text(value: Column | str) -> Column:
    return F.coalesce(as_column(value).cast("string"), F.lit(""))


def _extra(df: DataFrame, separator: str, escape: bool) -> Column:
    """Key=value pairs of an optional map column ``extra``, in key order."""
    if "extra" not in df.columns:
        return F.lit("")
    value = (lambda v: _escape(v)) if escape else (lambda v: _text(v))
    pairs = F.transform(F.array_sort(F.map_entries("extra")),
                        lambda e: F.concat(F.lit(separator), e["key"], F.lit("="), value(e["value"])))
    return F.coalesce(F.array_join(pairs, ""), F.lit(""))


def format_cef(df: DataFrame, vendor: str = VENDOR, product: str = PRODUCT, version: str = VERSION) -> DataFrame:
    """Add ``line`` in Common Event Format."""
    line = F.concat(
        F.lit(f"CEF:0|{vendor}|{product}|{version}|"), _escape("sub_type"), F.lit("|"), _escape("description"),
        F.lit("|"), cef_severity("severity").cast("string"),
        F.lit("|deviceExternalId="), _text("device_id"), F.lit(" src="), _escape("machine_ip"),
        F.lit(" rt="), _text("timestamp_ms"), F.lit(" mitre="), _escape("mitre_id"), F.lit(" cat="), _escape("category"),
        _extra(df, " ", True),
    )
    return df.withColumn("line", line)


def format_leef(df: DataFrame, vendor: str = VENDOR, product: str = PRODUCT, version: str = VERSION) -> DataFrame:
    """Add ``line`` in LEEF 2.0: tab-separated pairs."""
    pairs = [("cat", "category"), ("severity", "severity"), ("devTime", "timestamp_ms"), ("mitre", "mitre_id"),
             ("src", "machine_ip"), ("devId", "device_id"), ("msg", "description")]
    body = F.concat_ws("\t", *[F.concat(F.lit(f"{k}="), _text(c)) for k, c in pairs])
    head = F.concat(F.lit(f"LEEF:2.0|{vendor}|{product}|{version}|"), _text("sub_type"), F.lit("|"))
    return df.withColumn("line", F.concat(head, body, _extra(df, "\t", False)))


def format_rfc5424(df: DataFrame, product: str = PRODUCT) -> DataFrame:
    """Add ``line`` as an RFC 5424 message of facility local0."""
    pri = (F.lit(16 * 8) + syslog_severity("severity")).cast("string")
    line = F.concat(
        F.lit("<"), pri, F.lit(f">1 - {product} "), _text("category"), F.lit(" "), _text("device_id"), F.lit(" "),
        _text("sub_type"), F.lit(' [ss@32473 mitre="'), _text("mitre_id"), F.lit('" severity="'), _text("severity"),
        F.lit('" ip="'), _text("machine_ip"), F.lit('"] '), _text("description"),
    )
    return df.withColumn("line", line)


def write_lines(df: DataFrame, path: str) -> None:
    df.select(F.col("line").alias("value")).write.mode("append").text(path)


BACKENDS = ["generic", "splunk_soar", "xsoar", "thehive"]


def soar_payload(df: DataFrame, backend: str = "generic", product: str = PRODUCT) -> DataFrame:
    """Add ``body``, the JSON message of a SOAR backend, to rows of ``soar_route``."""
    c = F.col
    rank = case_of("severity", RANKS, 0)
    ref = F.concat(F.lit("ss-"), _text("timestamp_ms"), F.lit("-"), _text("device_id"))
    if backend == "generic":
        fields = [c(n) for n in ["type", "severity", "title", "description", "mitre_id", "source", "device_id", "timestamp_ms"]]
        if "fields" in df.columns:
            # to_json leaves a null out, as an empty map should be.
            fields.append(F.when(F.size("fields") > 0, F.map_from_entries(F.array_sort(F.map_entries("fields")))).alias("fields"))
    elif backend == "splunk_soar":
        fields = [c("title").alias("name"), F.lit("events").alias("label"), c("severity"), c("description"),
                  ref.alias("source_data_identifier"), F.lit("amber").alias("sensitivity")]
    elif backend == "xsoar":
        label = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
        fields = [c("title").alias("name"), F.lit(product).alias("type"), rank.alias("severity"),
                  c("description").alias("details"),
                  F.array(label("mitre", _text("mitre_id")), label("device", _text("device_id"))).alias("labels")]
    elif backend == "thehive":
        fields = [c("title"), c("description"), F.lit("external").alias("type"), F.lit(product).alias("source"),
                  ref.alias("sourceRef"), rank.alias("severity"), F.lit(2).alias("tlp"),
                  F.array(_text("mitre_id"), F.lit(product)).alias("tags")]
    else:
        raise ValueError(f"unknown backend '{backend}'")
    return df.withColumn("body", F.to_json(F.struct(*fields)))
