"""Hand-kept text files: rules, indicator feeds and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchloom.functions.columns import held
from watchloom.functions.network import ioc_type_alias
from watchloom.operators.intel import latest_entries
from watchloom.rules.detection import BUILTIN_RULES

# Severities a rule may have.
SEVERITIES = ["low", "medium", "high", "critical"]


def _ordered_lines(spark: SparkSession, path: str, name: Column) -> DataFrame:
    """Lines with their file and a key that sorts as they stand in it.

    Large files are split, so there is no line number; a split's offset and
    the running id inside the split order the lines just as well.
    """
    key = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return spark.read.text(path).select(name.alias("file"), key.alias("line_no"), F.col("value").alias("line"))


def _field(parts: Column, i: int) -> Column:
    return F.trim(F.translate(F.coalesce(F.get(parts, i), F.lit("")), "\t", " "))


def parse_rules(lines: DataFrame) -> DataFrame:
    """Valid user rules of (line_no, line); the pattern keeps its own bars."""
    line = F.trim(F.translate("line", "\t\r", "  "))
    parts = F.split(line, r"\|", 4)
    rows = lines.filter((line != "") & ~line.startswith("#")).filter(F.size(parts) >= 4)
    rows = rows.select("line_no", *[_field(parts, i).alias(n) for i, n in enumerate(["name", "severity", "category", "pattern"])])
    return rows.filter(
        (F.col("name") != "") & (F.col("pattern") != "") & F.col("severity").isin(*SEVERITIES)
    )


def load_rules(spark: SparkSession, path: str | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Built-in rules plus the file's; a later rule of the same name replaces an earlier one."""
    builtin = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.struct(F.lit(-1).cast("bigint").alias("block"), F.lit(i).cast("bigint").alias("id")).alias("line_no"),
                 F.lit(r.name).alias("name"),
                 F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"),
                 F.lit(r.pattern).alias("pattern"), F.lit(True).alias("is_builtin"))
        for i, r in enumerate(BUILTIN_RULES)
    ])))
    if lines is None and path is None:
        return builtin.drop("line_no")
    if lines is None:
        lines = _ordered_lines(spark, path, F.lit("rules"))
    elif lines.schema["line_no"].dataType.typeName() != "struct":
        place = F.struct(F.lit(0).cast("bigint").alias("block"), F.col("line_no").cast("bigint").alias("id"))
        lines = lines.withColumn("line_no", place)
    user = parse_rules(lines).withColumn("is_builtin", F.lit(False)).select(*builtin.columns)
    latest = F.max_by(F.struct("severity", "category", "pattern", "is_builtin"), "line_no")
    return builtin.unionByName(user).groupBy("name").agg(latest.alias("_r")).select("name", "_r.*")


def parse_feed_lines(lines: DataFrame) -> DataFrame:
    """Feed entries of (feed_source, line_no, line): type|value|severity|description|mitre_id|tags."""
    line = F.trim(F.translate(F.split_part("line", F.lit("#"), F.lit(1)), "\t\r", "  "))
    # Split and read once, however many fields and filters use them.
    rows = held(lines.select("feed_source", "line_no", "line"), _parts=F.split(line, r"\|")).filter(F.size("_parts") >= 2)
    text = lambda i: _field(F.col("_parts"), i)
    read = held(rows, type=ioc_type_alias(text(0)), value=F.lower(text(1)), _severity=text(2)).filter("value <> ''")
    return read.select(
        "type", "value", F.when(F.col("_severity") == "", "high").otherwise(F.col("_severity")).alias("severity"), "feed_source",
        text(3).alias("description"), text(4).alias("mitre_id"), text(5).alias("tags"), "line_no",
    )


def load_ioc_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """All ``.csv`` feeds of a folder; of equal (type, value) the last loaded entry stays."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.csv$", "")
    lines = _ordered_lines(spark, f"{folder.rstrip('/')}/*.[cC][sS][vV]", stem).withColumnRenamed("file", "feed_source")
    return latest_entries(parse_feed_lines(lines)).withColumn("load_order", F.struct("feed_source", "line_no"))


def write_feed_table(feed: DataFrame, path: str) -> None:
    """Keep a parsed feed as Parquet by type, so a lookup reads only its type."""
    feed.write.mode("overwrite").partitionBy("type").parquet(path)


def parse_audit_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Audit rows of ``ts|user|tenant|action|ok/fail|ip|detail`` lines; the detail keeps its own bars."""
    parts = F.split(column, r"\|", 7)
    text = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    return lines.filter(F.size(parts) >= 6).select(
        text(0).try_cast("bigint").alias("timestamp_ms"), text(1).alias("username"), text(2).alias("tenant_id"),
        text(3).alias("action"), (text(4) == "ok").alias("success"), text(5).alias("source_ip"), text(6).alias("detail"),
    ).filter("timestamp_ms is not null")


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_audit_log(spark.read.text(path))
