"""Detection tables and the legacy CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import fixed
from watchloom.schemas import TABLES


def shape_table(df: DataFrame, name: str, received_at: Column | None = None, max_chars: int | None = None) -> DataFrame:
    """Columns and types of a stored table, stamped with ``received_at``; texts are whole unless ``max_chars`` cuts them."""
    columns = []
    for field in TABLES[name].fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if max_chars is not None and field.dataType.typeName() == "string":
            value = F.left(value, F.lit(max_chars))
        columns.append(value.alias(field.name))
    stamp = received_at if received_at is not None else F.current_timestamp()
    return df.select(*columns, stamp.alias("received_at"))


def write_table(df: DataFrame, name: str, root: str, received_at: Column | None = None, cluster: bool = True,
                batch: int | None = None) -> None:
    """Append to a table under ``root``, partitioned by event date.

    ``cluster`` sorts rows by device before writing, so that Parquet statistics can skip files; the number of
    writers follows the size of the data, also of one date or device. With ``batch`` (a micro-batch's number) the
    rows replace that batch's, so a batch that is tried again is not stored twice; such a table is partitioned by
    batch and date.
    """
    shaped = shape_table(df, name, received_at)
    at = "timestamp_ms" if "timestamp_ms" in shaped.columns else "first_seen_ms"
    shaped = shaped.withColumn("date", F.to_date(F.timestamp_millis(at)))
    if cluster:
        shaped = shaped.hint("rebalance", F.col("date")).sortWithinPartitions("date", *[c for c in ("device_id", at) if c in shaped.columns])
    path = f"{root.rstrip('/')}/{name}"
    if batch is None:
        shaped.write.mode("append").partitionBy("date").parquet(path)
    else:
        shaped.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(f"{path}/batch={batch}")


def telemetry_csv(features: DataFrame) -> DataFrame:
    """timestamp, device, cpu with one decimal, failed logins - as text columns."""
    return features.select(
        F.col("timestamp_ms").cast("string").alias("ts"), F.col("device_id").cast("string").alias("device"),
        fixed(F.col("cpu_pct"), 1).alias("cpu"), F.col("auth_failures").cast("string").alias("fails"),
    )


def write_telemetry_csv(features: DataFrame, path: str) -> None:
    telemetry_csv(features).write.mode("append").csv(path)
