"""Telemetry files, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchloom.schemas import TELEMETRY


def read_telemetry(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(TELEMETRY).format(fmt).load(path)
