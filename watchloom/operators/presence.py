"""Distinct devices in any span of time from sketches that are kept per time bucket.

A bucket's sketch is a few kilobytes whatever the number of reports, and sketches of buckets add up, so a question
about any window reads the sketches and not the telemetry. The same aggregate runs on a stream, where a bucket is
written once the watermark has passed its end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Log2 of a sketch's registers.
REGISTERS = 12


def error_bound(registers: int = REGISTERS, sigmas: float = 3.0) -> float:
    """The relative error that a count exceeds in less than three of a thousand cases (three sigmas)."""
    return sigmas * 1.04 / math.sqrt(2**registers)


def device_sketches(telemetry: DataFrame, bucket_s: int = 300, late: str | None = None, registers: int = REGISTERS) -> DataFrame:
    """bucket_end_ms and a sketch of the devices heard in (end - bucket, end], for each bucket with a report.

    ``late`` sets the watermark of a stream; its reports may come that much behind the newest one. Reports without a
    device count for none.
    """
    # A bucket includes its end, so reports are placed one millisecond earlier.
    placed = telemetry.select("device_id", F.timestamp_millis(F.col("timestamp_ms") - 1).alias("_at"))
    if late is not None:
        placed = placed.withWatermark("_at", late)
    per = placed.groupBy(F.window("_at", f"{bucket_s} seconds").alias("_w")).agg(F.hll_sketch_agg("device_id", F.lit(registers)).alias("sketch"))
    return per.select(F.unix_millis("_w.end").alias("bucket_end_ms"), "sketch")


def _buckets(window_s: int, bucket_s: int) -> int:
    if window_s < bucket_s or window_s % bucket_s:
        raise ValueError("a window is one or more whole buckets")
    return window_s // bucket_s


def _estimate(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0)).cast("long")


def online_from_sketches(sketches: DataFrame, as_of_ms: int, window_s: int, bucket_s: int = 300) -> DataFrame:
    """About how many devices were heard in the window that ends at ``as_of_ms``, the end of a bucket."""
    _buckets(window_s, bucket_s)
    if as_of_ms % (bucket_s * 1000):
        raise ValueError("as_of_ms isn't the end of a bucket")
    inside = sketches.filter((F.col("bucket_end_ms") > as_of_ms - window_s * 1000) & (F.col("bucket_end_ms") <= as_of_ms))
    return inside.agg(_estimate("sketch").alias("devices_online"))


def online_trend(sketches: DataFrame, window_s: int, bucket_s: int = 300) -> DataFrame:
    """For the end of every bucket that a device was heard in or less than a window before: about how many devices.

    Each sketch goes to the window_s / bucket_s ends whose windows hold it.
    """
    n, step = _buckets(window_s, bucket_s), bucket_s * 1000
    ends = F.explode(F.sequence(F.col("bucket_end_ms"), F.col("bucket_end_ms") + (n - 1) * step, F.lit(step)))
    return sketches.select("sketch", ends.alias("end_ms")).groupBy("end_ms").agg(_estimate("sketch").alias("devices_online"))
