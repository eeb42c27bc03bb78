"""Telemetry: late-data drop, features, adaptive baselines."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchloom.functions.columns import div_floor
from watchloom.operators.sequence import sequence, with_predecessors

DAY_MS = 86_400_000


def monotonic(
    df: DataFrame,
    arrival: str,
    *,
    key: str = "device_id",
    ts: str = "timestamp_ms",
    segment: int = 1_000_000,
) -> DataFrame:
    """Drop reports that are not newer than every earlier arrival of their device.

    ``segment`` is the width of an arrival segment: maxima are taken inside
    segments and carried across them, so a busy device is spread out.
    """
    cut = df.withColumn("_seg", div_floor(F.col(arrival), segment))
    tops = cut.groupBy(key, "_seg").agg(F.max(ts).alias("_top"))
    across = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(key, "_seg", F.max("_top").over(across).alias("_carried"))
    within = Window.partitionBy(key, "_seg").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.greatest(F.col("_carried"), F.max(ts).over(within))
    return (
        cut.join(carried, [key, "_seg"])
        .withColumn("_newest", newest)
        .filter(F.col("_newest").isNull() | (F.col(ts) > F.col("_newest")))
        .drop("_seg", "_carried", "_newest")
    )


_COUNTERS = [
    "timestamp_ms", "cpu_user_ticks", "cpu_kernel_ticks", "cpu_idle_ticks", "net_bytes_in", "net_bytes_out",
]


def telemetry_features(df: DataFrame, tiebreak: str | None = None, segment_ms: int = DAY_MS) -> DataFrame:
    """Usage and deltas against the previous report of the device.

    The first report has no deltas and cpu 0; a counter that wrapped counts 0.
    """
    order = ["timestamp_ms"] + ([tiebreak] if tiebreak else [])
    rows = sequence(df, ["device_id"], order, segment=segment_ms, carry=_COUNTERS)
    prev = lambda c: F.col(f"prev.{c}")
    ticks = lambda p: p("cpu_user_ticks") + p("cpu_kernel_ticks") + p("cpu_idle_ticks")
    d_total = ticks(F.col) - ticks(prev)
    d_idle = F.col("cpu_idle_ticks") - prev("cpu_idle_ticks")
    percent = lambda part, whole: F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole)).otherwise(0.0)
    delta = lambda c: F.greatest(F.lit(0).cast("long"), F.col(c) - prev(c))
    return rows.withColumns({
        "cpu_pct": F.when(d_total > 0, 100.0 * (1.0 - d_idle / d_total)).otherwise(0.0),
        "ram_pct": F.when(F.col("ram_total_bytes") > 0,
                          100.0 * (1.0 - F.col("ram_avail_bytes") / F.col("ram_total_bytes"))).otherwise(0.0),
        "disk_free_pct": percent("disk_free_bytes", "disk_total_bytes"),
        "net_in_delta": delta_or_null(delta("net_bytes_in")),
        "net_out_delta": delta_or_null(delta("net_bytes_out")),
        "interval_ms": F.col("timestamp_ms") - prev("timestamp_ms"),
    }).drop("prev")


def delta_or_null(value: Column) -> Column:
    """``greatest`` skips nulls, so the first report must be masked."""
    return F.when(F.col("prev").isNotNull(), value)


def event_counts(
    features: DataFrame, security_events: DataFrame, on: Sequence[str] = ("device_id", "timestamp_ms")
) -> DataFrame:
    """Attach the number of security events, authentication failures and distinct users that failed to each report."""
    failure = F.col("category") == "auth_failure"
    user = F.regexp_extract("matched_text", r"(?i)for\s+(\S+)\s+from", 1)
    counts = security_events.groupBy(*on).agg(
        F.count("*").alias("event_count"),
        F.count_if(failure).alias("auth_failures"),
        F.count_distinct(F.when(failure & (user != ""), user)).alias("auth_users"),
    )
    return features.join(counts, list(on), "left").fillna(0, ["event_count", "auth_failures", "auth_users"])


@dataclass(frozen=True)
class Metric:
    """A tracked series; ``skip`` leading reports of a device carry no value for it."""

    name: str
    value: Column
    skip: int = 1


def default_metrics() -> list[Metric]:
    d_in, d_out = F.col("net_in_delta").cast("double"), F.col("net_out_delta").cast("double")
    return [
        Metric("net_in", d_in),
        Metric("net_out", d_out),
        Metric("in_out_ratio", F.when(d_out > 1, d_in / d_out).otherwise(0.0)),
        Metric("cpu", F.col("cpu_pct")),
        Metric("ram", F.col("ram_pct"), skip=0),
        Metric("auth_failures", F.col("auth_failures").cast("double")),
        Metric("events", F.col("event_count").cast("double")),
        Metric("interval", F.greatest(F.lit(1.0), F.col("interval_ms").cast("double"))),
    ]


def memory_rows(alpha: float) -> int:
    """Rows after which an older value weighs less than one part in 10^18."""
    return math.ceil(18 * math.log(10) / -math.log(1 - alpha))


def ewma_baseline(
    df: DataFrame,
    metrics: Sequence[Metric] | None = None,
    *,
    key: str = "device_id",
    seq: str = "seq",
    alpha: float = 0.05,
    warmup: int = 20,
) -> DataFrame:
    """Exponentially weighted mean, deviation and z-score of every metric at every report.

    The recurrence forgets: beyond ``memory_rows`` the past is below double
    precision. Numbered rows are therefore cut into blocks of that length, each
    preceded by a copy of the block before it, and the recurrence becomes two
    running sums with geometric weights inside ``(key, block)`` - no device is
    ever processed by one task, and no Python is involved.

    Adds ``<m>_n``, ``<m>_ready``, ``<m>_mean``, ``<m>_sd`` and ``<m>_z``; the
    z-score is taken after the value was absorbed.
    """
    metrics = list(metrics) if metrics is not None else default_metrics()
    block_rows = memory_rows(alpha)
    keep = 1.0 - alpha
    rows = with_predecessors(
        df.withColumns({f"_x_{m.name}": m.value for m in metrics}), block_rows, block_rows, seq
    )
    # Position from the start of the copied block; 0 … 2·block_rows - 1.
    pos = (F.col(seq) - 1 - F.greatest(F.lit(0).cast("long"), F.col("block") - 1) * block_rows).cast("double")
    rows = rows.withColumn("_up", F.pow(F.lit(keep), -pos)).withColumn("_down", F.pow(F.lit(keep), pos))

    by_block = Window.partitionBy(key, "block").orderBy(seq)
    running = by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def n(m: Metric) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.col(seq) - m.skip)

    # Every block is measured from its first value: a constant series is then
    # exactly constant, and the first value needs no weight of its own.
    rows = rows.withColumns({
        f"_c_{m.name}": F.first(F.when(n(m) >= 1, F.col(f"_x_{m.name}")), ignorenulls=True).over(running)
        for m in metrics
    })

    def centred(m: Metric) -> Column:
        return F.coalesce(F.col(f"_x_{m.name}") - F.col(f"_c_{m.name}"), F.lit(0.0))

    rows = rows.withColumns({
        f"_m_{m.name}": alpha * F.col("_down") * F.sum(centred(m) * F.col("_up")).over(running) for m in metrics
    })
    rows = rows.withColumns({
        f"_d_{m.name}": centred(m) - F.coalesce(F.lag(f"_m_{m.name}").over(by_block), F.lit(0.0)) for m in metrics
    })
    spreads = {}
    for m in metrics:
        square = F.col(f"_d_{m.name}") * F.col(f"_d_{m.name}")
        variance = alpha * keep * F.col("_down") * F.sum(square * F.col("_up")).over(running)
        spreads[f"{m.name}_sd"] = F.sqrt(F.greatest(F.lit(0.0), variance))
        spreads[f"{m.name}_mean"] = F.coalesce(F.col(f"_c_{m.name}") + F.col(f"_m_{m.name}"), F.lit(0.0))
    rows = rows.withColumns(spreads).filter("own")

    scores = {}
    for m in metrics:
        ready = n(m) >= warmup
        sd, mean = F.col(f"{m.name}_sd"), F.col(f"{m.name}_mean")
        scores[f"{m.name}_n"] = n(m)
        scores[f"{m.name}_ready"] = ready
        scores[f"{m.name}_z"] = F.when(ready & (sd >= 1e-9), (F.col(f"_x_{m.name}") - mean) / sd).otherwise(0.0)
    rows = rows.withColumns(scores)
    scratch = [f"_{part}_{m.name}" for m in metrics for part in "xcmd"]
    return rows.drop("block", "own", "_up", "_down", *scratch)


def baseline_snapshot(
    df: DataFrame,
    metrics: Sequence[Metric] | None = None,
    *,
    key: str = "device_id",
    seq: str = "seq",
    alpha: float = 0.05,
    warmup: int = 20,
) -> DataFrame:
    """The current baseline of every device.

    Only the last blocks of a device can matter, so older rows are filtered
    away before anything is windowed.
    """
    metrics = list(metrics) if metrics is not None else default_metrics()
    newest = df.groupBy(key).agg(F.max(seq).alias("_newest"))
    first_block = div_floor(F.col("_newest") - 1, memory_rows(alpha)) - 1
    recent = df.join(newest, key).filter(F.col(seq) > first_block * memory_rows(alpha))
    rows = ewma_baseline(recent, metrics, key=key, seq=seq, alpha=alpha, warmup=warmup)
    stats = [f"{m.name}_{s}" for m in metrics for s in ("n", "ready", "mean", "sd")]
    return rows.filter(F.col(seq) == F.col("_newest")).select(key, F.col(seq).alias("reports"), *stats)
