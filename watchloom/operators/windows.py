"""Trailing time windows on a bounded number of rows.

Events are first counted per key and millisecond, then placed in time buckets
one window wide. A bucket holds at most two windows of milliseconds, whatever
the number of events, so neither a busy key nor a busy bucket grows a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchloom.functions.columns import div_floor


def per_millisecond(df: DataFrame, keys: Sequence[str], ts: str, sums: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys, ts).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def trailing_sums(
    counted: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    widths_ms: Column | int,
    include_now: bool = True,
) -> DataFrame:
    """Add ``<column>_win``: sums over the window that ends at each row.

    ``counted`` has one row per key and millisecond; ``widths_ms`` may differ
    by key. Every row adds its count when it comes and takes it back when it
    leaves the window, so the window is one running sum - a sliding frame would
    be summed anew for each row.
    """
    width = F.lit(widths_ms) if isinstance(widths_ms, int) else widths_ms
    bucket = div_floor(F.col(ts), F.col("_w"))
    moves = F.array(
        F.struct(F.col(ts).alias("_at"), F.lit(1).alias("_sign")),
        F.struct((F.col(ts) + F.col("_w") + 1).alias("_at"), F.lit(-1).alias("_sign")),
    )
    placed = (
        counted.withColumn("_w", width.cast("long"))
        .select("*", bucket.alias("_home"), F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
        .select("*", F.explode(moves).alias("_m")).select("*", "_m.*").drop("_m")
    )
    so_far = Window.partitionBy(*keys, "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    sums = {}
    for name in columns:
        value = F.sum(F.col(name) * F.col("_sign")).over(so_far)
        sums[f"{name}_win"] = (value if include_now else value - F.col(name)).cast("long")
    out = placed.withColumns(sums).filter("_home = _bucket and _sign = 1")
    return out.drop("_w", "_home", "_bucket", "_at", "_sign")


def trailing_chain(counted: DataFrame, keys: Sequence[str], ts: str, stages: Sequence[str], used: Column | int, widths_ms: Column | int) -> DataFrame:
    """Add ``started``: the latest start of a chain of stages in order that a row's time completes, if any.

    A row of a stage continues the chains that reached the stage before, so the latest start that has reached stage i
    is a running maximum over the rows of stage i of what reached stage i - 1. ``used`` says how many of the stages a
    key has. Rows are placed in buckets one window wide and the next one; starts before both are too old anyway.
    """
    width = F.lit(widths_ms) if isinstance(widths_ms, int) else widths_ms
    bucket = div_floor(F.col(ts), width.cast("long"))
    placed = counted.select("*", bucket.alias("_home"), F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    so_far = Window.partitionBy(*keys, "_bucket").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col(ts)
    for i, stage in enumerate(stages):
        placed = placed.withColumn(f"_r{i}", F.max(F.when(F.col(stage) > 0, reached)).over(so_far))
        reached = F.col(f"_r{i}")
    count = F.lit(used) if isinstance(used, int) else used
    started = F.element_at(F.array(*[f"_r{i}" for i in range(len(stages))]), count.cast("int"))
    own = placed.filter("_home = _bucket").withColumn("started", started)
    return own.drop("_home", "_bucket", *[f"_r{i}" for i in range(len(stages))])


def trailing_distinct(events: DataFrame, keys: Sequence[str], member: str, ts: str, widths_ms: Column | int, into: str = "members") -> DataFrame:
    """One row per key and millisecond: how many distinct members have an event in the window that ends there.

    An event adds one from its time until its member's next event, or until it leaves the window. A member's next
    event within a window lies in its bucket or the following one, and the sums run over two buckets of milliseconds,
    so neither a busy member nor a busy key grows a task.
    """
    keys = list(keys)
    width = F.lit(widths_ms) if isinstance(widths_ms, int) else widths_ms
    bucket = div_floor(F.col(ts), F.col("_w"))
    once = events.select(*keys, member, ts).distinct().withColumn("_w", width.cast("long"))
    near = once.select("*", bucket.alias("_home"), F.explode(F.array(bucket, bucket - 1)).alias("_bucket"))
    following = F.lead(ts).over(Window.partitionBy(*keys, member, "_bucket").orderBy(ts))
    spans = near.withColumn("_leave", F.least(following, F.col(ts) + F.col("_w") + 1)).filter("_home = _bucket")
    moves = F.array(
        F.struct(F.col(ts).alias("at"), F.lit(1).alias("d"), F.col("_home").alias("b"), F.lit(True).alias("own")),
        F.struct(F.col("_leave").alias("at"), F.lit(-1).alias("d"), F.col("_home").alias("b"), F.lit(False).alias("own")),
        F.struct(F.col(ts).alias("at"), F.lit(1).alias("d"), (F.col("_home") + 1).alias("b"), F.lit(False).alias("own")),
        F.struct(F.col("_leave").alias("at"), F.lit(-1).alias("d"), (F.col("_home") + 1).alias("b"), F.lit(False).alias("own")),
    )
    dealt = spans.select(*keys, F.explode(moves).alias("_m")).select(*keys, "_m.*")
    merged = dealt.groupBy(*keys, "b", "at").agg(F.sum("d").alias("d"), F.max("own").alias("own"))
    so_far = Window.partitionBy(*keys, "b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn(into, F.sum("d").over(so_far)).filter("own").select(*keys, F.col("at").alias(ts), into)


def sliding_count(
    events: DataFrame,
    window_sec: int,
    keys: Sequence[str] = ("device_id", "category"),
    ts: str = "timestamp_ms",
) -> DataFrame:
    """Events of the same key in the trailing window that ends at each event, peers included."""
    counted = per_millisecond(events, keys, ts, {"_n": F.lit(1)})
    width = window_sec * 1000
    windowed = trailing_sums(counted, keys, ts, ["_n"], width)
    windowed = windowed.select(*keys, ts, F.col("_n_win").alias("window_count"))
    return events.join(windowed, [*keys, ts])
