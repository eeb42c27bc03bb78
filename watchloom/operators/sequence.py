"""Row numbers and previous rows per key, without one task per key.

A window over ``partitionBy(key)`` sends a busy key to a single task. Here the
history of a key is cut into segments of the order column; each segment is
windowed on its own and only one summary row per segment crosses over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from watchloom.functions.columns import div_floor


def sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    segment: int,
    carry: Sequence[str] = (),
    seq: str = "seq",
    prev: str = "prev",
) -> DataFrame:
    """Add ``seq`` (1, 2, … per key) and, with ``carry``, the previous row's columns as a struct.

    ``order`` must be unique within a key and start with a numeric column;
    ``segment`` is the segment width in the unit of that column.
    """
    keys = list(keys)
    cut = df.withColumn("_seg", div_floor(F.col(order[0]), segment))
    within = Window.partitionBy(*keys, "_seg").orderBy(*order)
    row = F.struct(*(carry or order[:1]))
    rows = cut.select(
        "*",
        F.row_number().over(within).alias("_rn"),
        F.lag(row).over(within).alias("_prev"),
        F.lead(F.lit(True)).over(within).isNull().alias("_last"),
    )

    across = Window.partitionBy(*keys).orderBy("_seg")
    heads = (
        rows.filter("_last")
        .select(*keys, "_seg", F.col("_rn").alias("_n"), row.alias("_row"))
        .select(
            *keys, "_seg",
            F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.lag("_row").over(across).alias("_carried"),
        )
    )
    out = rows.join(heads, [*keys, "_seg"]).withColumn(seq, (F.col("_before") + F.col("_rn")).cast("long"))
    if carry:
        out = out.withColumn(prev, F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_prev")))
    return out.drop("_seg", "_rn", "_prev", "_last", "_before", "_carried")


def with_predecessors(df: DataFrame, block_rows: int, lookback: int, seq: str = "seq") -> DataFrame:
    """Assign numbered rows to blocks and copy each block's last ``lookback`` rows into the next block.

    Windows over ``(key, block)`` that look back at most ``lookback`` rows are
    then exact for the rows with ``own`` set.
    """
    block = div_floor(F.col(seq) - 1, block_rows)
    offset = F.pmod(F.col(seq) - 1, F.lit(block_rows))
    homes = F.when(offset >= block_rows - lookback, F.array(block, block + 1)).otherwise(F.array(block))
    return (
        df.select("*", block.alias("_home"), F.explode(homes).alias("block"))
        .withColumn("own", F.col("_home") == F.col("block"))
        .drop("_home")
    )
