"""Greedy suppression and threshold alerts.

Both are chains: what fires next depends on what fired last. Short histories
are folded natively in one aggregate. A long history is cut into segments;
every segment first reports where each possible entry state would leave it,
the (few) reports are chained, and then all segments fire independently.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from watchloom.functions.columns import as_column, div_floor
from watchloom.operators.windows import per_millisecond, trailing_sums
from watchloom.rules.detection import DEFAULT_THRESHOLDS, Threshold
from watchloom.session import cut

# Rows of one key that a single native fold may hold, and rows aimed at per segment beyond it.
FOLD_ROWS = 4096
SEGMENT_ROWS = 50_000

_NONE = np.iinfo(np.int64).min


def _next_fire(ts: np.ndarray, need: int, window: int, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row, the row that fires next if this one fired; and the rows able to fire at all.

    A row can fire when ``need`` events lie in its trailing window; after a
    fire, only later events count and ``cooldown`` must have passed.
    """
    n = len(ts)
    able = np.flatnonzero(np.arange(n) - np.searchsorted(ts, ts - window) + 1 >= need)
    start = np.maximum(np.arange(n) + need, np.searchsorted(ts, ts + cooldown))
    pos = np.searchsorted(able, start)
    nxt = np.append(able, n)[pos]
    return nxt, able


def _entry_fires(ts: np.ndarray, nxt: np.ndarray, able: np.ndarray, own: int, tail: np.ndarray) -> np.ndarray:
    """First fire at or after row ``own``: with no earlier fire, then for each tail row as the last fire."""
    n = len(ts)
    fresh = np.append(able, n)[np.searchsorted(able, own)]
    return np.concatenate([[fresh], np.maximum(nxt[tail], fresh)]).astype(np.int64)


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int, dict[str, int]]:
    """Times, ids and number of tail rows of a segment in order, and the values that all its rows share."""
    ts, ids = (table.column(c).to_numpy() for c in ("_ms", "_id"))
    order = np.lexsort((ids, ts))
    shared = {c: table.column(c)[0].as_py() for c in table.column_names if c not in ("_ms", "_id")}
    return ts[order], ids[order], int(pc.sum(table.column("_tail")).as_py()), shared


def _segment_exits(table: pa.Table) -> dict[str, np.ndarray]:
    ts, ids, own, shared = _ordered(table)
    need, window, cooldown = (shared[c] for c in ("_need", "_window", "_cooldown"))
    nxt, able = _next_fire(ts, need, window, cooldown)
    tail = np.arange(own)
    first = _entry_fires(ts, nxt, able, own, tail)

    # Last fire reached from each row: follow the chain by doubling.
    n = len(ts)
    last = np.append(np.where(nxt < n, nxt, np.arange(n)), n)
    while True:
        jumped = last[last]
        if np.array_equal(jumped, last):
            break
        last = jumped
    leave = last[first]
    reach = shared["_end"] - max(window, cooldown)
    held = (leave < n) & (np.append(ts, 0)[leave] >= reach)
    exit_ms = np.where(held, np.append(ts, 0)[leave], _NONE)
    exit_id = np.where(held, np.append(ids, 0)[leave], _NONE)
    entry_ms = np.concatenate([[_NONE], ts[tail]])
    entry_id = np.concatenate([[_NONE], ids[tail]])
    change = np.ones(len(entry_ms), dtype=bool)
    change[1:] = (exit_id[1:] != exit_id[:-1]) | (exit_ms[1:] != exit_ms[:-1])
    return {
        "entry_ms": entry_ms[change], "entry_id": entry_id[change],
        "exit_ms": exit_ms[change], "exit_id": exit_id[change],
    }


def _chain_segments(pdf: pd.DataFrame) -> pd.DataFrame:
    state = (_NONE, _NONE)
    segs, states = [], []
    for seg, steps in pdf.groupby("_seg", sort=True):
        steps = steps.sort_values(["entry_ms", "entry_id"])
        segs.append(seg)
        states.append(state)
        known = list(zip(steps["entry_ms"], steps["entry_id"]))
        at = bisect_right(known, state) - 1
        state = (int(steps["exit_ms"].iloc[at]), int(steps["exit_id"].iloc[at]))
    return pd.DataFrame({
        "_seg": segs, "state_ms": [s[0] for s in states], "state_id": [s[1] for s in states],
    })


def _segment_fires(table: pa.Table) -> dict[str, np.ndarray]:
    ts, ids, own, shared = _ordered(table)
    need, window, cooldown = (shared[c] for c in ("_need", "_window", "_cooldown"))
    nxt, able = _next_fire(ts, need, window, cooldown)
    at = np.flatnonzero((ts[:own] == shared["state_ms"]) & (ids[:own] == shared["state_id"]))
    prev = int(at[0]) if len(at) else -1
    row = int(_entry_fires(ts, nxt, able, own, at[:1])[-1])
    rows, counts = [], []
    while row < len(ts):
        oldest = int(np.searchsorted(ts, ts[row] - window))
        rows.append(row)
        counts.append(row - max(oldest - 1, prev))
        prev, row = row, int(nxt[row])
    return {"_ms": ts[rows], "_id": ids[rows], "fired_count": np.array(counts, dtype=np.int64)}


def _grouped(fn, keys: Sequence[str]):
    """Run a function on the ordered frame of a group and put the keys back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values("_seg", kind="stable").reset_index(drop=True))
        for key in keys:
            out[key] = pdf[key].iloc[0] if len(out) else pd.Series(dtype=pdf[key].dtype)
        return out

    return run


def _per_segment(fn, keys: Sequence[str]):
    """Run a segment function and put the keys back. Rows stay in Arrow: only times and ids become arrays."""

    def run(table: pa.Table) -> pa.Table:
        columns = {name: pa.array(values, pa.int64()) for name, values in fn(table).items()}
        n = len(next(iter(columns.values())))
        for key in keys:
            columns[key] = pa.repeat(table.column(key)[0], n)
        return pa.table(columns)

    return run


def _fire_in_segments(rows: DataFrame, keys: Sequence[str], segment_rows: int) -> DataFrame:
    """Fires of long histories. ``rows``: keys, _ms, _id, _need, _window, _cooldown, _rows, _lo, _hi."""
    keys = list(keys)
    reach = F.greatest("_window", "_cooldown")
    parts = F.ceil(F.col("_rows") / segment_rows)
    span = F.greatest(2 * reach, F.ceil((F.col("_hi") - F.col("_lo") + 1) / parts)) + 1
    seg = div_floor(F.col("_ms") - F.col("_lo"), F.col("_span"))
    near_end = F.col("_ms") >= F.col("_lo") + (F.col("_home") + 1) * F.col("_span") - reach
    cut = (
        rows.withColumn("_span", span.cast("long"))
        .withColumn("_home", seg)
        .select("*", F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))).alias("_seg"))
        .withColumn("_tail", F.col("_seg") > F.col("_home"))
        .withColumn("_end", F.col("_lo") + (F.col("_seg") + 1) * F.col("_span"))
        .select(*keys, "_seg", "_ms", "_id", "_need", "_window", "_cooldown", "_tail", "_end")
    )
    # A tail without own rows is a segment nothing fires in, but it must still be left.
    types = {f.name: f.dataType for f in cut.schema.fields}
    key_fields = [T.StructField(k, types[k]) for k in keys]
    longs = lambda names: [T.StructField(n, T.LongType()) for n in names]

    exits = cut.groupBy(*keys, "_seg").applyInArrow(
        _per_segment(_segment_exits, [*keys, "_seg"]),
        T.StructType(longs(["entry_ms", "entry_id", "exit_ms", "exit_id"]) + key_fields + longs(["_seg"])),
    )
    states = exits.groupBy(*keys).applyInPandas(
        _grouped(_chain_segments, keys),
        T.StructType(longs(["_seg", "state_ms", "state_id"]) + key_fields),
    )
    return (
        cut.join(states, [*keys, "_seg"])
        .groupBy(*keys, "_seg")
        .applyInArrow(
            _per_segment(_segment_fires, keys),
            T.StructType(longs(["_ms", "_id", "fired_count"]) + key_fields),
        )
    )


def _fold_short(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy suppression of short histories: one fold over a bounded, sorted array per key."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<_ms:bigint,_id:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fires = acc["last"].isNull() | (x["_ms"] - acc["last"] >= F.col("_cooldown"))
        return F.when(
            fires, F.struct(x["_ms"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        ).otherwise(acc)

    return (
        rows.groupBy(*keys, "_cooldown")
        .agg(F.sort_array(F.collect_list(F.struct("_ms", "_id"))).alias("_all"))
        .select(*keys, F.explode(F.aggregate("_all", start, step, lambda acc: acc["kept"])).alias("_kept"))
        .select(*keys, F.col("_kept._ms"), F.col("_kept._id"))
    )


def _sized(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    sizes = rows.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.min("_ms").alias("_lo"), F.max("_ms").alias("_hi")
    )
    return rows.join(sizes, list(keys))


def cooldown(
    df: DataFrame,
    keys: Sequence[str],
    seconds: Column | str | int,
    *,
    ts: str = "timestamp_ms",
    tiebreak: str = "event_id",
    compacted: bool = False,
    fold_rows: int = FOLD_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Keep the first row of a key, then each row at least ``seconds`` after the last kept one.

    ``seconds`` may be a column that is constant per key. Of rows with equal
    time only one with the lowest ``tiebreak`` (an integer) can be kept.
    ``compacted`` says that ``df`` is one row per key and time, and materialized:
    it is counted, folded and chained, so otherwise its compact form is computed once and kept.
    Null is a key value like others.
    """
    columns, named = df.columns, list(keys)
    # One text names the key from here on: a null field is left out of it, and joins find it again.
    df, keys = df.withColumn("_key", F.to_json(F.struct(*named))), ["_key"]
    gap = F.lit(seconds) if isinstance(seconds, int) else as_column(seconds)
    firsts = df.select(
        *keys, F.col(ts).cast("long").alias("_ms"), (gap * 1000).cast("long").alias("_cooldown"),
        F.col(tiebreak).cast("long").alias("_id"),
    ) if compacted else cut(
        df.groupBy(*keys, F.col(ts).cast("long").alias("_ms"), (gap * 1000).cast("long").alias("_cooldown"))
        .agg(F.min(F.col(tiebreak).cast("long")).alias("_id"))
    )
    sized = _sized(firsts, keys)
    short = _fold_short(sized.filter(F.col("_rows") <= fold_rows), keys)
    long = _fire_in_segments(
        sized.filter(F.col("_rows") > fold_rows)
        .withColumn("_need", F.lit(1).cast("long"))
        .withColumn("_window", F.lit(0).cast("long")),
        keys, segment_rows,
    ).select(*keys, "_ms", "_id")
    kept = short.unionByName(long)
    kept = kept.select(*keys, F.col("_ms").alias(ts), F.col("_id").alias(tiebreak))
    at = [*keys, ts, tiebreak]
    return df.join(kept, at, "left_semi").select(*columns).dropDuplicates([*named, ts, tiebreak])


def _threshold_column(thresholds: Sequence[Threshold], attribute: str) -> Column:
    expr = None
    for t in thresholds:
        value = F.lit(getattr(t, attribute)).cast("long")
        expr = F.when(F.col("category") == t.category, value) if expr is None else expr.when(F.col("category") == t.category, value)
    return expr


def _alert_columns(fires: DataFrame, thresholds: Sequence[Threshold]) -> DataFrame:
    shown = F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd HH:mm:ss")
    return (
        fires.withColumn("threshold", _threshold_column(thresholds, "count"))
        .withColumn("window_sec", _threshold_column(thresholds, "window_sec"))
        .withColumn(
            "alert_line",
            F.concat(
                F.lit("["), shown, F.lit("] [ALERT] device="), F.col("device_id").cast("string"),
                F.lit(" ip="), F.col("machine_ip"), F.lit(" category="), F.col("category"),
                F.lit(" severity="), F.col("severity"), F.lit(" rule="), F.col("rule_name"),
                F.lit(" count="), F.col("event_count").cast("string"), F.lit("/"), F.col("threshold").cast("string"),
                F.lit(" window="), F.col("window_sec").cast("string"), F.lit("s | "), F.col("matched_text"),
            ),
        )
    )


def threshold_alerts(
    events: DataFrame,
    thresholds: Sequence[Threshold] = tuple(DEFAULT_THRESHOLDS),
    *,
    tiebreak: Sequence[str] = ("event_id", "line_no", "rule_no"),
    fold_rows: int = FOLD_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Alerts where enough events of a device and category fall in the trailing window.

    An alert clears the history and silences the pair for the cooldown.
    ``tiebreak`` columns order security events of equal time.
    """
    keys = ["device_id", "category"]
    thresholds = list(thresholds)
    same_ms = Window.partitionBy(*keys, "timestamp_ms").orderBy(*tiebreak)
    used = events.filter(F.col("category").isin([t.category for t in thresholds]))
    used = used.withColumn("_id", F.row_number().over(same_ms).cast("long"))
    # With a cooldown longer than the window the cleared history can no longer
    # matter when the next alert becomes possible: sliding counts and
    # suppression say everything, and both compact per millisecond.
    simple = [t for t in thresholds if t.cooldown_sec > t.window_sec]
    coupled = [t for t in thresholds if t.cooldown_sec <= t.window_sec]
    of = lambda some: used.filter(F.col("category").isin([t.category for t in some]))
    fires = []
    if simple:
        fires.append(_fires_by_window(of(simple), keys, simple, fold_rows, segment_rows))
    if coupled:
        fires.append(_fires_by_chain(of(coupled), keys, coupled, fold_rows, segment_rows))
    all_fires = fires[0] if len(fires) == 1 else fires[0].unionByName(fires[1])
    return _alert_columns(used.join(all_fires, [*keys, "timestamp_ms", "_id"]).drop("_id"), thresholds)


def _fires_by_window(events, keys, thresholds, fold_rows, segment_rows):
    """(key, time, rank within the millisecond, count) of the events that raise an alert."""
    counted = per_millisecond(events, keys, "timestamp_ms", {"_n": F.lit(1)})
    width = _threshold_column(thresholds, "window_sec") * 1000
    prior = trailing_sums(
        counted, keys, "timestamp_ms", ["_n"], width, include_now=False
    )
    # The event that crosses the threshold is the _id-th of its millisecond.
    able = (
        prior.withColumn("_id", F.greatest(F.lit(1).cast("long"), _threshold_column(thresholds, "count") - F.col("_n_win")))
        .filter(F.col("_n") >= F.col("_id"))
        .select(*keys, "timestamp_ms", "_id", (F.col("_n_win") + F.col("_id")).alias("event_count"),
                _threshold_column(thresholds, "cooldown_sec").alias("_gap"))
    )
    return cooldown(
        cut(able), keys, "_gap", tiebreak="_id", compacted=True, fold_rows=fold_rows, segment_rows=segment_rows
    ).drop("_gap")


def _fold_chain(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fires of short histories: one fold over a bounded, sorted array of milliseconds per key.

    ``counted``: keys, _ms, _n, _n_win (events of the window before this millisecond), _need, _cooldown. Of the events
    of a millisecond the first one that completes the window since the last fire raises the alert; without a
    cooldown every further ``need`` of them raise another one.
    """
    fire = "array<struct<_ms:bigint,_id:bigint,_first:bigint,_more:bigint>>"
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.lit(None).cast("long").alias("last"), zero.alias("prev"), zero.alias("seen"), F.array().cast(fire).alias("kept"))
    need, gap, step = F.col("_need"), F.col("_cooldown"), F.greatest(F.lit(1).cast("long"), F.col("_need"))

    def fold(acc: Column, x: Column) -> Column:
        own = F.greatest(F.lit(1).cast("long"), need - x["_n_win"], need + acc["prev"] - acc["seen"])
        fires = (own <= x["_n"]) & (acc["last"].isNull() | (x["_ms"] - acc["last"] >= gap))
        more = F.when(gap <= 0, ((x["_n"] - own - F.pmod(x["_n"] - own, step)) / step).cast("long")).otherwise(zero)
        count = F.least(x["_n_win"] + own, acc["seen"] + own - acc["prev"])
        hit = F.struct(x["_ms"].alias("_ms"), own.alias("_id"), count.alias("_first"), more.alias("_more"))
        return F.struct(
            F.when(fires, x["_ms"]).otherwise(acc["last"]).alias("last"),
            F.when(fires, acc["seen"] + own + more * step).otherwise(acc["prev"]).alias("prev"),
            (acc["seen"] + x["_n"]).alias("seen"),
            F.when(fires, F.concat(acc["kept"], F.array(hit))).otherwise(acc["kept"]).alias("kept"))

    return (
        counted.groupBy(*keys, "_need", "_cooldown")
        .agg(F.sort_array(F.collect_list(F.struct("_ms", "_n", "_n_win"))).alias("_all"))
        .select(*keys, step.alias("_step"), F.explode(F.aggregate("_all", start, fold, lambda acc: acc["kept"])).alias("_f"))
        .select(*keys, "_step", "_f.*", F.explode(F.sequence(zero, F.col("_f._more"))).alias("_nth"))
        .select(*keys, "_ms", (F.col("_id") + F.col("_nth") * F.col("_step")).alias("_id"),
                F.when(F.col("_nth") == 0, F.col("_first")).otherwise(F.col("_step")).alias("fired_count"))
    )


def _fires_by_chain(events, keys, thresholds, fold_rows, segment_rows):
    """(key, time, rank within the millisecond, count) of the events that raise an alert, cleared histories included."""
    counted = cut(per_millisecond(events, keys, "timestamp_ms", {"_n": F.lit(1).cast("long")}))
    sized = counted.join(
        counted.groupBy(*keys).agg(
            F.count("*").alias("_times"), F.sum("_n").alias("_rows"),
            F.min("timestamp_ms").cast("long").alias("_lo"), F.max("timestamp_ms").cast("long").alias("_hi")),
        keys,
    ).select(
        *keys, F.col("timestamp_ms").cast("long").alias("_ms"), "_n", "_times", "_rows", "_lo", "_hi",
        _threshold_column(thresholds, "count").alias("_need"),
        (_threshold_column(thresholds, "window_sec") * 1000).alias("_window"),
        (_threshold_column(thresholds, "cooldown_sec") * 1000).alias("_cooldown"),
    )
    folded = (F.col("_times") <= fold_rows) & (F.col("_window") > 0)
    short = trailing_sums(sized.filter(folded), keys, "_ms", ["_n"], F.col("_window"), include_now=False)
    # The events of a millisecond are numbered from 1, so their counts say which there are.
    long = sized.filter(~folded).withColumn("_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n", "_times")
    fires = _fold_chain(short, keys).unionByName(_fire_in_segments(long, keys, segment_rows))
    return fires.select(*keys, F.col("_ms").alias("timestamp_ms"), "_id", F.col("fired_count").alias("event_count"))
