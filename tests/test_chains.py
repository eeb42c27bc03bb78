"""Ordered operators against brute force, with small segments so that every path is taken."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from watchloom.operators.cooldown import cooldown, threshold_alerts
from watchloom.operators.sequence import sequence
from watchloom.operators.windows import sliding_count
from watchloom.rules.detection import Threshold


def _greedy(times, gap):
    kept, last = [], None
    for ms, i in sorted(times):
        if last is None or ms - last >= gap:
            kept.append(i)
            last = ms
    return kept


def _events(seed, n, keys, span):
    rng = random.Random(seed)
    # The first key holds a third of the rows.
    return [(0 if rng.random() < 0.33 else rng.randrange(1, keys), rng.randrange(span) // 100 * 100, i) for i in range(n)]


@pytest.mark.parametrize("fold_rows,segment_rows", [(10_000, 10_000), (0, 40), (50, 25)])
def test_cooldown_equals_brute_force(spark, fold_rows, segment_rows):
    rows = _events(1, 3000, 12, 4_000_000)
    df = spark.createDataFrame(rows, "device_id long, timestamp_ms long, event_id long")
    got = sorted(r.event_id for r in cooldown(df, ["device_id"], 20, fold_rows=fold_rows, segment_rows=segment_rows).collect())
    want = sorted(i for k in range(12) for i in _greedy([(t, i) for d, t, i in rows if d == k], 20_000))
    assert got == want


def _alerts(times, need, window, gap):
    out, seen, last = [], [], None
    for ms, i in sorted(times):
        seen = [t for t in seen if t >= ms - window] + [ms]
        if len(seen) >= need and (last is None or ms - last >= gap):
            out.append((i, len(seen)))
            last, seen = ms, []
    return out


@pytest.mark.parametrize("need,window,gap", [(4, 60, 300), (3, 300, 60), (2, 60, 60), (1, 60, 0)])
@pytest.mark.parametrize("segment_rows", [25, 100_000])
def test_threshold_alerts_equal_brute_force(spark, need, window, gap, segment_rows):
    rows = _events(2, 2500, 8, 6_000_000)
    df = spark.createDataFrame(rows, "device_id long, timestamp_ms long, event_id long").select(
        "*", F.lit("c").alias("category"), F.lit("ip").alias("machine_ip"), F.lit("high").alias("severity"),
        F.lit("r").alias("rule_name"), F.lit("text").alias("matched_text"))
    alerts = threshold_alerts(df, [Threshold("c", need, window, gap)], tiebreak=["event_id"], fold_rows=50, segment_rows=segment_rows)
    got = sorted((r.event_id, r.event_count) for r in alerts.collect())
    want = sorted(a for k in range(8) for a in _alerts([(t, i) for d, t, i in rows if d == k], need, window * 1000, gap * 1000))
    assert got == want


@pytest.mark.parametrize("need,window,gap", [(3, 300, 60), (2, 60, 0), (4, 60, 60), (1, 0, 0)])
def test_short_histories_with_cleared_windows_are_folded(spark, monkeypatch, need, window, gap):
    from watchloom.operators import cooldown as module

    sent = []
    segments = module._fire_in_segments
    monkeypatch.setattr(module, "_fire_in_segments", lambda rows, *rest: sent.append(rows.count()) or segments(rows, *rest))
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.randrange(400) * 2000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "device_id long, timestamp_ms long, event_id long").select(
        "*", F.lit("c").alias("category"), F.lit("ip").alias("machine_ip"), F.lit("high").alias("severity"),
        F.lit("r").alias("rule_name"), F.lit("text").alias("matched_text"))
    alerts = threshold_alerts(df, [Threshold("c", need, window, gap)], tiebreak=["event_id"])
    got = sorted((r.event_id, r.event_count) for r in alerts.collect())
    assert got == sorted(a for k in range(40) for a in _alerts([(t, i) for d, t, i in rows if d == k], need, window * 1000, gap * 1000))
    assert sent == [0 if window else len(rows)]


def test_sliding_count_includes_the_edge_and_peers(spark):
    rows = [(1, "a", t) for t in (0, 1000, 300_000, 300_000, 300_001, 601_000)]
    df = spark.createDataFrame(rows, "device_id long, category string, timestamp_ms long")
    got = sorted((r.timestamp_ms, r.window_count) for r in sliding_count(df, 300).collect())
    assert got == [(0, 1), (1000, 2), (300_000, 4), (300_000, 4), (300_001, 4), (601_000, 1)]


@pytest.mark.parametrize("segment", [1, 7, 1000])
def test_sequence_numbers_rows_across_segments(spark, segment):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 5).alias("t"), F.col("id").alias("v"))
    rows = sequence(df, ["k"], ["t"], segment=segment, carry=["v"]).collect()
    for k in range(3):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: r.t)
        assert [r.seq for r in mine] == list(range(1, len(mine) + 1))
        assert [r.prev and r.prev.v for r in mine] == [None] + [r.v for r in mine][:-1]
