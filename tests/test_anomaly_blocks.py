"""Forests of the past: the same findings at once and in turn, and pools against plain ranks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.operators.anomaly import _grow_trees, _path_lengths, anomaly_features, block_forests, observe, past_pools, score_blocks, tree_samples

ROWS = ("event_id long, device_id long, timestamp_ms long, machine_ip string, cpu_pct double, ram_pct double, net_in_delta long, net_out_delta long, "
        "event_count long, auth_failures long, interval_ms long")
HOUR = 3_600_000


def _reports(spark, n: int = 900):
    """Ten hours of reports, nearly all in one hour of them, with some far out of the ordinary, and a beacon."""
    rng, rows = random.Random(3), []
    for k in range(n):
        odd = k % 150 == 149
        hour = 5 if rng.random() < 0.7 else rng.randrange(10)
        rows.append((k, k % 7, hour * HOUR + rng.randrange(HOUR), "ip", 99.0 if odd else 20 + rng.random(), 95.0 if odd else 30 + rng.random(), 10 ** 8 if odd else rng.randrange(1000),
                     10 ** 9 if odd else rng.randrange(1000), 400 if odd else rng.randrange(5), 90 if odd else 0, None if k < 7 else 60_000 + rng.randrange(50)))
    return spark.createDataFrame(rows, ROWS)


def _set(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_at_once_and_in_turn(spark):
    rows = _reports(spark)
    options = {"block_ms": HOUR, "window": 200, "warmup": 50}
    whole = observe(rows, **options)
    want = _set(whole)
    assert {r[3] for r in want} >= {"iforest"} and any(r[1] // HOUR == 5 for r in want)
    for cuts in ([0, 10], [0, 2, 6, 10], [0, 1, 2, 5, 6, 8, 9, 10]):
        parts = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            batch = rows.where((F.col("timestamp_ms") >= lo * HOUR) & (F.col("timestamp_ms") < hi * HOUR))
            parts += _set(observe(batch, history=rows.where(F.col("timestamp_ms") < lo * HOUR), **options))
        assert sorted(parts) == want


def test_only_the_past_counts(spark):
    """What comes later changes nothing that was said before."""
    rows, options = _reports(spark), {"block_ms": HOUR, "window": 200, "warmup": 50}
    early = rows.where(F.col("timestamp_ms") < 6 * HOUR)
    assert _set(observe(early, **options)) == [r for r in _set(observe(rows, **options)) if r[1] < 6 * HOUR]
    assert observe(early.limit(0), **options).count() == 0


@pytest.mark.parametrize("window", [1, 30, 5000])
def test_pools(spark, window):
    rows = anomaly_features(_reports(spark))
    blocks, pools = past_pools(rows, HOUR, window, 20)
    order = sorted((r.timestamp_ms, r.event_id) for r in rows.select("timestamp_ms", "event_id").collect())
    want = {}
    for b in {t // HOUR for t, _ in order}:
        before = [e for e in order if e[0] < b * HOUR]
        if len(before) >= 20:
            want[b] = set(before[-window:])
    got: dict = {}
    for r in pools.collect():
        assert (r.timestamp_ms, r.event_id) not in got.setdefault(r.block, set())
        got[r.block].add((r.timestamp_ms, r.event_id))
    assert got == want
    assert {r.block: r.before for r in blocks.collect()} == {b: sum(t < b * HOUR for t, _ in order) for b in {t // HOUR for t, _ in order}}


def test_parts_of_a_block_agree(spark):
    rows = anomaly_features(_reports(spark))
    blocks, pools = past_pools(rows, HOUR, 200, 50)
    forests = block_forests(pools, trees=8).cache()
    score = lambda n: {r.event_id: r.score for r in score_blocks(rows, blocks, forests, HOUR, part_rows=n).collect()}
    assert score(10) == score(100_000)


def test_trees_part_their_rows():
    """Children share their parent's rows, every row ends in the leaf that counts it, and depth is bounded."""
    rng = np.random.default_rng(1)
    x, tree = rng.normal(size=(300, 7)), np.repeat(np.arange(3), 100)
    x[:100] = 1.0  # rows that nothing parts
    grown = _grow_trees(x, tree, 3, 7, 5)
    assert [len(g["rows"]) for g in grown][0] == 1 and all(g["rows"][0] == 100 for g in grown)
    for t in (1, 2):
        g = grown[t]
        inner = np.flatnonzero(g["left_id"] >= 0)
        assert (g["rows"][inner] == g["rows"][g["left_id"][inner]] + g["rows"][g["right_id"][inner]]).all()
        at, normal = np.zeros(100, int), g["normal"].reshape(-1, 7)
        for _ in range(6):
            go = g["left_id"][at] >= 0
            below = (x[tree == t] * normal[at]).sum(axis=1) < g["intercept"][at]
            at = np.where(go, np.where(below, g["left_id"][at], g["right_id"][at]), at)
        leaves, counts = np.unique(at, return_counts=True)
        assert (g["left_id"][leaves] == -1).all() and (g["rows"][leaves] == counts).all()
        depths = _path_lengths(x[tree == t], {"left": g["left_id"], "right": g["right_id"], "rows": np.ones(len(g["rows"])), "intercept": g["intercept"], "normal": normal})
        assert 1 <= depths.min() and depths.max() <= 5
    assert [g["rows"].tolist() for g in _grow_trees(x, tree, 3, 7, 5)] == [g["rows"].tolist() for g in grown]


def test_draws_are_those_of_a_forest(spark):
    """A block's trees grow from the rows that the plain draws over its pool give."""
    rows = anomaly_features(_reports(spark))
    _, pools = past_pools(rows, HOUR, 200, 50)
    sizes = {r.tree_id: r["rows"][0] for r in block_forests(pools.where("block = 9"), trees=4, subsample=64).collect()}
    drawn = tree_samples(pools.where("block = 9"), 4, 64, 7).groupBy("tree_id").count().collect()
    assert sizes == {r.tree_id: r["count"] for r in drawn} == dict.fromkeys(range(4), 64)
