"""Ordered stages and device counts against plain comparison of all events."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from watchloom.operators.correlate import correlate
from watchloom.operators.windows import trailing_chain, trailing_distinct
from watchloom.rules.correlation import CorrelationRule, Stage

EVENTS = "device_id long, timestamp_ms long, source string, category string, severity string"
THREE = CorrelationRule("three", "in a row", "high", "T", "T1", 10, 3, False, (Stage("a"), Stage("b"), Stage("c")))


def _events(seed: int, n: int, devices: int, span: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.randrange(devices), rng.randrange(span), rng.choice("abcd"), "x", "high") for _ in range(n)]


def _plainly(events, rule) -> list[tuple]:
    """(scope, time) of the incidents: every event's window is read anew."""
    out, last = [], {}
    scope = lambda e: "global" if rule.cross_device else str(e[0])
    for s in sorted({scope(e) for e in events}):
        mine = [e for e in events if scope(e) == s and any(e[2] == g.source for g in rule.stages)]
        for now in sorted({e[1] for e in mine}):
            seen = [e for e in mine if now - rule.window_seconds * 1000 <= e[1] <= now]
            if len(seen) < rule.min_events or {g.source for g in rule.stages} - {e[2] for e in seen}:
                continue
            if len({e[0] for e in seen}) < rule.min_devices:
                continue
            at = now - rule.window_seconds * 1000
            for g in rule.stages if rule.ordered else ():
                at = min((e[1] for e in seen if e[2] == g.source and e[1] >= at), default=None)
                if at is None:
                    break
            if at is not None and (s not in last or now - last[s] >= 300_000):
                out.append((s, now))
                last[s] = now
    return sorted(out)


@pytest.mark.parametrize("rule", [THREE, replace(THREE, ordered=True), replace(THREE, cross_device=True, ordered=True), replace(THREE, cross_device=True, min_devices=3),
                                  replace(THREE, cross_device=True, ordered=True, min_devices=3), replace(THREE, stages=(Stage("b"), Stage("a")), ordered=True)])
def test_incidents(spark, rule):
    events = _events(4, 500, 5, 4_000_000) + _events(5, 60, 5, 40_000)
    got = correlate(spark.createDataFrame(events, EVENTS), [rule]).select("scope", "first_seen_ms").collect()
    want = _plainly(events, rule)
    assert sorted(map(tuple, got)) == want and want


def test_shorter_rules_beside_longer(spark):
    """A rule of two stages and one of three are judged together, each with its own number of stages."""
    two = replace(THREE, name="two", stages=(Stage("c"), Stage("a")), min_events=2, ordered=True)
    events = _events(9, 400, 4, 3_000_000)
    got = correlate(spark.createDataFrame(events, EVENTS), [replace(THREE, ordered=True), two])
    for rule in (replace(THREE, ordered=True), two):
        assert sorted((r.scope, r.first_seen_ms) for r in got.where(F.col("rule_name") == rule.name).collect()) == _plainly(events, rule)


def test_distinct_members(spark):
    """One member holds nearly all events; times repeat; windows end at every event."""
    rng = random.Random(2)
    events = [("k", 0 if rng.random() < 0.95 else rng.randrange(1, 9), rng.randrange(20_000)) for _ in range(3000)] + [("k", 3, -5), ("other", 1, 7)]
    got = trailing_distinct(spark.createDataFrame(events, "key string, m long, t long"), ["key"], "m", "t", 500).collect()
    want = {(k, t): len({m for o, m, u in events if o == k and t - 500 <= u <= t}) for k, _, t in events}
    assert {(r.key, r.t): r.members for r in got} == want and len(got) == len(want)


def test_chain_keeps_its_groups_small(spark):
    """A single key over many windows is dealt to buckets of at most two windows."""
    rows = spark.range(20_000).selectExpr("'k' as key", "id * 10 as t", "cast(id % 3 = 0 as long) as s0", "cast(id % 5 = 0 as long) as s1")
    chained = trailing_chain(rows, ["key"], "t", ["s0", "s1"], 2, 1000)
    assert chained.count() == 20_000
    late = chained.where("t >= 1000 and (started is null or started < t - 60)")
    assert late.count() == 0
    assert "_bucket" in chained._jdf.queryExecution().executedPlan().toString()
