"""Whitening against numpy on all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clash
from watchloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def check(got: list, vectors: dict, sample: np.ndarray) -> None:
    """``vectors``: id -> grid vector; ``sample``: the grid vectors of the fit."""
    n, sums = len(sample), sample.sum(axis=0)
    mean = sums / n
    cov = (sample - mean).T @ (sample - mean) / n
    values, units = np.linalg.eigh(cov)
    values, units = values[::-1], units[:, ::-1]
    rows: dict = {}
    for r in got:
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert set(rows) == set(vectors)
    keep = min(32, sample.shape[1])
    signs = {}
    for i, x in vectors.items():
        assert sorted(rows[i]) == list(range(1, keep + 1))
        for c, r in rows[i].items():
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
            assert r.explained == pytest.approx(values[c - 1] / np.trace(cov), abs=1e-9) and r.identity_error < 1e-9
            want = (x - mean) @ units[:, c - 1] / np.sqrt(values[c - 1]) if values[c - 1] > 1e-9 else None
            if want is None:
                assert r.whitened is None
            elif abs(want) > 1e-6:
                signs.setdefault(c, set()).add(bool(np.sign(want) == np.sign(r.whitened)))
                assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-7)
    assert all(len(s) == 1 for s in signs.values())


def grid(v) -> np.ndarray:
    return np.floor(64 * np.asarray(v, np.float32).astype(float)).astype(np.int64) + 1_000_000


@pytest.mark.parametrize("dims", [3, 40])
def test_all_rows(session, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(200, dims)).astype(np.float32) * np.linspace(1, 4, dims, dtype=np.float32)
    rows = [(k, base[0 if k % 3 == 0 else k % 200].tolist(), 1) for k in range(500)]  # one vector is a third of all
    vectors = {i: grid(v) for i, v, _ in rows}
    odd = [(900, None, 1), (901, [1.0, None, *[2.0] * (dims - 2)], 1), (902, [float("nan")] * dims, 1), (903, [float("inf")] + [0.0] * (dims - 1), 1), (904, [], 1)]
    table = clash(session.createDataFrame(rows + odd, SCHEMA).repartition(4)).withColumn("x", F.lit(1)).withColumn("dims", F.lit("d"))
    check(whitening.whiten(table).collect(), vectors, np.array(list(vectors.values())))
    one = whitening.whiten(table, weights="one").where("vec_id = 1").collect()
    distinct = np.unique(np.array(list(vectors.values())), axis=0)
    mean = distinct.mean(axis=0)
    values, units = np.linalg.eigh((distinct - mean).T @ (distinct - mean) / len(distinct))
    first = next(r for r in one if r.component == 1)
    assert abs(first.whitened) == pytest.approx(abs((vectors[1] - mean) @ units[:, -1] / np.sqrt(values[-1])), rel=1e-9)


def test_without_variance(session):
    """Fewer rows than dimensions, constant vectors, one row, ids that repeat or are null, lengths that differ, none."""
    rows = [(1, [1.0, 2.0, 3.0], 0), (1, [2.0, 2.0, 3.0], 0), (None, [3.0, 2.0, 3.0], 0)]
    got = whitening.whiten(session.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 9 and {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    got = whitening.whiten(session.createDataFrame([*rows, (7, [1.0], 0), (8, [2.0], 0)], SCHEMA)).collect()
    assert {(r.vec_id, r.n) for r in got} == {(1, 3), (None, 3), (7, 2), (8, 2)}
    assert [abs(r.whitened) for r in got if r.vec_id in (7, 8)] == [1.0, 1.0]
    got = whitening.whiten(session.createDataFrame(rows[:1] * 3, SCHEMA)).collect()
    assert len(got) == 9 and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0 for r in got)
    assert whitening.whiten(session.createDataFrame([], SCHEMA)).count() == 0


def test_huge_entries(session):
    """Entries that the grid can't hold saturate, exact deviations beyond a long are null."""
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])]
    got = whitening.whiten(session.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id != 3) and all(np.isfinite(r.whitened) for r in got if r.component == 1)
