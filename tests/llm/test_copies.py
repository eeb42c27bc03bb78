"""Exact and near duplicates against plain comparison of all rows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ROWS, SCHEMA, awkward, empty, near_components, near_family
from watchloom.llm import minhash_forest
from watchloom.llm.exact_dedup import exact_dedup
from watchloom.llm.minhash_forest import components, near_dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(session, keep):
    groups: dict = {}
    for i, t, *_ in ROWS:
        groups.setdefault(t or "", []).append(i)
    best = max if keep == "largest" else min
    want = []
    for i, t, *_ in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        kept = best(ids) if ids else None
        want.append((i, kept, len(groups[t or ""]), i == kept, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, exact_dedup(awkward(session), keep=keep).collect()), key=str) == sorted(want, key=str)
    assert exact_dedup(empty(session)).count() == 0


def test_colliding_hashes_come_apart(session, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.lit("00" * 16))
    rows = exact_dedup(awkward(session)).collect()
    assert {(r.doc_id, r.keep_id) for r in rows if r.doc_id in (1, 2, 3, 4, 13, 14)} == {(1, 1), (2, 1), (3, 3), (4, 3), (13, 13), (14, 14)}


@pytest.mark.parametrize("words", [4, 5])
def test_near_family(session, words):
    rows = near_family(seed=words)
    want = near_components(rows, words)
    got = near_dedup(session.createDataFrame(rows, SCHEMA), words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_crowded_regions_go_deeper(session, monkeypatch):
    """A family far larger than a region: the same components, in regions of bounded size."""
    monkeypatch.setattr(minhash_forest, "REGION", 8)
    rows = [(k, " ".join([f"w{j}" for j in range(200)] + [f"end{k}"]), "en", "s", 1) for k in range(120)]
    got = near_dedup(session.createDataFrame(rows, SCHEMA), words=4).collect()
    assert {r.component_id for r in got} == {0}


def test_crowds_keep_borderline_links(session, monkeypatch):
    """Members of one template, far more than a region, each with a single partner just above the limit."""
    monkeypatch.setattr(minhash_forest, "REGION", 16)
    base, rows = [f"w{j}" for j in range(200)], []
    for k in range(400):
        words = base + [f"pair{k // 2}x{j}" for j in range(14)] + [f"own{k}x{j}" for j in range(26)]
        rows.append((k, " ".join(words), "en", "s", 1))
    want = near_components(rows, 4)
    assert len({c for _, c in want.values()}) == 200
    got = near_dedup(session.createDataFrame(rows, SCHEMA), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_heavy_regions(session, monkeypatch):
    """Regions whose sets are too large together are parted and met by blocks of a bounded number of shingles."""
    monkeypatch.setattr(minhash_forest, "WEIGHT", 600)
    rows = near_family(seed=8, n=120)
    got = near_dedup(session.createDataFrame(rows, SCHEMA), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_components(rows, 4)


@pytest.mark.parametrize("region", [2, 1024])
def test_ids_that_repeat(session, monkeypatch, region):
    """One id with near-equal texts, with texts unlike each other, and each with partners of its own."""
    monkeypatch.setattr(minhash_forest, "REGION", region)
    text = lambda name, last: " ".join([f"{name}{k}" for k in range(60)] + [last])
    rows = [(5, text("a", "x")), (5, text("a", "y")), (6, text("b", "x")), (6, text("c", "x")), (2, text("b", "z")), (9, text("c", "z")), (4, text("d", "x")), (4, text("d", "x")), (3, None), (3, text("e", "x")), (8, text("e", "y"))]
    got = near_dedup(session.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA), words=4).collect()
    want = {5: 5, 6: 2, 2: 2, 9: 2, 4: 4, 3: 3, 8: 3}
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles} == set(want.items())


def test_near_awkward(session):
    got = near_dedup(awkward(session), words=4).collect()
    assert len(got) == len(ROWS)
    want = near_components([r for r in ROWS if r[0] is not None], 4)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, n, c) for i, (n, c) in want.items()}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup(empty(session)).count() == 0


def test_components_of_chains_and_stars(session):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(session.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
