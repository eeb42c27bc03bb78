"""Merkle manifests against a plain tree."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.helpers import ROWS, SCHEMA, awkward, empty
from watchloom.llm import merkle


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower: bool = False) -> str:
    i, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf the texts before and behind it, level by level."""
    where, found = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, w in enumerate(where):
            run = w - w % 8
            found[k].append(("".join(nodes[run:w]), "".join(nodes[w + 1 : run + 8])))
        nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        where = [w // 8 for w in where]
    return nodes[0], found


def plainly(rows: list[tuple]) -> list[tuple]:
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda x: b"" if x is None else b"=" + x.encode())
    order = {n: sorted(trees[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for n in names}
    made = {n: climb([leaf(r) for r in order[n]]) for n in names}
    root, above = climb([made[n][0] for n in names])
    out = []
    for n, up in zip(names, above, strict=True):
        for r, path in zip(order[n], made[n][1], strict=True):
            tampered = zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 3 == 0
            folded = leaf(r, tampered)
            for before, behind in path + up:
                folded = h(before + folded + behind)
            out.append((r[0], leaf(r), made[n][0], root, h("".join(a + b for a, b in path + up)), folded, folded == root))
    return out


def got(docs, **how) -> list[tuple]:
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, merkle.merkle_manifest(docs, **how).select(columns).collect()), key=str)


def test_layout_is_a_bijection():
    for levels in range(1, 6):
        places = np.concatenate([merkle.address(d, np.arange(8**d), levels) for d in range(levels)])
        assert sorted(places.tolist()) == list(range(merkle.subtree(levels)))
        assert merkle.address(0, np.array([0]), levels)[0] == 0
    # Five levels: two above, then each subtree of three levels in one stretch.
    below = merkle.address(2, np.array([5]), 5)[0]
    inside = [merkle.address(d, np.arange(5 * 8 ** (d - 2), 6 * 8 ** (d - 2)), 5) for d in (2, 3, 4)]
    assert sorted(np.concatenate(inside).tolist()) == list(range(below, below + merkle.subtree(3)))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 520])
@pytest.mark.parametrize("height", [1, 2, 4])
def test_blocks_by_hand(n, height):
    leaves = [h(str(k)) for k in range(n)][: 8**height]
    root, want = climb(leaves)
    stored = merkle.lay_out(leaves, True, height)
    assert stored[:32].hex() == root
    assert merkle.paths(stored, len(leaves), True, [], height) == [[x for pair in path for x in pair] for path in want]


@pytest.mark.parametrize("height", [1, 4])
def test_storeys(session, height):
    """Trees of one row, of one run and of many storeys, a third of the rows in one language."""
    rows = [(k, f"Text {k}" if k % 5 else None, ["en", "en", "de", None, f"x{k}"][k % 5 if k % 50 < 40 or k % 5 < 4 else 0], "s" if k % 7 else None, k if k % 3 else None) for k in range(700)]
    want = sorted(plainly(rows), key=str)
    assert got(session.createDataFrame(rows, SCHEMA).repartition(5), height=height) == want
    assert {r[6] for r in want} == {True, False}


def test_manifest_awkward(session):
    assert got(awkward(session)) == sorted(plainly(ROWS), key=str)
    assert got(empty(session)) == []
    assert got(session.createDataFrame(ROWS[:1], SCHEMA)) == plainly(ROWS[:1])


def test_twin(session, tmp_path):
    session.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(con.execute(f"select {', '.join(columns)} from ({merkle.OP11_SQL})").fetchall(), key=str) == sorted(plainly(ROWS), key=str)
