"""Fingerprints, archives, mixing and shards against plain versions, and their awkward cases."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ROWS, SCHEMA, awkward, clash, empty, near_family
from watchloom.llm import kdtree, phrases, raking, warc
from watchloom.llm.common import scratch


def likeness(a: str, b: str) -> float:
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / phrases.MINIMA


def parse_plainly(symbols: list[int]) -> list[tuple[int, ...]]:
    """One level of phrases of one text, symbol by symbol."""
    runs: list[list[int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    labels = [s for s, _ in runs]

    def toss(values: list[int], fixed) -> list[int]:
        out = []
        for k, v in enumerate(values):
            before = values[k - 1] if k else fixed(v)
            place = ((v ^ before) & -(v ^ before)).bit_length() - 1
            out.append(2 * place + (v >> place & 1))
        return out

    mask = (1 << 64) - 1
    names = [int(phrases.mix(phrases.np.uint64([s * 0x9E3779B97F4A7C15 + n & mask]))[0]) if n > 1 else s for s, n in runs]
    labels = toss(toss(toss(names, lambda v: v ^ mask), lambda v: v ^ 1), lambda v: v ^ 1)
    found = [[names[0]]]
    for k in range(1, len(names)):
        if 1 < k < len(names) - 1 and labels[k] < labels[k - 1] and labels[k] < labels[k + 1]:
            found.append([])
        found[-1].append(names[k])
    return [tuple(f) for f in found]


@pytest.mark.parametrize("text", ["a", "aa", "mississippi" * 9, "Größe 漢字 and a longer sentence, with some words.", "x" * 500 + "yz" * 40])
def test_phrases_symbol_by_symbol(text):
    np = phrases.np
    symbols = phrases.mix(np.array([ord(c) for c in text], np.uint64) + np.uint64(0xFFFF))
    want = parse_plainly(symbols.tolist())
    names, begins = phrases.parse(symbols, np.array([0]))
    assert len(names) == len(want) and begins.tolist() == [0]
    assert len({*zip(want, names.tolist(), strict=True)}) == len(set(want)) == len(set(names.tolist()))
    several, at = phrases.parse(np.concatenate([symbols] * 3), np.arange(3) * len(symbols))
    assert several.tolist() == names.tolist() * 3 and at.tolist() == [0, len(names), 2 * len(names)]


def test_equal_substrings_share_names_at_any_offset():
    text = next(r[1] for r in near_family(n=1))
    for cut in (1, 5, 17):
        assert likeness(*phrases.fingerprints([text, text[cut:]])) > 0.6
    assert phrases.fingerprints([text] * 2 + [""])[:2] == [phrases.fingerprints([text])[0]] * 2


def test_likeness_has_no_step_at_any_length():
    """A text and the same with a tenth more stay alike whatever their length."""
    long = " ".join(r[1] for r in near_family(n=12))
    for n in range(30, 400, 10):
        pairs = [(long[at : at + n], long[at : at + n + max(3, n // 10)]) for at in range(0, 1200, 150)]
        found = [likeness(*phrases.fingerprints(list(p))) for p in pairs]
        assert sum(found) / len(found) > 0.5, n


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_next_and_edited(session, range_rows, monkeypatch):
    monkeypatch.setattr(phrases.neighbour_ranges, "__defaults__", ("doc_id", "text", range_rows))
    got = phrases.edited_likeness(awkward(session)).collect()
    order = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (-(r[0] or -1), r[1].encode()))
    want = []
    for k, (i, text) in enumerate(order):
        follows, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *phrases.fingerprints([text, edited, follows])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert phrases.edited_likeness(empty(session)).count() == 0
    one = phrases.edited_likeness(session.createDataFrame(ROWS[:1], SCHEMA)).select(phrases.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("x")).collect()
    assert [r.x for r in one] == [1.0]
    assert phrases.fingerprint_documents(awkward(session)).count() == len(ROWS)


def test_a_range_is_a_task(session):
    docs = session.range(400).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    found = phrases.neighbour_ranges(docs, range_rows=40).select("part", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(found) == len({r.task for r in found}) == len({r.part for r in found}) == 10


PAGES = [
    (1, "http://a/1", "<p>" + "long page " * 200), (2, "http://a/2", "<p>" + "long page " * 200), (3, None, "<p>" + "long page " * 200), (3, None, "<p>" + "long page " * 200),
    (4, "http://b c\n/", "short"), (5, "http://b", "short"), (6, "http://c", None), (7, None, ""), (None, "http://n", "<p>" + "long page " * 200),
    (None, None, "lonely" * 300), (8, "http://d", "ü" * 500), (9, "http://d", "ü" * 500), (10, "http://e", "ü" * 499 + "x"), (11, "http://e", "ü" * 499 + "x"), (12, "http://f", "z" * 900_000),
]


def test_archives(session):
    pages = clash(session.createDataFrame(PAGES, "page_id long, url string, html string"))
    folder = scratch(session, "test-warc")
    manifest = warc.write_archives(pages, folder)
    got = warc.read_archives(manifest, folder, keep_payload=True).collect()
    last = {}
    for i, _, html in PAGES:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in PAGES:
        data, keep = (html or "").encode(), last[html or ""]
        again = len(data) >= 1000 and keep >= 0 and i != keep
        want.append((i, "revisit" if again else "response", keep if again else None, len(data), hashlib.sha1(data).hexdigest(), True, b"" if again else data))
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.verified, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    for row in manifest.collect():
        with gzip.open(row.path) as file:
            assert file.read().count(b"WARC/1.1\r\n") == row.records
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch(session, "test-warc")), folder).count() == 0


def test_damage_is_seen():
    one, two = warc.record(1, "u", b"x" * 5000, None, False), warc.record(2, "u", b"y", None, False)
    records = list(warc.read_archive(io.BytesIO(one + two)))
    assert [r.verified for r in records] == [True, True] and [r.payload_bytes for r in records] == [5000, 1]
    raw = gzip.decompress(one)
    assert [r.verified for r in warc.read_archive(io.BytesIO(gzip.compress(raw.replace(b"xx", b"xz", 1))))] == [False]
    for bad in (one[:-20], gzip.compress(raw[:-5]), gzip.compress(b"no record")):
        with pytest.raises((ValueError, KeyError)):
            list(warc.read_archive(io.BytesIO(bad)))


def test_archive_in_tiny_pieces(monkeypatch):
    data = b"".join(warc.record(k, "u", os.urandom(50) * k, None, k % 3 == 2) for k in range(20))
    for piece in (1, 7, 100):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert [r.headers["warc-record-id"] for r in warc.read_archive(io.BytesIO(data)) if r.verified] == [f"<urn:page:{k}>" for k in range(20)]


def rake_plainly(cells: dict[tuple, float], targets: list[dict], rounds: int) -> dict[tuple, float]:
    total = sum(cells.values())
    weights = {c: v / total for c, v in cells.items()}
    for _ in range(rounds):
        for d, wanted in enumerate(targets):
            sums: dict = defaultdict(float)
            for c, w in weights.items():
                sums[c[d]] += w
            weights = {c: w * wanted[c[d]] / sums[c[d]] for c, w in weights.items()}
    return weights


def test_rake(session):
    cells = {("a", "x", "p"): 80.0, ("a", "y", "p"): 10.0, ("b", "x", "q"): 5.0, (None, "y", "q"): 4.0, ("b", "y", "p"): 1.0}
    targets = [{"a": 0.4, "b": 0.4, None: 0.2}, {"x": 0.5, "y": 0.5}, {"p": 0.7, "q": 0.3}]
    frame = session.createDataFrame([(*c, v) for c, v in cells.items()], "source string, lang string, topic string, tokens double")
    wanted = {d: session.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in zip(raking.DIMENSIONS, targets, strict=True)}
    got = {(r.source, r.lang, r.topic): r.weight for r in raking.rake(frame, wanted, 30).collect()}
    assert got == pytest.approx(rake_plainly(cells, targets, 30))
    for d in range(3):
        sums: dict = defaultdict(float)
        for c, w in got.items():
            sums[c[d]] += w
        assert dict(sums) == pytest.approx(targets[d], abs=0.02 if d < 2 else 1e-9)


def mixed_cells(session, rows: list[tuple]):
    """Documents with so many words per (source, lang, topic), ten words each."""
    docs = [(k, "w " * 9 + "w", lang, source, topic) for k, (source, lang, topic) in enumerate(r[:3] for r in rows for _ in range(r[3]))]
    return session.createDataFrame(docs, "doc_id long, text string, lang string, source string, kind string")


CELLS = [("a", "x", "p", 60), ("a", "y", "p", 10), ("b", "x", "q", 20), (None, "y", "q", 8), ("b", "y", "p", 2)]


def test_mix_to_given_targets(session):
    wanted = {"source": {"a": 1, "b": 1, "gone": 5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.6, "q": 0.4}}
    got = raking.mix_sources(mixed_cells(session, CELLS), topic=F.col("kind"), targets=wanted, tolerance=1e-4, budget=330).collect()
    total = sum(r.n_tokens for r in got)
    chances = {(r.source, r.lang, r.topic): r.probability for r in got}
    tokens = Counter()
    for r in got:
        tokens[r.source, r.lang, r.topic] += r.n_tokens
    aims = [{"a": 0.46, "b": 0.46, None: 0.08}, {"x": 0.5, "y": 0.5}, {"p": 0.6, "q": 0.4}]
    weights = rake_plainly(tokens, aims, 400)
    factor = {c: w / tokens[c] for c, w in weights.items()}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(v * min(1, mid * factor[c]) for c, v in tokens.items()) < 330 else (lo, mid)
    assert total == 1100 and chances == pytest.approx({c: min(1, lo * f) for c, f in factor.items()}, abs=2e-3)
    assert max(chances.values()) == 1 and sum(r.probability * r.n_tokens for r in got) == pytest.approx(330)
    every = raking.mix_sources(mixed_cells(session, CELLS), topic=F.col("kind"), budget=5000).collect()
    assert all(r.probability == 1 and r.sampled for r in every)


def test_mix_with_targets_out_of_reach(session):
    """Each source has one language of its own, so the two can't have different shares."""
    docs = mixed_cells(session, [("a", "x", "p", 5), ("b", "y", "p", 5)])
    with pytest.raises(ValueError, match="largest marginal error is 0.[45]"):
        raking.mix_sources(docs, topic=F.col("kind"), targets={"source": {"a": 9, "b": 1}, "lang": {"x": 5, "y": 5}}, tolerance=1e-3)
    near = mixed_cells(session, [("a", "x", "p", 50), ("b", "y", "p", 50), ("a", "y", "p", 5), ("b", "x", "p", 5)])
    got = raking.mix_sources(near, topic=F.col("kind"), targets={"source": {"a": 6, "b": 4}, "lang": {"x": 5, "y": 5}}, tolerance=1e-3).collect()
    shares = Counter()
    for r in got:
        shares[r.source] += r.probability * r.n_tokens
    assert shares["a"] / sum(shares.values()) == pytest.approx(0.6, abs=2e-3)
    with pytest.raises(ValueError, match="no such"):
        raking.mix_sources(docs, targets={"author": {"a": 1}})
    with pytest.raises(ValueError, match="positive"):
        raking.mix_sources(docs, targets={"lang": {"x": 0}})
    assert raking.mix_sources(empty(session), targets={"lang": {"x": 1}}, tolerance=1e-6, budget=5).count() == 0


def test_mix_awkward(session):
    got = raking.mix_sources(awkward(session)).collect()
    cells = Counter()
    for r in got:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    targets = []
    for d in range(3):
        sums: Counter = Counter()
        for c, v in cells.items():
            sums[c[d]] += v
        total = sum(v**raking.FLATTEN for v in sums.values())
        targets.append({k: v**raking.FLATTEN / total for k, v in sums.items()})
    weights, total = rake_plainly(cells, targets, raking.ROUNDS), sum(cells.values())
    factor = {c: w / (cells[c] / total) for c, w in weights.items()}
    assert len(got) == len(ROWS)
    for r in got:
        chance = factor[r.source, r.lang, r.topic] / max(factor.values())
        number = int(hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.probability == pytest.approx(chance) and r.sampled == (number < chance)
    kept = raking.with_mix(awkward(session), raking.topic_of(F.col("text")), raking.tokens_of(F.col("text")), into="_mix")
    assert kept.columns == [*awkward(session).columns, "_mix"] and kept.where("topic = 'other'").count() == len(ROWS)
    assert raking.mix_sources(empty(session)).count() == 0


def test_mix_topics_and_words(session):
    cases = [
        ("a | b | c | d | e", "tabular", 10),
        ("one | two", "prose", 4),
        ("COPYRIGHT 1999", "legal", 3),
        ("Licensed Under the terms", "legal", 5),
        ("all rights reserved", "legal", 4),
        ("see http://x", "web", 3),
        ("write to me@host.org", "contact", 4),
        ("meet @ noon", "prose", 4),
        ("a ### b", "marked", 4),
        ("number 123456", "numeric", 3),
        ("stop!! now", "prose", 3),
        ("spaces      \t between\tand\r\nlines  ", "prose", 5),
        ("", "prose", 1),
        (None, "prose", 1),
    ]
    docs = session.createDataFrame([(k, t, "en", "s", 1) for k, (t, *_) in enumerate(cases)], SCHEMA)
    got = {r.doc_id: (r.topic, r.n_tokens) for r in raking.mix_sources(docs).collect()}
    assert got == {k: (topic, tokens) for k, (_, topic, tokens) in enumerate(cases)}


def test_mix_and_twin_with_nulls(session, tmp_path):
    awkward(session).select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.execute(raking.OP5_SQL.replace("select doc_id, source, lang, topic, n_tokens", "select doc_id, topic, n_tokens")).fetchall()
    got = raking.mix_sources(session.read.parquet(f"{tmp_path}/d")).select("doc_id", "topic", "n_tokens", F.round("probability", 6), "sampled").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def dimensions() -> dict:
    return {"length": F.length(F.coalesce("text", F.lit(""))), "source": F.crc32(F.coalesce("source", F.lit("")).cast("binary")), "id": F.col("doc_id")}


def shards_plainly(rows: list, shards: int, n: int) -> dict:
    """doc id and text -> leaf, splitting sorted lists of groups of equal texts at weighted medians."""
    bounds = [([r[f"d{k}"] for r in rows if r[f"d{k}"] is not None]) for k in range(n)]
    top = (1 << kdtree.CELL) - 1
    weight = max(1, int(sum(r["size"] for r in rows) / shards * kdtree.SLACK))

    def cell(values, k):
        lo, hi = min(bounds[k], default=0.0), max(bounds[k], default=0.0)
        known = [v for v in values if v is not None]
        return 0 if not known or hi == lo else int((min(known) - lo) * (top / (hi - lo)))

    groups = defaultdict(list)
    for r in rows:
        groups[r["h1"], r["h2"]].append(r)
    parts, out = [], {}
    for (h1, _), found in groups.items():
        cells = [cell([r[f"d{k}"] for r in found], k) for k in range(n)]
        pieces = defaultdict(list)
        for r in found:
            size = sum(x["size"] for x in found)
            pieces[r["dealt"] % -(-size // weight) if size > weight else 0].append(r)
        parts += [(cells, (h1 & 0xFFFFFFFF) << 16 | piece, members) for piece, members in pieces.items()]

    def split(part, leaves, first):
        if leaves == 1 or not part:
            out.update({(r["doc_id"], r["text_crc32"]): first for _, _, members in part for r in members})
            return
        wide = max(range(n), key=lambda k: max(p[0][k] for p in part) - min(p[0][k] for p in part))
        sizes = Counter()
        for cells, tie, members in part:
            sizes[cells[wide] << 48 | tie] += sum(r["size"] for r in members)
        want, seen = max(1, round(sum(sizes.values()) * (leaves // 2) / leaves)), 0
        for key in sorted(sizes):
            if seen + sizes[key] >= want:
                limit = key + (seen + sizes[key] - want <= want - seen)
                break
            seen += sizes[key]
        split([p for p in part if (p[0][wide] << 48 | p[1]) < limit], leaves // 2, first)
        split([p for p in part if (p[0][wide] << 48 | p[1]) >= limit], leaves - leaves // 2, first + leaves // 2)

    split(parts, shards, 0)
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(session, shards):
    family = [(k + 100, *r[1:]) for k, r in enumerate(near_family(n=90))]
    copies = [(k + 300, family[k % 7][1], "de" if k % 2 else None, f"s{k % 3}", 1) for k in range(40)]
    docs = awkward(session).select(*[c.split()[0] for c in SCHEMA.split(", ")]).unionByName(session.createDataFrame(family + copies, SCHEMA))
    got = kdtree.kd_shards(docs, dimensions(), shards=shards).collect()
    want = shards_plainly(kdtree.points(docs, dimensions()).withColumn("dealt", F.xxhash64("doc_id")).collect(), shards, 3)
    assert {(r.doc_id, r.text_crc32): r.shard for r in got} == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == docs.count()


def test_copies_share_a_shard(session):
    """A crowd of a third of all rows is divided among the shards it fills; light groups stay whole, whatever their metadata."""
    light = [(k, f"text {k % 400} " + "w" * (k % 400 % 50), ["en", "de", None][k % 3], f"s{k % 5}", 1) for k in range(1200)]
    crowd = [(k + 5000, "the same text again " * 2, ["en", "fr"][k % 2], f"s{k % 4}", 1) for k in range(600)]
    got = kdtree.kd_shards(session.createDataFrame(light + crowd, SCHEMA), dimensions(), shards=6).collect()
    sizes, shards_of = Counter(), defaultdict(set)
    for r in got:
        sizes[r.shard] += r["size"]
        shards_of[r.text_crc32].add(r.shard)
    crowds = [s for s in shards_of.values() if len(s) > 1]
    assert len(got) == 1800 and len(shards_of) == 401 and len(crowds) == 1 and len(crowds[0]) <= 4
    assert max(sizes.values()) - min(sizes.values()) <= 4 * kdtree.SLACK * sum(sizes.values()) / 6


def test_shards_reach_target_bytes(session, tmp_path):
    docs = session.createDataFrame(near_family(n=120), SCHEMA)
    placed = kdtree.kd_shards(clash(docs), dimensions(), target_bytes=8_000)
    sizes = Counter()
    for r in placed.collect():
        sizes[r.shard] += r["size"]
    largest = max(len(r[1]) + 1 for r in near_family(n=120))
    assert max(sizes.values()) <= 8_000 + 3 * largest and max(sizes.values()) - min(sizes.values()) <= 5 * largest
    kdtree.write_shards(docs, placed, f"{tmp_path}/shards")
    assert session.read.parquet(f"{tmp_path}/shards").count() == 120
    assert kdtree.kd_shards(empty(session), dimensions(), shards=4).count() == 0
