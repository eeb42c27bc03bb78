"""Near duplicates by an LSH forest: documents sorted by several orders of one MinHash signature.

Texts with equal shingle sets become one node. Tree t reads a node's 128 minima from slot 4t on, round about; nodes
with a common prefix are neighbours in that order. A region is a prefix of four minima, and where more than
``REGION`` nodes share it, the shortest longer prefix that fewer share (at full depth hashed ids part it). A pair of
similarity 0.8 shares a four-minima prefix in at least one of the 32 trees but for one case in twenty million.

Inside a region pairs are judged by all 128 minima. Each pair belongs to the first tree in which its nodes share a
region, so no pair is looked at twice. First every region proposes a spanning forest of its likeliest pairs, which
are confirmed on the full sets; then all its other likely pairs whose nodes are still apart are confirmed in the
region itself. Pairs inside a component are never listed, so a family of thousands costs as many rows as members.
Last, the four-minima regions of more than ``REGION`` nodes, where they still have several components, are judged
whole. Those that share nodes are one crowd, so a node is dealt once and not once per tree: the nodes of a crowd go to
blocks, and every pair of blocks that isn't of one component is a task's work. Regions and blocks are bounded by the
shingles of their nodes too, so what a task holds doesn't grow with the texts (but for a single text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from watchloom.llm.common import pieces, read_table, utf8, written
from watchloom.llm.wordhash import shingle_hashes, word_hashes

TREES, WIDTH = 32, 4
SLOTS = TREES * WIDTH
#: Prefix lengths that a crowded region may grow to, and the nodes a region may have.
DEEPER, REGION = (6, 8, 12, 16, 24, 32), 1024
#: Shingles that the nodes of a region may have together.
WEIGHT = 4 << 20
#: Pairs below this estimate are not confirmed: 4.5 standard deviations under a similarity of 0.8.
LIKELY = 0.64

_RANDOM = np.random.Generator(np.random.PCG64(0xF0357))
_SEEDS = _RANDOM.integers(0, 2**32, SLOTS, np.uint32)[:, None]
_FACTORS = (_RANDOM.integers(0, 2**32, SLOTS, np.uint32) | np.uint32(1))[:, None]


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (column 1)."""
    shingles, at = shingle_hashes(*word_hashes(*utf8(batch.column(1))), words)
    for k in range(len(at) - 1):
        yield np.unique(shingles[at[k] : at[k + 1]])


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each of the 128 hash functions over a set."""
    low, out = (found >> np.uint64(32)).astype(np.uint32), None
    for k in range(0, len(low), 2048):
        part = (((low[k : k + 2048] ^ _SEEDS) * _FACTORS)).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return out


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (size of the shingle set), digest of the set, its minima and their lowest bytes (null for empty sets)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                sizes, digests, sigs, lows = [], [], [], []
                for found in _sets(part, words):
                    sig = minima(found)
                    sizes.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sigs.append(None if sig is None else sig.tobytes())
                    lows.append(None if sig is None else sig.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(lows, pa.binary())], ["doc_id", "n", "digest", "sig", "low"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n int, digest binary, sig binary, low binary")


def regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, t and the key of its region, for every region of two nodes or more; the same for the crowded prefixes."""
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    prefix = F.transform(trees, lambda t: F.xxhash64(t, F.substr("sig", t * (4 * WIDTH) + 1, F.lit(4 * WIDTH))))
    rows = nodes.select("node", "n", F.posexplode(prefix).alias("t", "key"))
    measures = F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")
    shared = written(rows.join(rows.groupBy("key").agg(*measures).where("size > 1"), "key"), "forest-shared")
    small = (F.col("size") <= REGION) & (F.col("weight") <= WEIGHT)
    around = F.concat("sig", "sig")
    longer = F.transform(
        F.array(*[F.lit(d) for d in DEEPER]),
        lambda d: F.struct(d.alias("depth"), F.xxhash64("t", d, F.substr(around, 4 * WIDTH * F.col("t") + 1, 4 * d)).alias("key")),
    )
    deep = shared.where(~small).select("node", "t").join(nodes.select("node", "n", "sig"), "node")
    deep = deep.select("node", "n", "t", F.explode(longer).alias("p")).select("node", "n", "t", "p.depth", "p.key")
    fits = deep.join(deep.groupBy("key").agg(*measures), "key").where(small | (F.col("depth") == DEEPER[-1]))
    chosen = fits.groupBy("node", "t").agg(F.min(F.struct("depth", "key", "size", "weight")).alias("p")).select("node", "t", "p.key", "p.size", "p.weight").where("size > 1")
    part = F.pmod(F.xxhash64("node", "t"), F.ceil(F.greatest(F.col("size") / REGION, F.col("weight") / WEIGHT)))
    parted = chosen.select("node", "t", F.when(~small, F.xxhash64("key", part)).otherwise(F.col("key")).alias("key"))
    crowded = shared.where(~small).select("node", "t", "key")
    return shared.where(small).select("node", "t", "key").unionByName(parted), crowded


def short_keys(placed: DataFrame) -> DataFrame:
    """node, regions (the key of its region in each tree or 0) and keys (31 bits of each)."""
    at = placed.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("t", "key"))).alias("at"))  # 32 entries at most
    own = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.element_at("at", t), F.lit(0)))
    short = F.transform("regions", lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int"))
    return at.select("node", own.alias("regions")).withColumn("keys", short)


def crowds_of(crowded: DataFrame) -> DataFrame:
    """node and crowd: crowded regions that share nodes, directly or through others, are one crowd."""
    hubs = crowded.groupBy("key").agg(F.min("node").alias("hub"))
    links = crowded.join(hubs, "key").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    return components(links).withColumnRenamed("component", "crowd")


def block_pairs(crowds: DataFrame, labels: DataFrame) -> DataFrame:
    """key (of a pair of blocks), side, node and label: the work that crowds of several components leave.

    ``crowds`` has node, n and crowd. A component of a block's size or more has blocks of its own, the others share
    blocks. Every two blocks of a crowd meet, and each meets itself, unless all their nodes are of one component; a
    pair of blocks has about 3/4 of REGION and WEIGHT.
    """
    block, heavy = max(1, REGION * 3 // 8), max(1, WEIGHT * 3 // 8)
    here = written(crowds.join(labels, "node", "left").select("crowd", "node", "n", F.coalesce("component", "node").alias("label")), "forest-crowded")
    sizes = here.groupBy("crowd", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    blocks = lambda size, weight: F.ceil(F.greatest(size / block, weight / heavy))
    alone = (F.col("size") >= block) | (F.col("weight") >= heavy)
    rest = [F.sum(F.when(~alone, F.col(c))).alias(f"rest_{c}") for c in ("size", "weight")]
    mixed = sizes.groupBy("crowd").agg(F.count(F.lit(1)).alias("labels"), *rest).where("labels > 1")
    plan = sizes.join(mixed, "crowd").select(
        "crowd", "label", F.when(alone, F.col("label")).alias("only"),
        F.when(alone, blocks(F.col("size"), F.col("weight"))).otherwise(blocks(F.col("rest_size"), F.col("rest_weight"))).alias("blocks"))
    part = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = here.join(plan, ["crowd", "label"]).select("crowd", "node", "label", "only", F.xxhash64("crowd", F.col("only").isNull(), "only", part).alias("block"))
    dealt = written(dealt, "forest-dealt")
    kinds = dealt.groupBy("crowd", "block").agg(F.first("only").alias("only"))
    one, two = kinds.select("crowd", F.col("block").alias("a"), F.col("only").alias("x")), kinds.select("crowd", F.col("block").alias("b"), F.col("only").alias("y"))
    pairs = one.join(two, "crowd").where((F.col("a") <= F.col("b")) & F.coalesce(F.col("x") != F.col("y"), F.lit(True)))
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    met = pairs.select(F.xxhash64("crowd", "a", "b").alias("pair"), F.posexplode(ends).alias("side", "block"))
    return dealt.join(met, "block").select(F.col("pair").alias("key"), "side", "node", "label")


class _Region:
    """The nodes of one region and its likely pairs; with ``split``, those of a node before it and one behind it only.

    Pairs are those that share their first region in tree ``t``; without a tree, those that share a region in any.
    """

    def __init__(self, t: int | None, node: np.ndarray, n: np.ndarray, low: np.ndarray, keys: np.ndarray, similarity: float, split: int = 0):
        self.node, first, second, score = node, [], [], []
        for k in range(0, split or len(node), 64):
            at, end = split or k, min(k + 64, split or len(node))
            same = (low[k:end, None, :] == low[None, at:, :]).sum(axis=2, dtype=np.int32)
            value = (same / SLOTS - 1 / 256) / (1 - 1 / 256)
            small, large = np.minimum(n[k:end, None], n[None, at:]), np.maximum(n[k:end, None], n[None, at:])
            a, b = np.nonzero((value >= LIKELY) & (small >= similarity * large - 1e-9))
            ahead = b + at > a + k
            a, b = a[ahead], b[ahead]
            score.append(value[a, b]), first.append(a + k), second.append(b + at)
        a, b, score = np.concatenate(first), np.concatenate(second), np.concatenate(score)
        shared = (keys[a] == keys[b]) & (keys[a] != 0)
        own = shared.any(axis=1) if t is None else shared.argmax(axis=1) == t
        a, b, score = a[own], b[own], score[own]
        order = np.argsort(-score, kind="stable")
        self.a, self.b = a[order], b[order]


class _Union:
    def __init__(self, labels: np.ndarray):
        self.up = labels.tolist()

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def _by_region(work: Callable[[pa.Table], list[dict]], shape: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Feed ``work`` the rows of one key at a time from partitions sorted by key; a region's rows are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows: list[dict] = []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if held and held[0].column(0)[0].as_py() != keys[0]:
                rows += work(pa.Table.from_batches(held))
                held = []
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(keys)), strict=True):
                held.append(batch.slice(lo, hi - lo))
                if hi < len(keys):
                    if len(held) > 1 or hi - lo > 1:
                        rows += work(pa.Table.from_batches(held))
                    held = []
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, shape)
                rows = []
        if held:
            rows += work(pa.Table.from_batches(held))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)

    return run


def _read(table: pa.Table, similarity: float) -> _Region:
    """The region in columns key, t, node, n, low, keys, or the two blocks that column side (in place of t) tells apart."""
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, SLOTS)
    keys = pa.concat_arrays(table.column("keys").chunks).flatten().to_numpy().reshape(-1, TREES)
    sides = table.column("side").to_numpy() if "side" in table.column_names else np.zeros(1, np.int32)
    split = int(np.searchsorted(sides, 1)) if sides[-1] else 0
    return _Region(table.column("t")[0].as_py() if "t" in table.column_names else None, table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.int64), low, keys, similarity, split)


def _similar(inter: int, a: int, b: int, similarity: float) -> bool:
    return 100 * inter >= round(100 * similarity) * (a + b - inter)


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node it can reach) of all nodes in ``links`` (a, b).

    Large and small stars in turn, each round a written table, until nothing changes; every step is an aggregate or
    a join in which a node with very many links is one row on the other side.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = Observation()
        marks = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")
        edges = written(moved.unionByName(root.select("u", F.col("m").alias("v"))).where("u <> v").distinct().observe(found, *marks), "forest-stars")
        if found.get == mark:
            break
        mark = found.get
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked whose sets of ``words``-word shingles (A-Z lower-cased) have at least that Jaccard
    similarity (whole hundredths). ``component_id`` is the least id that links reach, ``kept`` marks that document.
    A text of fewer words is one shingle; null, empty and blank texts have none and link with nothing. Rows that
    repeat an id belong together, whatever their texts, and so does what each of these texts links with. Rows without an id can't be named as a component's document: they
    have no component and are kept. Other columns are ignored, and an empty table gives no rows.
    """
    signed = written(signatures(docs, words, id_col, text_col), "forest-signed")
    some = signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sig", "low")).alias("x"))
    # A set's node is a number of its own: an id with several texts may be the least one of several sets.
    nodes = written(some.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("x.doc_id").alias("least"), "x.n", "x.sig", "x.low"), "forest-nodes")
    texts_of = signed.where("n > 0 and doc_id is not null").select("doc_id", "digest").distinct()
    several = texts_of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets"), F.min("digest").alias("first")).where("sets > 1")
    named = nodes.select("node", "digest")
    repeated = texts_of.join(several, "doc_id").join(named, "digest").join(named.select(F.col("node").alias("a"), F.col("digest").alias("first")), "first")
    repeated = written(repeated.select("a", F.col("node").alias("b")), "forest-repeated")

    placed, crowded = regions(nodes)
    members = written(short_keys(placed).join(nodes.select("node", "n", "low"), "node"), "forest-members")
    spread = members.select("node", "n", "low", "keys", F.posexplode("regions").alias("t", "key")).where("key <> 0")
    spread = spread.select("key", "t", "node", "n", "low", "keys")

    pair = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def propose(table: pa.Table) -> list[dict]:
        region, key = _read(table, similarity), table.column(0)[0].as_py()
        union, out = _Union(np.arange(len(region.node))), []
        for a, b in zip(region.a.tolist(), region.b.tolist(), strict=True):
            if union.join(a, b):
                out.append({"key": key, "a": int(region.node[a]), "b": int(region.node[b])})
                if len(out) == len(region.node) - 1:
                    break
        return out

    ordered = spread.repartition("key").sortWithinPartitions("key", "node")
    proposed = written(ordered.mapInArrow(_by_region(propose, pair), "key long, a long, b long"), "forest-proposed")

    # Full sets of the nodes that any likely pair has.
    ends = proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least", "digest"), "node")
    ends = written(ends, "forest-ends")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                found = list(_sets(part, words))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
                at = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "digest", "items"])

    def full_sets(ends: DataFrame) -> DataFrame:
        """node and items of the nodes in ``ends`` (node, least, digest)."""
        wanted = texts.join(ends.select(F.col("least").alias("doc_id")), "doc_id", "left_semi")
        made = wanted.mapInArrow(collect, "doc_id long, digest binary, items array<long>")
        full = made.join(ends, (F.col("doc_id") == F.col("least")) & (made["digest"] == ends["digest"])).select("node", "items").dropDuplicates(["node"])
        return written(full, "forest-sets")

    sets = full_sets(ends)

    one, two = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = both * 100 >= (F.size("x") + F.size("y") - both) * F.lit(round(100 * similarity))
    links = written(proposed.select("a", "b").join(one, "a").join(two, "b").where(enough).select("a", "b").unionByName(repeated), "forest-links")
    labels = components(links)

    # Likely pairs that are still apart, confirmed in their regions.
    live = spread.join(proposed.select("key").distinct(), "key", "left_semi").join(ends.select("node"), "node", "left_semi")
    live = live.join(labels, "node", "left").select("key", "t", "node", "n", "low", "keys", F.coalesce("component", "node").alias("label"))

    def apart(table: pa.Table) -> tuple[_Region, np.ndarray, np.ndarray]:
        region = _read(table, similarity)
        label = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        return region, label, label[region.a] != label[region.b]

    def flag(table: pa.Table) -> list[dict]:
        region, _, cross = apart(table)
        key = table.column(0)[0].as_py()
        return [{"key": key, "node": int(region.node[k])} for k in np.unique(np.concatenate([region.a[cross], region.b[cross]]))]

    def confirm(table: pa.Table) -> list[dict]:
        region, label, cross = apart(table)
        union, out = _Union(np.arange(len(region.node))), []
        items = [table.column("items")[k].values.to_numpy().view(np.uint64) for k in range(table.num_rows)]
        a, b = region.a[cross], region.b[cross]
        for k in np.unique(a).tolist():
            others = [o for o in b[a == k].tolist() if union.find(int(label[o])) != union.find(int(label[k]))]
            if not others:
                continue
            flat, mine = np.concatenate([items[o] for o in others]), items[k]
            spot = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            sizes = np.array([len(items[o]) for o in others])
            inter = np.add.reduceat(mine[spot] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
            for o, i in zip(others, inter.tolist(), strict=True):
                if _similar(i, len(mine), len(items[o]), similarity) and union.join(int(label[o]), int(label[k])):
                    out.append({"key": 0, "a": int(region.node[k]), "b": int(region.node[o])})
        return out

    sorted_live = live.repartition("key").sortWithinPartitions("key", "node")
    flagged = written(sorted_live.mapInArrow(_by_region(flag, pa.schema([("key", pa.int64()), ("node", pa.int64())])), "key long, node long"), "forest-apart")
    again = live.join(flagged, ["key", "node"]).join(sets, "node").select("key", "t", "node", "n", "low", "keys", "label", "items")
    more = again.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_by_region(confirm, pair), "key long, a long, b long")
    links = written(links.unionByName(more.select("a", "b")), "forest-linked")
    labels = components(links)

    # Crowds in which components are still apart, block by block.
    if not crowded.isEmpty():
        crowds = crowds_of(crowded).join(nodes.select("node", "n", "low"), "node").join(short_keys(crowded).select("node", "keys"), "node")
        crowds = written(crowds, "forest-crowds")
        met = block_pairs(crowds, labels).join(crowds.drop("crowd"), "node").select("key", "side", "node", "n", "low", "keys", "label")
        sorted_met = written(met, "forest-blocks").repartition("key").sortWithinPartitions("key", "side", "node")
        flagged = written(sorted_met.mapInArrow(_by_region(flag, pa.schema([("key", pa.int64()), ("node", pa.int64())])), "key long, node long"), "forest-crowd-apart")
        ends = written(flagged.select("node").distinct().join(nodes.select("node", "least", "digest"), "node"), "forest-crowd-ends")
        again = sorted_met.join(flagged, ["key", "node"]).join(full_sets(ends), "node").select("key", "side", "node", "n", "low", "keys", "label", "items")
        more = again.repartition("key").sortWithinPartitions("key", "side", "node").mapInArrow(_by_region(confirm, pair), "key long, a long, b long")
        labels = components(links.unionByName(more.select("a", "b")))

    found = nodes.select("digest", "node", "least").join(labels, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    named = found.join(found.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("digest", "component_id")
    out = signed.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"), words=4)
