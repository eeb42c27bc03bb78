"""Merkle manifest of a dataset: a tree of eight-fold runs per language, and one over the languages' roots.

A tree is stored as aligned blocks of ``8 ** HEIGHT`` leaves. A block is one binary value that holds its nodes in the
van Emde Boas layout: the levels are split at half height, the upper part comes first, then each lower subtree in a
row, and every part is laid out in the same way. Where a node lies follows from its depth and index by arithmetic
alone, so building a block and fetching the siblings of a leaf touch few neighbouring bytes whatever the cache. The
roots of a tree's blocks are the leaves of its blocks one storey up, until one block is left.

Ranks of leaves come from ranges of ids and the counts of each range, so a language of any size is ranked, built and
proven by many tasks; a task holds one block at a time. Paths go down the storeys: a block's path is found once and
serves all its leaves.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.llm.common import by_id_text, read_table, written

ARITY = 8
#: Levels below a block's root.
HEIGHT = 4
DIGEST = 32
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def subtree(levels: int) -> int:
    """Nodes of a full tree of that many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Where the nodes of one depth (the root has 0) lie in the van Emde Boas layout of a tree of ``levels`` levels."""
    index = np.asarray(index, np.int64)
    place = np.zeros(index.shape, np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth, levels = depth - upper, levels - upper
        below = index // ARITY**depth
        place += subtree(upper) + below * subtree(levels)
        index = index - below * ARITY**depth
    return place


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes: int, whole: bool, height: int = HEIGHT) -> list[int]:
    """How many nodes each depth of a block has, the root first; a ``whole`` tree ends as soon as one node is left."""
    counts = [nodes]
    while len(counts) <= height and not (whole and counts[0] == 1):
        counts.insert(0, -(-counts[0] // ARITY))
    return counts


def lay_out(leaves: list[str], whole: bool, height: int = HEIGHT) -> bytes:
    """The nodes of a block over its leaves (hex digests) in the van Emde Boas layout."""
    counts = levels_of(len(leaves), whole, height)
    used = max(int(address(d, np.array([n - 1]), len(counts))[0]) for d, n in enumerate(counts)) + 1
    stored = np.zeros((used, DIGEST), np.uint8)
    row = leaves
    for depth in range(len(counts) - 1, -1, -1):
        stored[address(depth, np.arange(len(row)), len(counts))] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, DIGEST)
        row = [digest_of("".join(row[k : k + ARITY])) for k in range(0, len(row), ARITY)]
    return stored.tobytes()


def paths(stored: bytes, nodes: int, whole: bool, above: list[str], height: int = HEIGHT) -> list[list[str]]:
    """For each leaf of a block its path to the root: the text before and behind it in each run, then ``above``."""
    counts = levels_of(nodes, whole, height)
    grid = np.frombuffer(stored, np.uint8).reshape(-1, DIGEST)
    found = [above]
    for depth in range(1, len(counts)):
        text = grid[address(depth, np.arange(counts[depth]), len(counts))].tobytes().hex()
        names = [text[k : k + 2 * DIGEST] for k in range(0, len(text), 2 * DIGEST)]
        below = []
        for k in range(len(names)):
            run = k - k % ARITY
            below.append(["".join(names[run:k]), "".join(names[k + 1 : run + ARITY]), *found[k // ARITY]])
        found = below
    return found


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for k in range(0, len(path), 2):
        leaf = digest_of(path[k] + leaf + path[k + 1])
    return leaf


def leaf_of(values: dict[str, Column]) -> Column:
    """The digest of a row: each value as ``-`` if null, else its UTF-8 bytes, ``:`` and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with i, their rank (from 0) in their ``tree`` by ``order``, and n, the size of their tree.

    The rows are dealt by ranges of tree and order and numbered within each range; what precedes a range in its tree
    is a sum over the ranges' counts, of which there are as many as ranges and trees together.
    """
    sorted_rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = written(sorted_rows.select("*", F.spark_partition_id().alias("part"), at.alias("at")), "merkle-numbered")
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    starts = counts.select("tree", "part", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("start"), F.sum("here").over(of_tree).alias("n"))
    return numbered.join(starts, ["tree", "part"]).withColumn("i", F.col("start") + F.col("at")).drop("part", "at", "start")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of one tree and block each, in order; a block that batches part comes in several slices."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch.column("tree"), batch.column("block")
        new = pc.or_(pc.not_equal(tree[1:], tree[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts = [0, *(np.flatnonzero(np.asarray(new)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(lo, hi - lo)


def _build(height: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block from its leaves in order (tree, block, n, digest)."""
    name, held = None, []

    def made() -> pa.RecordBatch:
        tree, block, n = name
        nodes = lay_out([x.hex() for part in held for x in part.column("digest").to_pylist()], n <= ARITY**height, height)
        return pa.RecordBatch.from_pydict({"tree": [tree], "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64()), "nodes": pa.array([nodes], pa.binary())})

    for part in _runs(batches):
        mine = tuple(part.column(c)[0].as_py() for c in ("tree", "block", "n"))
        if mine != name and held:
            yield made()
            held = []
        name = mine
        held.append(part)
    if held:
        yield made()


BLOCK_FIELDS = "tree string, block long, n long, nodes binary"


def storeys(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The blocks of all trees over ``leaves`` (tree, i, n, digest), storey by storey; each is a written table."""
    size = ARITY**height
    most = leaves.agg(F.max("n")).first()[0] or 0
    found: list[DataFrame] = []
    while most:
        rows = leaves.select("tree", F.floor(F.col("i") / size).alias("block"), "i", "n", "digest")
        dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
        found.append(written(dealt.mapInArrow(functools.partial(_build, height), BLOCK_FIELDS), "merkle-blocks"))
        if most <= size:
            break
        most = -(-most // size)
        leaves = found[-1].where(F.col("n") > size).select("tree", F.col("block").alias("i"), F.ceil(F.col("n") / size).alias("n"), F.substr("nodes", F.lit(1), F.lit(DIGEST)).alias("digest"))
    return found


def roots(blocks: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree and digest of its root, from the storey where the tree has one block."""
    out = None
    for storey in blocks:
        top = storey.where(F.col("n") <= ARITY**height).select("tree", F.substr("nodes", F.lit(1), F.lit(DIGEST)).alias("digest"))
        out = top if out is None else out.unionByName(top)
    return out


def _paths_of(row: dict, height: int) -> tuple[int, list[list[str]]]:
    """The first leaf of a block's row and the paths of its leaves."""
    size = ARITY**height
    first = row["block"] * size
    return first, paths(row["nodes"], min(row["n"] - first, size), row["n"] <= size, row["path"], height)


def _down(height: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tree, i and path of all leaves of each block with its path; the leaves are blocks of the storey below."""
    for batch in batches:
        for row in batch.to_pylist():
            first, own = _paths_of(row, height)
            for k in range(0, len(own), 512):
                part = own[k : k + 512]
                yield pa.RecordBatch.from_pydict({"tree": [row["tree"]] * len(part), "i": pa.array(range(first + k, first + k + len(part)), pa.int64()), "path": pa.array(part, pa.list_(pa.string()))})


def with_paths(blocks: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """The lowest storey with each block's ``path``, given the path of each tree's root (tree, path).

    Also the paths of the leaves themselves (tree, i, path), for trees of few leaves.
    """
    leaf_paths = None
    for storey in reversed(blocks):
        top = storey.where(F.col("n") <= ARITY**height).join(above, "tree")
        if leaf_paths is not None:
            rest = storey.where(F.col("n") > ARITY**height).join(leaf_paths.withColumnRenamed("i", "block"), ["tree", "block"])
            top = top.unionByName(rest.select(top.columns))
        lowest = top
        leaf_paths = top.select("tree", "block", "n", "nodes", "path").mapInArrow(functools.partial(_down, height), "tree string, i long, path array<string>")
    return lowest, leaf_paths


@dataclasses.dataclass
class Manifest:
    """Written tables of a dataset's trees: the ranked leaves, the blocks by storey, and the same over the trees' roots."""

    leaves: DataFrame  # tree, i, n, doc_id, digest, changed (the leaf of the tampered row, or null)
    blocks: list[DataFrame]
    tops: DataFrame  # tree (always ""), i, n, name (a tree of the leaves), digest (its root)
    upper: list[DataFrame]
    root: bytes | None
    height: int = HEIGHT


def tree_name(group: Column) -> Column:
    """A tree's name, which sorts as its group does bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def build(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The trees over all rows of ``docs`` (doc_id, source, lang, n_chars, text), one per lang.

    Leaves ascend by doc_id (null first); rows that repeat an id are ordered by their digests. ``tampered`` says of
    which rows a changed leaf is kept too, that of the text with A-Z lower-cased.
    """
    values = {c: F.col(c) for c in LEAF_COLUMNS}
    lower = values | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    changed = F.when(F.lit(False) if tampered is None else tampered, leaf_of(lower))
    rows = docs.select(tree_name(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(values).alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("row"))
    leaves = written(ranked(written(rows, "merkle-leaves"), ["doc_id", "digest", "row"]).drop("row"), "merkle-ranked")
    blocks = storeys(leaves, height)
    if not blocks:
        return Manifest(leaves, [], leaves.limit(0), [], None, height)
    tops = written(roots(blocks, height).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-roots")
    tops = written(ranked(tops, ["name"]), "merkle-tops")
    upper = storeys(tops, height)
    return Manifest(leaves, blocks, tops, upper, bytes(roots(upper, height).first().digest), height)


def _prove(height: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of the leaves of each block, whose own row comes before theirs."""
    own, first = [], 0
    for part in _runs(batches):
        if part.column("i")[0].as_py() < 0:
            first, own = _paths_of(part.slice(0, 1).to_pylist()[0], height)
            part = part.slice(1)
        proofs, folded = [], []
        for i, leaf in zip(part.column("i").to_pylist(), pc.coalesce(part.column("changed"), part.column("digest")).to_pylist(), strict=True):
            path = own[i - first]
            proofs.append(digest_of("".join(path)))
            folded.append(fold(leaf.hex(), path))
        if proofs:
            kept = [part.column(c) for c in ("tree", "doc_id", "digest")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(proofs, pa.string()), pa.array(folded, pa.string())], ["tree", "doc_id", "digest", "proof_sha256", "folded_root"])


def prove(manifest: Manifest) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of the siblings on the way to the root; ``folded_root`` is what those siblings and
    the leaf of the row as it is now (the changed one, where it is kept) give, and ``verified`` whether that is the root.
    """
    fields = "tree string, doc_id long, digest binary, proof_sha256 string, folded_root string"
    if manifest.root is None:
        rows = manifest.leaves.select("tree", "doc_id", "digest", F.lit("").alias("proof_sha256"), F.lit("").alias("folded_root"))
        subroots = manifest.leaves.select(F.col("tree").alias("name"), F.col("digest").alias("subroot"))
    else:
        _, found = with_paths(manifest.upper, manifest.tops.select("tree", F.array().cast("array<string>").alias("path")).limit(1), manifest.height)
        above = found.join(manifest.tops.select("i", "name"), "i").select(F.col("name").alias("tree"), "path")
        lowest, _ = with_paths(manifest.blocks, written(above, "merkle-paths"), manifest.height)
        size = ARITY**manifest.height
        heads = lowest.select("tree", "block", F.lit(-1).cast("long").alias("i"), "n", "nodes", "path", *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("digest", "binary"), ("changed", "binary"))])
        members = manifest.leaves.select("tree", F.floor(F.col("i") / size).alias("block"), "i", "n", F.lit(None).cast("binary").alias("nodes"), F.lit(None).cast("array<string>").alias("path"), "doc_id", "digest", "changed")
        dealt = heads.unionByName(members).repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
        rows = dealt.mapInArrow(functools.partial(_prove, manifest.height), fields)
        subroots = manifest.tops.select("name", F.col("digest").alias("subroot"))
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    named = rows.join(subroots, rows["tree"] == subroots["name"])
    return named.select(
        "doc_id", F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), root.alias("root"),
        "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


def merkle_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Leaves, roots and proofs of all documents, every third one (by the crc32 of its id) tampered with.

    Any column may be null: a null is a leaf part of its own (``-``), null langs form the first tree, null ids come
    first and count as empty text for the choice of the tampered rows. Rows that repeat one another are leaves each.
    An empty table gives no rows; other columns are ignored.
    """
    return prove(build(docs, by_id_text(F.col("doc_id")) % 3 == 0, height))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return merkle_manifest(read_table(spark, sf_dir, "documents"))


#: Levels of eight-fold runs that the twin climbs: recursion ends by itself when one node is left.
OP11_SQL = """
with recursive raw as (
    select doc_id, source, lang, n_chars, text, cast(coalesce(cast(doc_id as varchar), '') as varchar) as id_text from documents
), crc as (
    select *, xor(list_reduce(list_transform(range(1, length(id_text) + 1), lambda k: cast(ascii(substr(id_text, k, 1)) as bigint)),
        lambda c, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::bigint), 4294967295::bigint) as crc
    from raw
), hashed as (
    select doc_id, lang, crc % 3 = 0 as tampered,
        sha256(concat(coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-'),
            coalesce(strlen(text) || ':' || text, '-'))) as leaf,
        sha256(concat(coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-'),
            coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) as lowered
    from crc
), leaves as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from hashed
), up as (
    select lang, 0 as level, i, n, leaf as digest from leaves
    union all
    select lang, level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by i))
    from up where n > 1 group by lang, level, i // 8
), subroots as (
    select lang, digest as subroot, row_number() over (order by encode(lang) nulls first) - 1 as i, count(*) over () as n from up where n = 1
), top as (
    select 0 as level, i, n, subroot as digest from subroots
    union all
    select level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by i)) from top where n > 1 group by level, i // 8
), runs as (
    select lang, level, i // 8 as run, list(digest order by i) as ds from up where n > 1 group by lang, level, i // 8
), top_runs as (
    select level, i // 8 as run, list(digest order by i) as ds from top where n > 1 group by level, i // 8
), climb as (
    select doc_id, lang, leaf, 0 as level, i, '' as proof, case when tampered then lowered else leaf end as folded, row_number() over () as id from leaves
    union all
    select c.doc_id, c.lang, c.leaf, c.level + 1, c.i // 8,
        c.proof || array_to_string(r.ds[1:c.i % 8], '') || array_to_string(r.ds[c.i % 8 + 2:], ''),
        sha256(array_to_string(r.ds[1:c.i % 8], '') || c.folded || array_to_string(r.ds[c.i % 8 + 2:], '')), c.id
    from climb c join runs r on r.lang is not distinct from c.lang and r.level = c.level and r.run = c.i // 8
), arrived as (
    select * from climb qualify level = max(level) over (partition by id)
), climb_top as (
    select a.doc_id, a.lang, a.leaf, s.subroot, 0 as level, s.i, a.proof, a.folded, a.id from arrived a join subroots s on a.lang is not distinct from s.lang
    union all
    select c.doc_id, c.lang, c.leaf, c.subroot, c.level + 1, c.i // 8,
        c.proof || array_to_string(r.ds[1:c.i % 8], '') || array_to_string(r.ds[c.i % 8 + 2:], ''),
        sha256(array_to_string(r.ds[1:c.i % 8], '') || c.folded || array_to_string(r.ds[c.i % 8 + 2:], '')), c.id
    from climb_top c join top_runs r on r.level = c.level and r.run = c.i // 8
), done as (
    select * from climb_top qualify level = max(level) over (partition by id)
)
select doc_id, leaf, subroot, (select digest from top where n = 1) as root, sha256(proof) as proof_sha256, folded as folded_root,
    folded = (select digest from top where n = 1) as verified
from done
"""
