"""Shards as leaves of a k-d tree, split at weighted medians until they reach the target bytes.

The points of the tree are groups of equal texts, with the least metadata of their rows, so that copies share a shard.
A group heavier than a documented part of a shard is dealt by hashed ids to pieces of that size, which lie next to each
other. Each level splits all open nodes at once: the widest dimension of each node is an aggregate, and its weighted
median is found digit by digit from histograms of a 63-bit key (15 bits of the dimension, 32 hashed bits of the text
that part equal values, 16 bits of the piece), so no node is sorted or gathered and a value that holds a third of all
rows is split like any other. Only one row per node comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.llm.common import read_table, written

#: Bits of a histogram's digit; digits of a key; bits of a dimension in it, so that keys are not negative.
DIGIT, DIGITS, CELL = 16, 4, 15
#: The part of a shard's bytes up to which a group of equal texts is not divided.
SLACK = 1 / 32
#: Rows that are numbered together.
RUN_ROWS = 1024


@dataclass
class Node:
    """An open or finished box: its bytes, how many leaves it becomes, and the dimension and key it is split at."""

    shards: int
    size: int
    first: int
    dimension: int = -1
    limit: int = 0


def points(docs: DataFrame, dimensions: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, a 128-bit hash of the text and one double per dimension of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("kd"), text).alias("h2"),
        *[c.cast("double").alias(f"d{k}") for k, c in enumerate(dimensions.values())],
    )


def _piece(pieces: Column) -> Column:
    """The piece of its group that a row belongs to; rows that equal in id and text share it."""
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), pieces), F.lit(0).cast("long"))


def kd_shards(docs: DataFrame, dimensions: dict[str, Column], target_bytes: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and one), text_crc32, shard, slot (gapless from 0 in its shard).

    Give ``target_bytes`` (then there are as many leaves as the total asks for) or the number of ``shards``. A node
    of k leaves is split so that its halves hold bytes in the proportion of their leaves, to within half a piece.
    Rows of equal text share a shard while they weigh no more than ``slack`` of one; heavier groups are divided where
    a split needs it, into pieces of about that weight (65,536 at most) that hold rows equal in id and text together.
    Null texts equal empty ones and have size 1, null ids are ids, null values count as least, other columns are
    ignored; with fewer pieces than leaves some leaves are empty, and an empty table gives no rows.
    """
    if (target_bytes is None) == (shards is None):
        raise ValueError("give target_bytes or shards")
    n = len(dimensions)
    rows = written(points(docs, dimensions, id_col, text_col), "kd-points")
    bounds = rows.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), *[f(f"d{k}").alias(f"{f.__name__}{k}") for k in range(n) for f in (F.min, F.max)]).first()
    total = bounds["size"] or 0
    leaves = shards if shards is not None else max(1, -(-total // target_bytes))
    cells = []
    for k in range(n):
        lo, hi = bounds[f"min{k}"], bounds[f"max{k}"]
        scale = 0.0 if lo is None or hi == lo else ((1 << CELL) - 1) / (hi - lo)
        cells.append(F.coalesce(F.floor((F.col(f"d{k}") - F.lit(lo or 0.0)) * F.lit(scale)), F.lit(0)).cast("long"))
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("size"), *[F.min(f"d{k}").alias(f"d{k}") for k in range(n)])
    groups = written(groups.select("h1", "h2", "size", F.array(*cells).alias("cells")), "kd-groups")
    weight = max(1, int(total / leaves * slack))
    # The groups above weight are no more than leaves / slack, since their bytes add up to the total at most.
    heavy = groups.where(F.col("size") > weight).select("h1", "h2", "cells", F.least(F.ceil(F.col("size") / weight), F.lit(1 << DIGIT)).cast("long").alias("pieces"))
    dealt = rows.join(F.broadcast(heavy), ["h1", "h2"]).withColumn("piece", _piece(F.col("pieces")))
    parts = dealt.groupBy("h1", "h2", "piece", "cells").agg(F.sum("size").alias("size"))
    light = groups.where(F.col("size") <= weight).withColumn("piece", F.lit(0).cast("long"))
    tree = written(light.unionByName(parts), "kd-pieces")
    tie = F.shiftleft(F.col("h1").bitwiseAND(0xFFFFFFFF), DIGIT).bitwiseOR(F.col("piece"))
    tree = tree.select("h1", "h2", "piece", "size", tie.alias("tie"), "cells", F.lit(0).alias("node"))
    nodes = [Node(leaves, total, 0)]
    while any(x.shards > 1 for x in nodes):
        nodes, tree = _split(nodes, tree, n)
    first = F.array(*[F.lit(x.first) for x in nodes])
    placed = tree.select("h1", "h2", "piece", F.element_at(first, F.col("node") + 1).alias("shard"))
    named = rows.select("doc_id", "size", "text_crc32", "h1", "h2").join(F.broadcast(heavy.select("h1", "h2", "pieces")), ["h1", "h2"], "left")
    named = named.withColumn("piece", _piece(F.col("pieces"))).join(placed, ["h1", "h2", "piece"])
    return _number(named.select("doc_id", "size", "text_crc32", "shard"), leaves, bounds["rows"])


def _split(nodes: list[Node], rows: DataFrame, n: int) -> tuple[list[Node], DataFrame]:
    """Halve every node of several leaves; the two parts of node k become 2k and 2k + 1."""
    open_ = rows.where(F.element_at(F.array(*[F.lit(x.shards > 1) for x in nodes]), F.col("node") + 1))
    spread = open_.groupBy("node").agg(*[(F.max(F.col("cells")[k]) - F.min(F.col("cells")[k])).alias(f"s{k}") for k in range(n)])
    for row in spread.collect():
        nodes[row["node"]].dimension = max(range(n), key=lambda k: row[f"s{k}"])
    dimension = F.element_at(F.array(*[F.lit(max(x.dimension, 0)) for x in nodes]), F.col("node") + 1)
    key = F.shiftleft(F.element_at("cells", dimension + 1), DIGIT * (DIGITS - 1)).bitwiseOR(F.col("tie"))
    keyed = rows.withColumn("key", key)
    prefix, below = [0] * len(nodes), [0] * len(nodes)
    for level in reversed(range(DIGITS)):
        shift = DIGIT * level
        # The top digit has no prefix; a shift by all 64 bits would be one by none.
        mine = F.lit(True) if level == DIGITS - 1 else F.shiftright("key", shift + DIGIT) == F.element_at(F.array(*[F.lit(p).cast("long") for p in prefix]), F.col("node") + 1)
        live = keyed.where(F.element_at(F.array(*[F.lit(x.shards > 1) for x in nodes]), F.col("node") + 1) & mine)
        bins = live.groupBy("node", F.shiftright("key", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        need = F.element_at(F.array(*[F.lit(_left_bytes(x) - b).cast("long") for x, b in zip(nodes, below, strict=True)]), F.col("node") + 1)
        found = bins.withColumn("upto", upto).where((F.col("upto") >= need) & (F.col("upto") - F.col("size") < need))
        for row in found.collect():
            k = row["node"]
            prefix[k] = prefix[k] << DIGIT | row["digit"]
            lower = below[k] + row["upto"] - row["size"]
            if level:
                below[k] = lower
            else:  # the one key that crosses goes to the side that leaves less over
                want, upper = _left_bytes(nodes[k]), below[k] + row["upto"]
                takes = upper - want <= want - lower
                nodes[k].limit, below[k] = prefix[k] + takes, upper if takes else lower
    limit = F.element_at(F.array(*[F.lit(x.limit).cast("long") for x in nodes]), F.col("node") + 1)
    splits = F.element_at(F.array(*[F.lit(x.shards > 1) for x in nodes]), F.col("node") + 1)
    right = F.when(splits & (F.col("key") >= limit), 1).otherwise(0)
    out = keyed.withColumn("node", (F.col("node") * 2 + right).cast("int")).drop("key")
    parts = []
    for x, b in zip(nodes, below, strict=True):
        left = x.shards // 2
        if x.shards > 1:
            parts += [Node(left, b, x.first), Node(x.shards - left, x.size - b, x.first + left)]
        else:
            parts += [x, Node(0, 0, x.first)]
    return parts, out


def _left_bytes(node: Node) -> int:
    """Bytes that belong left of the split, at least one so that some key reaches them."""
    return max(1, round(node.size * (node.shards // 2) / node.shards)) if node.shards > 1 else 0


def _number(rows: DataFrame, leaves: int, count: int) -> DataFrame:
    """Slots: runs of hashed ids are counted, then numbered inside from where the runs before them end."""
    runs = max(1, count // (leaves * RUN_ROWS))
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)))
    counts = dealt.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("place", place).join(starts, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", rows_per_file: int = 100_000) -> None:
    """Write the documents under ``path``/shard=k, in files of so many slots."""
    file = F.floor(F.col("slot") / rows_per_file)
    joined = docs.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot").dropDuplicates([id_col]), id_col)
    joined.repartition("shard", file).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_kd_shards(spark, sf_dir: str) -> DataFrame:
    """Sixteen leaves over length, source, language and id."""
    docs = read_table(spark, sf_dir, "documents")
    dimensions = {
        "length": F.log1p(F.octet_length(F.coalesce("text", F.lit("")))),
        "source": F.crc32(F.coalesce("source", F.lit("")).cast("binary")),
        "lang": F.crc32(F.coalesce("lang", F.lit("")).cast("binary")),
        "id": F.col("doc_id"),
    }
    return kd_shards(docs, dimensions, shards=16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
