"""Population anomalies (extended isolation forest) and beacon scoring."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from watchloom.functions.columns import div_floor, explode_once, fixed, held
from watchloom.operators.sequence import sequence, with_predecessors
from watchloom.session import cut

FEATURES = ["cpu_pct", "ram_pct", "net_in_delta", "net_out_delta", "event_count", "auth_failures", "interval_ms"]

# Forest, scoring and beacon defaults.
TREES = 64
SUBSAMPLE = 256
WARMUP_ROWS = 128
POOL_ROWS = 2048
SCORE_THRESHOLD = 0.65
CRITICAL_SCORE = 0.85
HIGH_SCORE = 0.75
EULER_GAMMA = 0.5772156649
BEACON_WINDOW = 64
BEACON_MIN_SAMPLES = 12
BEACON_MAX_JITTER = 0.15
BEACON_MIN_AUTOCORR = 0.35


def anomaly_features(rows: DataFrame) -> DataFrame:
    """Add the seven-number feature vector; a first report has no deltas and drops out."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES]
    return rows.filter(F.col("interval_ms").isNotNull()).withColumn("features", F.array(*values))


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe)


NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("left_id", T.IntegerType()),
    T.StructField("right_id", T.IntegerType()),
    T.StructField("rows", T.IntegerType()),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("normal", T.ArrayType(T.DoubleType())),
])


def _grow_tree(tree_id: int, sample: np.ndarray, seed: int, max_depth: int) -> list[tuple]:
    """Nodes of one tree, breadth first: random hyperplanes until rows are alone."""
    rng = np.random.default_rng([seed, tree_id])
    nodes: list[tuple] = []
    level = [(0, sample, 0)]
    next_id = 1
    while level:
        node_id, rows, depth = level.pop(0)
        split = None
        if len(rows) > 1 and depth < max_depth:
            normal = rng.normal(size=rows.shape[1])
            normal /= max(np.linalg.norm(normal), 1e-6)
            side = rows @ normal
            lo, hi = side.min(), side.max()
            if hi - lo >= 1e-9:
                intercept = rng.uniform(lo, hi)
                left = side < intercept
                if left.any() and not left.all():
                    split = (normal, intercept, rows[left], rows[~left])
        if split is None:
            nodes.append((tree_id, node_id, -1, -1, len(rows), 0.0, []))
            continue
        normal, intercept, left_rows, right_rows = split
        nodes.append((tree_id, node_id, next_id, next_id + 1, len(rows), float(intercept), normal.tolist()))
        level += [(next_id, left_rows, depth + 1), (next_id + 1, right_rows, depth + 1)]
        next_id += 2
    return nodes


_PRIME = 2**31 - 1


def _row_number(order: Sequence[str]) -> Column:
    """32 bits of a digest of the row."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order])), F.lit(1), F.lit(8)), 16, 10).cast("long")


def _maps(trees: int, seed: int) -> list[tuple[int, int]]:
    """Factor and shift of each tree."""
    digests = [hashlib.md5(f"{seed}:{t}".encode()).hexdigest() for t in range(trees)]
    return [(int(d[:7], 16) + 1, int(d[7:14], 16)) for d in digests]


def _draws(trees: int, seed: int, row: Column) -> Column:
    """For each tree a number in [0, 2**31 - 1) of a row: an affine map, drawn for the tree, of one digest of the row."""
    return F.array(*[F.struct(F.lit(t).alias("tree_id"), ((row * a + b) % _PRIME).alias("_h")) for t, (a, b) in enumerate(_maps(trees, seed))])


def tree_samples(
    rows: DataFrame, trees: int, subsample: int, seed: int, order: Sequence[str] = ("timestamp_ms", "event_id"),
) -> DataFrame:
    """tree_id, _h and features of the rows each tree grows from: those of its ``subsample`` least draws over all rows.

    A row enters a tree's draw if its number is under twice the share that the tree needs, so a tree ranks about
    2 x subsample rows however many there are.
    """
    share = min(1.0, 2.0 * subsample / max(1, rows.count()))
    # The digest is computed once per row, not once per tree.
    numbered = held(rows.select("features", *order), _row=_row_number(order))
    found = F.filter(_draws(trees, seed, F.col("_row")), lambda x: x["_h"] <= int(share * _PRIME))
    drawn = explode_once(numbered, ["features", *order], found, "_d").select("_d.tree_id", "_d._h", *order, "features")
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy("_h", *order))
    return drawn.withColumn("_place", place).filter(F.col("_place") <= subsample)


def train_forest(
    rows: DataFrame,
    *,
    trees: int = TREES,
    subsample: int = SUBSAMPLE,
    seed: int = 7,
    order: Sequence[str] = ("timestamp_ms", "event_id"),
) -> DataFrame:
    """Node table of an extended isolation forest.

    Each tree draws its rows from all rows by a seeded hash. Draws depend on (seed, tree, row) alone and each tree
    grows in its own group, so the same forest comes out however the data is partitioned.
    """
    max_depth = math.ceil(math.log2(max(2, subsample)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        if len(pdf) < 2:
            return pd.DataFrame(columns=NODE_SCHEMA.names)
        sample = np.array(pdf["features"].tolist(), dtype=float)
        return pd.DataFrame(_grow_tree(int(pdf["tree_id"].iloc[0]), sample, seed, max_depth),
                            columns=NODE_SCHEMA.names)

    return tree_samples(rows, trees, subsample, seed, order).groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA)


def _laid_out(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A tree to descend without asking for leaves: a leaf is its own child and knows its path length."""
    n = len(tree["left"])
    inner = tree["left"] >= 0
    child = np.stack([np.where(inner, tree[side], np.arange(n)) for side in ("right", "left")], axis=1).ravel()
    depth = np.zeros(n)
    level, steps = np.array([0]), 0
    while len(level := level[inner[level]]):
        level = np.concatenate([tree["left"][level], tree["right"][level]])
        steps += 1
        depth[level] = steps
    return {"child": child, "normal": tree["normal"], "intercept": tree["intercept"],
            "path": depth + average_path(tree["rows"]), "steps": steps}


def _path_lengths(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Path length of every row in one tree: all rows descend a level at a time."""
    tree = _laid_out(tree)
    at = np.zeros(len(x), dtype=np.int64)
    for _ in range(tree["steps"]):
        goes_left = np.einsum("ij,ij->i", x, tree["normal"].take(at, axis=0)) < tree["intercept"].take(at)
        at = tree["child"].take(2 * at + goes_left)
    return tree["path"].take(at)


def score_forest(rows: DataFrame, forest: DataFrame, subsample: int = SUBSAMPLE) -> DataFrame:
    """Add ``score`` in [0, 1]; above one half is more anomalous than average.

    A forest has at most trees x 2 x subsample nodes, whatever the data, so its
    node table is small enough to travel with the task; rows stay where they are.
    """
    nodes = forest.orderBy("tree_id", "node_id").toPandas()
    trees = []
    for _, t in nodes.groupby("tree_id", sort=True):
        width = max((len(v) for v in t["normal"]), default=0)
        trees.append({
            "left": t["left_id"].to_numpy(), "right": t["right_id"].to_numpy(),
            "rows": t["rows"].to_numpy(), "intercept": t["intercept"].to_numpy(),
            "normal": np.array([list(v) or [0.0] * width for v in t["normal"]], dtype=float).reshape(len(t), width),
        })
    scale = float(average_path(subsample))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for features in batches:
            if not trees or not len(features):
                yield pd.Series(np.zeros(len(features)))
                continue
            x = np.array(features.tolist(), dtype=float)
            paths = sum(_path_lengths(x, t) for t in trees) / len(trees)
            yield pd.Series(2.0 ** (-paths / scale))

    return rows.withColumn("score", score("features"))


def forest_findings(scored: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Rows whose score passes the threshold, with severity and the technique their features suggest."""
    s = F.col("score")
    x = lambda name: F.col("features")[FEATURES.index(name)]
    exfil = (x("net_out_delta") > x("net_in_delta") * 2.0) & (x("net_out_delta") > 1e6)
    hijack = (x("cpu_pct") > 80.0) & (x("ram_pct") > 70.0)
    brute = x("auth_failures") > 3.0
    evidence = F.concat(
        F.lit("cpu="), fixed(x("cpu_pct"), 1), F.lit("% ram="), fixed(x("ram_pct"), 1), F.lit("% net_in="),
        fixed(x("net_in_delta"), 0), F.lit("B net_out="), fixed(x("net_out_delta"), 0), F.lit("B events="),
        fixed(x("event_count"), 0), F.lit(" auth_fail="), fixed(x("auth_failures"), 0))
    return scored.filter(s >= threshold).withColumns({
        "detector": F.lit("iforest"),
        "confidence": F.least(F.lit(1.0), (s - 0.5) * 2.0),
        "severity": F.when(s >= CRITICAL_SCORE, "critical").when(s >= HIGH_SCORE, "high").otherwise("medium"),
        "mitre_id": F.when(exfil, "T1041").when(hijack, "T1496").when(brute, "T1110").otherwise("T1078"),
        "mitre_tactic": F.when(exfil, "Exfiltration").when(hijack, "Impact")
                         .when(brute, "Credential Access").otherwise("Defense Evasion"),
        "description": F.concat(F.lit("ML outlier detected -- isolation forest score "), fixed(s, 6),
                                F.lit(f" (threshold {threshold:.6f})")),
        "evidence": evidence,
    })


@dataclass(frozen=True)
class BeaconLimits:
    window: int = BEACON_WINDOW
    min_samples: int = BEACON_MIN_SAMPLES
    max_jitter: float = BEACON_MAX_JITTER
    min_autocorr: float = BEACON_MIN_AUTOCORR


def beacon_score(
    rows: DataFrame,
    interval: str = "interval_ms",
    order: Sequence[str] = ("timestamp_ms",),
    *,
    key: str = "device_id",
    segment: int = 86_400_000,
    limits: BeaconLimits = BeaconLimits(),
) -> DataFrame:
    """Findings where the last intervals of a device are regular and positively correlated.

    Rows are numbered without a per-device task, cut into blocks that carry
    the last rows of the block before, and windowed inside the blocks.
    """
    w = limits.window
    used = rows.filter(F.col(interval) > 0)
    numbered = with_predecessors(sequence(used, [key], list(order), segment=segment), 64 * w, w - 1)
    block = Window.partitionBy(key, "block").orderBy("seq")
    last = block.rowsBetween(-(w - 1), 0)
    whole = Window.partitionBy(key, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Deviations and their products do not change when a constant is taken off;
    # doing so keeps the sums small beside the spread they measure.
    v = F.col("_v")
    centred = numbered.withColumn("_c", F.first(interval).over(whole).cast("double")).withColumn(
        "_v", F.col(interval).cast("double") - F.col("_c"))
    centred = centred.withColumn("_vv", v * F.lag("_v").over(block))
    stats = centred.withColumns({
        "_n": F.count("*").over(last),
        "_s": F.sum("_v").over(last),
        "_q": F.sum(v * v).over(last),
        "_first": F.first("_v").over(last),
        "_p": F.coalesce(F.sum("_vv").over(block.rowsBetween(-(w - 2), 0)), F.lit(0.0)),
    }).filter("own")
    # A window of n rows holds n - 1 neighbouring pairs.
    n, m = F.col("_n"), F.col("_s") / F.col("_n")
    mean = m + F.col("_c")
    spread = F.greatest(F.lit(0.0), F.col("_q") - n * m * m)
    sd = F.sqrt(spread / n)
    pairs = F.col("_p") - m * (2 * F.col("_s") - F.col("_first") - v) + (n - 1) * m * m
    rows_out = stats.withColumns({
        "_mean": mean, "_sd": sd, "beacon_jitter": sd / mean,
        "autocorr": F.when(spread > 1e-9, pairs / spread).otherwise(0.0),
    }).filter(
        (n >= limits.min_samples) & (mean >= 1.0)
        & (F.col("beacon_jitter") < limits.max_jitter) & (F.col("autocorr") >= limits.min_autocorr)
    )
    j = limits.max_jitter
    conf = F.least(F.lit(1.0), (j - F.col("beacon_jitter")) / j * 0.5 + F.col("autocorr") * 0.5)
    found = rows_out.withColumns({
        "detector": F.lit("beaconing"),
        "samples": n,
        "score": 1.0 - F.col("beacon_jitter"),
        "confidence": conf,
        "severity": F.when(conf >= 0.75, "high").otherwise("medium"),
        "mitre_id": F.lit("T1071"),
        "mitre_tactic": F.lit("Command and Control"),
        "beacon_period_s": F.col("_mean") / 1000.0,
        "description": F.concat(
            F.lit("Periodic communication pattern detected -- possible C2 beacon (period="),
            F.floor(F.col("_mean") / 1000.0).cast("string"), F.lit("s, CoV="), fixed(F.col("beacon_jitter"), 6),
            F.lit(", autocorr="), fixed(F.col("autocorr"), 6), F.lit(")")),
        "evidence": F.concat(
            F.lit("samples="), n.cast("string"), F.lit(" mean_ms="), fixed(F.col("_mean"), 2),
            F.lit(" stddev_ms="), fixed(F.col("_sd"), 2), F.lit(" cov="), fixed(F.col("beacon_jitter"), 6),
            F.lit(" autocorr_lag1="), fixed(F.col("autocorr"), 6)),
    })
    return found.drop("block", "own", "_c", "_v", "_vv", "_n", "_s", "_q", "_first", "_p", "_mean", "_sd")


def past_pools(
    rows: DataFrame, block_ms: int, window: int = POOL_ROWS, warmup: int = WARMUP_ROWS, order: Sequence[str] = ("timestamp_ms", "event_id"),
) -> tuple[DataFrame, DataFrame]:
    """What is known before each time block: the blocks (block, here, before) and their pools (block, order, features).

    A pool holds the last ``window`` rows before its block starts; a block before which fewer than ``warmup`` rows lie
    has none. Only each block's last ``window`` rows are ranked, first by parts of the block, so neither the blocks'
    sizes nor a burst grow a task; where a tail stands in the whole follows from the blocks' counts.
    """
    block = div_floor(F.col(order[0]), block_ms).alias("block")
    placed = rows.select(block, *order, "features")
    # One row per time block.
    along = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("block").agg(F.count(F.lit(1)).alias("here")).withColumn("before", F.coalesce(F.sum("here").over(along), F.lit(0)))
    newest = [F.col(c).desc() for c in order]
    last = placed.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64)))
    last = last.withColumn("_p", F.row_number().over(Window.partitionBy("block", "_part").orderBy(*newest))).filter(F.col("_p") <= window)
    last = last.withColumn("_p", F.row_number().over(Window.partitionBy("block").orderBy(*newest))).filter(F.col("_p") <= window)
    ranked = last.join(blocks, "block").select((F.col("before") + F.col("here") - F.col("_p")).alias("_rank"), *order, "features")
    ranked = ranked.withColumn("_slice", div_floor(F.col("_rank"), window))
    ready = blocks.filter(F.col("before") >= max(1, warmup))
    slices = F.sequence(F.greatest(F.lit(0), div_floor(F.col("before") - window, window)), div_floor(F.col("before") - 1, window))
    wanted = ready.select("block", "before", F.explode(slices).alias("_slice"))
    pools = wanted.join(ranked, "_slice").filter((F.col("_rank") < F.col("before")) & (F.col("_rank") >= F.col("before") - window))
    return blocks, pools.select("block", *order, "features")


_TREE = "block long, tree_id int, left_id array<int>, right_id array<int>, rows array<int>, intercept array<double>, normal array<double>"


def _grow_trees(x: np.ndarray, tree: np.ndarray, trees: int, seed: int, max_depth: int) -> list[dict[str, np.ndarray]]:
    """Nodes of all trees, breadth first, from rows ``x`` that belong to ``tree``: every level of all trees at once."""
    rng = np.random.default_rng(seed)
    home, at, rows = np.arange(trees), tree.copy(), np.arange(len(x))
    made = [np.bincount(tree, minlength=trees)]
    left, right = [np.full(trees, -1)], [np.full(trees, -1)]
    cuts, normals, owner, first = [np.zeros(trees)], [np.zeros((trees, x.shape[1]))], [home], 0
    for _ in range(max_depth):
        rows = rows[np.argsort(at[rows], kind="stable")]
        if not len(rows):
            break
        nodes, begin, of, count = np.unique(at[rows], return_index=True, return_inverse=True, return_counts=True)
        normal = rng.normal(size=(len(nodes), x.shape[1]))
        normal /= np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-6)
        side = np.einsum("ij,ij->i", x[rows], normal[of])
        lo, hi = np.minimum.reduceat(side, begin), np.maximum.reduceat(side, begin)
        cut_at = rng.uniform(lo, np.maximum(hi, lo))
        below = side < cut_at[of]
        lefts = np.add.reduceat(below, begin, dtype=np.int64)
        split = (count > 1) & (hi - lo >= 1e-9) & (lefts > 0) & (lefts < count)
        local = nodes - first
        total, n = first + len(made[-1]), int(split.sum())
        rank = np.cumsum(split) - 1
        left[-1][local[split]], right[-1][local[split]] = total + 2 * rank[split], total + 2 * rank[split] + 1
        cuts[-1][local[split]], normals[-1][local[split]] = cut_at[split], normal[split]
        owner.append(np.repeat(owner[-1][local[split]], 2))
        made.append(np.stack([lefts[split], (count - lefts)[split]], axis=1).ravel())
        left.append(np.full(2 * n, -1)), right.append(np.full(2 * n, -1)), cuts.append(np.zeros(2 * n)), normals.append(np.zeros((2 * n, x.shape[1])))
        moves = split[of]
        at[rows] = np.where(moves, total + 2 * rank[of] + ~below, at[rows])
        rows, first = rows[moves], total
    owner, left, right = np.concatenate(owner), np.concatenate(left), np.concatenate(right)
    made, cuts, normals = np.concatenate(made), np.concatenate(cuts), np.concatenate(normals)
    out, place = [], np.full(len(owner) + 1, -1)
    for t in range(trees):
        mine = np.flatnonzero(owner == t)
        place[mine] = np.arange(len(mine))
        out.append({"left_id": place[left[mine]], "right_id": place[right[mine]], "rows": made[mine], "intercept": cuts[mine], "normal": normals[mine].ravel()})
    return out


def block_forests(pools: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7,
                  order: Sequence[str] = ("timestamp_ms", "event_id")) -> DataFrame:
    """One row per block and tree with the tree's nodes as arrays; each tree grows from its draws of the block's pool.

    A task holds one pool at a time; the draws are those of ``tree_samples`` over the pool.
    """
    max_depth = math.ceil(math.log2(max(2, subsample)))
    maps = np.array(_maps(trees, seed), np.int64)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        x, row = pdf[[f"f{i}" for i in range(len(FEATURES))]].to_numpy(float), pdf["_row"].to_numpy()
        drawn = np.argsort((row[None, :] * maps[:, :1] + maps[:, 1:]) % _PRIME, axis=1, kind="stable")[:, :subsample]
        grown = _grow_trees(x[drawn.ravel()], np.repeat(np.arange(trees), drawn.shape[1]), trees, seed, max_depth)
        block = int(pdf["block"].iloc[0])
        return pd.DataFrame([{"block": block, "tree_id": t, **{k: v.tolist() for k, v in g.items()}} for t, g in enumerate(grown)])

    flat = [F.col("features")[i].alias(f"f{i}") for i in range(len(FEATURES))]
    return pools.select("block", *order, _row_number(order).alias("_row"), *flat).groupBy("block").applyInPandas(grow, _TREE)


def score_blocks(rows: DataFrame, blocks: DataFrame, forests: DataFrame, block_ms: int, subsample: int = SUBSAMPLE,
                 order: Sequence[str] = ("timestamp_ms", "event_id"), part_rows: int = 100_000) -> DataFrame:
    """``rows`` of the blocks that have a forest, with ``score`` by the forest of their own block.

    A block's rows meet its trees in parts of about ``part_rows`` rows, each with a copy of the trees.
    """
    fields = rows.select("*", F.lit(0.0).alias("score"))
    parts = blocks.select("block", F.ceil(F.col("here") / part_rows).alias("_parts"))
    placed = rows.withColumn("block", div_floor(F.col(order[0]), block_ms)).join(parts, "block")
    placed = placed.withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    copies = forests.join(parts, "block").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part")).drop("_parts")
    scale, columns = float(average_path(subsample)), list(fields.columns)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        x = np.array(left["features"].tolist(), dtype=float)
        total = np.zeros(len(x))
        for t in right.sort_values("tree_id").itertuples():
            tree = {"left": np.array(t.left_id), "right": np.array(t.right_id), "rows": np.array(t.rows), "intercept": np.array(t.intercept)}
            total += _path_lengths(x, tree | {"normal": np.array(t.normal).reshape(len(t.left_id), -1)})
        return left.assign(score=2.0 ** (-total / len(right) / scale))[columns]

    return placed.groupBy("block", "_part").cogroup(copies.groupBy("block", "_part")).applyInPandas(score, fields.schema)


def observe(
    rows: DataFrame,
    *,
    history: DataFrame | None = None,
    block_ms: int = 86_400_000,
    window: int = POOL_ROWS,
    warmup: int = WARMUP_ROWS,
    seed: int = 7,
    order: Sequence[str] = ("timestamp_ms", "event_id"),
    keep: Sequence[str] = ("device_id", "timestamp_ms", "machine_ip"),
) -> DataFrame:
    """Forest and beacon findings of telemetry features, each judged by what came before it.

    Time is cut into blocks. A row is scored by the forest that learned from the last ``window`` rows before its block,
    and not at all where fewer than ``warmup`` rows lie before it. ``history`` holds rows of earlier calls (at least
    the last ``window``, and each device's last intervals): rows give the same findings whether they come at once or
    in turn. ``order`` must name each row once.
    """
    need = [c for c in dict.fromkeys([*keep, *order, *FEATURES])]
    known = rows.select(*need).withColumn("_new", F.lit(True))
    if history is not None:
        known = known.unionByName(history.select(*need).withColumn("_new", F.lit(False)))
    vectors = cut(anomaly_features(known))
    columns = [*keep, "detector", "severity", "score", "confidence", "mitre_id", "mitre_tactic", "description", "evidence"]
    beacons = beacon_score(vectors, order=order).filter("_new").select(*columns)
    blocks, pools = past_pools(vectors, block_ms, window, warmup, order)
    fresh = vectors.filter("_new")
    asked = fresh.select(div_floor(F.col(order[0]), block_ms).alias("block")).distinct()
    forests = block_forests(pools.join(asked, "block", "left_semi"), seed=seed, order=order)
    scored = score_blocks(fresh.drop("_new"), blocks, forests, block_ms, order=order)
    return forest_findings(scored).select(*columns).unionByName(beacons)


def as_threats(findings: DataFrame) -> DataFrame:
    """Findings in the shape of the threat_detections table."""
    return findings.select(
        "device_id", "timestamp_ms", "machine_ip", F.lit("ml_anomaly").alias("category"),
        F.col("detector").alias("sub_type"), "severity", "confidence", "mitre_id", F.lit("").alias("mitre_name"),
        "mitre_tactic", "description", "evidence",
    )
