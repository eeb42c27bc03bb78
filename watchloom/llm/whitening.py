"""Whitening of embeddings by the covariance of their distinct vectors, weighted by how often each occurs.

Vectors are put on an integer grid, equal ones are grouped (map tasks collapse them first, so a vector that a third of
the rows share is one row per task), and every later step reads the distinct vectors with their counts: the sums, the
centred weighted products, the whitening itself and the check of what it gives. The rows get their distinct vector's
result back by its digest. Vectors of different lengths are fits of their own.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import read_table, written

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this saturate, so that a vector of any finite doubles has a place on the grid.
FAR = float(1 << 53)
COMPONENTS = 32
#: Variance below this share of the largest is rounding, not variance.
NOISE = 1e-12
#: A vector that at least this share of the rows has is joined by broadcast; there are at most 1 / HOT of them.
HOT = 1 / 1000


def on_grid(vectors: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Which vectors are whole and finite, and the grid entries of those as little-endian 64-bit integers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten()
    missing = np.asarray(flat.is_null())
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(missing | ~np.isfinite(values))])
    good = np.asarray(vectors.is_valid()) & (bad[ends] == bad[ends - sizes])
    with np.errstate(invalid="ignore", over="ignore"):
        grid = np.clip(np.floor(SCALE * np.where(np.isfinite(values), values, 0.0)), -FAR, FAR).astype(np.int64) + SHIFT
    return good, [grid[end - size : end].astype("<i8").tobytes() for end, size in zip(ends[good], sizes[good], strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Rows of one vector length at a time: the length, the vectors as a matrix, and the rows."""
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == d))
            yield d, np.frombuffer(b"".join(part.column(column).to_pylist()), "<i8").reshape(part.num_rows, d), part


@dataclasses.dataclass
class Fit:
    """The model of one vector length: rows, sums (exact), unit components in rows, eigenvalues, and the variance's trace."""

    n: int
    weight: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections of the centred vectors over the roots of the eigenvalues; NaN for components without variance."""
        scale = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (x - self.mean) @ self.components.T / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions, exact; None beyond the range of a long."""
        reach = max((abs(self.n * int(x[:, j].max()) - s), abs(self.n * int(x[:, j].min()) - s)) for j, s in enumerate(self.sums)) if x.size else (0, 0)
        if x.size and max(reach) ** 2 * x.shape[1] < 1 << 62 and self.n * max(abs(int(x.max())), abs(int(x.min()))) < 1 << 62:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _summed(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], label: str) -> DataFrame:
    """dims, k and value: the rows of each task's partial matrices, added up by key in as many tasks as there are keys."""
    fields = "dims int, k int, value array<double>"
    names = ["dims", "k", "value"]
    types = [pa.int32(), pa.int32(), pa.list_(pa.float64())]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, matrix in work(batches):
            held[d] = held[d] + matrix if d in held else matrix
        for d, matrix in held.items():
            for k, row in enumerate(matrix):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((d, k, row), types, strict=True)], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, k, row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                held[d, k] = held[d, k] + np.array(row) if (d, k) in held else np.array(row)
        for (d, k), row in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((d, k, row), types, strict=True)], names)

    parts = written(rows.mapInArrow(partial, fields), f"{label}-parts")
    return parts.repartition("dims", "k").mapInArrow(add, fields)


def _matrices(summed: DataFrame) -> dict[int, np.ndarray]:
    """The matrices of each vector length on the driver: their size depends on the vectors' length, not on their number."""
    found: dict[int, dict[int, list[float]]] = {}
    for row in summed.collect():
        found.setdefault(row.dims, {})[row.k] = row.value
    return {d: np.array([rows[k] for k in sorted(rows)]) for d, rows in found.items()}


def grid_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dims and x (the grid entries) of the rows whose vector is whole and finite."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, found = on_grid(batch.column(1))
            sizes = pa.array([len(x) // 8 for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), sizes, pa.array(found, pa.binary())], ["vec_id", "dims", "x"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(place, "vec_id long, dims int, x binary").where("dims > 0")


def fit(distinct: DataFrame) -> dict[int, Fit]:
    """The model of each vector length from distinct vectors (dims, x, count, weight)."""
    # Sums of each dimension, exact as decimals: tasks add integers, in halves that no double rounds.
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for d, x, part in _blocks(batches):
            count, weight = part.column("count").to_numpy(), part.column("weight").to_numpy()
            fits = len(x) * int(np.abs(x).max()) * int(weight.max()) < 1 << 62
            sums = (weight[:, None] * x).sum(axis=0).tolist() if fits else [sum(w * v for w, v in zip(weight.tolist(), column, strict=True)) for column in x.T.tolist()]
            new = [int(count.sum()), int(weight.sum()), *sums]
            held[d] = [a + b for a, b in zip(held[d], new, strict=True)] if d in held else new
        for d, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values])], ["dims", "k", "value"])

    sums: dict[int, dict[int, int]] = {}
    parts = distinct.select("dims", "x", "count", "weight").mapInArrow(add_up, "dims int, k int, value string")
    for row in parts.groupBy("dims", "k").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        sums.setdefault(row.dims, {})[row.k] = int(row.value)
    totals = {d: (found[0], found[1], [found[k + 2] for k in range(d)]) for d, found in sums.items()}
    means = {d: np.array([float(s // w) + (s % w) / w for s in values]) for d, (_, w, values) in totals.items()}

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for d, x, part in _blocks(batches):
            centred = x - means[d]
            yield d, (centred * part.column("weight").to_numpy()[:, None]).T @ centred

    fits = {}
    for d, matrix in _matrices(_summed(distinct.select("dims", "x", "weight"), product, "whitening-covariance")).items():
        n, weight, values = totals[d]
        covariance = (matrix + matrix.T) / 2 / weight
        found, vectors = np.linalg.eigh(covariance)
        found, vectors = found[::-1], vectors[:, ::-1].T
        signs = np.sign(vectors[np.arange(d), np.abs(vectors).argmax(axis=1)])
        found = np.where(found > NOISE * max(found[0], 0), found, 0.0)[:COMPONENTS]
        fits[d] = Fit(n, weight, values, means[d], (vectors * signs[:, None])[:COMPONENTS], found, float(np.trace(covariance)))
    return fits


def whiten(vectors: DataFrame, weights: str = "counts", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component (up to 32): vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out, and so are empty ones. Entries become
    floor(64 c) + 1000000. ``weights``: ``counts`` fits on all rows, ``one`` on distinct vectors. ``deviation`` is the
    exact sum of (n x - S)^2, null where a long can't hold it. Components without variance (fewer rows than
    dimensions, or constant ones) have a null ``whitened`` and take no part in ``identity_error``, the largest entry
    of the covariance of what was whitened, over the fit's list, minus the identity. Rows that repeat an id or a
    vector are rows each; vectors of different lengths are fits of their own. An empty table gives no rows.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    rows = written(grid_rows(vectors, id_col, vector_col).withColumn("key", F.unhex(F.sha2("x", 256))), "whitening-rows")
    weight = F.col("count") if weights == "counts" else F.lit(1).cast("long")
    grouped = rows.groupBy("dims", "x").agg(F.count(F.lit(1)).alias("count")).withColumn("weight", weight)
    distinct = written(grouped, "whitening-distinct")
    fits = fit(distinct)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, part in _blocks(batches):
            z = fits[d].whiten(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel(), from_pandas=True))
            deviation = pa.array(fits[d].deviation(x), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("dims"), part.column("key"), part.column("count"), part.column("weight"), deviation, lists], ["dims", "key", "count", "weight", "deviation", "z"])

    shape = "dims int, key binary, count long, weight long, deviation long, z array<double>"
    keyed = distinct.withColumn("key", F.unhex(F.sha2("x", 256)))
    done = written(keyed.mapInArrow(apply, shape), "whitening-done")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                z = part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)[:, fits[d].values > 0]
                w = part.column("weight").to_numpy()[:, None]
                # A first column of ones carries the sums, whose products are taken off the rest.
                z = np.hstack([np.ones((len(z), 1)), z])
                yield d, (z * w).T @ z

    errors = {}
    for d, matrix in _matrices(_summed(done.select("dims", "weight", "z"), moments, "whitening-check")).items():
        mean = matrix[0, 1:] / matrix[0, 0]
        gap = matrix[1:, 1:] / matrix[0, 0] - np.outer(mean, mean) - np.eye(len(mean))
        errors[d] = float(np.abs(gap).max()) if gap.size else 0.0

    facts = [(d, f.n, [float(v / f.trace) if f.trace > 0 else 0.0 for v in f.values], errors[d]) for d, f in fits.items()]
    per_fit = vectors.sparkSession.createDataFrame(facts, "dims int, n long, explained array<double>, identity_error double")
    total = sum(f.n for f in fits.values())
    hot = F.col("count") >= max(1.0, HOT * total) if total else F.lit(False)
    # At most 1 / HOT vectors are hot; the others are met by a shuffle in which none has more than that share of the rows.
    few = F.broadcast(done.where(hot).select("key", "deviation", "z"))
    rest = done.where(~hot).select("key", "deviation", "z")
    ids = rows.select("vec_id", "dims", "key")
    met = ids.join(few, "key").unionByName(ids.join(F.broadcast(done.where(hot).select("key")), "key", "left_anti").join(rest, "key"))
    # One row per vector length, each with its 32 shares.
    wide = met.join(F.broadcast(per_fit), "dims").select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("z", "explained")).alias("k", "e"))
    return wide.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("e.z").alias("whitened"), F.col("e.explained").alias("explained"), "identity_error")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
