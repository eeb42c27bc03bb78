"""Document fingerprints by locally consistent parsing.

A text is cut into phrases whose borders depend on a few neighbouring symbols only: deterministic coin tossing reduces
the symbols to a handful of labels that differ between neighbours, and a border stands before every local minimum of
the labels. A phrase is named by the hash of its symbols; the names are the symbols of the next level. Equal
substrings therefore have equal names inside, wherever they stand, and an edit changes only names near it. Runs of one
symbol become one symbol with their length first, since coin tossing needs neighbours that differ.

A fingerprint is a sketch of a text's names of all levels, the same ones for texts of every length: 64 minima of hashed
names, 16 bits each. Short texts have telling names at the lower levels, long ones at the higher. The likeness of two
fingerprints is the share of equal minima.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import pieces, read_table, runs
from watchloom.llm.wordhash import mix

#: Levels that are parsed; their phrases have some three to three hundred characters.
LEVELS = 5
MINIMA = 64
#: Rows between two borders of the id ranges that are dealt to tasks.
RANGE_ROWS = 10_000

_RANDOM = np.random.Generator(np.random.PCG64(0xC0135))
_SEEDS = _RANDOM.integers(0, 2**32, MINIMA, np.uint32)[:, None]
_FACTORS = (_RANDOM.integers(0, 2**32, MINIMA, np.uint32) | np.uint32(1))[:, None]
_PLACES = _RANDOM.integers(0, 2**64, 256, np.uint64) | np.uint64(1)


@functools.cache
def _coins() -> np.ndarray:
    """For two bytes that differ: twice the place of their lowest different bit, plus that bit of the second."""
    a, b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    apart = (a ^ b) | 256
    place = np.log2(apart & -apart).astype(np.uint8)
    return (2 * place + (b >> place & 1)).astype(np.uint8).ravel()


def _labels(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Labels 0 to 7, different for neighbours in a text; the first symbol of a text is set against a fixed one."""
    before = np.concatenate([symbols[:1], symbols[:-1]])
    before[begins] = ~symbols[begins]
    apart = symbols ^ before
    low = apart & (~apart + symbols.dtype.type(1))
    place = np.frexp(low.astype(np.float64))[1].astype(np.uint8) - np.uint8(1)
    label = 2 * place + (symbols >> place.astype(symbols.dtype) & symbols.dtype.type(1)).astype(np.uint8)
    for _ in range(2):
        before = np.concatenate([label[:1], label[:-1]])
        before[begins] = label[begins] ^ 1
        label = _coins().take(before.astype(np.uint16) << np.uint16(8) | label)
    return label


def _collapse(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the runs of equal symbols, and where the texts begin among them."""
    first = np.ones(len(symbols), bool)
    first[1:] = symbols[1:] != symbols[:-1]
    first[begins] = True
    spot = np.flatnonzero(first)
    size = np.diff(np.append(spot, len(symbols)))
    names = symbols[spot].astype(np.uint64)
    long = size > 1
    names[long] = mix(names[long] * np.uint64(0x9E3779B97F4A7C15) + size[long].astype(np.uint64))
    return names, np.searchsorted(spot, begins)


def parse(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases one level up, and where the texts begin among them; no text is empty."""
    symbols, begins = _collapse(symbols, begins)
    label = _labels(symbols, begins)
    n = len(label)
    border = np.zeros(n, bool)
    border[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    last = np.append(begins[1:], n) - 1
    border[last] = False
    border[begins[begins + 1 < n] + 1] = False
    border[begins] = True
    spot = np.flatnonzero(border)
    size = np.diff(np.append(spot, n))
    place = _PLACES.take(np.minimum(runs(size), 255))
    names = mix(np.add.reduceat((symbols + np.uint64(1)) * place, spot) + size.astype(np.uint64))
    return names, np.searchsorted(spot, begins)


def fingerprints(texts: list[str]) -> list[str]:
    """One fingerprint per text, 256 hexadecimal digits; an empty text has all ones."""
    full = [k for k, t in enumerate(texts) if t]
    out = ["f" * (4 * MINIMA)] * len(texts)
    if not full:
        return out
    lengths = np.fromiter((len(texts[k]) for k in full), np.int64, len(full))
    points = np.frombuffer("".join(texts[k] for k in full).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols, begins = mix(points.astype(np.uint64) + np.uint64(0xFFFF)), np.cumsum(lengths) - lengths
    levels = []
    for level in range(1, LEVELS + 1):
        symbols, begins = parse(symbols, begins)
        levels.append((symbols, np.append(begins, len(symbols))))
    for j, k in enumerate(full):
        own = np.concatenate([names[at[j] : at[j + 1]] for names, at in levels])
        found = np.unique((own >> np.uint64(32)).astype(np.uint32))
        least = None
        for first in range(0, len(found), 4096):
            part = ((found[first : first + 4096] ^ _SEEDS) * _FACTORS).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        # The low half of a minimum is as good as random; its high half is close to zero in long texts.
        out[k] = (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()
    return out


def likeness(one: Column, two: Column) -> Column:
    """The share of equal minima of two fingerprint columns, 0 to 1; null if one is null."""
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.lit(MINIMA - 1)), lambda k: F.substr(c, k * 4 + 1, F.lit(4)))
    same = F.zip_with(cut(one), cut(two), lambda a, b: (a == b).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(MINIMA))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; null counts as empty, equal texts have equal fingerprints."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(texts))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, "doc_id long, fingerprint string")


def neighbour_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows in descending id order inside ranges of ids (column part), each range followed by a guest.

    The guest is the first row of the range below, so that every row meets the next one in its own task; the last
    range has the very first row. Texts are shuffled once; a range adds one row. Equal ids are in the order of their
    texts, null ids come after all others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    count = docs.count()
    wanted = max(1, -(-count // range_rows))
    shares = [k / wanted for k in range(1, wanted)]
    cuts = np.array(sorted(set(rows.agg(F.percentile_approx(order, shares, min(100 * wanted, 1_000_000))).first()[0] or [])) if shares else [], np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, ids.to_numpy(), "left")).astype(np.int32))

    own = rows.select("doc_id", "text", range_of(order).alias("part"), F.lit(False).alias("guest"))
    # A row per range comes to the driver: the id it begins with. The first range's goes to the last range.
    heads = rows.select(range_of(order).alias("part"), order.alias("id")).groupBy("part").agg(F.max("id").alias("head")).orderBy("part").collect()
    guests = docs.sparkSession.createDataFrame([(h["head"], heads[k - 1]["part"]) for k, h in enumerate(heads)], "head long, part int")
    # One row per range of ``range_rows`` documents: some megabytes for a billion, so its rows go to the texts.
    first = rows.withColumn("head", order).join(F.broadcast(guests), "head").groupBy("head", "doc_id", "part").agg(F.min("text").alias("text"))
    extra = first.select("doc_id", "text", "part", F.lit(True).alias("guest"))
    return own.unionByName(extra).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "guest", order.desc(), "text")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its fingerprint, that of the text whose second half the next row's beginning replaces, and the
    next row's: doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                rows = ([held] if held else []) + list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                held = rows[-1]
                if len(rows) > 1:
                    yield finish(rows)

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3] and a[2] == b[2]]
        signs = fingerprints([r[1] for r in rows])
        by_row = {id(r): s for r, s in zip(rows, signs, strict=True)}
        edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array([by_row[id(a)] for a, _ in pairs], pa.string()),
                pa.array(fingerprints(edited), pa.string()), pa.array([by_row[id(b)] for _, b in pairs], pa.string()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"],
        )

    return neighbour_ranges(docs, id_col, text_col).mapInArrow(
        work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = edited_likeness(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
