"""Text quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.common import by_id_text, pieces, read_table, runs, utf8
from watchloom.llm.wordhash import mix, word_hashes

#: Slots of the weight vector: 2 MB as doubles whatever the corpus, so it can be broadcast.
SLOTS = 1 << 18
#: Labelled rows to learn from; of more, those whose hashed ids are least. The bound of the fitting sample.
SAMPLE_ROWS = 20_000
#: Bytes of whole texts that are hashed at a time.
_WORK = 1 << 19


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, n + 1 offsets) of the texts' hashed words and word pairs.

    A slot's value is the root of its count over the root of all, so a text's vector has length one. Every text has
    the slot 0 besides, which stands for the intercept.
    """
    words, woff = word_hashes(data, at)
    n = len(woff) - 1
    sizes = np.diff(woff)
    owner = np.repeat(np.arange(n), sizes)
    pair = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
    pairs = mix(words[pair] * np.uint64(3) + words[pair + 1])
    hashed = np.concatenate([words, pairs])
    slot = (hashed % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    keys, counts = np.unique(np.concatenate([owner, owner[pair]]) * SLOTS + slot, return_counts=True)
    doc, slot = keys // SLOTS, keys % SLOTS
    total = np.bincount(doc, counts, minlength=n)
    value = np.sqrt(counts / total[doc])
    per = np.bincount(doc, minlength=n) + 1
    offsets = np.concatenate([[0], np.cumsum(per)])
    slots, values = np.zeros(offsets[-1], np.int64), np.ones(offsets[-1])
    place = offsets[doc] + 1 + runs(per - 1)
    slots[place], values[place] = slot, value
    return slots, values, offsets


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal: the learning rate falls with a coordinate's own gradients, l1 keeps it sparse.

    The rate is high because a text's vector has length one, so a coordinate's gradients are small.
    """

    alpha: float = 20.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.0

    def __post_init__(self):
        self.z, self.n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        """One step; the slots of a row are distinct."""
        z, n = self.z[slots], self.n[slots]
        w = self.weights(z, n)
        g = (1 / (1 + np.exp(-min(max(float(w @ values), -35.0), 35.0))) - label) * values
        self.z[slots] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def train(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learnt from a bounded sample of labelled rows, in the order of their hashed ids.

    Rows without a label or id are left out; an id with several labels counts once for each. Without any row the
    weights are zero and every score one half. One task sees the sample, a bounded number of rows, as a stream.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    # The first rows of that order lie under a bound of the hash; without it every partition sends as many as are wanted.
    share, total = 1.0, known.count()
    if total > sample_rows:
        share = 1.5 * sample_rows / total
        while share < 1 and known.where(order[0] <= int(share * 2**64) - 2**63).count() < sample_rows:
            share *= 2
    under = known.where(order[0] <= int(share * 2**64) - 2**63) if share < 1 else known
    sample = under.orderBy(*order).limit(sample_rows)
    rows = texts.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _WORK):
                slots, values, offsets = features(*utf8(part.column(1)))
                at = pa.array(offsets.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.ListArray.from_arrays(at, pa.array(slots.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values.astype(np.float32)))],
                    ["doc_id", "label", "slots", "values"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for batch in batches:
            slots, values, labels = batch.column(2), batch.column(3), batch.column(1).to_numpy()
            at, flat, amount = np.asarray(slots.offsets), slots.values.to_numpy(), values.values.to_numpy()
            for k, label in enumerate(labels):
                model.learn(flat[at[k] : at[k + 1]], amount[at[k] : at[k + 1]].astype(np.float64), int(label))
        yield pa.RecordBatch.from_pylist([{"weights": model.weights(model.z, model.n).tobytes()}])

    vectors = rows.mapInArrow(hashed, "doc_id long, label int, slots array<int>, values array<float>")
    (row,) = vectors.repartition(1).sortWithinPartitions(*order).mapInArrow(fit, "weights binary").collect() or [None]
    return np.frombuffer(row.weights, np.float64) if row else np.zeros(SLOTS)


def score_texts(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """Sparse dot products of many texts, as probabilities."""
    out, first = [np.zeros(0)], 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _WORK):
            size += len(texts[last])
            last += 1
        slots, values, offsets = features(*utf8(pa.array(texts[first:last], pa.string())))
        out.append(1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[slots] * values, offsets[:-1]), -35, 35))))
        first = last
    return np.concatenate(out)


def score(spark: SparkSession, weights: np.ndarray, text: Column) -> Column:
    """Probability of label 1 for a text column; null counts as empty, which the intercept alone decides."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(shared.value, [t if isinstance(t, str) else "" for t in texts]))

    return probability(text)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Learn from labels of four fifths of the ids, score all rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = by_id_text(F.col("doc_id")) % 5 == 0
    weights = train(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), score(spark, weights, F.col("text")).alias("score"))
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
