"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled text: each task sums its texts into one matrix and sends the filled
slots once, so a language that holds a third of all rows costs no more than others. The log-probability matrix has
``slots`` rows and one column per language, a size that doesn't depend on the corpus, and travels as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.common import by_id_text, pieces, read_table
from watchloom.llm.pretoken import LETTER, _classes
from watchloom.llm.wordhash import mix

#: The answer for texts without a letter.
UNDETERMINED = "und"
#: Slots of the matrix and lengths of the n-grams.
SLOTS, ORDERS = 1 << 15, (1, 2, 3)
#: The largest matrix that may be broadcast: about 4,000 languages.
MOST_BYTES = 512 << 20


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with every non-letter as a space, n + 1 offsets, and each text's letters."""
    lower = [f" {t.lower()} " if t else " " * max(ORDERS) for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))])
    letter = _classes()[points] == LETTER
    return np.where(letter, points, np.uint32(32)), at, np.add.reduceat(letter, at[:-1], dtype=np.int64)


def _slots(points: np.ndarray, at: np.ndarray, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: their slots, and where each text's begin (every text has some)."""
    wide = points.astype(np.uint64)
    for n in ORDERS:
        total = np.full(len(wide) - n + 1, n, np.uint64)
        for j in range(n):
            total = total * np.uint64(0x100000001B3) + wide[j : len(wide) - n + 1 + j]
        inside = np.ones(len(total), bool)
        for j in range(1, n):  # an n-gram that reaches into the next text isn't one
            inside[at[1:-1] - j] = False
        kept = np.flatnonzero(inside)
        yield (mix(total[kept]) % np.uint64(slots)).astype(np.int64), np.searchsorted(kept, at[:-1])


@dataclass(frozen=True)
class NaiveBayes:
    """Languages in alphabetical order, log probabilities (slots x languages) and log priors."""

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language (of equals the first) and its posterior probability; ``und`` and 0 without letters."""
        labels, scores = [], []
        first = 0
        while first < len(texts):  # some hundred thousand characters at a time
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last] or "") <= 500_000):
                size += len(texts[last] or "")
                last += 1
            names, values = self._predict(texts[first:last])
            labels += names
            scores.append(values)
            first = last
        return labels, np.concatenate([np.zeros(0), *scores])

    def _predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        points, at, letters = _points(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total = np.tile(self.priors, (len(texts), 1))
        for slots, begins in _slots(points, at, len(self.weights)):
            total += np.add.reduceat(self.weights.take(slots, axis=0), begins, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        found = letters > 0
        return [self.languages[b] if x else UNDETERMINED for b, x in zip(best, found, strict=True)], np.where(found, score, 0.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", slots: int = SLOTS, alpha: float = 0.5) -> NaiveBayes:
    """Learn from all rows whose text and language are not null; without any, every text is undetermined."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                texts, langs = part.column(0).to_pylist(), part.column(1).dictionary_encode()
                points, at, _ = _points(texts)
                codes = langs.indices.to_numpy()
                names = langs.dictionary.to_pylist()
                for code, name in enumerate(names):
                    sums.setdefault(name, np.zeros(slots + 1, np.int64))[slots] += int((codes == code).sum())
                for found, begins in _slots(points, at, slots):
                    owner = np.repeat(codes, np.diff(np.append(begins, len(found)))).astype(np.int64)
                    table = np.bincount(owner * slots + found, minlength=len(names) * slots).reshape(len(names), slots)
                    for code, name in enumerate(names):
                        sums[name][:slots] += table[code]
        for name, row in sums.items():
            filled = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(filled)), pa.array(filled.astype(np.int32)), pa.array(row[filled])], ["lang", "slot", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # a row per filled slot and language, bounded by the matrix
    langs = table.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(langs.dictionary.to_pylist())
    if len(languages) * slots * 4 > MOST_BYTES:
        raise ValueError(f"{len(languages)} languages x {slots} slots exceed the broadcast bound; use fewer slots")
    column = np.array([languages.index(x) for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()] if languages else np.zeros(0, np.int64)
    counts = np.zeros((slots + 1, len(languages)))
    counts[table.column("slot").to_numpy(), column] = table.column("n").to_numpy()
    weights = np.log((counts[:slots] + alpha) / (counts[:slots].sum(axis=0) + alpha * slots))
    priors = np.log(counts[slots] / max(1.0, counts[slots].sum()))
    return NaiveBayes(tuple(languages), weights.astype(np.float32), priors)


def predicted(spark: SparkSession, model: NaiveBayes, text: Column) -> Column:
    """A struct (lang_pred, score) for a text column; the other columns never leave the JVM."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            labels, scores = shared.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": pd.Series(labels, dtype=object), "score": scores})

    # Called nondeterministic so that a filter on the result doesn't evaluate it a second time, in workers of its own.
    return score.asNondeterministic()(text)


def identify(docs: DataFrame, model: NaiveBayes, text_col: str = "text", into: str = "language") -> DataFrame:
    """All columns and rows of ``docs`` and the struct (lang_pred, score) as column ``into``, in place of one so named.

    Null, empty and letterless texts are ``und`` with score 0; of equally likely languages the first by name is taken.
    """
    return docs.withColumn(into, predicted(docs.sparkSession, model, F.col(text_col)))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Train on three quarters of the ids, predict all rows."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = by_id_text(F.col("doc_id")) % 4 == 2
    model = train(docs.where(~held_out))
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))
