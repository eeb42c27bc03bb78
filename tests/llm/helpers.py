"""Small tables with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ("kept", "shard", "slot", "node", "key", "t", "n", "lang_pred", "score", "language", "mix", "topic", "part", "guest", "head", "label", "ids", "hash", "size", "cells")

_BASE = " ".join(f"wort{k % 37}x{k}" for k in range(120))

ROWS = [
    (1, "Hello there, it's a plain text of some words that we'll meet again.", "en", "a", 10),
    (2, "Hello there, it's a plain text of some words that we'll meet again.", "en", "a", 10),
    (3, None, "en", "a", None),
    (4, "", None, "b", 0),
    (5, "   \n\t ", "en", None, 6),
    (6, "12345 67890 !!! ???", "de", "b", 19),
    (7, _BASE, "de", "hot", 900),
    (8, _BASE.replace("wort5x5 ", "anders "), "de", "hot", 900),
    (9, _BASE.replace("wort5x5 ", "anders ").replace("wort36x110", "neu"), None, "hot", 900),
    (10, "word " * 40_000, "en", "hot", 200_000),
    (11, "a" * 30_000, "fr", "hot", 30_000),
    (12, "Größe, ça va? 漢字   don't\r\n<|endoftext|>", "fr", "c", 30),
    (13, "x", "en", "c", 1),
    (13, "x", "en", "c", 1),
    (14, "X", "en", "c", 1),
    (None, "Hello there, it's a plain text of some words that we'll meet again.", "en", "a", 10),
    (None, "no id and nothing like it anywhere", "en", "c", 10),
    (15, "two words", "en", "c", 9),
    (16, "TWO Words", "en", "c", 9),
    (17, "und 漢", None, None, 5),
]


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls, blanks, long texts, ties, repeated rows, and columns whose names clash."""
    return clash(spark.createDataFrame(ROWS, SCHEMA))


def clash(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def near_family(seed: int = 3, n: int = 160) -> list[tuple]:
    """Texts around a few bases with edits at a similarity near 0.8, above and below it."""
    rng, out = random.Random(seed), []
    bases = [[f"{rng.choice('bcdfgh')}{rng.randrange(9999)}" for _ in range(rng.randrange(30, 150))] for _ in range(6)]
    for k in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, max(1, len(words) // 30) + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
        out.append((k, " ".join(words), "en", "s", len(words)))
    return out


def shingles(text: str | None, k: int) -> set:
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def near_components(rows: list[tuple], k: int) -> dict:
    """id -> (set size, least id that links reach), comparing all pairs."""
    sets = {}
    for r in rows:
        sets.setdefault(r[0], shingles(r[1], k))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
