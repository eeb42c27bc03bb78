"""Classifiers: plain versions on small input and held-out accuracy on the tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ROWS, awkward, empty
from watchloom.llm import langid, quality
from watchloom.llm.common import utf8

SMALL = "/root/testdata/sf0.01"


def test_counts_and_posterior_by_hand(session):
    docs = session.createDataFrame([(1, "aab"), (2, "bbb"), (3, "a1")], "doc_id long, text string").selectExpr("doc_id", "text", "if(doc_id = 2, 'y', 'x') as lang")
    model = langid.train(docs, slots=1 << 12)
    grams = {}
    for text, lang in (("aab", "x"), ("bbb", "y"), ("a1", "x")):
        padded = f" {''.join(c if c.isalpha() else ' ' for c in text)} "
        for n in langid.ORDERS:
            grams.setdefault(lang, Counter()).update(padded[k : k + n] for k in range(len(padded) - n + 1))
    total = {lang: math.log(p) for lang, p in (("x", 2 / 3), ("y", 1 / 3))}
    for lang in total:
        size = sum(grams[lang].values())
        for n in langid.ORDERS:
            for k in range(len(" ab ") - n + 1):
                total[lang] += math.log((grams[lang][" ab "[k : k + n]] + 0.5) / (size + 0.5 * (1 << 12)))
    labels, scores = model.predict(["ab"])
    assert labels == [max(total, key=total.get)]
    assert scores[0] == pytest.approx(1 / sum(math.exp(v - max(total.values())) for v in total.values()), rel=1e-4)


def test_language_awkward(session):
    docs = awkward(session)
    got = langid.identify(docs, langid.train(docs)).select("doc_id", "language.lang_pred", "language.score", "kept").collect()
    assert len(got) == len(ROWS) and {r.kept for r in got} == {"other"}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 6}
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    none = langid.train(empty(session))
    assert {r.language.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty(session), none).count() == 0


def test_language_held_out(session):
    rows = langid.op4_language_id(session, SMALL).collect()
    truth = dict(map(tuple, session.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_features_are_word_ngrams():
    slots, values, at = quality.features(*utf8(pa.array(["a b a b", "", "B  A", None])))
    vectors = [dict(zip(slots[lo:hi].tolist(), values[lo:hi].tolist(), strict=True)) for lo, hi in zip(at, at[1:], strict=False)]
    assert [len(v) for v in vectors] == [5, 1, 4, 1] and vectors[1] == vectors[3] == {0: 1.0}
    assert sorted(v**2 for v in vectors[0].values()) == pytest.approx([1 / 7, 2 / 7, 2 / 7, 2 / 7, 1])
    assert set(vectors[2]) <= set(vectors[0])


def test_ftrl_step_by_hand():
    model = quality.Ftrl(alpha=0.5, beta=1.0, l1=0.0, l2=0.0)
    model.learn(np.array([0, 5]), np.array([1.0, 0.5]), 1)
    assert model.z[[0, 5]] == pytest.approx([-0.5, -0.25]) and model.n[[0, 5]] == pytest.approx([0.25, 0.0625])
    assert model.weights(model.z, model.n)[[0, 5]] == pytest.approx([0.5 * 0.5 / 1.5, 0.25 * 0.5 / 1.25])


def test_quality_awkward(session):
    docs = awkward(session)
    labels = session.createDataFrame([(1, 1), (1, 0), (7, 1), (8, None), (None, 1), (6, 0), (99, 1), (6, 0)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    got = docs.select("doc_id", quality.score(session, weights, docs.text).alias("p")).collect()
    assert len(got) == len(ROWS) and all(0 <= r.p <= 1 for r in got)
    assert len({r.p for r in got if r.doc_id in (3, 4, 5)}) == 1
    blank = quality.train(empty(session), labels)
    assert not blank.any() and set(quality.score_texts(blank, ["x", ""])) == {0.5}
    assert empty(session).select(quality.score(session, blank, F.col("text"))).collect() == []


def test_quality_sample_is_the_least_hashes(session):
    docs, labels = (session.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    repeated = labels.union(labels.where("doc_id % 7 = 1"))
    order = [F.xxhash64("doc_id"), "doc_id", F.col("quality").cast("int")]
    least = repeated.where("quality in (0, 1) and doc_id is not null").orderBy(*order).limit(60)
    assert repeated.count() > 200
    assert (quality.train(docs, repeated, sample_rows=60) == quality.train(docs, least)).all()


def test_quality_held_out(session):
    rows = quality.op10_quality(session, "/root/testdata/sf0.1").collect()
    truth = dict(map(tuple, session.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality").collect()))
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(p == y for _, y, p in held) / len(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
