"""Licence scan: ordered signature rules behind a keyword prefilter, overlapping detections resolved by priority.

A text becomes its words, lower-case, with one space between them. An Aho-Corasick automaton finds in one pass which
rules have their keyword in the text; only their patterns run. Of the detections, one that lies inside another's
interval goes if that one has the higher priority, or the same one and more words, or the same interval and an
earlier rule. Base phrases are detections like the rest, but they always stay.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import pieces, read_table, utf8
from watchloom.llm.license_rules import Rule, rules

#: Bytes to words: letters A-Z in lower case, other ASCII but digits and a-z parts words, bytes from 0x80 on stay.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


class Detection(NamedTuple):
    start: int  # of its first character in the text of words
    end: int
    rule: int


@functools.cache
def _prefilter() -> tuple[list[Rule], ahocorasick.Automaton]:
    """The rules, and an automaton from their keywords (whole words) to the numbers of the rules."""
    listed, gated = rules(), {}
    for k, rule in enumerate(listed):
        for keyword in {rule.keyword, rule.keyword.replace("license", "licence")}:
            gated.setdefault(f" {keyword} ", []).append(k)
    automaton = ahocorasick.Automaton()
    for keyword, numbers in gated.items():
        automaton.add_word(keyword, numbers)
    automaton.make_automaton()
    return listed, automaton


def words_of(text: bytes) -> str:
    """The words with one space before and behind each; one character a byte, so that places are those of bytes."""
    parts = text.translate(_TO_WORDS).split()
    return (b" " + b" ".join(parts) + b" ").decode("latin-1") if parts else " "


def detect(words: str) -> list[Detection]:
    """All matches of the rules whose keyword is in the text."""
    listed, automaton = _prefilter()
    open_ = sorted({k for _, numbers in automaton.iter(words) for k in numbers})
    return [Detection(m.start(), m.end(), k) for k in open_ for m in listed[k].pattern.finditer(words)]


def resolve(found: list[Detection], listed: list[Rule]) -> list[Detection]:
    """The detections that stay, by start.

    Containment with a better rank is transitive, so what another suppressed one would suppress goes anyway: it is
    enough to ask, per priority, for the furthest end among the intervals that start no later.
    """
    kept: list[Detection] = []
    starts: list[int] = []
    reach: list[int] = []  # the furthest end of all better intervals up to each start
    for priority in sorted({listed[d.rule].priority for d in found}, reverse=True):
        same = sorted((d for d in found if listed[d.rule].priority == priority), key=lambda d: (d.start, -d.end, d.rule))
        furthest = -1
        for d in same:
            k = bisect.bisect_right(starts, d.start)
            inside = (k > 0 and reach[k - 1] >= d.end) or furthest >= d.end
            furthest = max(furthest, d.end)
            if listed[d.rule].base or not inside:
                kept.append(d)
        pairs = sorted([*zip(starts, reach, strict=True), *((d.start, d.end) for d in same)])
        starts = [s for s, _ in pairs]
        reach = np.maximum.accumulate([e for _, e in pairs]).tolist()
    return sorted(kept)


def scan_text(text: bytes) -> dict:
    """The columns of one text, see ``scan_licenses``."""
    listed, _ = _prefilter()
    words = words_of(text)
    found = detect(words)
    spaces = np.flatnonzero(np.frombuffer(words.encode("latin-1"), np.uint8) == 32) if found else np.zeros(0, np.int64)
    word_at = lambda place: int(np.searchsorted(spaces, place)) - 1
    kept = resolve(found, listed)
    base = sorted(word_at(d.start) for d in found if listed[d.rule].base)
    return {
        "n_words": words.count(" ") - 1,
        "n_base": len(base),
        "first_word": base[0] if base else None,
        "last_word": base[-1] if base else None,
        "base_labels": ",".join(sorted({listed[d.rule].label for d in found if listed[d.rule].base})),
        "labels": ",".join(sorted({listed[d.rule].label for d in kept})),
        "score": max((listed[d.rule].confidence for d in kept), default=0.0),
        "detections": [{"label": listed[d.rule].label, "priority": listed[d.rule].priority, "first_word": word_at(d.start), "last_word": word_at(d.end - 1)} for d in kept],
    }


_DETECTION = pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])
_SHAPE = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(_DETECTION)),
])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. ``n_base`` counts all places
    of the base phrases, ``first_word`` and ``last_word`` are their smallest and largest start, counted in words from
    0 (null without any). ``labels`` are those of the detections that stay, the base ones with them; ``score`` is the
    highest confidence among these, 0 without any. ``detections`` are the intervals that stay, in words. Null texts
    count as empty; rows are independent of one another; other columns are ignored; no rows give no rows. A task
    holds one text, of any length, and its detections.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at = utf8(part.column(1))
                held, bounds = data.tobytes(), at.tolist()
                rows = [scan_text(held[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_pylist([{"doc_id": i, **row} for i, row in zip(ids, rows, strict=True)], _SHAPE)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(scan, f"{fields}, detections array<struct<label: string, priority: int, first_word: long, last_word: long>>")


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")
