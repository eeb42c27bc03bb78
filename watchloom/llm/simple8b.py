"""Token ids as word-aligned binary files: Simple-8b words in blocks, with an index for random access.

A 64-bit word holds a 4-bit selector and 60 bits of payload: 60 ids of 1 bit, 30 of 2, ... , one of 60. Selector 15
is the escape: the next word is one raw 64-bit id. Every block of ``BLOCK`` ids starts at a word of its own, whose
number stands in the index, so blocks decode apart from each other and whole columns of words decode at once.

File: magic; words; for each block its first word (u64) and its ids (u32); for each document its id (i64), whether it
has one (u8) and its number of ids (u64); numbers of words, blocks and documents (u64 each); magic. Little-endian.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.llm.common import pieces, read_table, runs, scratch, utf8, written
from watchloom.llm.pretoken import WordIds

MAGIC = b"S8BIDS01"
BLOCK = 1024
#: Ids a word can hold, in the order of the selectors 0, 1, ...; each has 60 // n bits.
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15

_N = np.array([*PER_WORD, 0, 0], np.int64)
_SELECTOR = {n: s for s, n in enumerate(PER_WORD)}
_SMALL_WIDTHS = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)
#: A window of n values is two smaller ones, side by side.
_WINDOWS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (10, 5), 20: (10, 10), 30: (15, 15), 60: (30, 30)}


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, ids of each block) of unsigned ids; all blocks advance side by side."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = -(-n // block)
    grid = np.zeros((rows, block + 60), np.uint64)
    full = np.zeros(rows * block, np.uint64)
    full[:n] = ids
    grid[:, :block] = full.reshape(rows, block)
    sizes = np.full(rows, block)
    sizes[-1] = n - (rows - 1) * block
    width = _widths(grid)
    most = {1: width}
    best = (width[:, :block] <= 60).astype(np.uint8)
    for m, (a, b) in _WINDOWS.items():
        most[m] = np.maximum(most[a][:, : block + 61 - m], most[b][:, a : a + block + 61 - m])
        np.copyto(best, np.uint8(m), where=most[m][:, :block] <= 60 // m)
    # Where each block's next word starts; a finished block stays at the stop behind its last id.
    stride = block + 60
    jump = np.zeros((rows, stride), np.int64)
    jump[:, :block] = np.maximum(best, 1)
    jump[np.arange(stride) >= sizes[:, None]] = 0
    jump, at, took = jump.ravel(), np.arange(rows) * stride, []
    while len(live := np.flatnonzero(step := jump.take(at))):
        took.append(at if len(live) == rows else at[live])
        at = at + step
    spot = np.sort(np.concatenate(took))
    row = spot // stride
    count = best.ravel().take(row * block + spot - row * stride)
    cost = (count == 0).astype(np.int64) + 1
    where = np.cumsum(cost) - cost
    words, flat = np.zeros(int(cost.sum()), np.uint64), grid.ravel()
    for m in np.flatnonzero(np.bincount(count)).tolist():
        of = np.flatnonzero(count == m)
        ids_at = spot[of]
        if m == 0:
            words[where[of]] = np.uint64(ESCAPE) << np.uint64(60)
            words[where[of] + 1] = flat[ids_at]
            continue
        word = np.full(len(of), _SELECTOR[m] << 60, np.uint64)
        for j in range(m):
            word |= flat.take(ids_at + j) << np.uint64(j * (60 // m))
        words[where[of]] = word
    return words, where[np.searchsorted(row, np.arange(rows))], sizes


def _widths(grid: np.ndarray) -> np.ndarray:
    """The bits of each value, 1 at least; above 2**53 rounding may add one, which only costs room."""
    if len(grid) and grid.max() < 1 << 16:
        return _SMALL_WIDTHS.take(grid.astype(np.int64))
    return np.maximum(np.frexp(grid.astype(np.float64))[1], 1).astype(np.uint8)


def decode_blocks(words: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All ids of adjoining blocks; ``firsts`` counts from the first of ``words``."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = []
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw or raw[-1] != i:  # a raw word may look like an escape
            raw.append(i + 1)
    raw = np.array(raw, np.int64)
    counts = _N[selector]
    if len(raw):
        counts[raw - 1] = 0
        counts[raw] = 1
    begins = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), np.uint64)
    for m in np.flatnonzero(np.bincount(counts)).tolist():
        of = np.flatnonzero(counts == m)
        width = np.uint64(60 // m) if m else np.uint64(0)
        for j in range(m):
            ids[begins[of] + j] = (words[of] >> (np.uint64(j) * width)) & ((np.uint64(1) << width) - np.uint64(1))
    if len(raw):
        ids[begins[raw]] = words[raw]
    made = np.add.reduceat(counts, firsts)
    return ids[runs(made) < np.repeat(sizes, made)]


class Writer:
    """Writes one file, documents in the order given."""

    def __init__(self, out):
        self.out, self.rest, self.words = out, np.zeros(0, np.uint64), 0
        self.firsts, self.sizes, self.keys, self.known, self.lengths = [], [], [], [], []
        out.write(MAGIC)

    def add(self, keys: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys), self.known.append(known), self.lengths.append(lengths)
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        words, firsts, sizes = encode_blocks(ids)
        self.out.write(words.astype("<u8").tobytes())
        self.firsts.append(firsts + self.words)
        self.sizes.append(sizes)
        self.words += len(words)

    def close(self) -> None:
        self._blocks(self.rest)
        of = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        firsts, sizes, lengths = of(self.firsts, "<u8"), of(self.sizes, "<u4"), of(self.lengths, "<u8")
        for part in (firsts, sizes, of(self.keys, "<i8"), of(self.known, "u1"), lengths, np.array([self.words, len(firsts), len(lengths)], "<u8")):
            self.out.write(part.tobytes())
        self.out.write(MAGIC)


def read_file(file, at_once: int = 1024) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, their numbers of token ids, all those ids) of a file, in order, some blocks at a time."""
    size = file.size()
    tail = file.read_at(32, size - 32)
    if file.read_at(8, 0) != MAGIC or tail[24:] != MAGIC:
        raise ValueError("not a token file")
    n_words, n_blocks, n_docs = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
    index, docs = 8 + 8 * n_words, 8 + 8 * n_words + 12 * n_blocks
    firsts = np.frombuffer(file.read_at(8 * n_blocks, index), "<u8").astype(np.int64)
    sizes = np.frombuffer(file.read_at(4 * n_blocks, index + 8 * n_blocks), "<u4").astype(np.int64)
    keys = np.frombuffer(file.read_at(8 * n_docs, docs), "<i8")
    known = np.frombuffer(file.read_at(n_docs, docs + 8 * n_docs), "u1")
    lengths = np.frombuffer(file.read_at(8 * n_docs, docs + 9 * n_docs), "<u8").astype(np.int64)
    ends, done, held, seen = np.cumsum(lengths), 0, [], 0
    bounds = np.append(firsts, n_words)
    for b in range(0, n_blocks, at_once):
        last = min(b + at_once, n_blocks)
        lo, hi = int(bounds[b]), int(bounds[last])
        words = np.frombuffer(file.read_at(8 * (hi - lo), 8 + 8 * lo), "<u8")
        ids = decode_blocks(words, firsts[b:last] - lo, sizes[b:last])
        held.append(ids)
        seen += len(ids)
        upto = int(np.searchsorted(ends, seen, "right"))
        if upto > done or last == n_blocks:
            upto = n_docs if last == n_blocks else upto
            together = np.concatenate(held)
            cut = int(lengths[done:upto].sum())
            yield [int(k) if x else None for k, x in zip(keys[done:upto], known[done:upto], strict=True)], lengths[done:upto], together[:cut]
            held, done = [together[cut:]], upto
    if not n_blocks and n_docs:
        yield [int(k) if x else None for k, x in zip(keys, known, strict=True)], lengths, np.zeros(0, np.uint64)


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as URI or path."""
    return fs.FileSystem.from_uri(folder)


class TextIds:
    """Ids of texts by the tokenizers library, as its ``encode(text, add_special_tokens=False)`` gives them.

    Texts are cut at the file's added tokens first, the longest of those that begin at a place; what lies between is
    split into words, whose ids are remembered. A file with a normalizer, with another split than that of byte-level
    tokenizers without a prefix space, or with added tokens that take in their surroundings is refused.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        own = Tokenizer.from_file(tokenizer)
        told = json.loads(own.to_str())
        split, added = told["pre_tokenizer"] or {}, told["added_tokens"]
        if told["normalizer"] or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError("not a byte-level tokenizer without normalizer and prefix space")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on the text around them")
        model, letters = own.model, sorted(pre_tokenizers.ByteLevel.alphabet())
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that stand for themselves
        moved = [b for b in range(256) if b not in set(plain)]
        table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(moved)}
        assert sorted(table.values()) == letters, "the vocabulary isn't byte-level"

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [[x.id for x in model.tokenize(w.decode("latin-1").translate(table))] for w in words]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return counts, np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum()))

        self.words = WordIds(encode, 700_000)
        self.added = {t["content"].encode(): t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile(b"|".join(map(re.escape, longest))) if longest else None

    def texts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n + 1 offsets of each text's ids, and all ids in a row."""
        raw = data.tobytes()
        if self.marks is None or not self.marks.search(raw):
            return self.words.texts(data, at)
        gaps, own = [], []  # the parts between added tokens, and the id after each of them but a text's last
        first = np.zeros(len(at), np.int64)
        for k, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            for m in self.marks.finditer(raw, lo, hi):
                gaps.append(raw[lo : m.start()])
                own.append(self.added[m[0]])
                lo = m.end()
            gaps.append(raw[lo:hi])
            own.append(-1)
            first[k + 1] = len(gaps)
        offsets, ids = self.words.texts(*utf8(pa.array(gaps, pa.binary())))
        marks = np.array(own, np.int64)
        ids = np.insert(ids, offsets[1:][marks >= 0], marks[marks >= 0])
        return (offsets + np.append(0, np.cumsum(marks >= 0)))[first], ids


@functools.cache
def text_ids(tokenizer: str) -> TextIds:
    """A worker keeps the words it has met from task to task."""
    return TextIds(tokenizer)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """Tokenize whole texts and write their ids, in ascending id order, as files in a shared folder.

    One file per range of ids. Returns the manifest, a written table: path, first_id, n_docs, n_ids, and start, the
    number of ids in the files before. Null texts count as empty; null ids come first; rows that repeat an id keep
    the order of their texts. Each task attempt writes a file of its own name and only the manifest's files count,
    so retries and speculative tasks leave no trace in the result. The order key has the documents evenly split by
    ranges; a table without rows gives an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, totals = None, None, [0, 0]
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                if writer is None:
                    system, base = store(folder)
                    system.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.s8b"
                    out = system.open_output_stream(path)
                    writer, first = Writer(out), part.column(0)[0].as_py()
                offsets, ids = text_ids(tokenizer).texts(*utf8(part.column(1)))
                lengths = np.diff(offsets)
                if end_id is not None:
                    ids = np.insert(ids, offsets[1:], end_id)
                    lengths = lengths + 1
                keys = part.column(0)
                writer.add(keys.fill_null(0).to_numpy(), np.asarray(keys.is_valid()).astype(np.uint8), lengths, ids)
                totals = [totals[0] + len(lengths), totals[1] + int(lengths.sum())]
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first_id": first, "n_docs": totals[0], "n_ids": totals[1]}])

    files = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "path string, first_id long, n_docs long, n_ids long")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, so the window over the whole manifest is short.
    return written(written(files, "ids-files").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "ids-manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from its file: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``ids`` holds the ids as little-endian unsigned 32-bit integers. A file is read some blocks at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as file:
                    for keys, lengths, ids in read_file(file):
                        ends = np.cumsum(lengths)
                        data = pa.py_buffer(ids.astype("<u4").tobytes())
                        offsets = pa.py_buffer(np.append(0, ends * 4).astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, offsets, data])],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        start += int(lengths.sum())

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    """Whole documents through the binary token files and back."""
    import public_tokenizers

    folder = scratch(spark, "ids")
    manifest = write_ids(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
