"""Token files and byte-level BPE against the libraries, and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ROWS, awkward, empty
from watchloom.llm import bpe, simple8b
from watchloom.llm.common import scratch, utf8
from watchloom.llm.pretoken import WordIds, split_words

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.just(0), max_size=3000), st.integers(1, 300))
def test_blocks_round_trip(values, block):
    ids = np.array(values, np.uint64)
    words, firsts, sizes = simple8b.encode_blocks(ids, block)
    assert (simple8b.decode_blocks(words, firsts, sizes) == ids).all()
    assert len(words) <= 2 * max(1, len(ids))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t'strevldm ab1²é  !?漢\x1c"))) | st.text(), max_size=6))
def test_split_is_the_pattern(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    words, at = split_words(*utf8(pa.array(texts, pa.string())))
    found = words.to_pylist()
    for k, t in enumerate(texts):
        assert found[at[k] : at[k + 1]] == [w.encode() for w in regex.findall(public_tokenizers.PATTERN, t)]


def test_cache_starts_anew_when_full():
    seen = []
    cache = WordIds(lambda words: (seen.extend(words), (np.array([len(w) for w in words]), np.array([c for w in words for c in w], np.int32)))[1], most=3)
    for text in ("a bb", "a ccc d", "a bb"):
        offsets, ids = cache.texts(*utf8(pa.array([text])))
        assert bytes(ids.astype(np.uint8).tobytes()) == text.encode() and offsets.tolist() == [0, len(text)]
    assert len(seen) > 4


def test_full_cache_keeps_words_met_again():
    seen = []
    cache = WordIds(lambda words: (seen.extend(words), (np.array([len(w) for w in words]), np.array([c for w in words for c in w], np.int32)))[1], most=4)
    for text in ("a bb", "xx bb", "yy zz bb", "uuu bb", "a"):
        offsets, ids = cache.texts(*utf8(pa.array([text])))
        assert bytes(ids.astype(np.uint8).tobytes()) == text.encode() and offsets.tolist() == [0, len(text)]
        assert len(cache.slot) <= 4
    assert seen.count(b" bb") == 1 and seen.count(b"a") == 2


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_words_as_tiktoken(encoding):
    coder = bpe.bpe(RANKS)
    words = [w.encode() for w in ("aaaa", "a" * 777, "abab" * 90, " !!!!!!!!" * 9, "=-" * 300, "éé漢", "internationalisation", " xqzjk", "----", "the")]
    counts, ids = coder.encode_words(words)
    assert [ids[e - c : e].tolist() for c, e in zip(counts, np.cumsum(counts), strict=True)] == [encoding._encode_single_piece(w) for w in words]


def test_queries_start_from_sure_pairs(encoding):
    coder, words = bpe.bpe(RANKS), [w.encode() for w in (" internationalisation", " Verantwortungsbereich", "electroencephalograph", " xqzjk", " désordonnément")]
    part, data = np.repeat(np.arange(len(words)), [len(w) for w in words]), np.frombuffer(b"".join(words), np.uint8)
    of, tokens = coder._first_pairs(part, data)
    assert len(tokens) < 0.8 * len(data) and coder.decode(np.searchsorted(of, np.arange(len(words) + 1)), tokens) == words
    of, tokens = coder._contract(part, data)
    assert [tokens[of == k].tolist() for k in range(len(words))] == [encoding._encode_single_piece(w) for w in words]


def test_any_ranks_as_tiktoken(tmp_path):
    """Also tokens that no two tokens of lower rank make."""
    draw = random.Random(11)
    for k in range(30):
        longer = [b"ab", *("".join(draw.choices("abc", k=draw.randint(2, 5))).encode() for _ in range(draw.choice((6, 30, 120))))]
        tokens = [bytes([b]) for b in range(256)] + sorted(set(longer))
        if k % 2:
            draw.shuffle(tokens)
        path = tmp_path / f"{k}.tiktoken"
        path.write_bytes(b"".join(b"%s %d\n" % (base64.b64encode(t), r) for r, t in enumerate(tokens)))
        own = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
        words = ["".join(draw.choices("abcd", (5, 5, 5, 1), k=draw.randint(1, 40))).encode() for _ in range(300)]
        counts, ids = bpe.Bpe(path).encode_words(words)
        assert [ids[e - c : e].tolist() for c, e in zip(counts, np.cumsum(counts), strict=True)] == [own._encode_single_piece(w) for w in words]


def test_added_tokens_as_the_library():
    texts = ["one <|endoftext|> two", "<|endoftext|>", "", "<|endoftext|><|endoftext|> x", "a<|endoftext|", "plain  words", "é<|endoftext|>\n漢", None, "<|endoftext|> end <|endoftext|>"]
    offsets, ids = simple8b.text_ids(JSON).texts(*utf8(pa.array(texts, pa.string())))
    library = Tokenizer.from_file(JSON)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids[:4].tolist() == [505, 220, 50256, 734]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aeth -=n")), min_size=1, max_size=60) | st.text(min_size=1, max_size=20), min_size=1, max_size=8))
def test_any_word_as_tiktoken(encoding, words):
    words = [w.encode("utf-8", "ignore") or b"x" for w in words]
    counts, ids = bpe.bpe(RANKS).encode_words(words)
    assert [ids[e - c : e].tolist() for c, e in zip(counts, np.cumsum(counts), strict=True)] == [encoding._encode_single_piece(w) for w in words]


def test_long_words_take_few_steps(encoding):
    draw = random.Random(5)
    letters = lambda some, n: "".join(draw.choice(some) for _ in range(n)).encode()
    coder, begun = bpe.bpe(RANKS), time.monotonic()
    words = [letters("abcdefghijklmnopqrstuvwxyz", 20_000), letters("ACGT", 20_000), letters([chr(0x4E00 + k) for k in range(3000)], 20_000), base64.b64encode(draw.randbytes(15_000))]
    longer = [letters("abcdefghijklmnopqrstuvwxyz", 200_000), b"a" * 200_000, letters("ACGT", 200_000), base64.b64encode(draw.randbytes(150_000))]
    for word in words + longer:
        counts, ids = coder.encode_words([word])
        assert coder.decode(np.array([0, len(ids)]), ids) == [word]
        if word in words:
            assert ids.tolist() == encoding._encode_single_piece(word)
    assert time.monotonic() - begun < 60


def test_bpe_rows(session, encoding):
    coded = bpe.bpe_decode(bpe.bpe_encode(awkward(session), RANKS), RANKS)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in coded.collect()), key=str)
    assert got == sorted(((i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS), key=str)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in bpe.bpe_encode(awkward(session), RANKS, decoded=True).collect()), key=str) == got
    row = bpe.digests(coded).where("doc_id = 15").first()
    ids = encoding.encode_ordinary("two words")
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.bpe_decode(bpe.bpe_encode(empty(session), RANKS), RANKS).count() == 0


def test_token_files(session):
    folder = scratch(session, "test-ids")
    manifest = simple8b.write_ids(awkward(session), folder, JSON)
    got = simple8b.read_ids(manifest, folder).orderBy("start").collect()
    library = Tokenizer.from_file(JSON)
    want, start = [], 0
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert {r.crc for r in simple8b.read_ids(manifest, folder).where("doc_id = 13").select(F.crc32("ids").alias("crc")).collect()} == {zlib.crc32(np.array(next(w[3] for w in want if w[0] == 13), "<u4").tobytes())}
    assert simple8b.read_ids(simple8b.write_ids(empty(session), scratch(session, "test-none"), JSON), folder).count() == 0
