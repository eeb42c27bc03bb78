"""The whole pipeline against a plain version of its stages."""

from __future__ import annotations

import hashlib

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.helpers import ROWS, SCHEMA, awkward, near_components, near_family
from watchloom.llm import bpe, raking

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_stages(session, tmp_path):
    rows = ROWS + [(k + 100, *r[1:]) for k, r in enumerate(near_family(n=60))]
    docs = awkward(session).unionByName(session.createDataFrame(rows[len(ROWS) :], SCHEMA), allowMissingColumns=True)
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")

    kept = [list(r) for r in rows if any(c.isalpha() for c in r[1] or "")]
    first: dict = {}
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(r[1], r)
    kept = list(first.values())
    near = near_components([r for r in kept if r[0] is not None], 5)
    kept = [r for r in kept if r[0] is None or near[r[0]][1] == r[0]]
    named = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(session, docs, "").collect()}
    con = duckdb.connect()
    con.execute("create table kept (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into kept values (?, ?, ?, ?, ?)", [[r[0], r[1], r[2] or named[r[0]], r[3], r[4]] for r in kept])
    drawn = con.execute(f"with {raking.mixing_sql('kept')} select doc_id, text from mixed where sampled").fetchall()
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    want = [(i, coder.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in drawn]

    got = corpus_pipeline.run(session, str(tmp_path)).collect()
    assert sorted([(r.doc_id, list(r.ids), r.decoded_sha256) for r in got], key=str) == sorted(want, key=str)
    assert 3 < len(want) < len(kept)


def test_documents_stay_where_no_row_names_a_language(session):
    docs = session.createDataFrame([(r[0], r[1], None, *r[3:]) for r in ROWS], SCHEMA)
    got = [(r.doc_id, r.lang) for r in corpus_pipeline.identify_language(session, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(r[0], "und") for r in ROWS if any(c.isalpha() for c in r[1] or "")], key=str)


def test_stages_keep_columns_and_stand_empty_tables(session):
    docs = awkward(session).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(session, docs, "")
        assert out.count() == 0, name
        assert name == "encode" or out.columns == NAMES
