"""Byte-level BPE by recursive DuckDB queries inside the tasks that Spark deals out.

A task splits its texts into words and looks up the distinct ones it hasn't met. Pairs of two bytes that nothing can
forestall, and whose token takes part in no pair of a lower rank, are contracted first, from tables by two bytes. A
recursive query then holds one row per token position, joins neighbouring tokens with the merge table and contracts, in
every word, the leftmost pair of the least rank until no pair can be merged. Where no pair with the merged token could
have a lower rank, all pairs of that rank go together, so long runs of one character take few steps. Long words that one
query leaves open go on in a second form, where all pairs go at once that nothing can forestall: a pair of rank m whose
neighbouring pairs have higher ranks, where no longer token that ends with the one before the pair (or begins with the
one after it) has a pair of rank m or less with the pair's own token. Whatever is merged around such a pair first, it is
still there when its rank's turn comes, so the steps of a word grow with the depth of its merges, not with its length.
Words are cut where no token of the vocabulary holds the two bytes. All this gives exactly the ids of one contraction at
a time. Decoding joins ids with the vocabulary and aggregates the bytes in order.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import pieces, read_table, runs, utf8
from watchloom.llm.pretoken import WordIds

#: Token positions that a recursive query starts from (one uncut word at least), and rows that all its steps may hold.
POSITIONS, STEP_ROWS = 150_000, 2_000_000
#: Positions of a word that one query leaves open, from which on the second form of the steps is used.
LONG = 256
#: The rank of what is no pair.
NEVER = np.iinfo(np.int32).max
#: Bytes of memory of the database, and for each position of an uncut word where that is more; nothing is spilled.
MEMORY, POSITION_MEMORY = 400 << 20, 1_000

# g is a token's place among all words of the query, w its word. A pick is a pair to contract: its left row takes the
# merged id, its right row goes. Of a run of one token every other pair is picked, counted from the run's beginning.
_STEPS = """
with recursive steps as (
  select 0 as step, w, g, t from start
  union all
  (with pairs as (
     select w, g, t, lead(t) over o as nt, lead(w) over o as nw, lead(g) over o as ng, row_number() over o as k
     from steps where step < {most} window o as (order by g)),
   ranked as (
     select p.w, p.g, p.t, p.nt, p.ng, p.k, m.m, m.safe from pairs p join merges m on m.l = p.t and m.r = p.nt where p.nw = p.w),
   best as (select w, min((m::bigint << 32) | g) as key from ranked group by w),
   hits as (select r.*, b.key & 4294967295 as leftmost from ranked r join best b using (w) where r.m = b.key >> 32),
   picks as (
     select g, ng, m from hits where g = leftmost or (safe and t <> nt)
     union all
     select g, ng, m from (
       select *, row_number() over (partition by w, run order by g) as place
       from (select *, k - row_number() over (order by g) as run from hits where safe and t = nt))
     where place % 2 = 1 and g <> leftmost),
   moves as (select g, m from picks union all select ng, -1 from picks)
   select s.step + 1, s.w, s.g, coalesce(x.m, s.t) from steps s join best using (w) left join moves x on x.g = s.g
   where coalesce(x.m, 0) >= 0))
select w, g, t, step from steps join (select w, max(step) as step from steps group by w) using (w, step) order by g
"""

# The same for words with many steps: all pairs that nothing can forestall go at once, at the price of two more joins.
_LONG_STEPS = """
with recursive steps as (
  select 0 as step, w, g, t from start
  union all
  (with pairs as (
     select w, g, t, lead(t) over o as nt, lead(g) over o as ng, lag(t) over o as bt, lead(t, 2) over o as nnt, row_number() over o as k
     from steps where step < {most} window o as (partition by w order by g)),
   ranked as (
     select p.*, m.m, m.safe, coalesce(a.m > m.m, true) and coalesce(b.m > m.m, true) as alone
     from pairs p join merges m on m.l = p.t and m.r = p.nt
     left join thief_before a on a.x = p.bt and a.r = p.t left join thief_after b on b.l = p.nt and b.x = p.nnt),
   best as (select w, min((m::bigint << 32) | g) as key from ranked group by w),
   hits as (
     select r.*, (r.m::bigint << 32) | r.g = b.key as own, coalesce(lag(k) over o <> k - 1 or lag(m) over o > m, true) as fore,
       coalesce(lead(k) over o <> k + 1 or lead(m) over o >= m, true) and (alone or (safe and r.m = b.key >> 32)) as aft
     from ranked r join best b using (w) window o as (partition by r.w order by r.k)),
   alike as (
     select *, row_number() over o as place, first_value(fore and aft) over o as led
     from (select *, k - row_number() over (partition by w order by k) as run from hits where t = nt) window o as (partition by w, run order by k)),
   picks as (
     select g, ng, m from hits where t <> nt and (own or (fore and aft))
     union all
     select g, ng, m from alike where (place = 1 and own) or (place % 2 = 1 and led and aft)),
   moves as (select g, m from picks union all select ng, -1 from picks)
   select s.step + 1, s.w, s.g, coalesce(x.m, s.t) from steps s join best using (w) left join moves x on x.g = s.g
   where coalesce(x.m, 0) >= 0))
select w, g, t, step from steps join (select w, max(step) as step from steps group by w) using (w, step) order by g
"""

_DECODE = """
select doc, from_hex(array_to_string(list(h order by pos), '')) as bytes
from ids join vocabulary using (id) group by doc order by doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Bpe:
    """The vocabulary and merge table of one rank file in an in-memory database of the Python worker."""

    def __init__(self, path: str):
        import duckdb

        ranks = read_ranks(path)
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        l, r, m = (np.array(c, np.int32) for c in zip(*splits, strict=True))
        self.joined = np.zeros((256, 256), bool)  # the pairs of bytes that stand together in a token
        for t in ranks:
            self.joined[tuple(np.frombuffer(t, np.uint8)[k:][: len(t) - 1] for k in (0, 1))] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY >> 20}MiB", "temp_directory": ""})
        unsafe = np.zeros(max(ranks.values()) + 1, bool)
        unsafe[l[m < l]] = True
        unsafe[r[m < r]] = True
        # by two bytes: the rank of their pair, and the least rank at which a longer token that ends with the first takes
        # the second, or one that begins with the second takes the first
        self.pair, self.taken_before, self.taken_after = np.full((3, 256, 256), NEVER, np.int32)
        for t, k in ranks.items():
            if len(t) == 2:
                self.pair[t[0], t[1]] = k
            elif len(t) > 2:
                if t[:-1] in ranks:
                    self.taken_before[t[-2], t[-1]] = min(k, self.taken_before[t[-2], t[-1]])
                if t[1:] in ranks:
                    self.taken_after[t[0], t[1]] = min(k, self.taken_after[t[0], t[1]])
        known = self.pair < NEVER
        self.sure = known & ~np.eye(256, dtype=bool)
        self.sure[known] &= ~unsafe[self.pair[known]]
        self.db.register("given", pa.table({"l": l, "r": r, "m": m, "safe": ~unsafe[m]}))
        self.db.execute("create table merges as select * from given")
        name = {r: t for t, r in ranks.items()}
        before, after = {}, {}
        for a, b, c in zip(l.tolist(), r.tolist(), m.tolist(), strict=True):
            for k in range(1, len(name[a])):
                if (x := ranks.get(name[a][k:])) is not None:
                    before[x, b] = min(c, before.get((x, b), c))
            for k in range(1, len(name[b])):
                if (x := ranks.get(name[b][:k])) is not None:
                    after[x, a] = min(c, after.get((x, a), c))
        for table, found, other in (("thief_before", before, "r"), ("thief_after", after, "l")):
            keys = np.array(list(found), np.int32).reshape(-1, 2)
            self.db.register("found", pa.table({"x": keys[:, 0], other: keys[:, 1], "m": np.fromiter(found.values(), np.int32, len(found))}))
            self.db.execute(f"create table {table} as select * from found")
        self.db.register("tokens", pa.table({"id": np.fromiter(ranks.values(), np.int32, len(ranks)), "h": [t.hex() for t in ranks]}))
        self.db.execute("create table vocabulary as select * from tokens")
        self.words = WordIds(self.encode_words, 300_000)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids in a row."""
        known = np.fromiter(map(self.ranks.get, words, repeat(-1)), np.int64, len(words))
        rest = np.flatnonzero(known < 0)
        counts, parts = np.ones(len(words), np.int64), [(np.flatnonzero(known >= 0), known[known >= 0].astype(np.int32))]
        if not len(rest):
            return counts, parts[0][1]
        unknown = [words[k] for k in rest.tolist()]
        sizes = np.fromiter(map(len, unknown), np.int64, len(rest))
        data = np.frombuffer(b"".join(unknown), np.uint8)
        cut = np.append(True, ~self.joined[data[:-1], data[1:]])
        cut[np.cumsum(sizes)[:-1]] = True
        begins = np.flatnonzero(cut)
        ends = np.append(begins[1:], len(data))
        of = np.repeat(rest, sizes)[begins]
        counts[rest], first = 0, 0
        while first < len(begins):
            last = max(first + 1, int(np.searchsorted(ends, begins[first] + POSITIONS, "right")))
            w, t = self._contract(np.repeat(np.arange(last - first), ends[first:last] - begins[first:last]), data[begins[first] : ends[last - 1]])
            parts.append((of[first + w], t))
            counts += np.bincount(of[first + w], minlength=len(words))
            first = last
        owner = np.concatenate([p[0] for p in parts])
        return counts, np.concatenate([p[1] for p in parts])[np.argsort(owner, kind="stable")]

    def _first_pairs(self, part: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part number, token id) after the pairs of two bytes that nothing can forestall and whose token forestalls nothing."""
        here, after = data[:-1], data[1:]
        rank = np.full(len(data) + 1, NEVER, np.int32)  # of the pair that ends at a byte
        before, behind = rank.copy(), rank.copy()
        inside = part[1:] == part[:-1]
        rank[1:-1] = np.where(inside, self.pair[here, after], NEVER)
        before[1:-1] = np.where(inside, self.taken_before[here, after], NEVER)
        behind[1:-1] = np.where(inside, self.taken_after[here, after], NEVER)
        own = rank[1:-1]
        pick = (own < np.minimum(rank[:-2], rank[2:])) & (own < np.minimum(before[:-2], behind[2:])) & self.sure[here, after]
        tokens = self.bytes[data]
        tokens[:-1][pick] = own[pick]
        kept = np.append(True, ~pick)
        return part[kept], tokens[kept]

    def _contract(self, part: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part number, token id) of all tokens of the parts of words whose bytes are given, in order."""
        part, tokens = self._first_pairs(part, data)
        state = {"w": part.astype(np.int32), "t": tokens}
        done, steps = [], _STEPS
        self.db.execute(f"set memory_limit = '{max(MEMORY, len(data) * POSITION_MEMORY) >> 20}MiB'")
        while n := len(state["w"]):
            most = max(1, min(24, STEP_ROWS // n))
            self.db.register("start", pa.table(state | {"g": np.arange(n, dtype=np.int32)}))
            out = self.db.execute(steps.format(most=most)).fetchnumpy()
            self.db.unregister("start")
            open_ = out["step"] >= most  # the steps of this query didn't reach the end
            steps = _LONG_STEPS if open_.any() and np.bincount(out["w"][open_]).max() >= LONG else _STEPS
            done.append((out["w"][~open_], out["t"][~open_]))
            state = {c: np.ascontiguousarray(out[c][open_], np.int32) for c in state}
        w = np.concatenate([d[0] for d in done])
        order = np.argsort(w, kind="stable")
        return np.asarray(w[order], np.int64), np.concatenate([d[1] for d in done])[order].astype(np.int32)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each text whose ids lie between neighbouring offsets."""
        sizes = np.diff(offsets)
        self.db.register("ids", pa.table({"doc": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "pos": runs(sizes).astype(np.int32), "id": ids.astype(np.int32)}))
        found = dict(self.db.execute(_DECODE).fetchall())
        self.db.unregister("ids")
        return [found.get(k, b"") for k in range(len(sizes))]


@functools.cache
def bpe(path: str) -> Bpe:
    """A worker keeps its tables and the words it has met from task to task."""
    return Bpe(path)


def bpe_encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of whole texts, by the ranks in a file, without special tokens.

    Null and empty texts have no ids. Rows stay apart: repeats and null ids come out as often as they went in. With
    ``decoded`` the same task decodes the ids again, as ``bpe_decode`` would, which spares a second Python worker.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                offsets, ids = bpe(ranks).words.texts(*utf8(part.column(1)))
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
                if decoded:
                    columns.append(pa.array(bpe(ranks).decode(offsets, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids", *["decoded"] * decoded]
    schema = "doc_id long, ids array<int>" + ", decoded binary" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


def bpe_decode(coded: DataFrame, ranks: str) -> DataFrame:
    """The rows of ``coded`` (doc_id, ids) with the bytes their ids stand for, as ``decoded``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, lists = 0, batch.column(1)
            ends = np.asarray(lists.offsets)
            while first < batch.num_rows:
                last = max(first + 1, min(batch.num_rows, int(np.searchsorted(ends, ends[first] + 200_000, "right")) - 1))
                part = batch.slice(first, last - first)
                ids = part.column(1)
                offsets = np.asarray(ids.offsets, np.int64)
                texts = bpe(ranks).decode(offsets - offsets[0], ids.flatten().to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])
                first = last

    return coded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded binary")


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """Counts and digests of decoded rows: the ids as decimals joined by a space, and the bytes; and columns named."""
    return coded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(bpe_encode(read_table(spark, sf_dir, "documents"), ranks, decoded=True))
