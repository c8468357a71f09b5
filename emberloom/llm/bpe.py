"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

Each task cuts its texts into pre-tokens, and the distinct new pre-tokens of a block of documents become rows
``(word, position, token)`` in an in-process DuckDB. One recursive query joins neighbouring rows with the merge
table, contracts in every word the leftmost pair of minimum rank, and repeats until no word has a pair left.
Decoding joins ids with the vocabulary and concatenates the pieces by an aggregate ordered by position.

A recursive query keeps the rows of all its rounds, so words go to it in slices of a bounded number of rows. For
pre-tokens of more than ``LONG`` bytes, whose rounds would be too many, the query contracts all occurrences of the
pair of minimum rank in one round, as far as contracting them one by one would have come before another pair was
due, and is called again after a bounded number of rounds. The ids are the same.

A memo of bounded size keeps what a worker has already encoded. A text of more than ``BLOCK_CHARS`` characters is
cut and encoded some chunks at a time, and ids are decoded in slices of ``DECODE_IDS``, so that memory is bounded
by those sizes and the longest single pre-token (some 60 bytes for each byte of it).

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; a null
``doc_id`` stays null; repeated rows each give a row; other columns of the input are not read. Texts are
encoded whole at any length.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters with Unicode's White_Space property. Fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Stands before a chunk that is given as it is, without a space to be put before it.
MARK = "\x01"
#: What makes a text take the pattern: white space whose runs must be seen together, rare spaces, and MARK.
UNEVEN = ("  ", " \n", "\n ", "\n\n", MARK, *SPACES.replace(" ", "").replace("\n", ""))
LONG = 200
MEMO_ROWS = 600_000
BLOCK_CHARS = 2_000_000
BLOCK_CHUNKS = 300_000
DECODE_IDS = 1_000_000
#: Rows that one recursive query may make in all its rounds.
QUERY_ROWS = 6_000_000

_CONTRACT = """
with recursive state(kk, t, done) as (
  select kk, t, false from words
  union all
  (with pairs as (
     select kk, t, lead(kk) over win as nk, (t::bigint << 20) | lead(t) over win as pair
     from state where not done window win as (order by kk)),
   best as (
     select p.kk >> 18 as w, min((m.merged::bigint << 36) | ((p.kk & 262143) << 18) | (p.nk & 262143)) as x
     from pairs p join merges m on m.pair = p.pair where p.kk >> 18 = p.nk >> 18 group by 1)
   select kk, case when (kk & 262143) = ((x >> 18) & 262143) then (x >> 36)::int else t end, x is null
   from pairs left join best on kk >> 18 = w
   where x is null or (kk & 262143) <> (x & 262143))
)
select kk >> 18 as w, t from state where done order by kk
"""

#: As above, but every occurrence of a word's pair of minimum rank at once, and ``rounds`` rounds at most. Rows that
#: follow each other with that pair are a chain, of which each second one is the right part of the one before. From
#: the left, the contractions end behind the first one that makes a pair of lower rank, which comes next then.
_CONTRACT_LONG = """
with recursive state(kk, t, n, done) as (
  select kk, t, 0, false from words
  union all
  (with pairs as (
     select kk, t, n, lead(kk) over win as nk, (t::bigint << 20) | lead(t) over win as pair
     from state where not done and n < {rounds} window win as (order by kk)),
   rated as (
     select kk, t, n, case when kk >> 32 = nk >> 32 then m.merged end as r from pairs p left join merges m on m.pair = p.pair),
   best as (select kk >> 32 as w, min(r) as x from rated group by 1),
   hit as (select kk, t, n, x, coalesce(r = x, false) as f from rated join best on kk >> 32 = w),
   chain as (select *, row_number() over (order by kk) - row_number() over (partition by f order by kk) as c from hit),
   taken as (select *, f and row_number() over (partition by f, c order by kk) % 2 = 1 as g from chain),
   beside as (
     select *, lag(g) over win as g1, lag(g, 2) over win as g2, lag(t) over win as t1, lag(kk) over win as k1,
       lead(t, 2) over win as t2, lead(kk, 2) over win as k2
     from taken window win as (order by kk)),
   stop as (
     select kk >> 32 as w, min(kk) as last from beside
     left join merges a on a.pair = (x::bigint << 20) | t2 and k2 >> 32 = kk >> 32
     left join merges b on b.pair = (case when g2 then x else t1 end::bigint << 20) | x and k1 >> 32 = kk >> 32
     where g and (a.merged < x or b.merged < x) group by 1)
   select kk, case when g and (last is null or kk <= last) then x else t end, n + 1, x is null
   from beside left join stop on w = kk >> 32
   where not (coalesce(g1, false) and (last is null or k1 <= last)))
)
select kk, t, done from state where done or n = {rounds} order by kk
"""

#: An aggregate over rows sorted by position. The one thread of the connection keeps that order; an ``order by`` within
#: the aggregate gives the same bytes in more than twice the time.
_DECODE = """
select d, string_agg(s, '') as s
from (select d, p, s from ids join vocab on vocab.t = ids.t order by d, p) group by d order by d
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """Every (left, right, merged) of which all three are in the vocabulary."""
    for token, merged in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                yield left, right, merged


class Coder:
    """The encoder and decoder of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.chunks = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]")
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.memo: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.made: set[str] = set()
        self.words_whole = self.pieces.findall(" Word") == [" Word"]

    def _merges(self) -> None:
        """The merge table; the workers that only decode need none."""
        if "merges" not in self.made:
            made = np.array(list(merge_pairs(self.ranks)), dtype=np.int64).reshape(-1, 3)
            self._table("merges", pair=(made[:, 0] << 20) | made[:, 1], merged=made[:, 2].astype(np.int32))
            self.made.add("merges")

    def _vocab(self) -> None:
        if "vocab" not in self.made:
            order = sorted(self.ranks.items(), key=lambda x: x[1])
            self._table("vocab", t=np.array([r for _, r in order], dtype=np.int32), s=[b.decode("latin-1") for b, _ in order])
            self.made.add("vocab")

    def _table(self, name: str, **columns) -> None:
        self.db.register("fresh", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from fresh")
        self.db.unregister("fresh")

    def _rows(self, words: list[bytes], shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (number of the word and position, ``shift`` bits) and first tokens of some words."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        number = np.repeat(np.arange(len(words), dtype=np.int64), lens)
        place = np.arange(len(number), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
        return (number << shift) | place, self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, by the recursive query."""
        self._merges()
        out = []
        for part in blocks([len(w) * (len(w) + 1) // 2 for w in words], QUERY_ROWS):
            some = words[part]
            kk, t = self._rows(some, 18)
            self._table("words", kk=kk, t=t)
            got = self.db.execute(_CONTRACT).fetchnumpy()
            flat = np.asarray(got["t"], dtype="<u4").tobytes()
            ends = np.searchsorted(got["w"], np.arange(len(some) + 1)) * 4
            out += [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return out

    def _contract_long(self, words: list[bytes]) -> list[bytes]:
        """Ids of each long word, by the query that takes all occurrences of a pair at once."""
        self._merges()
        out = []
        for part in blocks(list(map(len, words)), QUERY_ROWS // 8):
            some = words[part]
            kk, t = self._rows(some, 32)
            keys, ids = [], []
            while len(kk):
                self._table("words", kk=kk, t=t)
                got = self.db.execute(_CONTRACT_LONG.format(rounds=max(1, QUERY_ROWS // len(kk)))).fetchnumpy()
                done = np.asarray(got["done"], dtype=bool)
                kk, t = np.asarray(got["kk"]), np.asarray(got["t"])
                keys.append(kk[done])
                ids.append(t[done])
                kk, t = kk[~done], t[~done]
            kk, t = np.concatenate(keys), np.concatenate(ids)
            order = np.argsort(kk)
            flat = t[order].astype("<u4").tobytes()
            ends = np.searchsorted(kk[order] >> 32, np.arange(len(some) + 1)) * 4
            out += [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return out

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        cut = []
        for c in chunks:
            if self.words_whole and c.isascii() and c.isalpha():  # a space and letters are one pre-token
                cut.append([(" " + c).encode()])
            else:
                plain = c if c == "\n" else c[1:] if c[:1] == MARK else " " + c
                cut.append([p.encode() for p in self.pieces.findall(plain)])
        ids: dict[bytes, bytes] = {}
        short, long = [], []
        for word in {p for ps in cut for p in ps}:
            rank = self.ranks.get(word)
            if rank is not None:
                ids[word] = rank.to_bytes(4, "little")
            else:
                (long if len(word) > LONG else short).append(word)
        ids.update(zip(short, self._contract(short), strict=True))
        ids.update(zip(long, self._contract_long(long), strict=True))
        return {c: ids[ps[0]] if len(ps) == 1 else b"".join(map(ids.__getitem__, ps)) for c, ps in zip(chunks, cut, strict=True)}

    def _cut(self, text: str) -> list[str]:
        """The text's chunks. A text with plain single spaces and line ends needs no pattern: a chunk then stands
        for a space and what follows it, what stands behind MARK for itself, and so does a line end."""
        if any(x in text for x in UNEVEN):
            return [MARK + c for c in self.chunks.findall(text)]
        return (MARK + text.replace("\n", f" \n {MARK}")).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if any(len(t) > BLOCK_CHARS for t in texts):
            return [self._encode_some([self._cut(t)])[0] if len(t) <= BLOCK_CHARS else self._encode_very_long(t) for t in texts]
        return self._encode_some([self._cut(t) for t in texts])

    def _encode_very_long(self, text: str) -> bytes:
        found, out = self.chunks.finditer(text), []
        while some := [MARK + m[0] for m in itertools.islice(found, BLOCK_CHUNKS)]:
            out += self._encode_some([some])
        return b"".join(out)

    def _encode_some(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of each list of chunks."""
        get, fresh, out, again = self.memo.get, set(), [], []
        for i, chunks in enumerate(cut):
            found = list(map(get, chunks))
            if None in found:
                fresh.update([c for c, x in zip(chunks, found, strict=True) if x is None])
                again.append((i, found))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if fresh:
            made = self._encode_chunks(list(fresh))
            for i, found in again:
                out[i] = b"".join([made[c] if x is None else x for c, x in zip(cut[i], found, strict=True)])
            if (room := MEMO_ROWS - len(self.memo)) > 0:
                self.memo.update(itertools.islice(made.items(), room))
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids, by the ordered aggregate."""
        self._vocab()
        lens = [len(x) // 4 for x in ids]
        tokens = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        of, out = np.repeat(np.arange(len(ids), dtype=np.int32), lens), [[] for _ in ids]
        for at in range(0, len(tokens), DECODE_IDS):
            some = slice(at, at + DECODE_IDS)
            self.db.register("ids", pa.table({"d": of[some], "p": np.arange(len(of[some])), "t": tokens[some]}))
            for d, s in self.db.execute(_DECODE).fetchall():
                out[d].append(s.encode("latin-1"))
            self.db.unregister("ids")
        return [b"".join(x) for x in out]


_coders: dict[tuple, Coder] = {}


def _coder(ranks_path: str, pattern: str) -> Coder:
    if (ranks_path, pattern) not in _coders:
        _coders.clear()
        _coders[ranks_path, pattern] = Coder(load_ranks(ranks_path), pattern)
    return _coders[ranks_path, pattern]


@contextlib.contextmanager
def no_collection():
    """Python's collector rests within one task: the memo holds no cycles, and walking it costs time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def sizes(column: pa.Array) -> list[int]:
    """Bytes of each value of a text or binary column, without making Python objects of the values."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def blocks(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices of about ``most`` in sum, of one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every text."""

    def run(batches):
        coder = _coder(ranks_path, pattern)
        with no_collection():
            for batch in batches:
                for part in blocks(sizes(batch.column(1)), BLOCK_CHARS):
                    ids = coder.encode([t or "" for t in batch.column(1)[part].to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[part], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "n_tokens", "ids"],
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` (bytes) of what :func:`encode` returned."""

    def run(batches):
        coder = _coder(ranks_path, pattern)
        with no_collection():
            for batch in batches:
                for part in blocks(sizes(batch.column(2)), 4 * DECODE_IDS):
                    made = coder.decode(batch.column(2)[part].to_pylist())
                    yield pa.RecordBatch.from_arrays([*(c[part] for c in batch.columns), pa.array(made, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What :func:`decode` of :func:`encode` returns, by one Python worker for each task in place of two."""

    def run(batches):
        coder = _coder(ranks_path, pattern)
        with no_collection():
            for batch in batches:
                for part in blocks(sizes(batch.column(1)), BLOCK_CHARS):
                    ids = coder.encode([t or "" for t in batch.column(1)[part].to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[part], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(coder.decode(ids), pa.binary())],
                        names=["doc_id", "n_tokens", "ids", "decoded"],
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode every text; the digests of ids and decoded bytes."""
    done = round_trip(docs, ranks_path, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
