"""Alignment of two tokenizers' tokens: a byte-level BPE (A) and a sentence-piece BPE (B) on the same texts.

1. Every whole text is encoded by both libraries, with a space in front. Merges of neither cross the place before a
   space that follows another character than white space, so texts are cut there and the pieces' ids kept in a bounded
   memo; pieces that are not in it go through the libraries. A model with a space mark inside a piece is not cut.
2. Windows: a byte offset before which both have a token's end and behind which both have a token that begins with a
   space. These offsets are verified from the lengths of the tokens' bytes, and cut the ids into windows.
3. The alignment of a window follows from its ids alone: it is kept in a bounded memo by the ids of A and B, as the
   text of its groups and its links. A group ends where tokens of both end; a link is a pair of such tokens.
4. The links of a text leave the task as distinct pairs and their numbers. Counts of pairs over the corpus are added up
   per task, then by Spark. There are no more pairs than A ids times B ids, whatever the corpus; blocks of ``BLOCK_PAIRS``
   of them at most are broadcast one after the other, and each text adds up the counts of its own links.

Defined cases: null and empty texts, and texts of which A's or B's bytes are not the space and the text (white space
that B changes, its space mark in the text), have no tokens: zeros, and '' as ``groups_sha256``. Repeated rows count
and return each; a null ``doc_id`` stays null; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberloom.llm import scratch
from emberloom.llm.bpe import blocks, no_collection, sizes

MEMO_PIECES = 400_000
MEMO_WINDOWS = 400_000
MEMO_LENGTH = 48
BLOCK_CHARS = 1 << 22
LEARN_CHARS = 1 << 16
BLOCK_PAIRS = 1 << 21
TASK_PAIRS = 1 << 20
_NEW = (b"new", b"new")
#: A space that no piece begins before.
_UNCUT = re.compile(r"^ |\s ")


def byte_of_char() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the memos."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        table = byte_of_char()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(table[c] for c in x) if all(c in table for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:-1], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.cut = not any(b" " in x.lstrip(b" ") for x in self.bytes_b)
        self.n_b = len(pieces)
        self.kind = np.uint32 if len(names) * self.n_b < 1 << 32 else np.uint64
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.sizes_a, self.sizes_b = self.len_a.tolist(), self.len_b.tolist()
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.pieces: dict[str, tuple[bytes, bytes] | None] = {}
        self.windows: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}

    def pieces_of(self, text: str) -> list[str]:
        """The text cut before spaces behind other than white space; each piece without the space that it begins with."""
        if not self.cut:
            return [text]
        if text[-1] == " ":  # a space alone is no piece: the library puts none before an empty text
            body = text.rstrip(" ")
            *before, last = self.pieces_of(body) if body else [""]
            return [*before, last + text[len(body) :]]
        parts, out, held = text.split(" "), [], []
        if not _UNCUT.search(text):
            return parts
        for x in parts:
            held.append(x)
            if x and not x[-1].isspace():
                out.append(" ".join(held))
                held = []
        return [*out, " ".join(held)] if held else out

    def _of_one(self, x: str) -> tuple[bytes, bytes] | None:
        i, j = self.a.encode(" " + x, add_special_tokens=False).ids, self.b.encode(x)
        same = b" " + x.encode() == b"".join([self.bytes_a[t] for t in i]) == b"".join([self.bytes_b[t] for t in j])
        return (np.array(i, "<u4").tobytes(), np.array(j, "<u4").tobytes()) if same else None

    def _of_many(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of pieces as those of one text, taken apart by the lengths of their bytes; one by one where these differ."""
        text = " ".join(parts)
        ids = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, "<u4"), np.array(self.b.encode(text), "<u4")
        lens = np.cumsum([len(x.encode()) + 1 for x in parts])
        cuts = []
        for own, size, known in zip(ids, (self.len_a, self.len_b), (self.bytes_a, self.bytes_b), strict=True):
            ends = np.cumsum(size[own])
            at = np.searchsorted(ends, lens)
            if ends[-1] != lens[-1] or (ends[at] != lens).any() or b"".join([known[t] for t in own.tolist()]) != b" " + text.encode():
                return [self._of_one(x) for x in parts]
            cuts.append((4 * (at + 1)).tolist())
        a, b = (x.tobytes() for x in ids)
        rows = zip([0, *cuts[0]], cuts[0], [0, *cuts[1]], cuts[1], strict=False)
        return [(a[s:e], b[u:v]) for s, e, u, v in rows]

    def _learn(self, parts: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids by A and B (unsigned 32-bit) of new pieces; None where the bytes are not the piece's."""
        alone = [x for x in parts if "▁" in x or not x or x[-1].isspace() or not self.cut]
        rest = parts if not alone else sorted(set(parts) - set(alone))
        made = {x: self._of_one(x) for x in alone}
        for part in blocks([len(x) for x in rest], LEARN_CHARS):
            made |= zip(rest[part], self._of_many(rest[part]), strict=True)
        for x, ids in made.items():
            if len(x) <= MEMO_LENGTH and len(self.pieces) < MEMO_PIECES:
                self.pieces[x] = ids
        return made

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids by A and by B of the space and each text; None for texts without tokens."""
        cut = [self.pieces_of(t) if t else [] for t in texts]
        known = self.pieces.get
        found = [[known(x, _NEW) for x in parts] for parts in cut]
        missing = {x for parts, own in zip(cut, found, strict=True) if _NEW in own for x, ids in zip(parts, own, strict=True) if ids is _NEW}
        other = self._learn(list(missing)) if missing else {}
        out = []
        for parts, own in zip(cut, found, strict=True):
            if _NEW in own:
                own = [other[x] if ids is _NEW else ids for x, ids in zip(parts, own, strict=True)]
            if not own or None in own:
                out.append(None)
            else:
                a, b = zip(*own, strict=True)
                out.append((b"".join(a), b"".join(b)))
        return out

    def _window(self, a: bytes, b: bytes) -> tuple[str, bytes]:
        """Groups as text, and links, of a window's ids: two pointers over the ends of the tokens."""
        i, j = memoryview(a).cast("I").tolist(), memoryview(b).cast("I").tolist()
        size_a, size_b, n_b, groups, links = self.sizes_a, self.sizes_b, self.n_b, [], []
        s = u = v = end_a = end_b = 0
        for e, x in enumerate(i, 1):
            end_a += size_a[x]
            while end_b < end_a:
                end_b += size_b[j[v]]
                v += 1
            if end_a == end_b:
                groups.append(f"{','.join(map(str, i[s:e]))}|{','.join(map(str, j[u:v]))}")
                links.append(x * n_b + j[v - 1])
                s, u = e, v
        return ";".join(groups), np.array(links, self.kind).tobytes()

    def _aligned_window(self, a: bytes, b: bytes) -> tuple[str, bytes]:
        got = self.windows.get((a, b))
        if got is None:
            got = self._window(a, b)
            if len(a) + len(b) <= 8 * MEMO_LENGTH and len(self.windows) < MEMO_WINDOWS:
                self.windows[a, b] = got
        return got

    def align(self, texts: list[tuple[bytes, bytes]]) -> Iterator[tuple[str, np.ndarray]]:
        """Groups as text, and the links as numbers (A id times B's size plus B id), of each text's ids.

        The texts stand behind each other, and windows are cut in all of them at once. Windows of few tokens are told apart
        by their ids, packed into two numbers, so that each different one is looked up once.
        """
        a, b = (b"".join(x) for x in zip(*texts, strict=True))
        i, j = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
        start_a, start_b = (np.cumsum(n) - n for n in (self.len_a[i], self.len_b[j]))
        by_space_a, by_space_b = np.flatnonzero(self.space_a[i]), np.flatnonzero(self.space_b[j])
        _, x, y = np.intersect1d(start_a[by_space_a], start_b[by_space_b], assume_unique=True, return_indices=True)
        cut_a, cut_b = by_space_a[x], by_space_b[y]
        size_a, size_b = np.diff(np.append(cut_a, len(i))), np.diff(np.append(cut_b, len(j)))
        few = (size_a <= 4) & (size_b <= 4)
        code = np.empty(len(few), np.int64)
        code[few] = _pairs(_packed(i, cut_a[few], size_a[few]), _packed(j, cut_b[few], size_b[few]))
        n_few = int(code[few].max(initial=-1)) + 1
        code[~few] = n_few + np.arange((~few).sum())
        first = np.empty(n_few + (~few).sum(), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        spans = zip(*((4 * x[first]).tolist() for x in (cut_a, cut_a + size_a, cut_b, cut_b + size_b)), strict=True)
        windows = [self._aligned_window(a[s:e], b[u:v]) for s, e, u, v in spans]
        links = np.frombuffer(b"".join([w[1] for w in windows]), self.kind)
        n_links = np.array([len(w[1]) for w in windows], np.int64) // links.itemsize
        begins = np.cumsum(n_links) - n_links
        counts = n_links[code]
        ends = np.cumsum(counts)
        flat = links[np.repeat(begins[code] - (ends - counts), counts) + np.arange(counts.sum())]
        lengths = np.cumsum([len(t[0]) // 4 for t in texts])
        last = np.searchsorted(cut_a, lengths)
        strings, codes, at, link = [w[0] for w in windows], code.tolist(), 0, 0
        for to, to_link in zip(last.tolist(), ends[last - 1].tolist(), strict=True):
            yield ";".join([strings[c] for c in codes[at:to]]), flat[link:to_link]
            at, link = to, to_link


def _packed(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the distinct runs of up to four ids (under 2**32 each) from the given places."""
    out = np.zeros(len(at), np.int64)
    for k in range(4):
        own = np.where(sizes > k, ids[np.minimum(at + k, len(ids) - 1)].astype(np.int64) + 1, 0)
        out = np.unique(out << 33 | own, return_inverse=True)[1] if k else own
    return out


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers from 0 on of the distinct pairs."""
    return np.unique(x << 32 | y, return_inverse=True)[1].astype(np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_path: str, piece_path: str) -> Aligner:
    key = (byte_path, piece_path)
    if key not in _aligners:
        _aligners[key] = Aligner(byte_path, piece_path)
    return _aligners[key]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def alignments(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per row: numbers of tokens, groups and links, the hash of the groups, and its distinct links as ``pairs`` (unsigned,
    ascending) and ``times`` (unsigned 32-bit)."""

    def run(batches):
        coder = _aligner(byte_path, piece_path)
        with no_collection():
            for batch in batches:
                for part in blocks(sizes(batch.column(1)), BLOCK_CHARS):
                    rows, encoded = [], coder.encode([t or "" for t in batch.column(1)[part].to_pylist()])
                    known = [ids for ids in encoded if ids]
                    aligned = coder.align(known) if known else iter(())
                    for ids in encoded:
                        if ids is None:
                            rows.append((0, 0, 0, 0, "", b"", b""))
                            continue
                        groups, links = next(aligned)
                        pairs, times = np.unique(links, return_counts=True)
                        digest = hashlib.sha256(groups.encode()).hexdigest()
                        n_groups = groups.count(";") + 1
                        rows.append((len(ids[0]) // 4, len(ids[1]) // 4, n_groups, len(links), digest, pairs.tobytes(), times.astype("<u4").tobytes()))
                    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[part], *columns], names=_names(_ALIGNED))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ALIGNED)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def pair_counts(aligned: DataFrame, n_b: int, kind: type) -> DataFrame:
    """``pair``, ``n`` (links that hold it) and ``best`` (no pair of its B id has more) over all rows."""

    def flush(pairs, times):
        found, where = np.unique(np.concatenate(pairs), return_inverse=True)
        return found, np.bincount(where, np.concatenate(times), len(found)).astype(np.int64)

    def run(batches):
        pairs, times, held = [], [], 0
        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1), strict=True):
                pairs.append(np.frombuffer(p.as_buffer(), kind))
                times.append(np.frombuffer(t.as_buffer(), "<u4"))
                held += len(pairs[-1])
                if held > TASK_PAIRS:
                    p, t = flush(pairs, times)
                    pairs, times, held = [p], [t], len(p)
                    if held > TASK_PAIRS // 2:
                        yield _counted(p, t)
                        pairs, times, held = [], [], 0
        if pairs:
            yield _counted(*flush(pairs, times))

    parts = aligned.where("n_links > 0").select("pairs", "times").mapInArrow(run, "pair long, n long")
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(F.expr(f"pair % {n_b}"))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(by)).alias("best"))


def _counted(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])


def _blocks_of(counts: DataFrame) -> Iterator[tuple]:
    """(broadcast pairs, their counts and best marks; whether there are more blocks), of a checked size each."""
    total = counts.count()
    n_blocks = max(1, -(-total // BLOCK_PAIRS))
    block = lambda n: F.pmod(F.xxhash64("pair"), F.lit(n))
    while n_blocks > 1 and counts.groupBy(block(n_blocks).alias("k")).count().agg(F.max("count")).first()[0] > BLOCK_PAIRS:
        n_blocks += 1
    for k in range(n_blocks):
        own = counts.where(block(n_blocks) == k).toArrow() if total else None
        columns = [own.column(c).to_numpy() for c in ("pair", "n", "best")] if own else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        order = np.argsort(columns[0])
        shared = counts.sparkSession.sparkContext.broadcast([c[order] for c in columns])
        yield shared, n_blocks > 1
        if n_blocks > 1:
            shared.destroy()


def cross_alignment(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per row: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    coder = _aligner(byte_path, piece_path)
    n_b, kind = coder.n_b, coder.kind
    aligned = scratch.stash(alignments(docs, byte_path, piece_path), "aligned", compression="zstd")
    counts = scratch.stash(pair_counts(aligned, n_b, kind), "pair-counts")
    done = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    last = None
    for shared, many in _blocks_of(counts):

        def run(batches, shared=shared):
            known, n, best = shared.value
            for batch in batches:
                hits, sums = batch.column("n_best").to_numpy().copy(), batch.column("count_sum").to_numpy().copy()
                for k, (p, t) in enumerate(zip(batch.column("pairs"), batch.column("times"), strict=True)):
                    pairs = np.frombuffer(p.as_buffer(), kind).astype(np.int64)
                    if not len(pairs) or not len(known):
                        continue
                    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    times = np.where(known[at] == pairs, np.frombuffer(t.as_buffer(), "<u4"), 0).astype(np.int64)
                    hits[k] += times @ best[at]
                    sums[k] += times @ n[at]
                columns = {"n_best": pa.array(hits), "count_sum": pa.array(sums)}
                yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

        done = done.mapInArrow(run, done.schema)
        if many:
            done = scratch.stash(done, "aligned", compression="zstd")
            scratch.drop(last or aligned)
            last = done
    scratch.drop(counts)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
