"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` characters may differ by ``k = floor(m * rate)`` edits. Cut into ``k + 1`` pieces, one piece at
least must occur unchanged, whatever the edits. An Aho-Corasick automaton over the pieces of all items finds
every exact piece hit in a text; around each hit, Myers' bit-parallel algorithm gives the least edit distance of
the item to any substring of the window where it could lie, in arbitrary-width Python integers.

Texts and items are compared in lower case with runs of white space as one space. Every text is searched whole
against all items. The items go to the tasks as a broadcast only up to about ``BLOCK_CHARS`` characters; a larger
benchmark is searched in several blocks of that size, one pass over the texts for each. The results of a pass are
then written before the next block is made, so that driver and executors hold one block at a time.

Defined cases: null or blank items match nothing; null or empty texts have no match; null ids stay null;
repeated rows each give their matches; items of the same text each match; other columns are not read; an empty
table on either side gives no rows.
"""

from __future__ import annotations

import functools
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberloom.llm import scratch

RATE = 0.06
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    """Edits allowed in an item of ``length`` characters."""
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): ``k + 1`` pieces of near-equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def peq(item: str) -> dict[str, int]:
    """For each character, the bits of the positions where the item has it."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def substring_distance(item: str, masks: dict[str, int], window: str, most: int) -> int:
    """Least edit distance of the item to a substring of the window; ``most + 1`` if it is over ``most``."""
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score, best = full, 0, len(item), most + 1
    for c in window:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (full & ~(xh | plus))
        hn = plus & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best = score
        hp, hn = (hp << 1) & full, (hn << 1) & full  # row zero costs nothing: a match may start anywhere
        plus = hn | (full & ~(xv | hp))
        minus = hp & xv
    return best


class Matcher:
    """The automaton and items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(item_id, text, budget(len(text), rate), peq(text)) for item_id, text in items]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k, _) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                found.setdefault(piece, []).append((n, offset))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def search(self, text: str) -> list[tuple[int, int]]:
        """(item number, distance) of the items within their budget of some substring."""
        best: dict[int, int] = {}
        if self.empty or not text:
            return []
        reached: dict[int, int] = {}  # by item, the last start that was verified: hits on one alignment agree
        for end, (length, where) in self.automaton.iter(text):
            for n, offset in where:
                start = end + 1 - length - offset
                if best.get(n) == 0 or reached.get(n) == start:
                    continue
                reached[n] = start
                _, item, k, masks = self.items[n]
                if text.startswith(item, max(start, 0)) and start >= 0:
                    best[n] = 0
                    continue
                window = text[max(0, start - k) : start + len(item) + k]
                got = substring_distance(item, masks, window, k)
                if got <= k and got < best.get(n, k + 1):
                    best[n] = got
        return sorted(best.items())


_matchers: dict[str, Matcher] = {}


def _matcher(shared) -> Matcher:
    data = shared.value
    if data["key"] not in _matchers:
        _matchers.clear()
        _matchers[data["key"]] = Matcher(pickle.loads(data["items"]), data["rate"])
    return _matchers[data["key"]]


def _blocks_of(benchmark: DataFrame, rate: float) -> Iterator[tuple]:
    """(broadcast of about ``BLOCK_CHARS`` characters of items, whether there are more blocks than one), one by one."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where(F.length(F.trim("text")) > 0)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // BLOCK_CHARS))
    for b in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id", "text")
        listed = [(r.item_id, t) for r in own.toLocalIterator() if (t := normal(r.text))]
        shared = spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "items": pickle.dumps(listed), "rate": rate})
        yield shared, n_blocks > 1
        if n_blocks > 1:
            shared.destroy()


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id``, ``item_id`` and ``distance`` of every text that holds an item within its budget."""
    parts = []
    for shared, many in _blocks_of(benchmark, rate):

        def run(batches, shared=shared):
            matcher = _matcher(shared)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(doc_id, matcher.items[n][0], d) for n, d in matcher.search(normal(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "distance"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, distance long")
        parts.append(scratch.stash(found, "matches") if many else found)
    return functools.reduce(DataFrame.union, parts)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows whose text holds no item, with all their columns; each row is judged where it is."""
    text = docs.columns.index("text")
    for shared, many in _blocks_of(benchmark, rate):

        def run(batches, shared=shared):
            matcher = _matcher(shared)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(normal(t)) for t in batch.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = scratch.stash(docs, "clean") if many else docs
    return docs
