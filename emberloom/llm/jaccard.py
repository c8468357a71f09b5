"""Exact Jaccard join of word shingle sets by a partition of the universe of shingles.

Sets of sizes ``a`` and ``b`` with a Jaccard of ``percent`` or more differ in ``(100 - percent) (a + b) / (100 + percent)``
shingles at most. Sizes are cut into bands, so that a set's partners lie in its own band and the two beside it. A band
cuts the universe (64-bit hashes) into as many segments as its sets may differ in shingles, and one more.

1. Equal sets fold to one node each. A node's subset in a segment of its own band is a key of the index; it probes with its
   own keys and with those of the band below. Keys travel packed, by bucket, and those that one node has alone stay
   behind: what is left are the live keys.
2. Each node is verified against one hub only, the smallest node of most of its live keys. The components of what links
   there are done with: later, only pairs across components count.
3. Allocation, for each node and band that it probes. A segment gets 0 (skipped), 1 (an equal subset) or 2 (a subset that
   differs by one shingle at most), and the sum must be one more than the shingles in which the node may differ from
   partners. The cost of a 1 is the number of the key's index entries, and the dearest segments are skipped as far as the
   sum has room. A key that brings together many nodes which share nothing else costs more than a neighbourhood from
   ``DEAR`` of them on: it is skipped, too, against a 2 on a segment that is not live. For these the one-deletion
   neighbourhoods are probed: of the node's subsets against the subsets of nodes under the skipped keys, and the other
   way round. Copies of each other share neighbourhoods as well, so their keys are never skipped that way. All costs are
   counted over all nodes.
4. Candidates. Nodes under a key are compared by parity sketches of 2 bits a shingle, in tiles of bounded size. The bits in
   which two sketches differ are a lower bound of the shingles in which the sets differ, so this drops no link. The first
   rounds verify each node's nearest candidate of another component only, on the texts, which joins most of a family of
   copies; there are as many as it takes until a probe has few candidates left. The last one verifies all candidates that
   are still across components. Keys whose nodes are in one component leave after each round.
5. Components of all links, and each document's through its node.

Defined cases: A-Z fold to lower case, other letters do not; null, empty and blank texts have no set, no links and are
their own component; a text of fewer words than a shingle has its whole sequence as one shingle; repeated rows each
give a row; null ``doc_id`` takes part, and a component of null ids alone has a null ``component_id``; several texts under
one ``doc_id`` are several documents; other columns are not read; an empty table gives no rows. Shingles are compared by 64-bit
hashes within two sets, and sets are folded by 128 bits.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom.llm import scratch
from emberloom.llm.bpe import blocks, no_collection, sizes
from emberloom.llm.components import components

WORDS = 4
PERCENT = 85
#: Nodes that share one key only, from which it pays to skip the key against a one-deletion neighbourhood: a comparison of
#: sketches takes some 50 ns, and the neighbourhoods of a node's whole set some 0.6 ms.
DEAR = 10_000
#: Nodes of a key that are compared in one task; more are cut into chunks.
TILE = 2048
#: Candidates of a probe, on the average, up to which all of them are verified. With more, rounds in which each node's
#: nearest candidate alone is verified go on while they link something, ``ROUNDS`` at most; each takes some thirty jobs.
NEIGHBOURS = 4
ROUNDS = 8
#: Keys of a bucket on the average.
BUCKET_KEYS = 1 << 16
BLOCK_CHARS = 1 << 22
MEMO_WORDS = 300_000
#: Bits of the bitmap by which texts that nobody asks for stay out of a shuffle; a full one keeps out nothing.
FILTER_BITS = 1 << 26
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LEAST = -(2**63)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_words: dict[bytes, int] = {}


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), n)], np.uint64)
    found = [_words.get(w) for w in words]
    for i in [i for i, h in enumerate(found) if h is None] if None in found else ():
        found[i] = xxhash.xxh64_intdigest(words[i], 0)
        if len(_words) < MEMO_WORDS and len(words[i]) < 64:
            _words[words[i]] = found[i]
    own = np.array(found, np.uint64)
    made = mix(own[: len(own) - n + 1])
    for k in range(1, n):
        made = mix(made * _ODD + own[k : len(own) - n + 1 + k])
    return np.unique(made)


def signature(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as signed longs."""
    a, b = mix(x).sum(dtype=np.uint64), mix(x ^ _ODD).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def sketch(x: np.ndarray) -> bytes:
    """Whether an odd number of the set's shingles falls on each of 2 bits a shingle and more (a power of two)."""
    n_bits = max(64, 1 << int(2 * len(x) - 1).bit_length()) if len(x) else 64
    odd = np.bincount((x & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in which two sets differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # halves of a sketch fall on the bits of one half as long
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Universe:
    """Bands of set sizes, and the segments of each."""

    def __init__(self, percent: int):
        self.percent, self.low, self.high = percent, [], []
        #: Smaller sets link with equal ones only.
        self.first = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
        self._cuts: dict[int, np.ndarray] = {}

    def reach(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            low = self.high[-1] + 1 if self.high else self.first
            self.low.append(low)
            self.high.append(max(low, 100 * low // self.percent))

    def most(self, a: int, b: int) -> int:
        """Shingles in which linked sets of these sizes may differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def band(self, size: int) -> int:
        self.reach(size)
        return bisect.bisect_right(self.low, size) - 1

    def segments(self, t: int) -> int:
        return self.most(self.high[t], 100 * self.high[t] // self.percent) + 1

    def probed(self, size: int) -> Iterator[tuple[int, int]]:
        """(band, segments that may be skipped) of the own band, and of the one below if it holds partners."""
        if size < self.first:
            return
        t = self.band(size)
        yield t, self.segments(t) - 1 - self.most(size, size)
        if t and 100 * self.high[t - 1] >= self.percent * size:
            yield t - 1, self.segments(t - 1) - 1 - self.most(size, self.high[t - 1])

    def cuts(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper ends of all segments but the last one, and a salt for each segment."""
        if t not in self._cuts:
            m = self.segments(t)
            ends = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
            self._cuts[t] = ends, mix(np.arange(m, dtype=np.uint64) + (np.uint64(t + 1) << np.uint64(40)))
        return self._cuts[t]

    def subsets(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By segment: the sum of the subset's hashes with the salt, and where it begins and ends in the set."""
        ends, salt = self.cuts(t)
        at = np.searchsorted(x, ends)
        low, high = np.concatenate([[0], at]), np.concatenate([at, [len(x)]])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return total[high] - total[low] + salt, low, high

    def keys(self, x: np.ndarray, t: int) -> np.ndarray:
        return mix(self.subsets(x, t)[0]).view(np.int64)

    def shortened(self, x: np.ndarray, t: int, which: np.ndarray) -> np.ndarray:
        """Keys of the subsets of some segments, each without one of its shingles."""
        sums, low, high = self.subsets(x, t)
        counts = (high - low)[which]
        at = np.repeat(low[which] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return mix(np.repeat(sums[which], counts) - x[at]).view(np.int64)


def _id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(_LEAST))


def prints(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``h`` (a hash of the text), ``n`` (size of the set), ``s1``, ``s2`` (its signature), ``sketch``, and the
    segments that the set may skip in its own band and in the one below."""
    schema = "doc_id long, h long, n long, s1 long, s2 long, sketch binary, room int, room_below int"

    def run(batches):
        universe = Universe(percent)
        with no_collection():
            for batch in batches:
                for part in blocks(sizes(batch.column(1)), BLOCK_CHARS):
                    rows = []
                    for text in batch.column(1)[part].to_pylist():
                        x = shingle_set(text, words)
                        room = [r for _, r in universe.probed(len(x))]
                        rows.append((len(x), *signature(x), sketch(x) if len(x) >= universe.first else b"", *(room + [0, 0])[:2]))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
                    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(2)[part], *made], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, schema)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the nodes (with ``d`` and ``h`` of their first document)."""
    rows = docs.select(_id().alias("d"), F.xxhash64("text").alias("h"), "text")
    return rows.join(nodes.select("d", "h", "node").hint("merge"), ["d", "h"]).select("node", "text")


def _asked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The documents, without most of those that are no node's first document."""
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = nodes.select((bit / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS bits, whatever the corpus
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))

    def run(batches):
        for batch in batches:
            at = batch.column("h").to_numpy().view(np.uint64) & np.uint64(FILTER_BITS - 1)
            hit = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    return rows.mapInArrow(run, rows.schema).drop("h")


_LIVE = "key long, node long, own boolean, hub long, entries long"


def live_keys(texts: DataFrame, n_buckets: int, percent: int, words: int = WORDS) -> DataFrame:
    """``key``, ``node``, ``own`` (the node is an index entry; else it only probes), ``hub`` (the smallest entry) and
    ``entries`` of the keys that some entry shares with another node."""

    def pack(batches):
        universe = Universe(percent)
        for batch in batches:
            for part in blocks(sizes(batch.column(1)), BLOCK_CHARS):
                keys, owners = [], []
                for node, text in zip(batch.column(0)[part].to_pylist(), batch.column(1)[part].to_pylist(), strict=True):
                    x = shingle_set(text, words)
                    for k, (t, _) in enumerate(universe.probed(len(x))):
                        keys.append(universe.keys(x, t))
                        owners.append(np.full(len(keys[-1]), 2 * node + (k == 0), np.int64))
                if not keys:
                    continue
                key, owner = np.concatenate(keys), np.concatenate(owners)
                bucket = (key.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
                order = np.lexsort((owner, bucket))
                key, owner, bucket = key[order], owner[order], bucket[order]
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                packed = [[x[s:e].tobytes() for s, e in zip(at, [*at[1:], len(key)], strict=True)] for x in (key, owner)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), *(pa.array(x, pa.binary()) for x in packed)], names=["bucket", "keys", "owners"])

    def shared(keys, owners):
        key, owner = (np.concatenate([np.frombuffer(x, np.int64) for x in y]) for y in (keys, owners))
        order = np.lexsort((owner >> 1, -(owner & 1), key))  # entries first, the smallest at the head
        key, owner = key[order], owner[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
        key, owner = key[fresh], owner[fresh]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(at, len(key)))
        entries = np.add.reduceat(owner & 1, at)
        keep = np.repeat((n > 1) & (entries > 0), n)
        columns = [key, owner >> 1, (owner & 1).astype(bool), np.repeat(owner[at] >> 1, n), np.repeat(entries, n)]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=[c.split()[0] for c in _LIVE.split(", ")])

    def run(batches):
        bucket, keys, owners = None, [], []
        for batch in batches:
            for b, k, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and keys:
                    yield shared(keys, owners)
                    keys, owners = [], []
                bucket = b
                keys.append(k)
                owners.append(o)
        if keys:
            yield shared(keys, owners)

    packed = texts.mapInArrow(pack, "bucket long, keys binary, owners binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _LIVE)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Of the pairs (``a``, ``b``) of nodes, those that link: by their sketches, then by their texts."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"k_{c}")).hint("merge")
    near = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def by_sketch(batches):
        universe = Universe(percent)
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "k_a", "k_b")), strict=True)
            keep = pa.array([sketch_distance(x, y) <= universe.most(n, m) for n, m, x, y in columns], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    near = scratch.stash(near.select("a", "b", "n_a", "n_b", "k_a", "k_b").mapInArrow(by_sketch, "a long, b long"), "near")
    ends = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "node")
    known = nodes.join(ends.hint("merge"), "node").select("node", "d", "h")
    texts = scratch.stash(_texts(_asked(docs, known), known).dropDuplicates(["node"]), "texts", compression="zstd")
    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}")).hint("merge")

    def by_text(batches):
        last, x = None, None
        for batch in batches:
            keep = []
            for a, t, u in zip(batch.column("a").to_pylist(), batch.column("t_a"), batch.column("t_b"), strict=True):
                if a != last:  # the join leaves the pairs of one node beside each other
                    last, x = a, shingle_set(t.as_py(), words)
                y = shingle_set(u.as_py(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    linked = scratch.stash(near.join(of("b"), "b").join(of("a"), "a").select("a", "b", "t_a", "t_b").mapInArrow(by_text, "a long, b long"), "linked")
    scratch.drop(near), scratch.drop(texts)
    return linked


def allocate(live: DataFrame, nodes: DataFrame, dear: int) -> DataFrame:
    """``live`` (with ``alone``, the nodes that share this key only with its hub) with ``v``: 0 where the node skips the
    segment, else 1, and ``twos``: how many of the skipped ones call for a neighbourhood, for each node and band."""
    room = nodes.select("node", "room", "room_below")
    rows = live.join(room.hint("merge"), "node").withColumn("room", F.when(F.col("own"), F.col("room")).otherwise(F.col("room_below")))
    by = Window.partitionBy("node", "own")
    rows = rows.withColumn("place", F.row_number().over(by.orderBy(F.desc("entries"), "key")))
    left = (F.col("place") > F.col("room")) & (F.col("alone") > dear)
    rows = rows.withColumn("twos", F.sum(left.cast("long")).over(by))
    return rows.withColumn("v", F.when((F.col("place") <= F.col("room")) | left, 0).otherwise(1)).drop("room", "room_below", "place")


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length, that of the shortest, as rows of 64-bit numbers."""
    size = min(map(len, sketches))
    rows = np.empty((len(sketches), size // 8), np.uint64)
    for i, x in enumerate(sketches):
        own = np.frombuffer(x, np.uint64)
        while len(own) > rows.shape[1]:
            own = own[: len(own) // 2] ^ own[len(own) // 2 :]
        rows[i] = own
    return rows


def candidates(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """``r``, ``s`` and ``bits`` (in which their sketches differ): for each probe of a key, the entries of other components
    that may link, or the nearest one of them. ``many`` says how many there are in the tile. ``chunks`` of a row says into how many tiles its key's rows are cut a side.
    A pair of nodes that share several keys comes out under the smallest of them only."""
    if not nearest:
        lists = [F.collect_set(F.when(on, F.col("key"))).alias(c) for on, c in ((F.col("v") == 1, "asked"), (F.col("own"), "held"))]
        rows = rows.join(scratch.stash(rows.groupBy("node").agg(*lists), "lists").hint("merge"), "node")
    tiled = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "own", (F.col("v") == 1).alias("asks"), "root", "n", "sketch", *(() if nearest else ("asked", "held")))

    def once_a_pair(of, lists, x, y):
        """Which pairs of rows have this key as the smallest that they share as a probe and an entry."""
        key, out = of["key"][0], np.zeros(len(x), bool)
        for at, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            (asked_p, held_p), (asked_q, held_q) = lists[p], lists[q]
            out[at] = min(asked_p & held_q | asked_q & held_p) == key
        return out

    def near(of):
        """Pairs of the rows of one tile."""
        universe = Universe(percent)
        node, root, n, own, asks, mine = (np.array(of[c]) for c in ("node", "root", "n", "own", "asks", "mine"))
        asking, held = np.flatnonzero(asks), np.flatnonzero(own)
        if not len(asking) or not len(held) or (root == root[0]).all():
            return
        lists = None if nearest else [(set(a), set(h)) for a, h in zip(of["asked"], of["held"], strict=True)]
        bits, cross = _folded(of["sketch"]), of["lo"][0] != of["hi"][0]
        strip = max(1, (1 << 21) // (len(held) * bits.shape[1]))
        for at in range(0, len(asking), strip):
            r = asking[at : at + strip]
            ok = root[r][:, None] != root[held][None, :]
            if cross:
                ok &= mine[r][:, None] != mine[held][None, :]
            low, high = np.minimum(n[r][:, None], n[held][None, :]), np.maximum(n[r][:, None], n[held][None, :])
            ok &= 100 * low >= percent * high
            differ = np.bitwise_count(bits[r][:, None, :] ^ bits[held][None, :, :]).sum(axis=2, dtype=np.int64)
            ok &= differ <= universe.most(n[r][:, None], n[held][None, :])
            if nearest:
                best = np.argmin(np.where(ok, differ, 1 << 60), axis=1)
                i = np.flatnonzero(ok[np.arange(len(r)), best])
                j = best[i]
            else:
                i, j = np.nonzero(ok & ((node[r][:, None] < node[held][None, :]) | ~(asks[held][None, :] & own[r][:, None])))
                i, j = i[once := once_a_pair(of, lists, r[i], held[j])], j[once]
            if len(i):
                columns = [node[r[i]], node[held[j]], differ[i, j], ok.sum(axis=1, dtype=np.int64)[i]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["r", "s", "bits", "many"])

    def run(batches):
        tile, of = None, {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            marks = list(zip(columns["key"], columns["lo"], columns["hi"], strict=True))
            at = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for s, e in zip(at, at[1:], strict=False):
                if marks[s] != tile and of:
                    yield from near(of)
                    of = {}
                tile = marks[s]
                for c, x in columns.items():
                    of.setdefault(c, []).extend(x[s:e])
        if of:
            yield from near(of)

    dealt = tiled.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(run, "r long, s long, bits long, many long")


def neighbourhood_pairs(docs: DataFrame, nodes: DataFrame, live: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Candidates (``r``, ``s``) by subsets that differ by one shingle, between nodes with ``twos`` and the entries under keys
    that they skip. Segments that are not live come first. Where a node has too few segments for its twos, all its
    segments count, and the keys that it skips are among them.
    """
    keys = [F.collect_set(F.when(F.col("v") == v, F.col("key"))).alias(c) for v, c in ((0, "skipped"), (1, "busy"))]
    probes = live.where("twos > 0").groupBy("node", "own").agg(*keys, F.max("twos").alias("twos"))
    dear = live.where("v = 0 and twos > 0").select("key").distinct()
    entries = live.where("own").join(dear.hint("merge"), "key").select("node").distinct()
    need = probes.select("node").union(entries).distinct()
    known = scratch.stash(nodes.join(need.hint("merge"), "node").select("node", "d", "h"), "asked")
    texts = scratch.stash(_texts(_asked(docs, known), known).dropDuplicates(["node"]), "texts", compression="zstd")

    def rows(node, whole, short):
        key, kind = np.concatenate([whole, short]), np.repeat([True, False], [len(whole), len(short)])
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.full(len(key), node, np.int64)), pa.array(kind)], names=["key", "node", "whole"])

    def probe(batches):
        universe = Universe(percent)
        for batch in batches:
            for node, own, skipped, busy, twos, text in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                x = shingle_set(text, words)
                t = [t for t, _ in universe.probed(len(x))][0 if own else 1]
                keys = universe.keys(x, t)
                free, quiet = (~np.isin(keys, np.array(x, np.int64)) for x in (skipped, busy))
                which = np.concatenate([np.flatnonzero(free & quiet), np.flatnonzero(free & ~quiet)])[:twos]
                if len(which) < twos:
                    which = np.arange(len(keys))
                yield rows(node, keys[which], universe.shortened(x, t, which))

    def index(batches):
        universe = Universe(percent)
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = shingle_set(text, words)
                t = universe.band(len(x))
                yield rows(node, universe.keys(x, t), universe.shortened(x, t, np.arange(universe.segments(t))))

    schema = "key long, node long, whole boolean"
    asked = texts.join(probes.hint("merge"), "node").select("node", "own", "skipped", "busy", "twos", "text").mapInArrow(probe, schema)
    held = texts.join(entries.hint("merge"), "node", "left_semi").select("node", "text").mapInArrow(index, schema)
    asked, held = scratch.stash(asked, "probes"), scratch.stash(held, "neighbours")
    found = asked.alias("p").join(held.alias("s").hint("merge"), (F.col("p.key") == F.col("s.key")) & (F.col("p.node") != F.col("s.node")) & ~(~F.col("p.whole") & ~F.col("s.whole")))
    pairs = scratch.stash(found.select(F.col("p.node").alias("r"), F.col("s.node").alias("s")).distinct(), "pairs")
    for table in (known, texts, asked, held):
        scratch.drop(table)
    return pairs


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, dear: int = DEAR, words: int = WORDS) -> DataFrame:
    """Edges (``a``, ``b``) between nodes that span every set of linked ones."""
    universe = Universe(percent)
    several = nodes.where(F.col("n") >= universe.first)
    total = several.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, int(total * 2 * (100 - percent) / percent) // BUCKET_KEYS)
    live = scratch.stash(live_keys(_texts(docs, several), n_buckets, percent, words), "live")
    votes = scratch.stash(live.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("votes")), "votes")
    hubs = votes.groupBy("node").agg(F.max_by("hub", F.struct("votes", -F.col("hub"))).alias("hub"))
    edges = verified(_ordered(hubs, "node", "hub"), docs, nodes, percent, words)
    live = live.withColumn("alone", F.lit(0))
    if (live.agg(F.max("entries")).first()[0] or 0) > dear:
        single = votes.where("votes = 1").select("node", "hub").hint("merge")
        alone = live.join(single, ["node", "hub"]).groupBy("key").agg(F.count("*").alias("alone")).where(F.col("alone") > dear)
        live = live.drop("alone").join(scratch.stash(alone, "alone").hint("merge"), "key", "left").fillna(0, ["alone"])
    allotted = scratch.stash(allocate(live.select("key", "node", "own", "entries", "alone"), nodes, dear), "allocated")
    known, parts, left, was, nearest = nodes.select("node", "n", "sketch").hint("merge"), [edges], allotted.where("v = 1 or own"), None, True
    for step in range(ROUNDS + 1):
        label = components(functools.reduce(DataFrame.union, parts)).hint("merge")
        rows = left.select("key", "node", "own", "v").join(label, "node", "left")
        rooted = scratch.stash(rows.select("key", "node", "own", "v", F.coalesce("root", "node").alias("root")), "rooted")
        across = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
        across = scratch.stash(across.where("x < y").select("key", "chunks"), "across")
        left = scratch.stash(rooted.join(across.hint("merge"), "key").join(known, "node"), "open")
        for table in (rooted, across, was):
            scratch.drop(table)
        was = left
        if not nearest:
            break
        found = scratch.stash(candidates(left, percent, nearest=True), "nearest")
        many, probes = found.agg(F.sum("many"), F.count("*")).first()
        best = found.groupBy("r").agg(F.min_by("s", F.struct("bits", "s")).alias("s"))
        parts.append(verified(_ordered(best, "r", "s"), docs, nodes, percent, words))
        nearest = step + 1 < ROUNDS and (many or 0) > NEIGHBOURS * probes and parts[-1].limit(1).count() > 0
        scratch.drop(found)
    found = candidates(left, percent, nearest=False).select("r", "s")
    if allotted.where("twos > 0").limit(1).count():
        found = found.union(neighbourhood_pairs(docs, nodes, allotted, percent, words))
    parts.append(verified(_ordered(found, "r", "s"), docs, nodes, percent, words))
    scratch.drop(left)
    scratch.drop(votes), scratch.drop(allotted)
    return functools.reduce(DataFrame.union, parts)


def _rooted(docs: DataFrame, percent: int, words: int, dear: int) -> tuple[DataFrame, DataFrame]:
    """(:func:`prints` of every row; ``s1``, ``s2``, ``n``, first document (``d``, ``h``), smallest id ``low`` and ``root`` of every set)."""
    found = scratch.stash(prints(docs, percent, words), "prints")
    first = F.min(F.struct(_id().alias("d"), "h", "room", "room_below", "sketch"))
    nodes = found.where("n > 0").groupBy("s1", "s2", "n").agg(first.alias("f"), F.min("doc_id").alias("low"))
    nodes = scratch.stash(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "low", "f.*"), "nodes")
    label = components(links(docs, nodes, percent, dear, words))
    rooted = nodes.join(label.hint("merge"), "node", "left").select("s1", "s2", "n", "low", "d", "h", F.coalesce("root", "node").alias("root"))
    return found, scratch.stash(rooted, "rooted")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, dear: int = DEAR, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    found, rooted = _rooted(docs.select("doc_id", "text"), percent, words, dear)
    smallest = scratch.stash(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "smallest")
    named = scratch.stash(rooted.join(smallest.hint("merge"), "root").select("s1", "s2", F.col("n").alias("n_shingles"), "component_id"), "named")
    own = found.where("n > 0").select("doc_id", "s1", "s2", F.col("n").alias("n_shingles")).join(named.hint("merge"), ["s1", "s2", "n_shingles"])
    alone = found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.select("doc_id", "n_shingles", "component_id").union(alone)


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The document with the smallest ``doc_id`` of each component, once. Rows without an id, and texts without words, all
    stay; several texts of one ``doc_id`` are several documents, told apart by a hash of the text."""
    known = docs.where("doc_id is not null")
    found, rooted = _rooted(known.select("doc_id", "text"), percent, words, DEAR)
    first = rooted.groupBy("root").agg(F.min(F.struct("d", "h")).alias("k")).select("k.d", "k.h")
    blank = found.where("n = 0").select(_id().alias("d"), "h").distinct()
    kept = scratch.stash(first.union(blank), "kept")
    rows = known.select(F.struct(*docs.columns).alias("row"), _id().alias("d"), F.xxhash64("text").alias("h"), F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))).alias("size"))
    own = rows.join(kept.hint("merge"), ["d", "h"], "left_semi")
    full, empty = own.where("size > 0").dropDuplicates(["d", "h"]), own.where("size is null or size = 0")
    return full.union(empty).select("row.*").union(docs.where("doc_id is null"))


#: The same result by the definition: every pair of documents that share a shingle.
JACCARD_SQL = r"""
with recursive docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingle as (
  select distinct r, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from docs),
size as (select r, count(*) as n from shingle group by r),
link as (
  select x.r as a, y.r as b from shingle x join shingle y on x.s = y.s and x.r <> y.r
  join size m on m.r = x.r join size k on k.r = y.r where 100 * least(m.n, k.n) >= 85 * greatest(m.n, k.n)
  group by x.r, y.r, m.n, k.n having 100 * count(*) >= 85 * (m.n + k.n - count(*))),
reach as (select r as a, r as b from docs union select reach.a, link.b from reach join link on link.a = reach.b)
select d.doc_id, coalesce(n, 0) as n_shingles, (select min(o.doc_id) from reach join docs o on o.r = reach.b where reach.a = d.r) as component_id
from docs d left join size on size.r = d.r
"""
