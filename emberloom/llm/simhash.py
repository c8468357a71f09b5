"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints: XXH64 of every word shingle; a bit is set where over half of the hashes have it.
2. Equal fingerprints are folded to one node each (with the smallest ``doc_id``) before anything is compared.
3. The 64 bits are grouped into ``m`` partitions, correlated bits together: the correlations are sums over all
   nodes, added up per task (64 x 64 numbers) and then over tasks.
4. Thresholds ``t_i`` per partition with ``sum(t_i + 1) = distance + 1``: two fingerprints within ``distance``
   must be within ``t_i`` in some partition (-1: not probed). A dynamic program picks the allocation with the
   least estimated candidates; the estimate comes from value histograms over all nodes.
5. Probe: each node has one key per partition for ``t_i = 0``, and one key per cleared bit for ``t_i = 1``;
   nodes that share a key are compared in numpy, and only a spanning forest of the pairs that verify leaves the
   task, so that a group of near copies gives as many rows as it has members. Keys with more than
   ``BUCKET_ROWS`` members are cut into chunks and every pair of chunks is compared in a task of its own, so
   that no bucket has to fit in one task and none is capped.
6. Components of the forest edges (see :mod:`emberloom.llm.components`).

Defined cases: null text counts as empty; a text without words has fingerprint zero, linked like any other;
null ``doc_id`` takes part and a component of null ids alone has a null ``component_id``; repeated rows each
give a row; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberloom.llm import scratch
from emberloom.llm.bpe import blocks
from emberloom.llm.components import components

SEED = 42
DISTANCE = 3
BUCKET_ROWS = 4096
#: Nodes up to which 4, and then 3, partitions are used; beyond, 2. More nodes need longer keys.
PARTS = ((4, 1 << 22), (3, 1 << 28))
HISTOGRAM_BITS = 16
_HASHES = 1 << 15


def shingle_hashes(text: str, words_per_shingle: int = 3) -> np.ndarray:
    """XXH64 of each shingle of the text's words, with A-Z in lower case."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, digest = words_per_shingle, xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    pairs = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES):
        part = hashes[at : at + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) and ``h`` (a hash of the text) of every row."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = np.array([fingerprint(shingle_hashes(t, words_per_shingle)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64()), batch.column(2)], names=["doc_id", "fp", "h"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, fp long, h long")


def _bit_table(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlations(nodes: DataFrame) -> np.ndarray:
    """64 x 64 correlations of the bits over all nodes."""

    def run(batches):
        both, ones, n = np.zeros((64, 64)), np.zeros(64), 0
        for batch in batches:
            bits = _bit_table(batch.column(0).to_numpy()).astype(np.float32)
            both, ones, n = both + bits.T @ bits, ones + bits.sum(axis=0), n + len(bits)
        sums = np.concatenate([both.ravel(), ones, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["k", "v"])

    rows = nodes.select("fp").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 4161 sums
    sums = np.zeros(64 * 64 + 65)
    for r in rows:
        sums[r.k] = r.v
    n, mean = max(sums[-1], 1), sums[4096:4160] / max(sums[-1], 1)
    cov = sums[:4096].reshape(64, 64) / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return cov / np.outer(dev, dev)


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of near-equal size, each grown by the bit most correlated with it."""
    left, groups, size = set(range(64)), [], [64 // m + (i < 64 % m) for i in range(m)]
    strength = np.abs(corr) - np.eye(64)
    for want in size:
        first = max(sorted(left), key=lambda b: strength[b, sorted(left)].sum())
        group = [first]
        left.discard(first)
        while len(group) < want:
            best = max(sorted(left), key=lambda b: strength[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The group's bits of each fingerprint, packed in order."""
    out = np.zeros(len(fps), np.int64)
    for i, b in enumerate(group):
        out |= ((fps >> b) & 1) << i
    return out


def candidate_counts(nodes: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """Estimated pairs per partition at thresholds 0 and 1, from histograms over all nodes.

    A histogram takes the first 16 bits of a group at most (a bound on its size); further bits count as even.
    """
    width = [min(len(g), HISTOGRAM_BITS) for g in groups]

    def run(batches):
        found = [np.zeros(1 << w, np.int64) for w in width]
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for h, g, w in zip(found, groups, width, strict=True):
                h += np.bincount(_values(fps, g[:w]), minlength=1 << w)
        for i, h in enumerate(found):
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(h[at])], names=["part", "value", "n"])

    rows = nodes.select("fp").mapInArrow(run, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    table = rows.toPandas()  # m x 65536 rows at most
    out = np.zeros((len(groups), 2))
    for i, w in enumerate(width):
        h = np.zeros(1 << w)
        own = table[table.part == i]
        h[own["value"].to_numpy(np.int64)] = own.n.to_numpy(np.float64)
        at = np.arange(1 << w)
        one = sum(h[at ^ (1 << b)] for b in range(w))
        thin = 2.0 ** -(len(groups[i]) - w)
        extra = len(groups[i]) - w
        near = [h @ h / 2, h @ one / 2]
        out[i] = [near[0] * thin, (near[0] * (1 + extra) + near[1]) * thin]
    return out


def allocate(counts: np.ndarray, distance: int, most: int = 1) -> list[int]:
    """Thresholds of -1 to ``most`` with ``sum(t + 1) = distance + 1`` and the least candidates in sum."""
    best = {0: (0.0, [])}
    for row in counts:
        step = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, most + 1):
                key, total = spent + t + 1, cost + (row[t] if t >= 0 else 0.0)
                if key <= distance + 1 and (key not in step or total < step[key][0]):
                    step[key] = (total, [*chosen, t])
        best = step
    return best[distance + 1][1]


def _keys(nodes: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, key, fp): the nodes under each key of theirs. The low byte of a key names the cleared bit."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
                if t < 0:
                    continue
                value = _values(fps, g)
                made = [value << 8] if t == 0 else [((value & ~(1 << b)) << 8) | (b + 1) for b in range(len(g))]
                for key in made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int32)), pa.array(key), pa.array(fps)], names=["part", "key", "fp"])

    return nodes.select("fp").mapInArrow(run, "part int, key long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, root: dict[int, int]) -> list[tuple[int, int]]:
    """Of the pairs, those that join two trees; ``root`` holds the trees."""

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _close(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= distance  # of a signed number it would count the absolute value


def _within(fps: np.ndarray, distance: int, root: dict[int, int], other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Forest pairs of one bucket (or of two chunks of one), compared a strip at a time."""
    out, cols = [], fps if other is None else other
    strip = max(1, (1 << 20) // max(len(cols), 1))
    for at in range(0, len(fps), strip):
        rows = fps[at : at + strip]
        near = _close(rows[:, None], cols[None, :], distance)
        i, j = np.nonzero(near)
        if other is None:
            i, j = i[keep := j > i + at], j[keep]
        out += _forest(rows[i], cols[j], root)
    return out


def links(nodes: DataFrame, groups: list[list[int]], thresholds: list[int], distance: int = DISTANCE) -> DataFrame:
    """Edges (``a``, ``b``) between distinct fingerprints that span every set of linked ones."""
    spark = nodes.sparkSession
    keys = _keys(nodes, groups, thresholds)
    sizes = keys.groupBy("part", "key").agg(F.count("*").alias("n"))
    hot = scratch.stash(sizes.where(F.col("n") > BUCKET_ROWS).withColumn("chunks", F.ceil(F.col("n") / BUCKET_ROWS).cast("int")), "hot")
    joined = keys.join(hot.select("part", "key", "chunks"), ["part", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1)).cast("long")).cast("int")
    tasks = joined.withColumn("own", own)
    every = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    tiled = tasks.select("part", "key", "fp", "own", F.explode(every).alias("o"))
    tiled = tiled.select("part", "key", "fp", "own", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"))

    def run(batches):
        left = None
        for batch in itertools.chain(batches, [None]):
            cols = None if batch is None else [c.to_numpy() for c in batch.columns]
            if left is not None:
                cols = left if cols is None else [np.concatenate(x) for x in zip(left, cols, strict=True)]
            if cols is None or not len(cols[0]):
                continue
            part, key, lo, hi, fp, own = cols
            change = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            cut = len(key) if batch is None else int(change[-1]) if len(change) else 0
            left = [c[cut:] for c in cols]
            edges = _bucket_edges(fp[:cut], own[:cut], np.concatenate([[0], change[change < cut]]).astype(np.int64), cut, lo, hi, distance)
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = tiled.select("part", "key", "lo", "hi", "fp", "own").repartition("part", "key", "lo", "hi").sortWithinPartitions("part", "key", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bucket_edges(fp, own, starts, cut, lo, hi, distance) -> list[tuple[int, int]]:
    if not cut:
        return []
    ends = np.append(starts[1:], cut)
    sizes, out, root = ends - starts, [], {}
    number = np.repeat(np.arange(len(starts)), sizes)
    small = sizes <= 64
    at = np.flatnonzero(small[number])
    fps, of = fp[at], number[at]
    for step in range(1, int(sizes[small].max(initial=1))):  # the pairs of all small buckets, by their distance in order
        live = np.flatnonzero(of[step:] == of[:-step])
        if not len(live):
            break
        near = live[_close(fps[live], fps[live + step], distance)]
        out += _forest(fps[near], fps[near + step], root)
    for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        if lo[s] == hi[s]:
            out += _within(fp[s:e], distance, root)
        else:
            mine = own[s:e] == lo[s]
            out += _within(fp[s:e][mine], distance, root, fp[s:e][~mine])
    return out


def _rooted(docs: DataFrame, distance: int, words_per_shingle: int) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``fp`` and ``h`` (hash of the text) of every row; ``fp``, ``root`` and the smallest ``first`` of every
    fingerprint)."""
    prints = scratch.stash(fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = scratch.stash(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.min("doc_id").alias("low")), "nodes")
    n = nodes.count()
    m = next((m for m, most in PARTS if n <= most), 2)
    groups = group_bits(bit_correlations(nodes), m)
    thresholds = allocate(candidate_counts(nodes, groups), distance)
    labels = components(links(nodes, groups, thresholds, distance))
    linked = nodes.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return prints, linked.select("fp", F.coalesce("root", "fp").alias("root"), "first", "low")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words_per_shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    prints, nodes = _rooted(docs, distance, words_per_shingle)
    nodes = scratch.stash(nodes, "rooted")  # written, so that a root with very many nodes is split in the join
    smallest = scratch.stash(nodes.groupBy("root").agg(F.min("low").alias("component_id")), "smallest")
    ids = nodes.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(ids, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, distance: int = DISTANCE, words_per_shingle: int = 3) -> DataFrame:
    """The document with the smallest ``doc_id`` of each component, once. Several texts of one ``doc_id`` are several
    documents, told apart by a hash of the text; rows without an id all stay."""
    prints, nodes = _rooted(docs.where("doc_id is not null"), distance, words_per_shingle)
    first = nodes.groupBy("root").agg(F.min("first").alias("k"))
    kept = scratch.stash(first.select(F.col("k.doc_id").alias("i"), F.col("k.h").alias("t")).distinct(), "kept")
    known = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("t"))
    own = known.join(kept, ["i", "t"], "left_semi").dropDuplicates(["i", "t"]).select("row.*")
    return own.union(docs.where("doc_id is null"))
