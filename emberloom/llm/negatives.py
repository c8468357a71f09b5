"""Hard negatives: for an anchor and each of its positives, the best rows of other labels that score nearly as high.

1. Rows that take part are written once with whole-number vectors. Anchors come in blocks of ``BLOCK_ANCHORS`` at most,
   of a checked size; a block is broadcast and meets all rows, a batch at a time in each task.
2. The anchors of a block span a tree of least edge lengths. Along it, a row's score at an anchor lies within the edge's
   length times the row's norm of the score at the parent, and within the product of the norms; the root is scored for
   every row. Only rows of which these bounds reach the window that is asked for are scored exactly.
3. Positives: the window is open above; its lower end is the anchor's last best score in the task. Negatives: the windows
   are those of the anchor's positives, each raised to its own last best score. Each task leaves its best rows for
   each window, and Spark takes the best of all tasks.

Scores are whole numbers: floating-point products where these are exact, 64-bit products up to 2**62, Python's own
numbers beyond (a score that needs more than 64 bits is an error). Bounds are widened by more than their rounding.

Defined cases: rows with a null ``vec_id``, label or vector, or a null or non-finite component, take no part;
components beyond 2**62 after scaling count as 2**62; vectors of other lengths are filled up with zeros (an empty one scores 0); equal rows
count once, and rows that share a ``vec_id`` but differ are several rows, ordered by label and vector behind their
score and id; an anchor without other rows of its label, or a positive without rows in its window, has no row; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom.llm import scratch

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
BLOCK_ANCHORS = 1024
#: Scores held at a time in a task: anchors of a block times rows of a step.
STEP_SCORES = 1 << 21


def usable_rows(embeddings: DataFrame, label: Column) -> DataFrame:
    """``vec_id``, ``label`` (as given by the expression) and ``q``, the whole-number vector, of the rows that take part."""
    known = embeddings.select(F.col("vec_id").cast("long"), label.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("v", lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-(1 << 62))), F.lit(1 << 62)))
    return known.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select("vec_id", "label", whole.alias("q")).distinct()


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    flat, ends = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    at = np.repeat(np.arange(len(column)), ends)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows with a vector."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(vector).max(initial=0)) * len(vector)
    if most < 2**53:
        return (rows.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return rows @ vector
    return np.array((rows.astype(object) @ vector.astype(object)).tolist(), np.int64)


def spanning_tree(vectors: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Order of the anchors, parents before children; each one's parent (-1 at the root), and length of the edge to it."""
    n, x = len(vectors), vectors.astype(np.float64)
    near, parent, out = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    order = []
    at = int(np.argmin((x**2).sum(axis=1)))
    near[at] = 0
    for _ in range(n):
        order.append(at)
        out[at] = True
        length = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = ~out & (length < near)
        near[closer], parent[closer] = length[closer], at
        at = int(np.argmin(np.where(out, np.inf, near)))
    return order, parent.tolist(), near.tolist()


class Bounds:
    """Lower and upper bounds of the scores of some rows at each anchor of a tree, exact where they have been scored."""

    def __init__(self, anchors: np.ndarray, tree: tuple, rows: np.ndarray):
        self.anchors, (self.order, self.parent, self.length), self.rows = anchors, tree, rows
        self.norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        self.own = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        self.low, self.high = (np.empty((len(anchors), len(rows))) for _ in range(2))
        self.scored = 0

    def enter(self, a: int) -> None:
        """Bounds at an anchor from those of its parent."""
        up, most = self.parent[a], self.own[a] * self.norms
        room = self.length[a] * self.norms if up >= 0 else most
        slack = 1 + 1e-9 * (most + room)
        self.high[a] = np.minimum(self.high[up] + room, most) + slack if up >= 0 else most + slack
        self.low[a] = np.maximum(self.low[up] - room, -most) - slack if up >= 0 else -most - slack

    def score(self, a: int, which: np.ndarray) -> np.ndarray:
        """Exact scores of some rows, which then are the bounds (but for the rounding of large ones)."""
        found = products(self.rows[which], self.anchors[a])
        self.scored += len(which)
        self.low[a, which] = np.nextafter(found.astype(np.float64), -np.inf)
        self.high[a, which] = np.nextafter(found.astype(np.float64), np.inf)
        return found


def best(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best: by score, then id, then the row's own order."""
    return np.lexsort((rows, ids, ~scores))[:n]


class Tops:
    """The best rows (score, id, place in order) of each of a number of windows."""

    def __init__(self, n: int, size: int):
        self.size, self.rows = size, [(np.zeros(0, np.int64),) * 3 for _ in range(n)]

    def least(self, k: int) -> float:
        """The score that a further row must reach."""
        scores = self.rows[k][0]
        return np.nextafter(float(scores.min()), -np.inf) if len(scores) == self.size else -np.inf

    def add(self, k: int, scores: np.ndarray, ids: np.ndarray, order: np.ndarray) -> None:
        s, i, o = (np.concatenate(x) for x in zip(self.rows[k], (scores, ids, order), strict=True))
        at = best(s, o, i, self.size)
        self.rows[k] = (s[at], i[at], o[at])


def _steps(batches: Iterator[pa.RecordBatch], n_anchors: int, width: int) -> Iterator[tuple]:
    """(ids, labels, whole-number rows, places in order) of some rows at a time."""
    step = max(64, STEP_SCORES // max(n_anchors, 1))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width), part.column(3).to_numpy()


_PARTIAL = "k long, score long, id long, place long"


def _left(tops: Tops) -> Iterator[pa.RecordBatch]:
    sizes = [len(s) for s, _, _ in tops.rows]
    if sum(sizes):
        columns = [np.repeat(np.arange(len(sizes)), sizes), *(np.concatenate([r[c] for r in tops.rows]) for c in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "score", "id", "place"])


def _best_of_all(parts: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("k").orderBy(F.desc("score"), "id", "place")
    return parts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def _positives(rows: DataFrame, shared, width: int, n: int) -> DataFrame:
    """The best rows of each anchor's own label."""

    def run(batches):
        anchors, labels, places, tree = shared.value
        tops = Tops(len(anchors), n)
        for ids, own, x, place in _steps(batches, len(anchors), width):
            bounds = Bounds(anchors, tree, x)
            for a in bounds.order:
                bounds.enter(a)
                wanted = (own == labels[a]) & (place != places[a])
                which = np.flatnonzero(wanted & (bounds.high[a] >= tops.least(a)) if bounds.parent[a] >= 0 else np.ones(len(x), bool))
                if len(which):
                    scores, keep = bounds.score(a, which), wanted[which]
                    tops.add(a, scores[keep], ids[which][keep], place[which][keep])
        yield from _left(tops)

    return _best_of_all(rows.mapInArrow(run, _PARTIAL), n)


def _negatives(rows: DataFrame, shared, windows, width: int, n: int) -> DataFrame:
    """The best rows of other labels in each window; a window's number is that of the anchor times the positives plus the
    positive's."""

    def run(batches):
        anchors, labels, _, tree = shared.value
        low, high = windows.value  # anchors x positives; low over high where there is no window
        n_windows = low.shape[1]
        tops = Tops(low.size, n)
        for ids, own, x, place in _steps(batches, len(anchors), width):
            bounds = Bounds(anchors, tree, x)
            for a in bounds.order:
                bounds.enter(a)
                if bounds.parent[a] < 0:
                    which = np.arange(len(x))
                else:
                    overlaps = np.zeros(len(x), bool)
                    for w in np.flatnonzero(low[a] <= high[a]):
                        overlaps |= (bounds.high[a] >= max(low[a, w], tops.least(a * n_windows + w))) & (bounds.low[a] <= high[a, w])
                    which = np.flatnonzero(overlaps & (own != labels[a]))
                if not len(which):
                    continue
                scores, other = bounds.score(a, which), own[which] != labels[a]
                for w in np.flatnonzero(low[a] <= high[a]):
                    keep = other & (scores >= low[a, w]) & (scores <= high[a, w])
                    if keep.any():
                        tops.add(a * n_windows + w, scores[keep], ids[which][keep], place[which][keep])
        yield from _left(tops)

    return _best_of_all(rows.mapInArrow(run, _PARTIAL), n)


def _anchor_blocks(anchors: DataFrame) -> Iterator[pa.Table]:
    """The anchors in blocks of a checked size."""
    total = anchors.count()
    n_blocks = -(-total // BLOCK_ANCHORS)
    block = lambda n: F.pmod(F.xxhash64("place"), F.lit(n))
    while n_blocks > 1 and anchors.groupBy(block(n_blocks).alias("k")).count().agg(F.max("count")).first()[0] > BLOCK_ANCHORS:
        n_blocks += -(-n_blocks // 8)
    for k in range(n_blocks):
        own = anchors.where(block(n_blocks) == k).toArrow()
        if len(own):
            yield own.combine_chunks()


def hard_negatives(
    embeddings: DataFrame, label: Column, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``."""
    spark = embeddings.sparkSession
    rows = scratch.stash(usable_rows(embeddings, label).withColumn("place", F.monotonically_increasing_id()), "vectors")
    width = rows.agg(F.max(F.size("q"))).first()[0] or 0
    numbered = rows.select("vec_id", "label", "q", "place")
    out = []
    for block in _anchor_blocks(numbered.where(F.col("vec_id") % every == 0)):
        vectors = matrix(block.column(2).combine_chunks(), width)
        ids, labels, places = (block.column(c).to_numpy() for c in (0, 1, 3))
        shared = spark.sparkContext.broadcast((vectors, labels, places, spanning_tree(vectors)))
        best_rows = scratch.stash(_positives(numbered, shared, width, positives), "positives")
        low, high = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        for r in best_rows.toLocalIterator():  # positives of one block of anchors
            low[r.k, r.rank - 1], high[r.k, r.rank - 1] = -(-low_percent * r.score // 100), r.score
        windows = spark.sparkContext.broadcast((low, high))
        found = _negatives(numbered, shared, windows, width, negatives)
        named = spark.createDataFrame(pa.table({"a": np.arange(len(ids)), "anchor_id": ids}))
        own = best_rows.select((F.col("k") * positives + F.col("rank") - 1).alias("k"), F.col("k").alias("a"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = found.select("k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(own, "k").join(named, "a")
        out.append(scratch.stash(joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
        shared.destroy(), windows.destroy()
        scratch.drop(best_rows)
    scratch.drop(rows)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.parquet(*(x._stash_path for x in out))


#: The same result by the definition: every anchor against every row.
NEGATIVES_SQL = """
with rows as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as a, a.label as la, r.vec_id as r, r.label as lr, cast(list_dot_product(a.q, r.q) as bigint) as s
  from rows a join rows r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positive as (
  select a, la, r as p, s as ps from scored where la = lr
  qualify row_number() over (partition by a order by s desc, r) <= 5)
select p.a as anchor_id, p.p as positive_id, cast(row_number() over (partition by p.a, p.p order by n.s desc, n.r) as integer) as rank,
  n.r as negative_id, p.ps as positive_score, n.s as negative_score
from positive p join scored n on n.a = p.a and n.la <> n.lr and 80 * p.ps <= 100 * n.s and 100 * n.s <= 100 * p.ps
qualify row_number() over (partition by p.a, p.p order by n.s desc, n.r) <= 5
"""
