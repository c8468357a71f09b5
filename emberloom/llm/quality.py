"""A quality classifier by Bradley-Terry ranking of preference pairs.

A labelled good document is preferred to a labelled bad one. The chance that a is preferred to b is
``sigmoid(w . (x_a - x_b))``, so the weights come from logistic loss on feature differences without an
intercept. A document's strength is ``w . x``; strengths have no zero of their own, so the cut is a quantile of
the training strengths: the share of bad documents among the labels. The reported score is
``sigmoid(strength - cut + logit(0.7))``: 0.7 or more is at or above the cut. Share and quantile are of all labelled
documents outside the held-out fold, and exact: histograms narrow the place of the quantile down.

Features are read from the whole text: length, shares of character kinds, word shape, repetition of words and
lines. Language, source and ids are not features. The fit takes at most ``FIT_ROWS`` labelled rows (those with
the smallest hashes of their ids) and ``PAIRS`` pairs, so it is the same size for any corpus; the cut and the
scores cover every row.

Defined cases: a null or empty text has all features zero and is scored like any; null ``doc_id`` or null
label: not a training row; several labels of one id: the highest; several texts of a labelled id: the first in
order of text is the training row, and the weakest counts for the cut; repeated rows each give a row; other columns are not read; where the labels hold no pair, nothing can be ranked and every score is 0.7 (all are kept).
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberloom.llm import scratch
from emberloom.llm.brown import held_out

FIT_ROWS = 12_000
PAIRS = 60_000
CUT_SCORE = 0.7
RIDGE = 1e-3
#: Bytes by kind: control and spaces, digits, upper case, lower case, sentence marks, pairing marks, other
#: ASCII marks, bytes of other characters.
_KINDS = np.zeros(256, np.int64)
_KINDS[ord("0") : ord("9") + 1] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("a") : ord("z") + 1] = 3
_KINDS[[ord(c) for c in ".,;:?"]] = 4
_KINDS[[ord(c) for c in "()[]{}<>\"'/-_"]] = 5
_KINDS[[ord(c) for c in "!#$%&*+=@\\^`|~"]] = 6
_KINDS[128:] = 7
N_FEATURES = 8 + 8 + 8 + 13


def features(text: str) -> np.ndarray:
    """The features of one text."""
    out = np.zeros(N_FEATURES)
    raw = text.encode()
    words = raw.split()
    if not words:
        return out
    data = np.frombuffer(raw, np.uint8)
    n, counts = len(words), np.bincount(_KINDS[data], minlength=8)
    out[:8] = counts / len(data)
    space = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    inside = ~space
    ends, starts = data[inside[1:-1] & space[2:]], data[inside[1:-1] & space[:-2]]
    out[8:16] = np.bincount(_KINDS[ends], minlength=8) / n
    out[16:24] = np.bincount(_KINDS[starts], minlength=8) / n
    lens = np.fromiter(map(len, words), np.int64, n)
    lines = raw.split(b"\n")
    tally = Counter(words)
    pairs = set(zip(words, words[1:]))
    letters = counts[2] + counts[3]
    out[24:] = (
        np.log1p(n),
        np.log1p(len(data)),
        lens.mean(),
        lens.std(),
        (lens == 1).mean(),
        len(tally) / n,
        max(tally.values()) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(pairs) / n,
        counts[2] / max(letters, 1),
        raw.count(b"!!") / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
    )
    return out


class Ranker:
    """Weights, cut and feature scale; ``fit`` on a bounded sample."""

    def __init__(self, weights: np.ndarray, middle: np.ndarray, scale: np.ndarray, cut: float):
        self.weights, self.middle, self.scale, self.cut = weights, middle, scale, cut

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.score_of(self.strength(x))

    def score_of(self, strength: np.ndarray) -> np.ndarray:
        shift = np.log(CUT_SCORE / (1 - CUT_SCORE))
        # rounding keeps what is at the cut at the cut
        return np.round(1 / (1 + np.exp(-np.clip(strength - self.cut + shift, -40, 40))), 9)


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS) -> Ranker:
    """Newton's method on the pairs' logistic loss."""
    middle, scale = (np.median(x, axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    ranker = Ranker(np.zeros(x.shape[1] if len(x) else N_FEATURES), middle, scale, 0.0)
    if good.all() or not good.any():
        return ranker
    z = np.clip((x - middle) / scale, -6, 6)
    dice = np.random.default_rng(17)
    diff = z[dice.choice(np.flatnonzero(good), pairs)] - z[dice.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        grad = diff.T @ (p - 1) / pairs + RIDGE * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    ranker.weights = w
    order = np.sort(ranker.strength(x))
    bad = int((~good).sum())
    ranker.cut = float((order[bad - 1] + order[bad]) / 2)  # the quantile: as many below as there are bad ones
    return ranker


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x`` of every row."""

    def run(batches):
        for batch in batches:
            made = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, rows: int = FIT_ROWS) -> tuple[Ranker, DataFrame]:
    """The ranker fitted on at most ``rows`` labelled documents outside the held-out fold, and all labels of it."""
    ids = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality is not null")
    ids = ids.where(~held_out(F.col("doc_id"), mod)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # rows ids at most
    found = with_features(chosen).join(F.broadcast(some), "doc_id").orderBy("doc_id").collect()  # rows feature rows at most
    return fit(np.array([r.x for r in found]).reshape(-1, N_FEATURES), np.array([r.quality > 0 for r in found], bool)), ids


def kth(values: DataFrame, k: int, few: int = 10_000) -> float:
    """The value of column ``v`` that has ``k`` before it in order: each round counts the values in 1,024 equal steps and
    goes on with the step that it lies in."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        inside = values.where(F.col("v").between(low, high))
        step = F.least(F.floor((F.col("v") - low) / ((high - low) / 1024)), F.lit(1023))
        counts = inside.groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()  # 1,024 rows
        for r in counts:
            if k < r.n:
                break
            k -= r.n
        low, high = r.low, r.high
        if r.n <= few:
            return sorted(x.v for x in values.where(F.col("v").between(low, high)).collect())[k]  # few rows
    return low


def settle(ranker: Ranker, strengths: DataFrame, ids: DataFrame) -> Ranker:
    """The ranker with its cut at the share of bad ones of all labelled documents. ``strengths``: ``doc_id``, ``v``."""
    known = scratch.stash(strengths.groupBy("doc_id").agg(F.min("v").alias("v")).join(ids, "doc_id"), "strengths")
    n, bad = known.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") <= 0).cast("long")), F.lit(0))).first()
    if ranker.weights.any() and 0 < bad < n:
        ranker.cut = float((kth(known, bad - 1) + kth(known, bad)) / 2)
    scratch.drop(known)
    return ranker


def scores(docs: DataFrame, labels: DataFrame, mod: int = 4) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    ranker, ids = train(docs, labels, mod)

    def measure(batches):
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.strength(x), pa.float64())], names=["doc_id", "v"])

    rows = scratch.stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, "doc_id long, v double"), "measured")
    settled = settle(ranker, rows, ids)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(settled.score_of(batch.column(1).to_numpy()), pa.float64())], names=["doc_id", "score"])

    keep = F.when(F.col("score") >= CUT_SCORE, 1).otherwise(0)
    found = rows.mapInArrow(score, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), mod).alias("held_out"), "score", keep.alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, mod: int = 4) -> DataFrame:
    """The rows whose own text scores at or above the cut, with all their columns. Strengths are written by id and hash of
    the text, so that no text is measured twice and none is written; rows leave by a join with those below the cut."""
    ranker, ids = train(docs, labels, mod)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("h")]

    def measure(batches):
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(3).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ranker.strength(x), pa.float64())], names=["doc_id", "d", "h", "v"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, "text")
    rows = scratch.stash(texts.mapInArrow(measure, "doc_id long, d long, h long, v double"), "measured")
    settled = settle(ranker, rows.select("doc_id", "v"), ids)

    def below(batches):
        for batch in batches:
            yield batch.filter(pa.array(~(settled.score_of(batch.column(2).to_numpy()) >= CUT_SCORE)))

    bad = scratch.stash(rows.select("d", "h", "v").mapInArrow(below, "d long, h long, v double").select("d", "h").distinct(), "rejected")
    scratch.drop(rows)
    known = docs.select(F.struct(*docs.columns).alias("row"), *key)
    return known.join(bad.hint("shuffle_hash"), ["d", "h"], "left_anti").select("row.*")
