"""Hard negatives against every anchor and row, by the definition."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def some_rows(n, dims=6, seed=1, scale=1.0):
    dice = random.Random(seed)
    rows = [(i, [dice.gauss(0, scale) for _ in range(dims)], dice.randint(0, 3)) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2] ^ (i % 2)) for i in range(40)]  # ties
    rows += [(None, [1.0] * dims, 1), (9001, None, 1), (9002, [1.0] * dims, None), (9003, [1.0, None, 0.0], 1)]
    rows += [(9004, [float("nan")] * dims, 1), (9005, [float("inf")] * dims, 1), (9100, [], 2), (9007, [1.0, 2.0], 2), rows[5], rows[0]]
    return rows


def naive(rows, every=10, k=5):
    clean = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            clean[i] = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v])
    out = []
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    for a in clean:
        if a % every:
            continue
        scored = sorted((-dot(clean[a][1], v), i, label) for i, (label, v) in clean.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == clean[a][0]][:k]:
            near = [(n, m) for n, m, label in scored if label != clean[a][0] and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, p, r, m, -s, -n) for r, (n, m) in enumerate(near, 1)]
    return Counter(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("place", "k", "score", "q")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(df, label, **more)


@pytest.mark.parametrize(("block", "step", "scale"), [(1024, 1 << 21, 1.0), (7, 500, 1.0), (1024, 4000, 2.0**20), (50, 1 << 21, 2.0**21)])
def test_hard_negatives_by_their_definition(spark, monkeypatch, block, step, scale):
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(negatives, "STEP_SCORES", step)
    rows = some_rows(400, scale=scale)
    got = mined(spark, rows, every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = naive(rows)
    assert want and Counter(map(tuple, got.collect())) == want


def test_no_rows(spark):
    assert mined(spark, []).count() == 0
    assert mined(spark, [(1, [1.0], 1), (100, [1.0], 2)]).count() == 0


def test_equal_rows_and_shared_ids(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [0.5, 0.0], 1), (4, [0.9, 0.0], 2), (4, [0.9, 0.0], 2)]
    got = sorted(map(tuple, mined(spark, rows).collect()))
    assert got == [(100, 3, 1, 4, 65536, 58880)]


def test_bounds_hold_and_prune():
    dice = np.random.default_rng(3)
    anchors = np.concatenate([c + dice.integers(-6, 7, (20, 16)) for c in dice.integers(-200, 200, (5, 16))])
    rows = np.concatenate([c + dice.integers(-9, 10, (80, 16)) for c in dice.integers(-200, 200, (6, 16))])
    tree = negatives.spanning_tree(anchors)
    assert sorted(tree[0]) == list(range(100)) and sum(p < 0 for p in tree[1]) == 1
    bounds = negatives.Bounds(anchors, tree, rows)
    true = anchors @ rows.T
    for a in bounds.order:
        assert bounds.parent[a] < 0 or bounds.order.index(bounds.parent[a]) < bounds.order.index(a)
        bounds.enter(a)
        assert (bounds.low[a] <= true[a]).all() and (true[a] <= bounds.high[a]).all()
        which = np.flatnonzero(bounds.high[a] >= np.sort(true[a])[-20])
        assert (bounds.score(a, which) == true[a][which]).all() and set(np.argsort(true[a])[-10:]) <= set(which)
    assert bounds.scored < 0.6 * true.size
