"""The Jaccard join against all pairs, and its bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberloom.llm import jaccard

DOCS = "doc_id long, text string"


def naive_set(text, n=4):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def naive(rows, percent=85):
    sets = [naive_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n_links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                n_links += sets[i] != sets[j]
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    out = [(i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]
    return sorted(out, key=str), n_links


def some_rows(seed=2, families=12, words=400):
    """Families of copies with a few words changed, added or left out, at all distances around the threshold."""
    dice = random.Random(seed)
    word = lambda: f"Wort{dice.randint(0, 900)}"
    texts = ["", None, " \t\n", "one", "One", "one two three", "ONE  two\nthree", "a b c d", "a b c d e", "É x y z", "é x y z"]
    shared = [word() for _ in range(60)]
    for f in range(families):
        base = [word() for _ in range(dice.choice([6, 8, 12, 30, 90, words]))]
        if f % 3 == 0:
            base = shared + base
        for _ in range(dice.randint(2, 14)):
            own = list(base)
            for _ in range(dice.randint(0, 1 + len(own) // 40)):
                at = dice.randrange(len(own))
                own[at : at + dice.randint(0, 1)] = [word()] * dice.randint(0, 1)
            texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(dice.randint(1, 50))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    dice.shuffle(rows)
    return rows + [(None, texts[-1]), (None, "no id at all here"), (3, texts[20]), (rows[0][0], rows[0][1]), (rows[9][0], rows[9][1])]


@pytest.mark.parametrize(("seed", "dear", "percent", "bits"), [(2, 64, 85, 1 << 26), (3, 0, 85, 64), (4, 1, 80, 1 << 26), (5, 0, 60, 1 << 26)])
def test_join_by_its_definition(spark, monkeypatch, seed, dear, percent, bits):
    monkeypatch.setattr(jaccard, "BUCKET_KEYS", 500)
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
    rows = some_rows(seed)
    want, n_links = naive(rows, percent)
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("node", "key", "h", "n", "d")})
    got = jaccard.near_duplicates(docs, percent, dear)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want and n_links > 50


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0



@pytest.mark.parametrize("percent", [60, 85, 95])
def test_every_linked_pair_has_a_candidate(percent):
    """For any sets of up to 300 shingles that link, some probed segment is equal, whatever the larger one skips."""
    universe, dice = jaccard.Universe(percent), np.random.default_rng(percent)
    for _ in range(300):
        n = int(dice.integers(1, 300))
        x = np.unique(dice.integers(0, 2**64, n, dtype=np.uint64))
        gone = int(dice.integers(0, n // 4 + 1))
        y = np.unique(np.concatenate([dice.permutation(x)[gone:], dice.integers(0, 2**64, int(dice.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        differ = len(x) + len(y) - 2 * both
        assert jaccard.sketch_distance(jaccard.sketch(x), jaccard.sketch(y)) <= differ
        if not both or not differ or 100 * both < percent * (len(x) + len(y) - both):
            continue
        assert differ <= universe.most(len(x), len(y))
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        rooms = dict(universe.probed(len(x)))
        t = universe.band(len(y))
        assert t in rooms and rooms[t] >= 0
        assert np.sum(universe.keys(x, t) == universe.keys(y, t)) > rooms[t]


def test_one_deletion_keys():
    universe = jaccard.Universe(85)
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 120, dtype=np.uint64))
    t = universe.band(120)
    sums, low, high = universe.subsets(x, t)
    for i in range(universe.segments(t)):
        for at in range(low[i], high[i]):
            assert universe.keys(np.delete(x, at), t)[i] in universe.shortened(x, t, np.array([i]))
    assert len(universe.shortened(x, t, np.arange(universe.segments(t)))) == 120


def test_a_family_is_not_verified_pair_by_pair(spark, monkeypatch):
    """Copies that all link, and a hub that links with none: each round verifies a pair for each node at most."""
    dice = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base[: (at := dice.randrange(150))], f"own{i}", *base[at + 1 :]])) for i in range(300)]
    counts, verified = [], jaccard.verified

    def counted(pairs, *others):
        linked = verified(pairs, *others)
        counts.append(pairs.count())
        return linked.limit(0) if len(counts) == 1 else linked

    monkeypatch.setattr(jaccard, "verified", counted)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 300
    assert max(counts) <= 300, counts
