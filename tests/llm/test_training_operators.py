"""The training-data operators against brute force, round trips and held-out labels, on small tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from emberloom.llm import bpe, brown, components, decontam, media, quality, simhash, tokenbin, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
NAMES = ["the", "Erin", "that,", "of", "ouent.", "and", "là", "über", "x1", "no!", "a"]


def some_texts(n, seed=3):
    dice = random.Random(seed)
    made = [" ".join(dice.choices(NAMES, k=dice.randint(1, 60))) for _ in range(n)]
    return made + ["", None, "  two  spaces\n\n\nlines \n ", made[0], "long" * 5000, made[1] + " tail"]


def table(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 5), (0, texts[0], "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "ids", "d", "h", "row", "key", "word", "part") if extra else ():
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, some_texts(60), extra=True).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_byte_bpe_is_tiktokens(docs, local, spark):
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    want = Counter()
    for i, t in local:
        ids = np.array(coder.encode_ordinary(t or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(docs, RANKS, P.PATTERN).collect())) == want
    two = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert Counter(map(tuple, two.collect())) == Counter(map(tuple, bpe.round_trip(docs, RANKS, P.PATTERN).collect()))
    assert bpe.digests(empty(spark), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_of_odd_characters():
    coder = bpe.Coder(bpe.load_ranks(RANKS), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    dice, some = random.Random(1), " \n\t\r\x1c\x85\xa0 a'bstrevlmd1²٣é𝒳!?.​\x01"
    texts = ["".join(dice.choices(some, k=dice.randint(0, 40))) for _ in range(800)] + ["ab" * 700, "a" * 999]
    ids = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_byte_bpe_of_long_words_and_texts(monkeypatch):
    for name, value in (("BLOCK_CHARS", 3000), ("BLOCK_CHUNKS", 40), ("DECODE_IDS", 50), ("QUERY_ROWS", 20_000), ("MEMO_ROWS", 100)):
        monkeypatch.setattr(bpe, name, value)
    coder = bpe.Coder(bpe.load_ranks(RANKS), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    dice = random.Random(7)
    texts = ["".join(dice.choices("abcdefghij", k=n)) for n in (201, 500, 900)] + ["".join(dice.choices("ing th", k=4000)), "a" * 5000, "long" * 700, "é" * 400 + "aaab" * 90]
    texts += [" ".join("".join(dice.choices("abcdeé\n", k=5)) for _ in range(2000)), "", "short"]
    ids = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts] and len(coder.memo) == 100


def test_token_files_round_trip(docs, local, spark):
    coder = tokenbin.WordCoder(WORDS)
    want, start = [], 0
    for i, t in sorted(local, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenbin.offsets_and_digests(docs, WORDS, 1).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenbin.offsets_and_digests(empty(spark), WORDS, 1).count() == 0


def test_token_files_are_bounded(docs, spark):
    want = sorted(map(tuple, tokenbin.offsets_and_digests(docs, WORDS, 1).collect()), key=str)
    path = tokenbin.scratch.new_path(spark, "tokens")
    tokenbin.write_files(docs, path, WORDS, 1, file_records=4, file_bytes=300, block_ids=40)
    files = [r.content for r in spark.read.format("binaryFile").load(path).collect()]
    found = [tokenbin.read_footer(x) for x in files]
    assert len(files) > 8 and max(len(o) for o, _, _, _ in found) <= 3
    assert sorted(map(tuple, tokenbin.read_files(spark, path).collect()), key=str) == want


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 31])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    packed = tokenbin.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (tokenbin.unpack(packed, bits, 0, 1001) == ids).all()
    assert (tokenbin.unpack(packed, bits, 333, 50) == ids[333:383]).all()


def test_token_words_are_the_librarys():
    coder, dice, some = tokenbin.WordCoder(WORDS), random.Random(2), " \n\t\r\x1c\x85\xa0a'bstREVlmdIİΣ1²é𝒳!?.,​̇\"$%|<"
    texts = ["".join(dice.choices(some, k=dice.randint(0, 30))) for _ in range(1500)] + ["x <|endoftext|> y", "<|EndOfText|>", "Word, word"]
    want = [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want


def test_words_without_ids_when_the_memo_is_full(monkeypatch):
    monkeypatch.setattr(tokenbin, "MEMO_ROWS", 5)
    coder = tokenbin.WordCoder(WORDS)
    texts = ["a \u00a0 b \u2003 \x85", "new \u00a0 word \u2003", "\x85 a other", "\u2003"]
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(coder.encode([t])[0], "<u4").tolist() for t in texts] == want
    assert len(coder.memo) == 5


def naive_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    return {n: find(n) for n in nodes}


def test_simhash_against_all_pairs(spark):
    dice = random.Random(5)
    texts = some_texts(40)
    for t in texts[:12]:
        for _ in range(3):
            words = (t or "").split()
            words[dice.randrange(len(words))] = "new"
            texts.append(" ".join(words))
    docs = table(spark, texts)
    rows = [(r.doc_id, naive_fingerprint(r.text)) for r in docs.collect()]
    prints = sorted({f for _, f in rows})
    root = naive_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for i, f in rows:
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    got = simhash.near_duplicates(docs).collect()
    assert Counter(map(tuple, got)) == Counter((i, f"{f:016x}", low.get(root[f])) for i, f in rows)
    kept = [r.doc_id for r in simhash.keep_one_of_each(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(low.values())) and kept.count(None) == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_texts_of_one_id_are_told_apart(spark):
    words = lambda seed: " ".join(random.Random(seed).choices("abcdefghijklmnop", k=40))
    rows = [(3, words(1)), (5, words(1)), (5, words(2)), (5, words(2)), (5, words(3)), (7, words(3)), (None, words(1)), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("t", F.lit(2))
    got = simhash.keep_one_of_each(docs, 3, 5)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, words(1)), (5, words(2)), (5, words(3)), (None, words(1)), (9, None)])


def test_hot_bucket_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    dice = random.Random(6)
    base = dice.getrandbits(62)
    some = sorted({base ^ (1 << dice.randrange(62)) ^ (1 << dice.randrange(62)) ^ (1 << dice.randrange(62)) ^ (1 << dice.randrange(62)) for _ in range(150)})
    nodes = spark.createDataFrame([(x,) for x in some], "fp long")
    groups = [list(range(16 * i, 16 * i + 16)) for i in range(4)]
    for thresholds in ([0, 0, 0, 0], [1, 1, -1, -1]):
        edges = simhash.links(nodes, groups, thresholds).collect()
        root = naive_components(some, lambda a, b: (a ^ b).bit_count() <= 3)
        links = {(e.a, e.b) for e in edges}
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        assert naive_components(some, lambda a, b: (a, b) in links or (b, a) in links) == root


def test_allocation_covers_the_distance():
    chosen = simhash.allocate(np.array([[5.0, 50, 500], [5, 50, 500], [900, 9000, 90000], [1, 2, 500]]), 3)
    assert sum(t + 1 for t in chosen) == 4 and chosen[2] == -1


@pytest.mark.parametrize("split", [0, 200_000])
def test_components_of_a_path_and_a_star(spark, monkeypatch, split):
    monkeypatch.setattr(components, "SPLIT", split)
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 140), 100)}


def naive_brown(texts, model):
    """The score of each text by the definition, from the model's classes and pure counts of the training texts."""
    k = len(model.transition) - 2
    cls = {brown.END: k, **{w: int(model.classes[i]) for w, i in model.number.items()}}
    train = [[brown.END, *brown.tokens(t or ""), brown.END] for t in texts]
    c = Counter(w for t in train for w in t[1:])
    pairs = Counter((cls.get(a, k + 1), cls.get(b, k + 1)) for t in train for a, b in zip(t, t[1:]))
    second = [sum(n for (_, b), n in pairs.items() if b == j) for j in range(k + 2)]
    first = [sum(n for (a, _), n in pairs.items() if a == j) for j in range(k + 2)]
    members = Counter(cls.get(w, k + 1) for w in c)

    def score(text):
        total, was = 0.0, k
        for w in [*brown.tokens(text or ""), brown.END]:
            now = cls.get(w, k + 1)
            prior = (second[now] + 1) / (sum(second) + k + 2)
            total += math.log10((pairs[was, now] + brown.PRIOR * prior) / (first[was] + brown.PRIOR))
            if now != k:
                total += math.log10((c[w] + 1) / (second[now] + members[now] + (now == k + 1)))
            was = now
        return total

    return score


def test_brown_against_its_definition(spark, docs, local, monkeypatch):
    monkeypatch.setattr(brown, "DICTIONARY", 8)
    monkeypatch.setattr(brown, "LEAST", 2)
    monkeypatch.setattr(brown, "SEED", 4)
    monkeypatch.setattr(brown, "CLASSES", 2)
    train = [t for i, t in local if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*brown.tokens(t or ""), brown.END])
    total, distinct = sum(c.values()), len(c)
    fold = brown.held_out(F.col("doc_id"), 7)
    model, _ = brown.fit(docs.where(fold.isNull() | ~fold))
    assert 4 < len(model.number) <= 8
    score, want = naive_brown(train, model), Counter()
    for i, t in local:
        words = [*brown.tokens(t or ""), brown.END]
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words)
        want[i, None if i is None else zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(c[w] > 0 for w in words), total, round(base, 6), round(score(t), 6)] += 1
    got = brown.scores(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert brown.scores(empty(spark)).count() == 0


def likelihood(classes):
    return brown._nlogn(classes).sum() - brown._nlogn(classes.sum(axis=0)).sum() - brown._nlogn(classes.sum(axis=1)).sum()


def test_words_behind_the_seed_go_to_their_best_class(spark):
    dice = random.Random(2)
    words = [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    texts = [" ".join(dice.choice("aceg" if j % 2 else "bdf") for j in range(dice.randint(1, 9))) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    label = np.array([0, 1, 0, 1])
    pairs = brown.bigram_counts(docs, {w: i for i, w in enumerate(words[:4])}, 6)
    onehot = np.eye(4)[[0, 1, 0, 1, 2, 3]]
    start = onehot.T @ pairs @ onehot
    got = {r.w: r["class"] for r in brown.assign(brown.context_counts(docs, words, label), start).collect()}
    for w in (4, 5, 6):
        each = []
        for k in (0, 1):
            symbol = {b"a": 0, b"b": 1, b"c": 0, b"d": 1, words[w]: k}
            each.append(likelihood(brown.bigram_counts(docs, symbol, 4).astype(float)))
        assert got[w] == int(np.argmax(each))
    assert set(got) == {4, 5, 6} and got[4] == got[6] == 0 and got[5] == 1


def test_brown_model_is_a_distribution_and_exchange_helps():
    dice = np.random.default_rng(0)
    counts = np.zeros((10, 10), np.int64)
    for a, b in dice.integers(0, 8, (4000, 2)):
        counts[a, (b // 2) * 2 + (a + 1) % 2] += 1  # odd words follow even ones
    counts[9, 8] = counts[8, 9] = 5
    label = brown.exchange(counts, classes=2)
    assert sorted(map(sorted, ([i for i in range(8) if label[i] == k] for k in (0, 1)))) == [[0, 2, 4, 6], [1, 3, 5, 7]]
    onehot = np.eye(4)[np.concatenate([label, [2, 3]])]
    top = [(bytes([97 + i]), int(counts[:, i].sum())) for i in range(8)]
    model = brown.Model(4010, 11, top, 5, label, onehot.T @ counts @ onehot)
    emission = {}
    for c, e in zip(model.classes, model.emission, strict=True):
        emission[c] = emission.get(c, 0) + 10**e
    assert np.allclose([emission[0], emission[1]], 1) and np.allclose((10**model.transition).sum(axis=1), 1, atol=1e-3)


def test_brown_beats_the_unigram_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = brown.scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.95 and found.score.between(0, 1).all()
    kept = quality.keep_good(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == [*docs.columns, "score"] and 0 < kept.count() < docs.count()


def test_quality_is_the_rankers_of_all_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    good = {r.doc_id: r.quality > 0 for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in texts}
    ids = sorted(good)
    ranker = quality.fit(np.array([quality.features(texts[i]) for i in ids]), np.array([good[i] for i in ids]))
    want = {i: float(ranker.score(quality.features(t)[None])[0]) for i, t in texts.items()}
    got = quality.scores(docs, labels).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, abs=1e-8) and all(r.predicted == (r.score >= 0.7) for r in got)


def test_the_cut_is_of_all_labels(spark, monkeypatch):
    dice = np.random.default_rng(5)
    v = np.concatenate([dice.normal(size=4000), np.zeros(500), [1e6]])
    values = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
    assert [quality.kth(values, k, few=7) for k in (0, 1999, 2200, 4499, 4500)] == np.sort(v)[[0, 1999, 2200, 4499, 4500]].tolist()
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ranker, ids = quality.train(docs, labels, rows=60)
    rows = [(r.doc_id, float(ranker.strength(quality.features(r.text or "")[None])[0]), r.quality) for r in docs.join(ids, "doc_id").collect()]
    order, bad = sorted(x for _, x, _ in rows), sum(q <= 0 for _, _, q in rows)
    settled = quality.settle(ranker, spark.createDataFrame([r[:2] for r in rows], "doc_id long, v double"), ids)
    assert settled.cut == (order[bad - 1] + order[bad]) / 2 and len(rows) > 200


def test_quality_writes_no_texts(spark, monkeypatch):
    """Rows leave by id and hash of the text: repeated ones, other texts of an id and rows without an id by their own texts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.scores(docs, labels).collect()
    good, bad = {r.doc_id for r in found if r.predicted}, {r.doc_id for r in found if not r.predicted}
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin([min(good), min(bad)])).collect()}
    more = spark.createDataFrame([(None, texts[min(good)]), (None, texts[min(bad)]), (None, texts[min(good)])], "doc_id long, text string")
    written, stash = [], quality.scratch.stash
    monkeypatch.setattr(quality.scratch, "stash", lambda df, name, *a: written.append(df.dtypes) or stash(df, name, *a))
    rows = docs.select("doc_id", "text")
    kept = [r.doc_id for r in quality.keep_good(rows.union(rows).union(more), labels).collect()]
    assert sorted(kept, key=str) == sorted([*good, *good, None, None], key=str)
    assert written and not [c for kinds in written for c in kinds if c[1] == "string"]


def test_quality_without_pairs_keeps_all(spark, docs):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == docs.count()
    assert quality.scores(empty(spark), labels).count() == 0


def test_jpeg_payload_round_trip(docs, local, spark):
    want = Counter()
    for i, t in local:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    got = media.media_columns(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.media_columns(empty(spark)).count() == 0


def test_jpeg_of_more_than_one_frame():
    payload = np.random.default_rng(1).integers(0, 256, 576 * 350, dtype=np.uint8).tobytes()
    images = media.decode(media.encode_payload(payload))
    media.decode_thumbnails(images)
    assert len(images) == 2 and b"".join(i.thumbnail.tobytes() for i in images) == payload


def test_jpeg_with_colour_and_ac_values():
    """A 32 x 16 image, luminance sampled twice as finely, with AC values and without restart markers."""
    dc, ac = [(0, 2), (4, 2), (7, 3)], [(0x00, 2), (0x32, 2), (0xF0, 3), (0x81, 3)]
    spec = lambda rows: bytes([sum(n == k for _, n in rows) for k in range(1, 17)]) + bytes(s for s, _ in rows)
    code = lambda rows: {s: format(c, f"0{n}b") for s, c, n in media._codes([sum(m == k for _, m in rows) for k in range(1, 17)], [s for s, _ in rows])}
    dcs, acs, bits, last = code(dc), code(ac), "", {0: 0, 1: 0, 2: 0}
    means = {0: [10, 10, 0, 90, 90, 90, 0, 10], 1: [0, 12], 2: [9, 9]}
    at = {0: 0, 1: 0, 2: 0}
    for _ in range(2):
        for c in (0, 0, 0, 0, 1, 2):
            d = means[c][at[c]] - last[c]
            last[c], at[c] = means[c][at[c]], at[c] + 1
            size = 0 if d == 0 else 4 if abs(d) < 16 else 7
            d = {0: 0}.get(d, d)
            assert size == abs(d).bit_length()
            bits += dcs[size] + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
            bits += acs[0xF0] + acs[0x32] + "10" + acs[0x81] + "0" + acs[0x00]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([8]) * 64) + media._segment(0xC0, frame)
    data += media._segment(0xC4, b"\x00" + spec(dc)) + media._segment(0xC4, b"\x10" + spec(ac))
    data += media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    image = media.parse(data)
    media.decode_thumbnails([image])
    assert (image.thumbnail.astype(int) - 128).tolist() == [[10, 10, 90, 90], [0, 90, 0, 10]]


def naive_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_matches_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)  # several blocks
    dice = random.Random(8)
    items = [" ".join(dice.choices(NAMES, k=dice.randint(8, 40))) for _ in range(12)] + [None, "  ", "short one"]
    texts = some_texts(25, seed=9)
    for item in items[:12]:
        for edits in (0, 1, 3, 9):
            s = list(item)
            for _ in range(edits):
                s[dice.randrange(len(s))] = dice.choice("zq")
            texts.append("Before it. " + "".join(s).upper().replace(" ", "\n ") + " and after")
    texts = [t for t in texts if t is None or len(t) < 3000]
    docs, bench = table(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = Counter()
    for r in docs.collect():
        for n, item in enumerate(items):
            item = decontam.normal(item)
            if item and (d := naive_distance(item, decontam.normal(r.text))) <= decontam.budget(len(item)):
                want[r.doc_id, n, d] += 1
    assert Counter(map(tuple, decontam.matches(docs, bench).collect())) == want and len(want) > 30
    bad = {i for i, _, _ in want}
    assert {r.doc_id for r in decontam.remove_contaminated(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - bad
    assert decontam.matches(empty(spark), bench).count() == 0
    assert decontam.matches(docs, bench.limit(0)).count() == 0


def test_archives_and_histories(spark):
    rows = [(i, f"http://www.Host{i % 3}.example.com:80/p?q={i}", f"<p>{i // 4}</p>" if i % 2 else f"own {i} é") for i in range(60)]
    rows += [(100, None, None), (101, "http://a.b/", ""), (102, "no url", "x\r\n\r\nWARC/1.1\r\n\r\n"), (103, "http://a.b/", "x\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://c/", "lonely"), (7, rows[7][1], rows[7][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).repartition(3)
    newest = {}
    for i, _, h in rows:
        if i is not None:
            newest[h or ""] = max(i, newest.get(h or "", -1))
    want = Counter()
    for i, _, h in rows:
        raw, first = (h or "").encode(), newest.get(h or "")
        again = first is not None and first != i
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    got = warc.histories(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    got.sort(key=lambda r: (r.part, r.place))
    keys = [(r.urlkey, r.timestamp) for r in got]
    assert keys == sorted(keys) and keys[-1][0].startswith("no url")
    assert warc.histories(pages.limit(0)).count() == 0


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    for name, value in (("LARGE", 2000), ("FILE_BYTES", 200_000), ("RECORDS_PER_FILE", 10), ("HEAD_ROWS", 3)):
        monkeypatch.setattr(warc, name, value)
    rows = [(i, f"http://h{i % 4}/", str(i) * (40_000 if i % 20 == 0 else 5)) for i in range(100, 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.scratch.new_path(spark, "archives")
    warc.write_archives(pages, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    assert max(f.length for f in files) <= 200_000 and sum(f.length > 100_000 for f in files) == 5
    got = warc.histories(pages).orderBy("part", "place").collect()
    assert sorted(r.page_id for r in got) == list(range(100, 200)) and {r.payload_bytes for r in got} == {15, 120_000}
    assert [r.urlkey for r in got] == sorted(r.urlkey for r in got)


def test_loser_tree():
    dice = random.Random(4)
    for k in range(0, 9):
        runs = [sorted(dice.choices(range(50), k=dice.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_lists_as_of(spark):
    url = "http://user@WWW.Bad.example.com:8080/x/y"
    captures = spark.createDataFrame([(1, url, 5), (2, url, 10), (3, url, 19), (4, url, 20), (5, url, 300), (6, None, 10), (7, "nothing", 10), (8, "http://ok.org/", 10), (9, "http://other.example.com/", 45), (2, url, 10), (10, url, None)], "page_id long, url string, fetched int")
    entries = spark.createDataFrame(
        [("host", "bad.example.com", 10, "add"), ("host", "bad.example.com", 20, "remove"), ("host", "bad.example.com", 20, "add"), ("host", "bad.example.com", 100, "add"), ("site", "example.com", 40, "add"), ("site", "example.com", 50, "remove"), ("section", "bad.example.com/x", 18, "add"), ("section", "bad.example.com/x", 25, "remove"), ("host", None, 1, "add"), ("host", "ok.org", None, "add")],
        "kind string, key string, day int, action string",
    )
    got = Counter((r.page_id, r.host_since, r.site_since, r.section_since, r.blocked) for r in urlfilter.evaluate(captures, entries).collect())
    want = [(1, None, None, None, False), (2, 10, None, None, True), (3, 10, None, 18, True), (4, None, None, 18, True), (5, 100, None, None, True), (6, None, None, None, False), (7, None, None, None, False), (8, None, None, None, False), (9, None, 40, None, True), (2, 10, None, None, True), (10, None, None, None, False)]
    assert got == Counter(want)
    assert urlfilter.evaluate(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in urlfilter.evaluate(captures, entries.limit(0)).collect())


def test_open_entries_hold_on_any_later_day(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", 99), (2, "http://a.b/", 400), (3, "http://a.b/", 19_000), (4, "http://c.d/", 19_723), (5, "http://c.d/", 19_500)], "page_id long, url string, fetched int")
    entries = spark.createDataFrame([("host", "a.b", 100, "add"), ("host", "c.d", 19_600, "add"), ("host", "c.d", 30_000, "remove")], "kind string, key string, day int, action string")
    assert {r.page_id: r.host_since for r in urlfilter.evaluate(captures, entries).collect()} == {1: None, 2: 100, 3: 100, 4: 19_600, 5: None}


def test_hosts_and_sites(spark):
    want = {
        "http://[2001:db8::1]/x": ("[2001:db8::1]", "[2001:db8::1]"), "http://[2001:dead::2]:8080": ("[2001:dead::2]", "[2001:dead::2]"), "http://10.0.0.1:80/": ("10.0.0.1", "10.0.0.1"),
        "http://a.bbc.co.uk/": ("a.bbc.co.uk", "bbc.co.uk"), "http://other.co.uk": ("other.co.uk", "other.co.uk"), "http://co.uk": ("co.uk", "co.uk"), "http://www.x.example.org.": ("x.example.org", "example.org"),
        "http://notco.uk/": ("notco.uk", "notco.uk"), "https://u:p@localhost": ("localhost", "localhost"), "http:///x": (None, None),
    }
    rows = spark.createDataFrame([(u,) for u in want], "url string").withColumn("host", urlfilter.host_of(F.col("url")))
    assert {r.url: (r.host, r.site) for r in rows.withColumn("site", urlfilter.site_of(F.col("host"))).collect()} == want


def test_archive_dates_are_utc_in_any_zone(spark):
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", "x") for i in (0, 1, 1439, 1440, 100_000)], "page_id long, url string, html string")
    dates = lambda: sorted(re.findall(r"WARC-Date: (\S+)", "".join(r.record for r in warc.records(pages).collect())))
    want = ["2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", "2024-01-01T23:59:00Z", "2024-01-02T00:00:00Z", "2024-03-10T10:40:00Z"]
    assert dates() == want
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert dates() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
