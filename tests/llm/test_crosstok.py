"""Cross-tokenizer alignment against the libraries and the definition."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberloom.llm import crosstok

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = " \n\t\r\x1c\x85\xa0a'bstrevlmd1²é𝒳!?.,​▁ <|s>"


def odd_texts(n, seed=5):
    dice = random.Random(seed)
    words = ["the", "  two", "Haanth.\n", "über", "naïve", "x1", "<|endoftext|>", "<s>", "\n\n", "it's", "日本語", "a" * 70, "foo\tbar", "…"]
    made = ["".join(dice.choices(ODD, k=dice.randint(1, 40))) for _ in range(n)]
    made += [" ".join(dice.choices(words, k=dice.randint(1, 30))) for _ in range(n)]
    return made + ["", None, " ", "x", "long" * 900, made[-1], made[-1], "the end. " * 400, "a" + " " * 3000 + "b", "end  "]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def naive(texts, libraries):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, hash), by the definition."""
    a, b = libraries
    table = crosstok.byte_of_char()
    links, groups, sizes = [], [], []
    for t in texts:
        links.append([])
        if not t:
            groups.append(None), sizes.append((0, 0))
            continue
        i, j = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        of_a = [bytes(table[c] for c in a.id_to_token(x)) for x in i]
        of_b = [bytes([int(b.id_to_piece(x)[3:-1], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in j]
        if not b"".join(of_a) == b"".join(of_b) == (" " + t).encode():
            groups.append(None), sizes.append((0, 0))
            continue
        end_b, at = {}, 0
        for n, x in enumerate(of_b):
            at += len(x)
            end_b[at] = n
        found, at, s, u = [], 0, 0, 0
        for n, x in enumerate(of_a):
            at += len(x)
            if at in end_b:
                m = end_b[at]
                links[-1].append((i[n], j[m]))
                found.append(",".join(map(str, i[s : n + 1])) + "|" + ",".join(map(str, j[u : m + 1])))
                s, u = n + 1, m + 1
        groups.append(found), sizes.append((len(i), len(j)))
    count = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for own, g, (n, m) in zip(links, groups, sizes, strict=True):
        digest = hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
        out.append((n, m, len(g or []), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), digest))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_alignment_by_its_definition(spark, libraries, monkeypatch, small):
    if small:  # full memos, several blocks of pairs, several flushes
        for name, value in (("MEMO_PIECES", 20), ("MEMO_WINDOWS", 20), ("BLOCK_PAIRS", 300), ("TASK_PAIRS", 50), ("BLOCK_CHARS", 2000)):
            monkeypatch.setattr(crosstok, name, value)
    monkeypatch.setattr(crosstok, "_aligners", {})
    texts = odd_texts(150)
    docs = spark.createDataFrame([(None if n == 3 else n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("pairs", F.lit(1)).withColumn("n", F.lit(2))
    want = Counter((None if n == 3 else n, *r) for n, r in enumerate(naive(texts, libraries)))
    got = crosstok.cross_alignment(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert sum(r[1] == 0 for r in want) < len(want) / 2
    assert crosstok.cross_alignment(docs.limit(0), A, B).count() == 0


def test_pieces_are_the_libraries(libraries):
    a, b = libraries
    coder = crosstok.Aligner(A, B)
    assert coder.cut
    texts = [t for t in odd_texts(800, seed=9) if t]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        if ids is not None:
            assert crosstok.np.frombuffer(ids[0], "<u4").tolist() == a.encode(" " + t, add_special_tokens=False).ids
            assert crosstok.np.frombuffer(ids[1], "<u4").tolist() == b.encode(t)
