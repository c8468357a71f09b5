"""The pipeline's stages on sf0.001, each on what its predecessor kept, and the whole of it against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from test_jaccard import naive_set
from test_training_operators import naive_components, naive_distance, naive_fingerprint

import corpus_pipeline
from emberloom.llm import bpe, decontam, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    bench = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.scratch.stash(stage(spark, docs, SF), re.sub(r"\W", "", name))
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert now and set(now) <= set(before)
        if name == "line dedup":
            assert set(now) == set(before) and sum(map(len, now.values())) < sum(map(len, before.values()))
        else:
            assert all(now[i] == before[i] for i in now)
        if name == "benchmark decontamination":
            gone = [i for i in before if any(b in decontam.normal(before[i]) for b in bench)]
            assert not set(gone) & set(now)
        before = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(before) and all(len(r.ids) == 4 * r.n_tokens for r in last)


def naive_line_dedup(texts, stretch=20, least=30):
    """Every stretch of units against all earlier ones; runs of them go, with words that agree at both ends."""
    units, first, starts = {}, {}, {}
    for i in sorted(texts):
        raw = [y for x in re.split(r"(?<=\n)|(?<=[.!?] )", texts[i]) for y in (re.split("(?<=e )", x) if len(x.encode()) > 120 else [x])]
        own = [(p, x.split()) for p, x in enumerate(raw) if x.split()]
        units[i] = raw, own
        for k in range(len(own)):
            for onward in (True, False):
                e = k
                while 0 <= e < len(own) and sum(len(x) for _, x in own[min(k, e) : max(k, e) + 1]) < stretch:
                    e += 1 if onward else -1
                if 0 <= e < len(own):
                    low, high = min(k, e), max(k, e)
                    key = onward, tuple(" ".join(x) for _, x in own[low : high + 1])
                    first.setdefault(key, (i, low, high))
                    starts.setdefault(i, []).append((low, high, onward, key))
    agree = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = {}
    for i, (raw, own) in units.items():
        runs = []
        for low, high, onward, key in sorted(starts.get(i, []), key=lambda x: x[:3]):
            j, f, g = first[key]
            if (j, f) == (i, low):
                continue
            if runs and low <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], high)
            else:
                runs.append([low, high, 0, 0])
            side = lambda d, n: units[d][1][n][1] if 0 <= n < len(units[d][1]) else []
            if onward and low == runs[-1][0]:
                runs[-1][2] = agree(side(i, low - 1)[::-1], side(j, f - 1)[::-1])
            if not onward and high == runs[-1][1]:
                runs[-1][3] = agree(side(i, high + 1), side(j, g + 1))
        text, at, skip = "", 0, 0
        for low, high, before, behind in [r for r in runs if sum(len(x) for _, x in own[r[0] : r[1] + 1]) + r[2] + r[3] >= least]:
            gap = re.sub(r"^(\s*\S+){%d}" % skip, "", "".join(raw[at : own[low][0]]))
            text += re.sub(r"\S+(\s+\S+){0,%d}\s*$" % (before - 1), "", gap) if before else gap
            at, skip = own[high][0] + 1, behind
        out[i] = text + re.sub(r"^(\s*\S+){%d}" % skip, "", "".join(raw[at:]))
    return out


def test_pipeline_by_its_definition(spark, tmp_path):
    dice, words = random.Random(4), [f"word{i}" for i in range(60)]
    line = lambda: " ".join(dice.choices(words, k=dice.randint(4, 12))).capitalize() + dice.choice([". ", ".\n"])
    passage = "".join(line() for _ in range(6))
    items = {n: " ".join(dice.choices(words, k=9)) for n in range(4)}
    texts, good = {}, {}
    for i in range(1, 61):
        good[i] = i % 3 > 0
        body = "".join(line() for _ in range(dice.randint(4, 9)))
        texts[i] = body if good[i] else "!!! ".join(body.upper().split()[:20]) + " $$$ 99 %%% 1 2 3 4 !!!"
    for i in (10, 20, 35, 50):
        texts[i] = texts[i] + passage + "The end."
    texts[7] = line() + line()  # too short for the lines to go
    texts[22], texts[40] = texts[7], texts[7].lower()
    body = [dice.choice(words) for _ in range(60)]
    texts[28], texts[44] = " ".join(body), " ".join([*body[:30], "other", *body[31:]])  # 5 of 56 shingles differ
    for n, i in enumerate((5, 14, 26, 59)):
        texts[i] += items[n].replace("word1", "Word1").replace("word", "wrd", 1 + n % 2) + " and more."
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(g), 0) for i, g in good.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    ids = [i for i in sorted(good) if zlib.crc32(str(i).encode()) % 4 != 2]
    ranker = quality.fit(np.array([quality.features(texts[i]) for i in ids]), np.array([good[i] for i in ids]))
    kept = {i: t for i, t in texts.items() if ranker.score(quality.features(t)[None])[0] >= 0.7}
    assert 0 < len(kept) < len(texts)
    clean = naive_line_dedup(kept)
    assert clean != kept
    prints = {i: naive_fingerprint(t, 5) for i, t in clean.items()}
    root = naive_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    single = {i: clean[i] for i in first.values()}
    assert len(single) < len(clean)
    sets = {i: naive_set(t, 5) for i, t in single.items()}
    near = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    group, was = naive_components(sorted(single), near), len(single)
    single = {i: single[i] for i in {min(j for j in single if group[j] == g) for g in set(group.values())}}
    assert len(single) < was
    leaks = lambda t: any(naive_distance(decontam.normal(x), decontam.normal(t)) <= decontam.budget(len(decontam.normal(x))) for x in items.values())
    last = {i: t for i, t in single.items() if not leaks(t)}
    assert len(last) < len(single)
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: np.array(coder.encode_ordinary(t), "<u4").tobytes() for i, t in last.items()}
    assert {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
