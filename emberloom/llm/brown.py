"""A Brown class-based bigram language model.

Words get classes by exchange clustering; a token's probability is the class transition times the emission of
the word from its class. Counts cover every training text:

1. word counts, added up per task and then over tasks, into a table of the whole vocabulary;
2. the dictionary: words of at most ``WORD_BYTES`` bytes that occur ``LEAST`` times or more (fewer contexts tell
   nothing of a word's class), the most frequent ``DICTIONARY`` of them at most, cut at a step of their counts. It is
   what tasks hold in memory, and so has a bound;
3. classes of the ``SEED`` most frequent words: the counts of their bigrams, with one symbol for the document end and
   one for all other words, are summed over the corpus (``(SEED + 2)**2`` numbers at most), and the exchange moves
   one word at a time to the class that raises the likelihood most;
4. classes of all other words of the dictionary: a second pass over the corpus counts how often each stands behind
   and before each class, tables join those counts by word, and each word goes to the class where the likelihood of
   its contexts gains most, in parallel for all words;
5. transitions: a third pass counts the pairs of classes with every word of the dictionary in its class. Words outside
   the dictionary, unknown ones included, share one more class and differ by their own counts.

Scoring: transitions and the words of the dictionary are scored where the text is; every other word leaves as (row,
word, count in text) and meets its count in a join with the vocabulary table. So no word's count is dropped, and the
frequent words, which would be hot keys, never enter the join.

Smoothing: add one for emissions (each class has one unit for unseen words only where it may emit them, the
class of all others) and a Dirichlet prior of ``PRIOR`` class unigrams for transitions.

Defined cases: a null text counts as empty and is scored as its end token alone; null ``doc_id`` is a training
row with ``held_out`` null; repeated rows count and are scored each; other columns are not read; with no
training rows all counts are zero and the score is the uniform one of the formulas. Rows are named by partition and
place while they are scored: the input has to come in the same order whenever a task is run again, as it does from
files; write other inputs first.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberloom.llm import scratch

SEED = 1024
CLASSES = 48
DICTIONARY = 200_000
LEAST = 5
WORD_BYTES = 48
PRIOR = 20.0
PASSES = 12
#: The end token; no word holds a space.
END = b" "
_FLUSH_WORDS = 400_000


def tokens(text: str) -> list[bytes]:
    """The words of a text, with A-Z in lower case."""
    return text.encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (bytes, the end token included) and ``c`` over all rows."""

    def run(batches):
        found: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens(text or ""))
                found[END] += 1
                if len(found) > _FLUSH_WORDS:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bigram_counts(docs: DataFrame, symbol: dict[bytes, int], n: int) -> np.ndarray:
    """``n`` x ``n`` counts of neighbouring symbols over all rows. Of the symbols, the last but one is the end and the
    last one is every word that ``symbol`` does not have."""
    shared = docs.sparkSession.sparkContext.broadcast(symbol)  # DICTIONARY words at most

    def run(batches):
        get, end, other = shared.value.get, n - 2, n - 1
        found = np.zeros(n * n, np.int64)
        for batch in batches:
            symbols = [end]
            for text in batch.column(0).to_pylist():
                symbols += [get(w, other) for w in tokens(text or "")]
                symbols.append(end)
                if len(symbols) > 500_000:
                    found += _pairs(symbols, n)
                    symbols = [end]
            found += _pairs(symbols, n)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["k", "c"])

    rows = docs.select("text").mapInArrow(run, "k int, c long").groupBy("k").agg(F.sum("c").alias("c"))
    table, out = rows.toPandas(), np.zeros(n * n, np.int64)  # n * n rows at most
    out[table.k.to_numpy(np.int64)] = table.c.to_numpy(np.int64)
    return out.reshape(n, n)


def context_counts(docs: DataFrame, words: list[bytes], label: np.ndarray) -> DataFrame:
    """``w`` (place in ``words``, of those behind the seed), ``ctx`` and ``n``: how often the word stands behind class
    ``ctx``, and (numbers from k + 2 on) before class ``ctx - k - 2``. ``label`` has the classes of the seed words."""
    k, seed = int(label.max(initial=-1)) + 1, len(label)
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # DICTIONARY words at most
    # by place + 1: class of the word, and the class of all others at 0
    of = np.concatenate([[k + 1], label, np.full(len(words) - seed, k + 1)]).astype(np.int64)
    width = 2 * (k + 2)

    def run(batches):
        get, kept, n_kept = shared.value.get, [], 0

        def counted(symbols: list[int]):
            s = np.array(symbols, np.int64)
            cls = np.where(s < 0, k, of[np.maximum(s, 0)])
            at = np.flatnonzero(s > seed)
            base = (s[at] - 1) * width
            return np.unique(np.concatenate([base + cls[at - 1], base + k + 2 + cls[at + 1]]), return_counts=True)

        def rows():
            codes, inverse = np.unique(np.concatenate([c for c, _ in kept]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([n for _, n in kept])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(codes // width), pa.array(codes % width), pa.array(sums)], names=["w", "ctx", "n"])

        for batch in batches:
            symbols = [-1]
            for text in batch.column(0).to_pylist():
                symbols += [get(w, -1) + 1 for w in tokens(text or "")]
                symbols.append(-1)
                if len(symbols) > 500_000:
                    kept.append(counted(symbols))
                    symbols = [-1]
            if len(symbols) > 1:
                kept.append(counted(symbols))
            n_kept = sum(len(c) for c, _ in kept)
            if n_kept > 3_000_000:
                yield rows()
                kept = []
        if kept:
            yield rows()

    made = docs.select("text").mapInArrow(run, "w long, ctx long, n long")
    return made.groupBy("w", "ctx").agg(F.sum("n").alias("n"))


def gains(pair: np.ndarray, behind: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What the likelihood of the class bigrams ``pair`` gains when words of these contexts (a row each) join each of
    the classes (all but the last two, which are the end and the others)."""
    k = len(pair) - 2
    p, own = pair[:k], np.arange(k)
    d = pair[own, own]
    wide = (_nlogn(p[None] + before[:, None, :]) - _nlogn(p)[None]).sum(axis=2)
    tall = (_nlogn(pair[:, :k].T[None] + behind[:, None, :]) - _nlogn(pair[:, :k].T)[None]).sum(axis=2)
    o, i = before[:, :k], behind[:, :k]
    both = _nlogn(d + o + i) - _nlogn(d + o) - _nlogn(d + i) + _nlogn(d)
    row, col = pair.sum(axis=1)[:k], pair.sum(axis=0)[:k]
    total = _nlogn(row + before.sum(axis=1, keepdims=True)) - _nlogn(row) + _nlogn(col + behind.sum(axis=1, keepdims=True)) - _nlogn(col)
    return wide + tall + both - total


def assign(contexts: DataFrame, pair: np.ndarray) -> DataFrame:
    """``w`` and ``class``: of each word the class with the highest gain, ties going to the lowest."""
    n = len(pair)
    pair = pair.astype(np.float64)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = np.zeros((len(part), 2 * n))
                of = np.repeat(np.arange(len(part)), [len(x) for x in part.column(1)])
                found[of, part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy()
                best = gains(pair, found[:, :n], found[:, n:]).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best)], names=["w", "class"])

    each = F.collect_list(F.struct("ctx", "n"))  # 2 * (CLASSES + 2) at most
    rows = contexts.groupBy("w").agg(each.alias("z")).select("w", "z.ctx", "z.n")
    return rows.mapInArrow(run, "w long, class long")


def _pairs(symbols: list[int], n: int) -> np.ndarray:
    s = np.array(symbols, np.int64)
    return np.bincount(s[:-1] * n + s[1:], minlength=n * n)


def _nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each seed word. The last two symbols of ``counts`` keep classes of their own.

    Starts from the words dealt to classes by rank, and takes words by rank; a word moves to the class with the
    highest likelihood, ties going to the lowest class, until a pass moves none.
    """
    n = len(counts) - 2
    k = min(classes, max(n, 1))
    label = np.concatenate([np.arange(n) % k, [k, k + 1]])
    onehot = np.zeros((n + 2, k + 2))
    onehot[np.arange(n + 2), label] = 1
    c = counts.astype(np.float64)
    pair = onehot.T @ c @ onehot
    for _ in range(passes):
        moved = 0
        for w in range(n):
            out, into, own = c[w] @ onehot, c[:, w] @ onehot, c[w, w]
            was = label[w]
            out[was] -= own
            into[was] -= own
            pair[was] -= out
            pair[:, was] -= into
            pair[was, was] -= own
            row, col = pair.sum(axis=1), pair.sum(axis=0)
            wide, tall = _nlogn(pair[:k] + out).sum(axis=1) - _nlogn(pair[:k]).sum(axis=1), _nlogn(pair[:, :k] + into[:, None]).sum(axis=0) - _nlogn(pair[:, :k]).sum(axis=0)
            diag = np.arange(k)
            d = pair[diag, diag]
            both = _nlogn(d + out[:k] + into[:k] + own) - _nlogn(d + out[:k]) - _nlogn(d + into[:k]) + _nlogn(d)
            gain = wide + tall + both - (_nlogn(row[:k] + out.sum() + own) - _nlogn(row[:k])) - (_nlogn(col[:k] + into.sum() + own) - _nlogn(col[:k]))
            best = int(np.argmax(gain))
            if gain[best] <= gain[was] + 1e-9:
                best = was
            pair[best] += out
            pair[:, best] += into
            pair[best, best] += own
            if best != was:
                label[w], moved = best, moved + 1
                onehot[w, was], onehot[w, best] = 0, 1
        if not moved:
            break
    return label[:n]


class Model:
    """What a task needs: bounded by ``DICTIONARY`` and ``CLASSES``. ``top`` has the dictionary's words and counts,
    ``label`` their classes, ``classes`` the counts of pairs of classes, with the end's and the others' behind."""

    def __init__(self, total: int, distinct: int, top: list[tuple[bytes, int]], end_count: int, label: np.ndarray, classes: np.ndarray):
        self.total, self.distinct = total, distinct
        k = len(classes) - 2
        self.end_class, self.other_class = k, k + 1
        self.class_totals = classes.sum(axis=0)  # a class as the second of a pair: each token once
        prior = (self.class_totals + 1) / (self.class_totals.sum() + k + 2)
        self.transition = np.log10((classes + PRIOR * prior) / (classes.sum(axis=1) + PRIOR)[:, None])
        members = np.bincount(label, minlength=k)
        other_size = distinct - len(top) - (end_count > 0)
        self.other_norm = self.class_totals[k + 1] + other_size + 1
        self.number = {w: i for i, (w, _) in enumerate(top)}
        self.counts = np.array([c for _, c in top], np.int64)
        self.classes = label
        self.emission = np.log10((self.counts + 1) / (self.class_totals[label] + members[label]))
        self.base_norm = total + distinct + 1
        self.base = np.log10((self.counts + 1) / self.base_norm)
        self.end_base, self.end_known = float(np.log10((end_count + 1) / self.base_norm)), int(end_count > 0)

    def score(self, words: list[bytes]) -> tuple[int, float, float, Counter]:
        """Known tokens, base and model sums of what the dictionary tells, and the counts of all other words."""
        at = list(map(self.number.get, words))
        rest: Counter = Counter()
        if None in at:
            rest.update([w for w, i in zip(words, at, strict=True) if i is None])
        idx = np.array([-1 if i is None else i for i in at], np.int64)
        known = idx[idx >= 0]
        cls = np.full(len(idx) + 2, self.other_class, np.int64)
        cls[0] = cls[-1] = self.end_class
        cls[1:-1][idx >= 0] = self.classes[known]
        model = float(self.transition[cls[:-1], cls[1:]].sum() + self.emission[known].sum())
        return len(known) + self.end_known, float(self.base[known].sum()) + self.end_base, model, rest


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of all word counts."""
    vocab = scratch.stash(word_counts(train), "words")
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = vocab.where(F.col("word") == F.lit(END)).select("c").first()
    short = vocab.where((F.col("word") != F.lit(END)) & (F.octet_length("word") <= WORD_BYTES) & (F.col("c") >= LEAST))
    # the step of a logarithmic histogram above which at most DICTIONARY words lie: some hundred rows, no sort
    step = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    sizes = sorted(((r.step, r.n) for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    sums = itertools.accumulate(n for _, n in sizes)
    least = min((s for (s, _), n in zip(sizes, sums, strict=True) if n <= DICTIONARY), default=None)
    found = short.where(step >= least).toPandas() if least is not None else None  # DICTIONARY rows at most
    top = [] if found is None else sorted(zip(map(bytes, found.word), found.c.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    words = [w for w, _ in top]
    pairs = bigram_counts(train, {w: i for i, w in enumerate(words[:SEED])}, min(SEED, len(words)) + 2)
    label = exchange(pairs)
    k = int(label.max(initial=-1)) + 1
    if len(words) > len(label):
        onehot = np.eye(k + 2)[np.concatenate([label, [k, k + 1]])]
        near = assign(context_counts(train, words, label), onehot.T @ pairs @ onehot).toPandas()  # DICTIONARY rows at most
        label = np.concatenate([label, np.zeros(len(words) - len(label), np.int64)])
        label[near.w.to_numpy()] = near["class"].to_numpy()
    classes = bigram_counts(train, dict(zip(words, label.tolist(), strict=True)), k + 2)
    return Model(total, distinct, top, end.c if end else 0, label, classes), vocab


def score(docs: DataFrame, model: Model, vocab: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the model's parameters
    kind = "row long, doc_id long, word binary, tf long, n_tokens long, n_known long, base double, model double"

    def run(batches):
        m, name = shared.value, itertools.count(TaskContext.get().partitionId() << 36)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 200):
                out = []
                for doc_id, text in zip(ids[at : at + 200], texts[at : at + 200], strict=True):
                    words, row = tokens(text or ""), next(name)
                    known, base, total, rest = m.score(words)
                    out.append((row, doc_id, END + str(row).encode(), 0, len(words) + 1, known, base, total))
                    out += [(row, None, w, n, 0, 0, 0.0, 0.0) for w, n in rest.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)
    counts = vocab.where((F.col("word") != F.lit(END)) & ~F.col("word").isin(b""))
    joined = parts.join(counts, "word", "left")
    c, tf = F.coalesce("c", F.lit(0)), F.col("tf")
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), tf).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + tf * F.log10((c + 1) / F.lit(float(model.base_norm)))).alias("base_score"),
        F.sum(F.col("model") + tf * F.log10((c + 1) / F.lit(float(model.other_norm)))).alias("score"),
    )
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


_NAMES = ["row", "doc_id", "word", "tf", "n_tokens", "n_known", "base", "model"]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def held_out(doc_id: Column, mod: int, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % mod) == remainder


def scores(docs: DataFrame, mod: int = 7) -> DataFrame:
    """Fit on the rows that are not held out and score all."""
    fold = held_out(F.col("doc_id"), mod)
    model, vocab = fit(docs.where(fold.isNull() | ~fold).select("doc_id", "text"))
    found = score(docs, model, vocab)
    return found.select("doc_id", fold.alias("held_out"), *found.columns[1:])
