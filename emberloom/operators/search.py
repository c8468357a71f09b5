"""Keyword, vector and hybrid retrieval as lazy plans.

Keyword filters apply before the limit, and vector filters behind it: the vector positions are then counted anew
over the rows that pass. Ties are always broken by id.

Keyword queries are read by :mod:`emberloom.operators.fulltext`; they are looked up in the texts themselves or in an index of
segments.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberloom import config as C
from emberloom.functions import python, scores, text
from emberloom.operators import fulltext
from emberloom.operators.scratch import written


def pool_size(limit: int) -> int:
    """Rows that each retriever gives to the fusion."""
    return min(C.POOL_CAP, C.OVERSAMPLE * limit)


def bm25(docs: DataFrame, query: fulltext.Query, id_col: str = "doc_id", text_cols: tuple[str, ...] = ("text",), where: Column | None = None, words: Callable[[Column], Column] = text.tokens) -> DataFrame:
    """``id`` and ``score`` of the rows that a query wants, found in their texts.

    One scan counts words and phrases of each row without shuffling text, and leaves a narrow table; document
    frequencies and the mean length are one small aggregate of it. They count all rows; ``where`` filters candidates.
    """
    phrases = fulltext.phrases_of(query)
    names = {c: f"w{i}" for i, c in enumerate(text_cols)}
    cut = [words(F.coalesce(F.col(c), F.lit(""))).alias(w) for c, w in names.items()]
    found = docs.select(F.col(id_col).alias("id"), (F.lit(True) if where is None else where).alias("_ok"), *cut)
    n = functools.reduce(operator.add, map(F.size, names.values()))
    counts = [fulltext.occurrences(p, {c: F.col(w) for c, w in names.items()}).alias(f"tf{i}") for i, p in enumerate(phrases)]
    rows = written(found.select("id", "_ok", n.alias("n"), *counts), "counts")
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *fulltext.frequencies(rows, len(phrases)))
    return fulltext.scored(rows.where("_ok"), stats, query)


def search_index(spark: SparkSession, index: fulltext.Index, query: fulltext.Query, allowed: DataFrame | None = None) -> DataFrame:
    """``id`` and ``score`` of the rows that a query wants, from an index: only the row groups with its terms are read.
    Frequencies count all rows; ``allowed`` (``id``) filters candidates."""
    found, size = fulltext.found_in_index(spark, index, query)
    rows = written(found, "counts")
    stats = rows.agg(*size, *fulltext.frequencies(rows, len(fulltext.phrases_of(query))))
    return fulltext.scored(rows if allowed is None else rows.join(allowed.select("id"), "id", "left_semi"), stats, query)


def numbered(df: DataFrame, order: list[Column], name: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in order, with their positions from 1. Only these go to one partition."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def keyword_candidates(
    docs: DataFrame, query: str, limit: int, where: Column | None = None, id_col: str = "doc_id", text_cols: tuple[str, ...] = ("text",), stemmed: bool = False, index: fulltext.Index | None = None
) -> DataFrame:
    """``id``, ``fts_pos``: the best rows for a query; an unusable query gives none. ``stemmed`` compares stems of words
    of any script instead of runs of a-z and 0-9. ``index`` has the same words of the same columns, and is then read instead."""
    parsed = fulltext.parse(query, python.stem_word if stemmed else str, text_cols)
    if parsed is None:
        return docs.sparkSession.createDataFrame([], "id long, score double, fts_pos int")
    if index is None:
        found = bm25(docs, parsed, id_col, text_cols, where, stemmed_words if stemmed else text.tokens)
    else:
        allowed = None if where is None else docs.where(where).select(F.col(id_col).alias("id"))
        found = search_index(docs.sparkSession, index, parsed, allowed)
    return numbered(found, [F.desc("score"), F.asc("id")], "fts_pos", pool_size(limit))


def stemmed_words(column: Column) -> Column:
    """The words of a stemmed search."""
    return python.stems(text.words(column))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id``, ``cosine``, ``vec_pos`` of the ``k`` nearest unit vectors, exactly."""
    target = F.array(*(F.lit(float(x)) for x in query))
    near = vectors.select(F.col(id_col).alias("id"), scores.dot(F.col(vec_col), target).alias("cosine"))
    return numbered(near, [F.desc("cosine"), F.asc("id")], "vec_pos", k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """``query``, ``id``, ``cosine``, ``pos``: the ``k`` nearest unit vectors (``id``, ``v``) of each query (``query``, ``q``).

    A stated query set against all rows, in blocks: a task multiplies one block of queries with one block of vectors
    and keeps the ``k`` best of each query, so that no more than ``k`` rows for each query and block leave it.
    """
    n = vectors.count()
    m = queries.count()
    kv, kq = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / block_rows))
    a = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(kv)).cast("int").alias("bv")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(kq - 1))))
    b = queries.select(F.col("query").alias("id"), F.col("q").alias("v"), F.pmod(F.xxhash64("query"), F.lit(kq)).cast("int").alias("bq")).withColumn("bv", F.explode(F.sequence(F.lit(0), F.lit(kv - 1))))
    both = a.select("bv", "bq", "id", "v", F.lit(False).alias("asks")).unionByName(b.select("bv", "bq", "id", "v", F.lit(True).alias("asks")))

    def best(table: pa.Table) -> pa.Table:
        asks, ids = table["asks"].to_numpy(), table["id"].to_numpy()
        if asks.all() or not asks.any():
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        m = np.array(table["v"].to_pylist(), np.float64)
        sims, rows = m[asks] @ m[~asks].T, ids[~asks]
        some = np.lexsort((np.broadcast_to(rows, sims.shape), -sims), axis=1)[:, :k]
        q = np.repeat(ids[asks], some.shape[1])
        return pa.table({"query": q, "id": rows[some].ravel(), "cosine": np.take_along_axis(sims, some, 1).ravel()})

    found = both.groupBy("bv", "bq").applyInArrow(best, "query long, id long, cosine double")
    win = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("pos", F.row_number().over(win)).where(F.col("pos") <= k)


def vector_candidates(vectors: DataFrame, query: list[float], limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """``id``, ``vec_pos``: nearest first, then the filter, then positions over what passes."""
    near = nearest(vectors, query, pool_size(limit)).drop("vec_pos")
    if allowed is not None:
        near = near.join(allowed.select("id"), "id", "left_semi")
    return numbered(near, [F.desc("cosine"), F.asc("id")], "vec_pos", pool_size(limit))


def access_stats(events: DataFrame, id_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """``id``, ``last_accessed`` (epoch seconds) and ``access_count`` from an append-only access log."""
    at = F.unix_timestamp(F.col(ts_col).cast("timestamp"))
    return events.groupBy(F.col(id_col).alias("id")).agg(F.max(at).alias("last_accessed"), F.count("*").alias("access_count"))


def hybrid(keyword: DataFrame, vector: DataFrame, docs: DataFrame, stats: DataFrame, query: str, now: int, limit: int) -> DataFrame:
    """Fuse both candidate lists and rank: fusion, reinforcement and exact match; score, fusion, age, id.

    ``docs`` has ``id``, ``title``, ``content`` and ``indexed_at``; ``stats`` is of :func:`access_stats`. At most
    two pools of rows take part in any join.
    """
    pairs = keyword.select("id", "fts_pos").join(vector.select("id", "vec_pos"), "id", "full_outer")
    rows = docs.join(F.broadcast(pairs), "id").join(stats, "id", "left")  # two pools of POOL_CAP rows at most
    fused = scores.rrf(F.col("fts_pos"), F.col("vec_pos"))
    bonus = scores.reinforcement(F.lit(now), F.col("last_accessed"), F.col("indexed_at"), F.col("access_count"))
    scored = rows.select("id", "title", "content", "indexed_at", "fts_pos", "vec_pos", fused.alias("rrf"), (fused + bonus + scores.exact_match(query, F.col("title"), F.col("content"))).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("rrf"), F.desc("indexed_at"), F.asc("id")).limit(limit)


def hybrid_many(keyword: DataFrame, vector: DataFrame, queries: DataFrame, docs: DataFrame, stats: DataFrame, now: int, limit: int) -> DataFrame:
    """``query``, ``id``, ``pos``, ``rrf`` and ``score``: :func:`hybrid` of many queries at once.

    ``keyword`` and ``vector`` have ``query``, ``id`` and ``pos``, a pool for each query; ``queries`` has ``query`` and ``words``,
    the query's text. Texts of candidates alone are joined.
    """
    pairs = keyword.select("query", "id", F.col("pos").alias("fts_pos")).join(vector.select("query", "id", F.col("pos").alias("vec_pos")), ["query", "id"], "full_outer")
    rows = pairs.join(docs, "id").join(queries.select("query", "words"), "query").join(stats, "id", "left")
    fused = scores.rrf(F.col("fts_pos"), F.col("vec_pos"))
    bonus = scores.reinforcement(F.lit(now), F.col("last_accessed"), F.col("indexed_at"), F.col("access_count"))
    scored = rows.select("query", "id", "indexed_at", fused.alias("rrf"), (fused + bonus + scores.exact_match(F.col("words"), F.col("title"), F.col("content"))).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("rrf"), F.desc("indexed_at"), F.asc("id"))
    return scored.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= limit).select("query", "id", "pos", "rrf", "score")
