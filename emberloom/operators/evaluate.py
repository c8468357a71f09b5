"""Retrieval quality: recall at k, reciprocal rank, and their means over queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query``, ``recall`` and ``rr``. ``ranked`` has ``query``, ``id``, ``pos``; ``relevant`` has ``query``, ``id``.
    A query without relevant rows, or without hits, counts 0."""
    wanted = relevant.select("query", "id").distinct()
    hits = wanted.join(ranked.select("query", "id", "pos"), ["query", "id"], "left")
    scored = hits.groupBy("query").agg(F.count_distinct("id").alias("n"), F.count_distinct(F.when(F.col("pos") <= k, F.col("id"))).alias("found"), F.min("pos").alias("first"))
    queries = ranked.select("query").union(relevant.select("query")).distinct()
    return queries.join(scored, "query", "left").select("query", F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))


def per_query_counts(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """The same from flags: ``ranked`` has ``query``, ``pos`` and ``rel``, ``totals`` the number ``n`` of relevant rows
    of every ``query``, so that relevant rows need not be listed."""
    hits = ranked.where("rel").groupBy("query").agg(F.sum((F.col("pos") <= k).cast("long")).alias("found"), F.min("pos").alias("first"))
    rows = totals.join(hits, "query", "left")
    recall = F.when(F.col("n") > 0, F.col("found") / F.col("n"))
    return rows.select("query", F.coalesce(recall, F.lit(0.0)).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))


def means(scored: DataFrame) -> DataFrame:
    """One row: ``queries``, ``recall`` and ``mrr``; no queries give zeros."""
    return scored.agg(F.count("*").alias("queries"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"))
