"""Duplicate flags: inserted once for each pair, located again, and resolved by events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_path", "entry_hash", "match_path", "match_hash"]


def from_pairs(pairs: DataFrame, kind: str, detected_by: str, at: int) -> DataFrame:
    """Flag rows of canonical pairs of structs (path, date, hash) with a ``similarity``."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    rows = pairs.select(a.alias("a"), b.alias("b"), "similarity")
    return rows.select(
        F.col("a.path").alias("source_path"), F.col("a.date").alias("entry_date"), F.col("a.hash").alias("entry_hash"),
        F.col("b.path").alias("match_path"), F.col("b.date").alias("match_date"), F.col("b.hash").alias("match_hash"),
        "similarity", F.lit(kind).alias("kind"), F.lit(detected_by).alias("detected_by"), F.lit("pending").alias("status"), F.lit(at).cast("long").alias("detected_at"),
    )


def insert_or_ignore(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fresh flags whose four-column key is not known, once each."""
    return fresh.join(known.select(*KEY), KEY, "left_anti").dropDuplicates(KEY)


def relocate(flags: DataFrame, entries: DataFrame) -> DataFrame:
    """Pending flags with both entries where they are now; a flag of which one side is gone is stale and drops."""
    side = [entries.select(F.col("path").alias(f"{p}_path"), F.col("date").alias(f"{p}_date"), F.col("hash").alias(f"{p}_hash"), F.col("place").alias(f"{p}_place")) for p in ("entry", "match")]
    first = side[0].withColumnRenamed("entry_path", "source_path")
    pending = flags.where("status = 'pending'")
    return pending.join(first, ["source_path", "entry_date", "entry_hash"]).join(side[1], ["match_path", "match_date", "match_hash"])


def latest_status(events: DataFrame, key: str = "flag_id") -> DataFrame:
    """``key``, ``status`` of the last event of each flag; later rows of the same time win by event id."""
    last = F.max_by("status", F.struct("at", "event_id"))
    return events.groupBy(key).agg(last.alias("status"))


def status_changes(events: DataFrame, key: str = "flag_id") -> DataFrame:
    """The events whose status differs from the one before it."""
    win = Window.partitionBy(key).orderBy("at", "event_id")
    return events.withColumn("was", F.lag("status").over(win)).where("was is null or was <> status")
