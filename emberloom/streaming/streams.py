"""Structured Streaming: incremental index, queue delivery, windows, look-back deduplication, run detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberloom import config as C
from emberloom.operators import fulltext, ingest
from emberloom.sources import sinks

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_changes(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """New and changed Markdown files. Deletions do not show in a file stream: :func:`reconcile` finds them."""
    found = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return found.select("path", F.unix_timestamp("modificationTime").alias("modified"), "length", F.decode("content", "utf-8").alias("content"))


def index_stream(changes: DataFrame, table: str, checkpoint: str, now: Callable[[], int], root: str = "", parts: int = 64):
    """Upsert each batch of changed files into the published table, and run until the input is used up. The table is kept
    in parts by hash of the path, of which a batch rewrites only those that it touches."""

    def upsert(batch: DataFrame, _: int) -> None:
        spark, part = batch.sparkSession, F.pmod(F.xxhash64("source_path"), F.lit(parts)).cast("string")
        fresh = ingest.parse_files(batch, now(), root)
        latest = fresh.groupBy("source_path").agg(F.max_by(F.struct(*fresh.columns), "file_mtime").alias("r")).select("r.*").persist()
        touched = [r.p for r in latest.select(part.alias("p")).distinct().collect()]  # parts at most
        try:
            old = sinks.published(spark, table, touched)
        except FileNotFoundError:  # the first batch
            old = latest.limit(0)
        stay = old.join(latest.select("source_path"), "source_path", "left_anti")
        same = old.join(latest.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_semi")
        new = latest.join(old.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_anti")
        whole = stay.unionByName(same.select(*stay.columns)).unionByName(new)
        if touched:
            sinks.publish_parts(whole.withColumn("_part", part), table, "_part")
        latest.unpersist()

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_index_stream(changes: DataFrame, index: fulltext.Index, checkpoint: str):
    """Keep a full-text index up to date: each batch of changes (``id``, ``at``, ``gone`` and the index's columns) adds one
    segment, with the last change of each id, and hides what it replaces or deletes. A batch that is run again after a
    failure comes to the same."""

    def change(batch: DataFrame, _: int) -> None:
        fields = F.struct("gone", *index.columns)
        last = batch.groupBy("id").agg(F.max_by(fields, "at").alias("r")).select("id", "r.*").persist()
        if not last.isEmpty():
            fulltext.apply_changes(batch.sparkSession, index, last.where(~F.col("gone")), deleted=last.where("gone"))
        last.unpersist()

    return changes.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile(table_rows: DataFrame, files: DataFrame) -> DataFrame:
    """The backstop: indexed rows of which the file is gone drop."""
    return table_rows.join(files.select(F.col("path").alias("source_path")), "source_path", "left_semi")


def deliver_queue(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str):
    """Hand over each queued line once: the checkpoint holds what was consumed."""
    queue = spark.readStream.schema(schema).json(folder)
    return queue.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_in_lookback(stream: DataFrame, keys: list[str], ts: str, days: int = 2) -> DataFrame:
    """Runs whose look-back windows overlap see a key once within the watermark."""
    return stream.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key; rows later than ``late`` drop (an extension)."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


def onset_stream(samples: DataFrame, run: int = C.ONSET_RUN) -> DataFrame:
    """Per host the first ``run`` growing counters in a row and the least load in them, as samples arrive.

    ``samples`` has host, ts, counter, load; within a batch a host's rows are put in order by ts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, low, done = state.get if state.exists else (None, 0, 0.0, False)
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            grown = last is not None and row.counter > last
            low = (min(low, row.load) if n else row.load) if grown else 0.0
            n, last = n + 1 if grown else 0, row.counter
            if n == run and not done:
                done = True
                out.append((key[0], row.ts, low))
        state.update((last, n, float(low), done))
        yield pd.DataFrame(out, columns=["host", "ts", "onset"])

    return samples.groupBy("host").applyInPandasWithState(step, "host string, ts timestamp, onset double", "last double, n int, low double, done boolean", "append", GroupStateTimeout.NoTimeout)
