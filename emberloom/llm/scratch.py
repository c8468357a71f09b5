"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage as a checkpoint does: after the loss of an executor, later jobs read the
files again instead of recomputing. The folder is the session's ``spark.checkpoint.dir``. Only a local session, whose one
machine is all there is, may leave it unset and gets a temporary folder; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one intermediate table or set of files."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, compression: str = "snappy", plain: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the files. Columns in ``plain`` (by their paths) hardly repeat, and
    are not tried with a dictionary."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`stash` that nothing will read any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
