"""Tables written between the rounds of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under ``spark.checkpoint.dir``. A local session may leave that unset and gets a temporary
    folder; on a cluster it has to be a folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as files under :func:`new_path`, read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing will read any more."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(df._written_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
