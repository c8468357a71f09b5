"""Writers: published snapshots, appended logs, Markdown of episodes, pending entries."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, table: str) -> str:
    """Write a new version beside the old ones, and then a pointer with the next number: a pointer is never changed or
    removed, so readers always find a whole version, the old one or the new one."""
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{folder}")
    point(df.sparkSession, table, {"": folder})
    return f"{table}/{folder}"


def publish_parts(df: DataFrame, table: str, part: str) -> None:
    """Write new versions of the parts of a table that ``df`` has rows of, whole, and a pointer to them and to all other
    parts as they were. ``part`` is a column of few values, which the table itself does not keep."""
    spark, folder = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(part).parquet(f"{table}/{folder}")
    target, system = _files(spark, f"{table}/{folder}")
    made = [s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()]
    point(spark, table, pointed(spark, table) | {name.split("=", 1)[1]: f"{folder}/{name}" for name in made})


def published(spark: SparkSession, table: str, parts: list[str] | None = None) -> DataFrame:
    """The version (or, of a table in parts, the version of each part or of some) that the last pointer names."""
    found = pointed(spark, table)
    if not found:
        raise FileNotFoundError(f"nothing is published under {table}")
    some = [p for k, p in found.items() if parts is None or k in parts]
    if some:
        return spark.read.parquet(*(f"{table}/{p}" for p in some))
    return spark.read.parquet(f"{table}/{next(iter(found.values()))}").limit(0)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that no pointer names."""
    target, system = _files(spark, path)
    system.delete(target, True)


def _last(spark: SparkSession, table: str) -> int:
    """Number of the last pointer; 0 before the first."""
    target, system = _files(spark, f"{table}/_pointers")
    return max((int(s.getPath().getName().split(".")[0]) for s in system.listStatus(target)), default=0) if system.exists(target) else 0


def pointed(spark: SparkSession, table: str) -> dict[str, str]:
    """The folder of each part that the last pointer names."""
    number = _last(spark, table)
    if not number:
        return {}
    target, system = _files(spark, f"{table}/_pointers/{number}.json")
    stream = system.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def point(spark: SparkSession, table: str, parts: dict[str, str]) -> None:
    """Write the next pointer under another name and rename it, so that no reader finds half of one."""
    number = _last(spark, table) + 1
    draft, system = _files(spark, f"{table}/_drafts/{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(parts).encode()))
    finally:
        stream.close()
    target, _ = _files(spark, f"{table}/_pointers/{number}.json")
    system.mkdirs(target.getParent())
    if not system.rename(draft, target):
        raise FileExistsError(f"pointer {number} of {table} is there already: another writer was first")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def episode_markdown(date: Column, session: Column, project: Column, score: Column, sections: dict[str, Column]) -> Column:
    """An episode's file: front matter with the keys that have values, then the sections that are not empty."""
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("date: "), date), F.concat(F.lit("session_id: "), session), F.concat(F.lit("project: "), project), F.concat(F.lit("value_score: "), score.cast("string")), F.lit("promoted: false"), F.lit("---"))
    parts = [F.when(F.length(F.trim(body)) > 0, F.concat(F.lit(f"## {name}\n\n"), F.trim(body))) for name, body in sections.items()]
    return F.concat(F.concat_ws("\n\n", front, *parts), F.lit("\n"))


def flush_pending(lines: DataFrame, line: str = "value") -> DataFrame:
    """Pending entries, one object or an array of them for each line: valid ones (with scope and content), and a
    count of those skipped beside them."""
    kind = "scope string, content string, project string, title string"
    struct = f"struct<{kind.replace(' string', ':string').replace(', ', ',')}>"
    many = F.from_json(F.col(line), f"array<{struct}>")
    one = F.array(F.from_json(F.col(line), struct))
    rows = lines.where(F.length(F.trim(line)) > 0).select(F.explode(F.when(F.trim(line).startswith("["), F.coalesce(many, F.array(F.lit(None).cast(struct)))).otherwise(one)).alias("e"))
    return rows.select("e.*", (F.col("e.scope").isin("agent", "project") & (F.length(F.trim("e.content")) > 0)).alias("ok")).withColumn("ok", F.coalesce("ok", F.lit(False)))


def clear_owned(df: DataFrame, column: str, fields: list[str], lists: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The nested fields of one owner removed, and of each of ``lists`` the items that are the owner's."""
    out = F.col(column).dropFields(*fields) if fields else F.col(column)
    for name, owned in (lists or {}).items():
        out = out.withField(name, F.filter(F.col(column)[name], _not(owned)))
    return df.withColumn(column, out)


def _not(owned: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: ~F.coalesce(owned(x), F.lit(False))


def append_samples(df: DataFrame, path: str) -> None:
    """A sampler's log: one JSON line for each sample, in folders by day of ``ts``, so that a reader of the last hours
    lists only those."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)
