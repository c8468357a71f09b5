"""Document ingest: classify paths, compare with the last snapshot, upsert and remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberloom import config as C
from emberloom.functions import text


def classify(path: Column, root: str = "", watched: tuple[tuple[str, str], ...] = ()) -> Column:
    """A struct (source_type, topic, project) of a path below the memory ``root``, or null where it is not indexed.

    The archive below the root is refused first, then the topic index. Project files count by their names, at any
    depth below the project's folder. ``watched`` names other projects by (folder, project) for the documentation
    files at the top of their folder.
    """
    none = F.lit(None).cast("string")

    def kind(name: str, topic: Column = none, project: Column = none) -> Column:
        return F.struct(F.lit(name).alias("source_type"), topic.alias("topic"), project.alias("project"))

    base = root.rstrip("/") + "/" if root else ""
    below = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1)))
    stem, slug = F.regexp_extract(below, r"([^/]+)\.md$", 1), F.regexp_extract(below, r"^projects/([^/]+)/", 1)
    chain = F.when(path.isNull() | below.startswith("archive/") | (below == "context/_index.md"), F.lit(None))
    chain = chain.when(below == "agent/CLAUDE.md", kind("agent"))
    chain = chain.when(below == "agent/learnings.md", kind("learning"))
    chain = chain.when(below.rlike(r"^context/.*\.md$"), kind("context", stem))
    for name, source_type in C.OWN_FILES.items():
        chain = chain.when(below.rlike(rf"^projects/[^/]+/(?:.*/)?{name}\.md$"), kind(source_type, project=slug))
    chain = chain.when(below.startswith("projects/"), F.lit(None))
    chain = chain.when(below.rlike(r"^episodes/.*\.md$"), kind("episode"))
    for folder, project in watched:
        for name, source_type in C.PROJECT_FILES.items():
            chain = chain.when(path == f"{folder.rstrip('/')}/{name}", kind(source_type, project=F.lit(project)))
    return chain.otherwise(F.lit(None))


def effective_project(kind: Column, block: Column) -> Column:
    """An episode's project is its front matter's (empty is null), any other row's is the path's."""
    return F.when(kind["source_type"] == "episode", text.front_matter_field(block, "project")).otherwise(kind["project"])


def parse_files(files: DataFrame, indexed_at: int, root: str = "", watched: tuple = ()) -> DataFrame:
    """Observations of files (``path``, ``content`` text, ``modified`` epoch seconds, ``length``): classified,
    within the size limit, with title, hash of the body, and front matter."""
    kept = files.where(F.col("length") <= C.MAX_FILE_BYTES).withColumn("kind", classify(F.col("path"), root, watched)).where("kind is not null")
    parts = kept.withColumn("front", text.front_matter(F.col("content")))
    return parts.select(
        F.col("kind.source_type").alias("source_type"),
        F.col("path").alias("source_path"),
        effective_project(F.col("kind"), F.col("front.block")).alias("project"),
        F.col("kind.topic").alias("topic"),
        text.title_of(F.col("front.body"), F.col("path")).alias("title"),
        F.col("front.body").alias("content"),
        F.sha2(F.col("front.body"), 256).alias("content_hash"),
        F.col("modified").alias("file_mtime"),
        F.lit(indexed_at).cast("long").alias("indexed_at"),
        F.col("front.block").alias("frontmatter"),
    )


def compare(old: DataFrame, new: DataFrame, key: str = "source_path", digest: str = "content_hash") -> DataFrame:
    """``key`` and ``status`` of every row of both snapshots: added, changed, unchanged or removed."""
    a = old.select(F.col(key).alias("_k"), F.col(digest).alias("_old"), F.lit(True).alias("_had"))
    b = new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_has"))
    both = b.join(a, b[key] == a["_k"], "full_outer")
    status = F.when(F.col("_had").isNull(), "added").when(F.col("_has").isNull(), "removed")
    status = status.when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select(F.coalesce(key, "_k").alias(key), status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str = "source_path", digest: str = "content_hash", keep: list[str] = ()) -> DataFrame:
    """The next snapshot: new rows replace old ones of another hash, equal ones stay as they were, and rows that
    are gone are removed. A changed row keeps the columns ``keep`` (its id) of the row that it replaces; they are
    null in a row that was not there before."""
    was = old.select(F.col(key), F.col(digest).alias("_was"), F.struct(*old.columns).alias("_old"))
    both = new.select(F.col(key), F.col(digest).alias("_now"), F.struct(*new.columns).alias("_new")).join(was, key, "left")
    same = F.col("_was").eqNullSafe(F.col("_now")) & F.col("_old").isNotNull()

    def pick(c: str) -> Column:
        fresh = F.lit(None) if c not in new.columns else F.col("_new")[c]
        return F.when(same | (F.lit(c in keep) & F.col("_old").isNotNull()), F.col("_old")[c]).otherwise(fresh).alias(c)

    return both.select(*(pick(c) for c in old.columns))


def replace_vectors(vectors: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Vectors with those of re-embedded rows put in their place: the old one of a row always goes."""
    return vectors.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*vectors.columns))


def rebuild_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``cleared`` and ``reembedded``: how many vectors a rebuild removed and made."""
    return before.agg(F.count("*").alias("cleared")).crossJoin(after.agg(F.count("*").alias("reembedded")))  # a row each


def counters(status: DataFrame) -> DataFrame:
    """``status`` and ``n``, and a total."""
    return status.rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def remove(rows: DataFrame, gone: DataFrame, key: str = "source_path") -> DataFrame:
    """The rows without those of ``gone``."""
    return rows.join(gone.select(key), key, "left_anti")
