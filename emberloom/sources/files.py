"""Readers: Markdown trees, episodes, topic indexes, transcripts, JSON lines, process tables, log exports.

Each is lazy and reads through Spark, so any file system that Spark reaches will do. A folder that isn't there
gives no rows where the reader says so.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberloom import config as C
from emberloom.functions import text

FILES = "path string, modified long, length long, content string"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def small_text(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of one small file. Spark's readers skip names that start with _, as an index's does."""
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        lines = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
    return spark.createDataFrame([(x,) for x in lines], "value string")


def markdown(spark: SparkSession, root: str, exclude: str | None = None, recursive: bool = True) -> DataFrame:
    """Files ending in .md below ``root`` with their text; those over the size limit, and those whose own name
    matches ``exclude``, are dropped before their content is read. No folder, no rows."""
    if not exists(spark, root):
        return spark.createDataFrame([], FILES)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).load(root)
    found = found.where(F.col("length") <= C.MAX_FILE_BYTES)
    if exclude:
        found = found.where(~F.substring_index("path", "/", -1).rlike(exclude))
    return found.select("path", F.unix_timestamp("modificationTime").alias("modified"), "length", F.decode("content", "utf-8").alias("content"))


def candidates(spark: SparkSession, memory: str, watched: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """All files that an index run looks at: each root with its exclusions, and the documentation files of watched
    projects, (folder, project), as far as they are there."""
    parts = [
        markdown(spark, f"{memory}/context"),
        markdown(spark, f"{memory}/projects"),
        markdown(spark, f"{memory}/agent", "^_legacy"),
        markdown(spark, f"{memory}/episodes", "^_"),
    ]
    extra = [f"{folder.rstrip('/')}/{name}" for folder, _ in watched for name in C.PROJECT_FILES]
    parts += [markdown(spark, p) for p in extra if exists(spark, p)]
    return functools.reduce(DataFrame.unionByName, parts).dropDuplicates(["path"])


def episodes(files: DataFrame) -> DataFrame:
    """Episode rows of Markdown files with front matter; files without it are skipped."""
    front = text.front_matter(F.col("content"))
    rows = files.select("path", front.alias("f")).where("f.block is not null")

    def get(name: str) -> Column:
        return text.front_matter_field(F.col("f.block"), name)

    turns = F.when(get("turns").rlike(r"^\d{1,9}$"), get("turns").cast("int"))
    return rows.select(
        text.entry_date(get("date"), F.col("path")).alias("date"), get("session_id").alias("session_id"), get("project").alias("project"), turns.alias("turns"),
        F.coalesce(F.lower(get("promoted")) == "true", F.lit(False)).alias("promoted"), text.value_score(get("value_score")).alias("value_score"), text.summary_of(F.col("f.body")).alias("summary"), "path",
    )


#: A line of the topic index. Fixed format.
_TOPIC = r"^-\s+\*\*([^*]+)\*\*\s+—\s+keywords:\s+([^—]+)—\s+file:\s+(\S+)"


def topic_index(lines: DataFrame, line: str = "value") -> DataFrame:
    """``name``, ``keywords``, ``file`` of index lines ``- **name** — keywords: a, b — file: name.md``; other lines
    are skipped."""
    found = lines.where(F.col(line).rlike(_TOPIC))
    get = lambda i: F.trim(F.regexp_extract(line, _TOPIC, i))
    words = F.filter(F.transform(F.split(get(2), ","), lambda x: F.trim(x)), lambda x: x != "")
    return found.select(get(1).alias("name"), words.alias("keywords"), get(3).alias("file"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sample_guard(samples: DataFrame) -> DataFrame:
    """Samples that have both their totals and the system's part."""
    return samples.where(F.col("totals").isNotNull() & F.col("sys").isNotNull())


def transcript(lines: DataFrame, line: str = "value") -> DataFrame:
    """``role`` and ``text`` of transcript lines, by the entry's type. A message's content is a string or a list of
    blocks, of which the text blocks count, each trimmed. Only turns of the user and the assistant with some text stay."""
    v = F.try_parse_json(F.col(line))
    role = F.try_variant_get(v, "$.type", "string")
    told = lambda x: F.when(F.schema_of_variant(x) != "VOID", x)
    whole = F.coalesce(told(F.try_variant_get(v, "$.message.content", "variant")), told(F.try_variant_get(v, "$.content", "variant")))
    plain = F.when(F.schema_of_variant(whole) == "STRING", F.try_variant_get(whole, "$", "string"))
    bare = lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")
    parts = F.from_json(F.to_json(whole), "array<struct<type:string,text:string>>")
    blocks = F.transform(F.filter(parts, lambda b: b["type"] == "text"), lambda b: bare(F.coalesce(b["text"], F.lit(""))))
    rows = lines.select(role.alias("role"), F.coalesce(bare(plain), F.array_join(F.filter(blocks, lambda x: x != ""), "\n")).alias("text"))
    return rows.where(F.col("role").isin("user", "assistant") & (F.length("text") > 0))


def process_table(lines: DataFrame, line: str = "value") -> DataFrame:
    """pid, ppid, rss, cpu and elapsed time of a process listing, and the rest of the line as the command."""
    pattern = r"^\s*(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)\s+(\S+)\s+(.*?)\s*$"
    found = lines.where(F.col(line).rlike(pattern))
    get = lambda i: F.regexp_extract(line, pattern, i)
    return found.select(get(1).cast("long").alias("pid"), get(2).cast("long").alias("ppid"), get(3).cast("long").alias("rss_kib"), get(4).cast("double").alias("pcpu"), get(5).alias("etime"), get(6).alias("command"))


def counters(report: Column, names: dict[str, str]) -> Column:
    """A struct of named whole numbers of a ``name: value`` report; a missing counter is null."""
    return F.struct(*(F.try_to_number(F.nullif(F.regexp_extract(report, rf"(?im)^[^:\n]*{label}[^:\n]*:\s*(\d+)", 1), F.lit("")), F.lit("9" * 18)).cast("long").alias(name) for name, label in names.items()))


#: Counters of the memory report by our names. "Compressions" must not match "Decompressions". Fixed values.
MEMORY_COUNTERS = {
    "pages_free": "Pages free", "pages_active": "Pages active", "pages_inactive": "Pages inactive", "pages_speculative": "Pages speculative",
    "pages_wired": "Pages wired down", "pages_purgeable": "Pages purgeable", "pages_occupied_by_compressor": "Pages occupied by compressor",
    "pages_stored_in_compressor": "Pages stored in compressor", "c_pageins": "Pageins", "c_pageouts": "Pageouts", "c_swapins": "Swapins",
    "c_swapouts": "Swapouts", "c_compressions": r"\bCompressions", "c_decompressions": "Decompressions",
}
PAGE_SIZE = 16384


def memory_report(report: Column) -> Column:
    """Page size (16,384 where it is not told) and page counts of a memory report."""
    size = F.coalesce(F.nullif(F.regexp_extract(report, r"page size of (\d+) bytes", 1), F.lit("")).cast("long"), F.lit(PAGE_SIZE).cast("long"))
    counts = counters(report, MEMORY_COUNTERS)
    return F.struct(size.alias("page_size"), *(counts[name].alias(name) for name in MEMORY_COUNTERS))


def _numbers(report: Column, pattern: str, names: list[str]) -> Column:
    get = lambda i: F.nullif(F.regexp_extract(report, pattern, i), F.lit("")).try_cast("double")
    return F.struct(*(get(i).alias(name) for i, name in enumerate(names, 1)))


def swap_usage(report: Column) -> Column:
    """Megabytes of swap in total, used and free; null where the report has another form."""
    return _numbers(report, r"total\s*=\s*([\d.]+)M\s+used\s*=\s*([\d.]+)M\s+free\s*=\s*([\d.]+)M", ["swap_total_mb", "swap_used_mb", "swap_free_mb"])


def load_average(report: Column) -> Column:
    """The load over one, five and fifteen minutes; null where the report has another form."""
    return _numbers(report, r"([\d.]+)\s+([\d.]+)\s+([\d.]+)", ["load1", "load5", "load15"])


def memory_size(report: Column) -> Column:
    """Bytes of memory, or null."""
    return F.trim(F.regexp_replace(report, r"\s+", " ")).try_cast("double").cast("long")


def log_export(spark: SparkSession, path: str, variants: dict[str, list[str]]) -> DataFrame:
    """A delimited export with a header, each column under the first of its variant names that is there."""
    raw = spark.read.option("header", True).csv(path)
    known = {c.strip().lower(): c for c in raw.columns}

    def column(name: str, options: list[str]) -> Column:
        there = [F.col(f"`{known[o.lower()]}`") for o in (name, *options) if o.lower() in known]
        return (F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name)

    return raw.select(*(column(n, o) for n, o in variants.items()))


def _uri_path(spark: SparkSession, root: str) -> str:
    """A folder as the paths of its files begin."""
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def recent_files(spark: SparkSession, root: str, after: str) -> DataFrame:
    """Files changed after a time, with the first path segment as their project."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, project string, modified long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("modifiedAfter", after).load(root)
    below = F.expr("path").substr(F.lit(len(_uri_path(spark, root)) + 2), F.length("path"))
    return found.select("path", F.split_part(below, F.lit("/"), F.lit(1)).alias("project"), F.unix_timestamp("modificationTime").alias("modified"))


def topic_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """One topic's text, or None; names are letters, digits, _ and - only."""
    import re

    if not re.fullmatch(r"[A-Za-z0-9_-]+", name) or not exists(spark, f"{folder}/{name}.md"):
        return None
    return markdown(spark, f"{folder}/{name}.md").first().content


def project_config(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(folder, project) of the watched projects that a JSON file lists; no file, or none that can be read, is an
    empty list, and entries without both fields are skipped."""
    if not exists(spark, path):
        return []
    kind = "struct<path:string,slug:string>"
    whole = small_text(spark, path).agg(F.array_join(F.collect_list("value"), "\n").alias("t"))  # one small file
    listed = F.when(F.ltrim("t").startswith("["), F.from_json("t", f"array<{kind}>")).otherwise(F.from_json("t", f"struct<projects:array<{kind}>>")["projects"])
    rows = whole.select(F.explode(listed).alias("p")).where("p.path is not null and p.slug is not null")
    return [(r.path, r.slug) for r in rows.select("p.*").collect()]
