"""Event logs: counts in one pass, repeated patterns, rules, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom import config as C
from emberloom.functions import text


def window(events: DataFrame, ts: str, cutoff: str, rule: str | None = None) -> DataFrame:
    """Entries from the cutoff on, of one rule if it is given."""
    found = events.where(F.col(ts) >= cutoff)
    return found if rule is None else found.where(F.col("rule") == rule)


def counts(events: DataFrame, dims: list[str], missing: dict[str, str] | None = None) -> DataFrame:
    """``dimension``, ``value``, ``n`` for each dimension and in total, by grouping sets over one scan. ``missing``
    names what stands for null: none for a rule, unknown for any other dimension."""
    missing = missing or {"rule": "none"}
    named = events.select(*(F.coalesce(F.col(d), F.lit(missing.get(d, "unknown"))).alias(d) for d in dims))
    sets = [[F.col(d)] for d in dims] + [[]]
    found = named.groupingSets(sets, *dims).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    width = len(dims)
    which, value = F.lit("total"), F.lit("all")
    for i, d in enumerate(dims):
        own = F.col("g") == ((1 << width) - 1) ^ (1 << (width - 1 - i))
        which, value = F.when(own, d).otherwise(which), F.when(own, F.col(d)).otherwise(value)
    return found.select(which.alias("dimension"), value.alias("value"), "n")


def repeats(events: DataFrame, least: int = 2, blocked: str = "BLOCKED") -> DataFrame:
    """Blocked commands that recur under one rule but for ids and spaces: count, first and last time, and the first
    of them as example; the most frequent come first."""
    found = events.where(F.col("decision") == blocked).withColumn("pattern", text.normal_command(F.col("command")))
    found = found.groupBy("rule", "pattern").agg(F.count("*").alias("n"), F.min_by("command", F.struct("ts", "event_id")).alias("example"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.where(F.col("n") >= least).orderBy(F.desc("n"), "rule", "pattern")


def thresholds(events: DataFrame, slow_ms: int = 200, least: int = 3) -> DataFrame:
    """Findings of a guard log by rule and kind: ``slow`` decisions, and rules that ``block`` often."""
    slow = F.sum((F.col("duration_ms") > slow_ms).cast("long"))
    blocks = F.sum((F.col("decision") == "BLOCKED").cast("long"))
    rows = events.groupBy(F.coalesce("rule", F.lit("none")).alias("rule")).agg(slow.alias("slow"), F.max("duration_ms").alias("most_ms"), blocks.alias("blocks"))
    kinds = F.array_compact(F.array(F.when(F.col("slow") > 0, "slow"), F.when(F.col("blocks") >= least, "frequent block")))
    return rows.select("rule", "slow", "most_ms", "blocks", F.explode(kinds).alias("finding"))


def decide(command: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct (decision, rule) of the first rule (pattern, decision, name) that matches; else allow."""
    chain = None
    for pattern, decision, name in rules:
        hit, out = command.rlike(pattern), F.struct(F.lit(decision).alias("decision"), F.lit(name).alias("rule"))
        chain = F.when(hit, out) if chain is None else chain.when(hit, out)
    allowed = F.struct(F.lit("allow").alias("decision"), F.lit(None).cast("string").alias("rule"))
    return allowed if chain is None else chain.otherwise(allowed)


def keep_recent_turns(turns: DataFrame, key: str, order: str, role: str = "role", body: str = "text", budget: int = C.TURN_BUDGET_CHARS) -> DataFrame:
    """``line``: the latest turns of each conversation as text for a reader, within a budget of characters.

    A line is the role in capitals, the text and a blank line, all of which count; a longer line than the budget is
    cut and marked. The latest turn is always there.
    """
    whole = F.concat(F.upper(role), F.lit(": "), F.coalesce(F.col(body), F.lit("")), F.lit("\n\n"))
    line = F.when(F.length(whole) > budget, F.concat(F.left(whole, F.lit(budget)), F.lit("[truncated]\n\n"))).otherwise(whole)
    win = Window.partitionBy(key).orderBy(F.desc(order))
    marked = turns.withColumn("line", line).withColumn("_size", F.sum(F.length("line")).over(win.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(win))
    return marked.where((F.col("_size") <= budget) | (F.col("_rn") == 1)).drop("_size", "_rn")


def distinct_counts(rows: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Per key how many different values each column of ``names`` has, under the name given there."""
    return rows.groupBy(key).agg(*(F.count_distinct(F.col(c)).alias(n) for c, n in names.items()))


def enough_turns(turns: DataFrame, key: str, least: int = C.MIN_TURNS) -> DataFrame:
    """Conversations with enough turns for an observation."""
    return turns.groupBy(key).agg(F.count("*").alias("turns")).where(F.col("turns") >= least)


#: What the observer says when there is nothing to say. A fixed value.
NO_SIGNAL = "No significant decisions made."


def has_signal(o: Column) -> Column:
    """Whether an observation (see :func:`reports.observation`) holds anything worth an episode."""
    lists = F.size(o["decisions"]) + F.size(o["corrections"]) + F.size(o["discoveries"]) + F.size(o["files_of_note"])
    told = (F.length(o["summary"]) > 0) & (o["summary"] != NO_SIGNAL)
    return F.coalesce((lists > 0) | told, F.lit(False))


#: A dated heading: the date alone, or the date, a dash and a title.
_HEAD = r"##[^\S\n]+(\d{4}-\d{2}-\d{2})(?:[^\S\n]+—[^\S\n]+([^\n]+?))?[^\S\n]*"


def entries(files: DataFrame, path: str = "path", body: str = "content") -> DataFrame:
    """Dated entries of Markdown: a block runs from a heading ``## date`` or ``## date — title`` to the next one, and
    other headings belong to the block. Path, date, title, body, hash of the block, and its place in the file."""
    plain = F.concat(F.lit("\n"), F.regexp_replace(F.col(body), "\r\n", "\n"))
    blocks = F.split(plain, rf"(?=\n{_HEAD}(?:\n|\z))")
    rows = files.select(F.col(path).alias("path"), F.posexplode(blocks).alias("place", "raw")).where(F.col("raw").rlike(rf"\A\n{_HEAD}(?:\n|\z)"))
    cut = rows.select("path", "place", F.regexp_replace("raw", r"\A\s+|\s+\z", "").alias("raw"))
    first = F.split_part("raw", F.lit("\n"), F.lit(1))
    rest = F.regexp_replace(F.substr("raw", F.length(first) + 1), r"\A\s+|\s+\z", "")
    title = F.nullif(F.trim(F.regexp_extract(first, rf"\A{_HEAD}\z", 2)), F.lit(""))
    return cut.select("path", F.regexp_extract(first, rf"\A{_HEAD}\z", 1).alias("date"), title.alias("title"), rest.alias("body"), F.sha2("raw", 256).alias("hash"), "place")


def sessionize(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """``session`` numbers from 1 in each key; a longer silence starts the next."""
    win = Window.partitionBy(key).orderBy(ts, "event_id")
    new = F.when(F.coalesce(F.col(ts) - F.lag(ts).over(win) > gap_seconds, F.lit(True)), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(win)).drop("_new")
