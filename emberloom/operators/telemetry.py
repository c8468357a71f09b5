"""Telemetry over ordered samples: deltas, runs, regressions, per-server cost, process trees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom import config as C
from emberloom.functions import text
from emberloom.operators.scratch import dropped, written


def deltas(samples: DataFrame, key: str, order: list[str], counter: str) -> DataFrame:
    """``delta`` of a counter from the sample before; the first, and resets, are as they come."""
    win = Window.partitionBy(key).orderBy(*order)
    return samples.withColumn("delta", F.coalesce(F.col(counter) - F.lag(counter).over(win), F.lit(0)))


def onset_runs(samples: DataFrame, key: str, order: list[str], counter: str, load: str, run: int = C.ONSET_RUN) -> DataFrame:
    """Per key the first stretch of ``run`` growing samples: when it is reached, and the least load in it."""
    win = Window.partitionBy(key).orderBy(*order)
    grown = deltas(samples, key, order, counter).withColumn("_up", (F.col("delta") > 0).cast("int"))
    named = grown.withColumn("_run", F.sum(1 - F.col("_up")).over(win)).where("_up = 1")
    inside = Window.partitionBy(key, "_run").orderBy(*order)
    counted = named.withColumn("_n", F.row_number().over(inside)).withColumn("_low", F.min(load).over(inside)).where(F.col("_n") == run)
    at = F.struct(*order)
    return counted.groupBy(key).agg(F.min_by("_low", at).alias("onset"), F.min(order[0]).alias("reached"))


def regression(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares by group: slope, intercept, r2, n. No spread in x: slope 0, intercept the mean; none in y:
    r2 is 0."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    flat = F.var_pop(x) == 0
    r2 = F.when(flat | (F.var_pop(y) == 0), 0.0).otherwise(F.regr_r2(y, x))
    return known.groupBy(*keys).agg(
        F.when(flat, 0.0).otherwise(F.regr_slope(y, x)).alias("slope"),
        F.when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x)).alias("intercept"),
        r2.alias("r2"),
        F.count("*").alias("n"),
    )


def last_samples(samples: DataFrame, order: list[str], n: int = C.WINDOW_SAMPLES) -> DataFrame:
    """The last ``n`` samples in order."""
    return samples.orderBy(*(F.desc(c) for c in order)).limit(n)


def server_cost(samples: DataFrame, window: int = C.WINDOW_SAMPLES) -> DataFrame:
    """``server``, ``mean``, ``stdev`` (population), ``n``: over every entry of the last samples, of the servers that
    are in the latest one; the largest comes first. ``samples`` has ``sample`` (ordered), ``server``, ``rss``, a row
    for each server of each session."""
    known = samples.select("sample").distinct().orderBy(F.desc("sample")).limit(window)
    recent = samples.join(F.broadcast(known), "sample")  # window rows at most
    latest = F.broadcast(known.agg(F.max("sample").alias("sample")))  # one row
    live = recent.join(latest, "sample", "left_semi").select("server").distinct()
    found = recent.join(live, "server", "left_semi").groupBy("server").agg(F.avg("rss").alias("mean"), F.stddev_pop("rss").alias("stdev"), F.count("*").alias("n"))
    return found.orderBy(F.desc("mean"), "server")


def biggest_lever(samples: DataFrame) -> DataFrame:
    """The server with the highest mean size (over all its entries) times mean concurrency (entries in a sample, over
    the samples in which it is)."""
    per = samples.groupBy("sample", "server").agg(F.sum("rss").alias("rss"), F.count("*").alias("copies"))
    both = per.groupBy("server").agg((F.sum("rss") / F.sum("copies")).alias("mean_rss"), F.avg("copies").alias("concurrency"))
    return both.withColumn("lever", F.col("mean_rss") * F.col("concurrency")).orderBy(F.desc("lever"), "server").limit(1)


def most_sessions(samples: DataFrame) -> DataFrame:
    """The most sessions of any sample (``sessions``), 0 where there is none."""
    return samples.agg(F.greatest(F.coalesce(F.max("sessions"), F.lit(0)), F.lit(0)).alias("most"))


def memory_of(sample: Column) -> Column:
    """Bytes that are free, available and compressed, from a sample's page counts; missing counts are zero."""
    count = lambda name: F.coalesce(sample[name], F.lit(0))
    size = sample["page_size"]
    available = sum((count(f"pages_{n}") for n in ("inactive", "speculative", "purgeable")), count("pages_free"))
    return F.struct((count("pages_free") * size).alias("free_bytes"), (available * size).alias("available_bytes"), (count("pages_occupied_by_compressor") * size).alias("compressor_bytes"))


@dataclass(frozen=True)
class ProcessRules:
    """Patterns that tell processes apart by their command lines. ``program`` starts an interactive session,
    ``versions`` with the flags of a resumed session a forked one; ``helpers`` belong to no session; ``own`` is the
    sampler itself. ``known`` servers are (part of the command, name). The defaults are fixed values."""

    program: str = r"/\.local/bin/agent(\s|$)"
    versions: str = r"/versions/[\d.]+"
    helpers: str = r" daemon run|--bg-pty-host|--bg-spare"
    own: str = r"resource-sampler\.js"
    known: tuple[tuple[str, str], ...] = ()
    prefix: str = ""


def process_kinds(processes: DataFrame, rules: ProcessRules = ProcessRules()) -> DataFrame:  # noqa: B008
    """``kind`` (interactive, forked, infra, self, server or other), ``is_root`` and ``server`` (its name) of each
    process by its ``command``."""
    c = F.col("command")
    forked = c.rlike(rules.versions) & c.rlike("--session-id") & c.rlike("--resume|--fork-session") & ~c.rlike("--bg-pty-host")
    server = c.rlike(r"(?i)mcp") | c.contains("@modelcontextprotocol/")
    for mark, _ in rules.known:
        server = server | c.contains(mark)
    kind = F.when(c.rlike(rules.own), "self").when(c.rlike(rules.program) & ~c.rlike(" daemon run"), "interactive").when(forked, "forked")
    kind = kind.when(c.rlike(rules.helpers), "infra").when(server, "server").otherwise("other")
    rows = processes.withColumn("kind", F.coalesce(kind, F.lit("other")))
    name = F.when(F.col("kind") == "server", text.server_name(c, rules.known, rules.prefix))
    return rows.withColumn("is_root", F.col("kind").isin("interactive", "forked")).withColumn("server", name)


def kind_totals(processes: DataFrame) -> DataFrame:
    """``kind``, ``procs`` and ``rss`` of the processes of :func:`process_kinds`; the sampler is left out."""
    return processes.where("kind <> 'self'").groupBy("kind").agg(F.count("*").alias("procs"), F.sum("rss").alias("rss"))


def process_roots(processes: DataFrame) -> DataFrame:
    """``pid``, ``root``: each process below a root (``is_root``), not crossing into another root's tree.

    Pointers to parents double each round, so a tree of depth d takes log2(d) joins, and log2 of the number of
    processes are enough: what has no root by then hangs on a cycle, and has none.
    """
    up = F.when(F.col("is_root"), F.col("pid")).otherwise(F.col("ppid"))
    now = written(processes.select("pid", up.alias("up"), "is_root"), "processes")
    for _ in range(2 + math.ceil(math.log2(max(2, now.count())))):
        above = now.select(F.col("pid").alias("up"), F.col("up").alias("upper"))
        step = now.join(above, "up", "left").select("pid", F.coalesce("upper", F.lit(None).cast("long")).alias("up"), "is_root", F.col("up").alias("was"))
        step = written(step, "processes")
        changed = step.where("not (up <=> was)").limit(1).count()
        dropped(now)
        now = step
        if not changed:
            break
    roots = now.where("is_root").select(F.col("pid").alias("root"))
    return now.select("pid", F.col("up").alias("root")).join(roots, "root", "left_semi")


def tree_rollup(processes: DataFrame) -> DataFrame:
    """Per root: processes, own size, total, that of named servers, and the rest."""
    rows = processes.join(process_roots(processes), "pid")
    own = F.sum(F.when(F.col("pid") == F.col("root"), F.col("rss")).otherwise(0))
    servers = F.sum(F.when((F.col("pid") != F.col("root")) & F.col("server").isNotNull(), F.col("rss")).otherwise(0))
    sums = rows.groupBy("root").agg(F.count("*").alias("procs"), F.sum("rss").alias("total"), own.alias("own"), servers.alias("servers"))
    return sums.withColumn("other", F.col("total") - F.col("own") - F.col("servers"))


def stall_point(events: DataFrame, key: str, ts: Column, gap_seconds: int = 300) -> DataFrame:
    """Keys whose last progress is more than the gap before the end of their log."""
    last = events.groupBy(key).agg(F.max(F.when(F.col("progress"), ts)).alias("last_progress"), F.max(ts).alias("log_end"))
    return last.withColumn("stalled", F.coalesce(F.col("log_end") - F.col("last_progress") > gap_seconds, F.lit(True)))


def bursts(events: DataFrame, key: str, ts: str, seconds: int, least: int) -> DataFrame:
    """Per key the most events within ``seconds``, where there are ``least`` or more."""
    win = Window.partitionBy(key).orderBy(ts).rangeBetween(-seconds, 0)
    return events.withColumn("_n", F.count("*").over(win)).groupBy(key).agg(F.max("_n").alias("burst")).where(F.col("burst") >= least)
