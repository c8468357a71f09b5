"""Work metrics and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberloom.functions import scores
from emberloom.operators.scratch import written


def rolling_mean(rows: DataFrame, key: str, order: str, value: str, n: int = 3) -> DataFrame:
    """Mean over the last ``n`` rows of each key."""
    win = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    return rows.withColumn("rolling", F.avg(value).over(win))


def carryover(items: DataFrame, plans: DataFrame, least: int = 3) -> DataFrame:
    """Items open in ``least`` or more plans in a row. ``items``: (item, plan); ``plans``: (plan, rank) dense."""
    ranked = items.join(plans, "plan").select("item", "rank").distinct()
    win = Window.partitionBy("item").orderBy("rank")
    runs = ranked.withColumn("island", F.col("rank") - F.row_number().over(win)).groupBy("item", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("item").agg(F.max("n").alias("streak")).where(F.col("streak") >= least)


def scorecard(commits: DataFrame, key: str) -> DataFrame:
    """Per key: commits, share of fixes, reverts, and fixes per feature ticket (a mean over tickets with features)."""
    fix, revert, feature = (F.col("kind") == k for k in ("fix", "revert", "feature"))
    tickets = commits.where(F.col("ticket").isNotNull()).groupBy(key, "ticket").agg(F.sum(fix.cast("long")).alias("fixes"), F.max(feature.cast("int")).alias("has"))
    per = tickets.where("has = 1").groupBy(key).agg(F.avg("fixes").alias("fixes_per_ticket"))
    own = commits.groupBy(key).agg(F.count("*").alias("commits"), (F.sum(fix.cast("long")) / F.count("*")).alias("fix_ratio"), F.sum(revert.cast("long")).alias("reverts"))
    return own.join(per, key, "left")


def target_status(value: Column, target: float, near: float) -> Column:
    """met, near or missed; lower is better, unknown stays unknown."""
    return F.when(value.isNull(), "unknown").when(value <= target, "met").when(value <= near, "near").otherwise("missed")


def progress_bar(ratio: Column, width: int = 14) -> Column:
    full = F.greatest(F.lit(0), F.least(F.lit(width), F.round(ratio * width).cast("int")))
    return F.concat(F.expr("''"), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def estimates(tasks: DataFrame, key: str) -> DataFrame:
    """Three-point estimates summed by key: deviations add as variances, and the sum is committed in halves."""
    expected, deviation, commit = scores.pert(F.col("low"), F.col("likely"), F.col("high"))
    rows = tasks.select(key, expected.alias("e"), deviation.alias("d"), commit.alias("c"))
    sums = rows.groupBy(key).agg(F.sum("e").alias("expected"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("deviation"), F.sum("c").alias("task_commitments"))
    return sums.withColumn("commitment", F.ceil(F.round((F.col("expected") + F.col("deviation")) * 2, 9)) / 2)


def nearest_rank(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``p50`` and ``p85`` by nearest rank, and the median; null for keys without values.

    Equal values are counted, and the counts sorted over all tasks; a place in a key's order is a sum within its
    part of the order and the sums of the parts before, so no task holds the values of a key.
    """
    counts = rows.groupBy(key, value).agg(F.when(F.col(value).isNull(), F.lit(0)).otherwise(F.count("*")).cast("long").alias("n"))
    counts = counts.select(F.col(key).alias("k"), F.col(value).alias("x"), "n").repartitionByRange("k", "x")
    counts = written(counts.withColumn("part", F.spark_partition_id()), "counts")
    parts, order = counts.groupBy("k", "part").agg(F.sum("n").alias("own")), Window.partitionBy("k")
    parts = parts.select(F.col("k").alias("pk"), F.col("part").alias("pp"), (F.sum("own").over(order.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(order).alias("all"))
    placed = counts.join(parts, F.col("k").eqNullSafe(F.col("pk")) & (F.col("part") == F.col("pp")))
    placed = placed.withColumn("last", F.col("before") + F.sum("n").over(Window.partitionBy("k", "part").orderBy("x")))
    at = lambda rank: F.max(F.expr(f"case when {rank} between last - n + 1 and last then double(x) end"))
    found = placed.groupBy("k").agg(at("(`all` + 1) div 2").alias("p50"), at("(`all` * 85 + 99) div 100").alias("p85"), at("(`all` + 2) div 2").alias("above"))
    return found.select(F.col("k").alias(key), "p50", "p85", ((F.col("p50") + F.col("above")) / 2).alias("median"))


def drift(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """``key`` and ``missing_in`` for keys of one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_a = a.join(b, key, "left_anti").select(key, F.lit(names[1]).alias("missing_in"))
    return only_a.unionByName(b.join(a, key, "left_anti").select(key, F.lit(names[0]).alias("missing_in")))


def three_way(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """create, update or delete for each key; a match is an update whatever the content."""
    a = old.select(*keys, F.lit(True).alias("_a")).distinct()
    b = new.select(*keys, F.lit(True).alias("_b")).distinct()
    both = a.join(b, keys, "full_outer")
    action = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "delete").otherwise("update")
    return both.select(*keys, action.alias("action"))


def merge_snapshots(old: DataFrame, new: DataFrame, key: str, fields: list[str], lists: list[str] = ()) -> DataFrame:
    """New values over old ones field by field (null means not told), and lists with what is new at the end."""
    a = old.select(key, *(F.col(c).alias(f"_{c}") for c in (*fields, *lists)))
    both = new.select(key, *fields, *lists).join(a, key, "full_outer")
    empty = {c: F.coalesce(F.col(c), F.array().cast(new.schema[c].dataType)) for c in lists}
    was = {c: F.coalesce(F.col(f"_{c}"), F.array().cast(new.schema[c].dataType)) for c in lists}
    return both.select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in fields), *(F.array_union(was[c], empty[c]).alias(c) for c in lists))


def plan_items(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The new list of items with the status that an item had before; items that are gone drop."""
    was = previous.select(F.col(key), F.col("status").alias("_status"))
    return current.join(was, key, "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def lifecycle(entries: DataFrame, today: Column) -> DataFrame:
    """graduate, prune, orphan or keep for memory entries (``linked``, ``closed``, ``durable``, ``updated``)."""
    action = F.when(~F.col("linked"), "orphan").when(F.col("durable"), "graduate")
    action = action.when(F.col("closed") & (F.datediff(today, F.col("updated")) > 30), "prune").otherwise("keep")
    return entries.withColumn("action", action)


def advance(items: DataFrame, ranks: dict[str, int], target: str) -> DataFrame:
    """Items whose status may move forward to the target: known, and below it."""
    rank = F.create_map(*(x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))))
    return items.where(rank[F.col("status")] < ranks[target]).withColumn("next", F.lit(target))


def extension_report(files: DataFrame) -> DataFrame:
    """Per file ending: files, bytes, share of all bytes in percent, mean size, oldest and newest."""
    total = F.broadcast(files.agg(F.sum("size").alias("all")))  # one row
    rows = files.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.avg("size").alias("mean_size"), F.min("born").alias("oldest"), F.max("born").alias("newest"), F.count_distinct("born").alias("times"))
    return rows.crossJoin(total).select("ext", "files", "bytes", F.round(F.col("bytes") * 100 / F.col("all"), 2).alias("share"), "mean_size", "oldest", "newest", "times")


#: What marks a commit that cleans up after a tool. Fixed values.
REACTIVE = r"SonarQube|sonar|[Ll]int|[Pp]rettier|[Cc]heckstyle|Copilot|unused import|unused variable|[Rr]emove unused"


def commit_kinds(commits: DataFrame, author: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Commits of an author and a time (``since`` to ``until``, exclusive), merges left out, with ``is_fix``,
    ``is_reactive`` and ``is_revert`` by their message."""
    found = commits.where("parents < 2")
    for column, on in (("author", author and F.col("author").contains(author)), ("since", since and (F.col("at") >= since)), ("until", until and (F.col("at") < until))):
        found = found.where(on) if on is not None else found
    m = F.col("message")
    return found.select("*", m.rlike("(?m)^Fix").alias("is_fix"), m.rlike(REACTIVE).alias("is_reactive"), m.rlike("(?m)^Revert").alias("is_revert"))


def sprint_drift(completed: DataFrame, sprint: DataFrame, most: float = 0.6) -> DataFrame:
    """One row: ``total`` completions (``ticket``), ``sprint`` ones, the ``share`` of others, and ``warning``: more than
    ``most`` of them, and nothing of the sprint."""
    known = sprint.select("ticket").distinct().withColumn("_in", F.lit(True))
    n = completed.join(known, "ticket", "left").agg(F.count("*").alias("total"), F.count("_in").alias("sprint"))
    share = F.when(F.col("total") > 0, (F.col("total") - F.col("sprint")) / F.col("total")).otherwise(F.lit(0.0))
    return n.select("total", "sprint", share.alias("share"), ((share > most) & (F.col("sprint") == 0)).alias("warning"))


def stale_stack(stack: DataFrame, promoted: DataFrame, days: int = 5) -> DataFrame:
    """``item`` and ``days`` of items (``item``, ``day``) that stood in the stack for ``days`` days or more and were never
    a main action."""
    seen = stack.groupBy("item").agg(F.count_distinct("day").alias("days")).where(F.col("days") >= days)
    return seen.join(promoted.select("item").distinct(), "item", "left_anti")


def blocker_stalls(blockers: DataFrame, days: int = 2) -> DataFrame:
    """``person``, ``ticket`` and ``days`` of blockers (with ``day``) in plans more than ``days`` days apart."""
    span = F.datediff(F.max("day"), F.min("day"))
    return blockers.groupBy("person", "ticket").agg(span.alias("days")).where(F.col("days") > days)


def open_work(items: DataFrame, key: str, most: int = 1) -> DataFrame:
    """``key`` and ``n`` of those with more open items than ``most``: finish before you start."""
    return items.where("open").groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)


def qa_bounces(transitions: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """``ticket`` and ``bounces``: tickets that went back from test, of those in flight if they are given."""
    back = transitions.where((F.col("from") == "In Test") & F.col("to").isin("In Progress", "Open"))
    found = back.groupBy("ticket").agg(F.count("*").alias("bounces"))
    return found if in_flight is None else found.join(in_flight.select("ticket"), "ticket", "left_semi")


def priority_order(work: DataFrame, overloaded: bool = False) -> DataFrame:
    """The day's items by kind (sprint, in progress, labelled defects, unassigned defects) and then priority and
    ticket: seven at most, five after days that were too full."""
    kinds = ("sprint", "in progress", "labelled defect", "unassigned defect")
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    rows = work.where(rank > 0).withColumn("rank", rank.cast("int"))
    return rows.orderBy("rank", "priority", "ticket").limit(5 if overloaded else 7)


def estimate_bias(rows: DataFrame, key: str, actual: str = "actual", estimate: str = "estimate") -> DataFrame:
    """``key`` and ``bias``: the median of actual over estimated; rows without an estimate, or of zero, are left out."""
    known = rows.where((F.col(estimate) > 0) & F.col(actual).isNotNull())
    return known.groupBy(key).agg(F.median(F.col(actual) / F.col(estimate)).alias("bias"))
