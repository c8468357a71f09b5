"""Smaller rules over work items, reports, logs and documents."""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberloom.functions import text
from emberloom.operators.scratch import written


def stale(episodes: DataFrame, now: Column, days: int) -> DataFrame:
    """Episodes of the last days that are not promoted."""
    return episodes.where((F.to_date("date") >= F.date_sub(now, days)) & ~F.col("promoted"))


def same_or_unknown(a: Column, b: Column) -> Column:
    """False only where both sides are known and differ."""
    return a.isNull() | b.isNull() | (a == b)


def project_of_folder(rows: DataFrame, watched: DataFrame, folder: str = "cwd") -> DataFrame:
    """``project`` of each folder: the first watched path (by ``rank``) that is it or stands above it on a segment
    boundary, else the folder's last segment. All ancestors of a folder are joined by equality."""
    folders = rows.select(folder).distinct()
    parts = F.split(F.col(folder), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = folders.select(folder, F.explode(above).alias("path")).join(watched.select("path", "project", "rank"), "path")
    best = met.groupBy(folder).agg(F.min_by("project", "rank").alias("_project"))
    found = rows.join(best, folder, "left")
    return found.withColumn("project", F.coalesce("_project", text.basename(F.regexp_replace(folder, "/+$", "")))).drop("_project")


NEEDLE_CHARS = 8_000_000


def containing(needles: DataFrame, rows: DataFrame, needle: str, hay: str) -> DataFrame:
    """Pairs in which the row's text holds the needle in either case: labels of an evaluation set resolved to rows.

    The needles are a stated set of queries, tried against every row: an automaton over all of them passes each text
    once. It goes to the tasks as a broadcast of about ``NEEDLE_CHARS`` characters; more needles make more blocks, and
    the pairs of one are written before the next is made. An empty needle stands in every text; a null one in none.
    """
    spark = rows.sparkSession
    listed = needles.where(F.col(needle).isNotNull()).select(F.lower(needle).alias("_needle")).distinct()
    total = listed.agg(F.coalesce(F.sum(F.length("_needle")), F.lit(0))).first()[0]
    blocks, found = max(1, -(-total // NEEDLE_CHARS)), []
    kind = T.StructType([*rows.schema.fields, T.StructField("_needle", T.StringType())])
    place = rows.columns.index(hay)
    for b in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("_needle"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([r._needle for r in own.toLocalIterator()])

        def run(batches, shared=shared):
            automaton, blank = ahocorasick.Automaton(), "" in shared.value
            for x in filter(None, shared.value):
                automaton.add_word(x, x)
            if len(automaton):
                automaton.make_automaton()
            for batch in batches:
                of, said = [], []
                for i, t in enumerate(batch.column(place).to_pylist()):
                    met = {x for _, x in automaton.iter(t.lower())} if t and len(automaton) else set()
                    if blank and t is not None:
                        met.add("")
                    of += [i] * len(met)
                    said += sorted(met)
                some = batch.take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(said, pa.string())], names=kind.names)

        met = rows.mapInArrow(run, kind)
        found.append(written(met, "met") if blocks > 1 else met)
        if blocks > 1:
            shared.destroy()
    met = functools.reduce(DataFrame.union, found)
    return needles.withColumn("_needle", F.lower(needle)).join(met, "_needle").drop("_needle").distinct()


def cross_reference(reported: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``unmentioned`` items that no report names and ``phantom`` ones that only reports do."""
    a, b = reported.select(key).distinct(), known.select(key).distinct()
    return b.join(a, key, "left_anti").select(key, F.lit("unmentioned").alias("kind")).unionByName(a.join(b, key, "left_anti").select(key, F.lit("phantom").alias("kind")))


def continuity(promised: DataFrame, done: DataFrame) -> DataFrame:
    """Items (``item``, ``date``) promised in one report and done in a later one."""
    d = done.groupBy("item").agg(F.max("date").alias("done"))
    p = promised.groupBy("item").agg(F.min("date").alias("promised"))
    return p.join(d, "item", "left").withColumn("kept", F.coalesce(F.col("done") > F.col("promised"), F.lit(False)))


def request_rollup(log: DataFrame, keys: tuple[str, ...] = ("session", "request")) -> DataFrame:
    """Per request (or whatever ``keys`` name: a session, a batch) its lines, span, last status, errors, and whether the
    counters of its latest line add up."""
    rows = log.groupBy(*keys).agg(
        F.count("*").alias("lines"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by("status", F.struct("ts", "line")).alias("status"),
        F.sum((F.col("level") == "ERROR").cast("long")).alias("errors"),
        F.max_by(F.struct("total", "done", "failed", "pending"), F.struct("ts", "line")).alias("c"),
    )
    return rows.select("*", F.coalesce(F.col("c.total") == F.col("c.done") + F.col("c.failed") + F.col("c.pending"), F.lit(False)).alias("adds_up")).drop("c")


def reference_health(references: DataFrame, calls: DataFrame, tools: DataFrame) -> DataFrame:
    """dead, tool-miss, permission-gap or healthy for each reference (``server``, ``tool``)."""
    live = tools.select("server").distinct().withColumn("_live", F.lit(True))
    known = tools.select("server", "tool").distinct().withColumn("_tool", F.lit(True))
    denied = calls.where("denied").select("server", "tool").distinct().withColumn("_denied", F.lit(True))
    rows = references.join(live, "server", "left").join(known, ["server", "tool"], "left").join(denied, ["server", "tool"], "left")
    state = F.when(F.col("_live").isNull(), "dead").when(F.col("_tool").isNull(), "tool-miss").when(F.col("_denied"), "permission-gap").otherwise("healthy")
    return rows.withColumn("state", state).drop("_live", "_tool", "_denied")


def release_audit(merged: DataFrame, tickets: DataFrame, version: str) -> DataFrame:
    """Tickets merged since a tag against the tickets of a version: both, missing from the version, or not merged."""
    a = merged.select("ticket").distinct().withColumn("_m", F.lit(True))
    b = tickets.where(F.col("version") == version).select("ticket").distinct().withColumn("_v", F.lit(True))
    state = F.when(F.col("_m").isNull(), "not merged").when(F.col("_v").isNull(), "not in the version").otherwise("released")
    return a.join(b, "ticket", "full_outer").select("ticket", state.alias("state"))


def open_threads(threads: DataFrame, comments: DataFrame) -> DataFrame:
    """Per pull request its unresolved threads and the latest comment of the scanner."""
    n = threads.groupBy("pr").agg(F.sum((~F.col("resolved")).cast("long")).alias("unresolved"))
    last = comments.where(F.col("body").contains("scan")).groupBy("pr").agg(F.max_by("body", "at").alias("scan"))
    return n.join(last, "pr", "full_outer").withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))


def days_since(now: Column, updated: Column) -> Column:
    """Whole days since the last change."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(updated)) / 86400)


def signals(prs: DataFrame, login: str) -> DataFrame:
    """One row for each signal of a pull request: a review asked of ``login``, a failed check, a merge conflict.

    ``prs`` has ``reviewers`` (logins), ``checks`` (structs of conclusion and state) and ``mergeable``.
    """
    bad = lambda c: F.coalesce(c.isin("FAILURE", "ERROR"), F.lit(False))
    rules = [
        ("review-requested", F.array_contains("reviewers", login)),
        ("ci-failed", F.exists("checks", lambda x: bad(x["conclusion"]) | bad(x["state"]))),
        ("merge-conflict", F.col("mergeable") == "CONFLICTING"),
    ]
    found = F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in rules)))
    return prs.select("*", F.explode(found).alias("signal"))


def digest_line(agent: Column, status: Column, run_at: Column, items: Column, labels: dict[str, str]) -> Column:
    """A queued run in one line: its label and day, and what it flagged. ``items`` are structs of ``pr_number``,
    ``title``, ``type``, ``key``, ``days_stale`` and ``status``, of which an agent's have some."""
    named = F.lit(None).cast("string")
    for name, label in labels.items():
        named = F.when(agent == name, label).otherwise(named)
    head = F.concat(F.coalesce(named, agent), F.lit(" ("), F.coalesce(F.left(run_at, F.lit(10)), F.lit("unknown")), F.lit("): "))
    n = F.coalesce(F.size(items), F.lit(0))
    join = lambda f: F.array_join(F.transform(items, f), ", ")
    prs = join(lambda x: F.concat(F.lit("#"), x["pr_number"].cast("string"), F.lit(' "'), x["title"], F.lit('" ('), x["type"], F.lit(")")))
    stale = join(lambda x: F.concat(x["key"], F.lit(" "), x["days_stale"].cast("string"), F.lit("d stale ("), x["status"], F.lit(")")))
    said = F.when(status == "error", "ERROR — skipped run").when(n <= 0, "nothing flagged")
    said = said.when(agent == "pr-surveillance", F.concat(n.cast("string"), F.lit(" flagged — "), prs)).when(agent == "sprint-staleness", stale)
    return F.concat(head, said.otherwise(F.concat(n.cast("string"), F.lit(" item(s)"))))


def digest(entries: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """``text``: the digest of the runs in a queue (``agent``, ``status``, ``run_at``, ``items``) in order of time; no row
    where there are none. A queue holds the runs since the last session."""
    line = digest_line(*(F.col(c) for c in ("agent", "status", "run_at", "items")), labels or {})
    rows = entries.select(F.struct(F.coalesce("run_at", F.lit("")).alias("at"), line.alias("line")).alias("x"))
    found = rows.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("x")).alias("l")).where("n > 0")
    head = F.concat(F.lit("[Background Digest — "), F.col("n").cast("string"), F.lit(" run(s) since last session]"))
    return found.select(F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def top_with_rest(rows: DataFrame, order: list[Column], shown: int = 8) -> tuple[DataFrame, int]:
    """The first rows, and how many more there are."""
    return rows.orderBy(*order).limit(shown), max(0, rows.count() - shown)


def safe_text(value: Column, most: int) -> Column:
    """Control characters and runs of white space as one space, trimmed and cut; no text is an empty one."""
    plain = F.regexp_replace(F.regexp_replace(value, r"[\x00-\x1f]", " "), r"\s+", " ")
    return F.coalesce(F.left(F.trim(plain), F.lit(most)), F.lit(""))


def observation(raw: Column, most: int = 20) -> Column:
    """A model's JSON object as typed fields, whatever shape it has; null if it is no object.

    Lists hold at most 20 texts of 500 characters, and a lone text counts as a list of one; files of note need a path
    and a reason; the summary has 2,000 characters and the project 64; a score out of range is unknown.
    """
    v = F.try_parse_json(raw)
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    said = lambda x, path: F.when(is_text(get(x, path, "variant")), get(x, path, "string"))

    def texts(name: str) -> Column:
        many = F.filter(get(v, f"$.{name}", "array<variant>"), is_text)
        listed = F.slice(F.transform(many, lambda x: safe_text(get(x, "$", "string"), 500)), 1, most)
        one = safe_text(said(v, f"$.{name}"), 500)
        none = F.array().cast("array<string>")
        return F.coalesce(listed, F.when(one != "", F.array(one)), none).alias(name)

    pairs = F.filter(get(v, "$.files_of_note", "array<variant>"), lambda x: said(x, "$.path").isNotNull() & said(x, "$.reason").isNotNull())
    files = F.transform(pairs, lambda x: F.struct(safe_text(said(x, "$.path"), 500).alias("path"), safe_text(said(x, "$.reason"), 500).alias("reason")))
    no_files = F.array().cast("array<struct<path:string,reason:string>>")
    score = F.when(F.schema_of_variant(get(v, "$.value_score", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), get(v, "$.value_score", "double"))
    whole = F.when((score == F.floor(score)) & score.between(0, 4), score.cast("int"))
    made = F.struct(
        safe_text(said(v, "$.summary"), 2000).alias("summary"), F.nullif(safe_text(said(v, "$.project"), 64), F.lit("")).alias("project"),
        texts("decisions"), texts("corrections"), texts("discoveries"),
        F.coalesce(F.slice(files, 1, most), no_files).alias("files_of_note"), whole.alias("value_score"),
    )
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), made)


#: Fixed values of the document lint: keys of front matter, reserved words of names, first and second person in a
#: description, marks of a reason, and the scores of the share of instructions that give one (up to a bound).
DOCUMENTED_KEYS = (
    "name", "description", "when_to_use", "argument-hint", "arguments", "disable-model-invocation", "user-invocable", "allowed-tools",
    "disallowed-tools", "model", "effort", "context", "agent", "hooks", "paths", "shell",
)
RESERVED_WORDS = ("anthropic", "claude")
PERSON = r"(?i)\bI can\b|\bI'll\b|\bI will\b|\bI help\b|\bI am\b|\bYou can\b|\bYou will\b|\bYou'll\b|\bHelps you\b|我可以|我能|我会|你可以|您可以"
REASONS = "because|so that|to avoid|to prevent|to ensure|since |otherwise|this ensures|this prevents|which ensures|因为|以便|避免|防止|否则|以确保|从而|确保不"
REASON_BANDS = ((0.0, 0), (0.25, 1), (0.50, 2))
MOST_CHARS = 1536


def lint(files: DataFrame) -> DataFrame:
    """The mechanical criteria of a skill document (``path``, ``content``), as far as rules decide them.

    ``fields`` (0 to 2): front matter that parses, with known keys only, and a description; ``faults`` lists what is
    wrong with it. ``name`` and ``name_ok``: the name, or else its folder's, of a-z, 0-9 and hyphens, without reserved
    words. ``told_ok``: a description, not too long together with when to use it, in the third person.
    ``instructions``, ``reasons`` and ``reason_score`` (0 to 3, null without instructions): bullets and steps outside
    code and tables, and how many of them give a reason.
    """
    lines = F.split("content", "\n")
    at = files.select("path", "content", lines.alias("l"))
    ends = F.filter(F.transform("l", lambda x, i: F.when((i > 0) & (F.trim(x) == "---"), i)), lambda x: x.isNotNull())
    at = at.withColumn("open", F.trim(F.get("l", F.lit(0))) == "---").withColumn("end", F.when(F.col("open"), F.get(ends, F.lit(0))))
    at = at.withColumn("front", F.when(F.col("end").isNotNull(), F.slice("l", F.lit(2), F.col("end") - 1)))
    top = F.filter("front", lambda x: (F.trim(x) != "") & ~x.rlike(r"^[# \t]"))
    at = at.withColumn("top", top).withColumn("block", F.array_join("front", "\n"))
    key = r"^([^\s:][^:]*):(?:\s|$)"

    def value(name: str) -> Column:
        found = rf"(?:\A|\n){name}:(?:[ \t]+([^\n]*))?((?:\n[ \t][^\n]*)*)"
        first = F.trim(F.regexp_extract("block", found, 1))
        rest = F.filter(F.transform(F.split(F.regexp_extract("block", found, 2), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\t", " "))), lambda x: x != "")
        first = F.when(first.isin(">", ">-", "|", "|-"), "").otherwise(first)
        return F.trim(F.concat_ws(" ", F.nullif(first, F.lit("")), F.array_join(rest, " ")))

    keys = F.transform(F.filter("top", lambda x: x.rlike(key)), lambda x: F.trim(F.regexp_extract(x, key, 1)))
    odd = F.filter(keys, lambda k: ~k.isin(*DOCUMENTED_KEYS))
    faults = (
        F.when(~F.col("open"), F.array(F.lit("no front matter")))
        .when(F.col("end").isNull(), F.array(F.lit("front matter is not closed")))
        .when(F.exists("top", lambda x: ~x.rlike(key)), F.array(F.lit("a line is not 'key: value'")))
        .otherwise(F.transform(odd, lambda k: F.concat(F.lit("unknown key "), k)))
    )
    told = value("description")
    at = at.withColumn("faults", faults).withColumn("told", told).withColumn("when", value("when_to_use"))
    at = at.withColumn("own", F.trim(F.regexp_extract("block", r"(?:\A|\n)name:[ \t]+([^\n]*)", 1)))
    name = F.coalesce(F.nullif("own", F.lit("")), F.regexp_extract("path", r"([^/]+)/[^/]*$", 1))
    body = F.when(F.col("end").isNotNull(), F.slice("l", F.col("end") + 2, F.size("l"))).otherwise(F.col("l"))
    fenced = F.transform(body, lambda x: F.when(F.regexp_replace(x, r"^\s+", "").startswith("```"), "```").otherwise(F.regexp_replace(x, r"\s+$", "")))
    outside = F.regexp_replace(F.concat(F.array_join(fenced, "\n"), F.lit("\n```")), r"(?s)(?:\A|(?<=\n))```\n.*?(?:\n```(?=\n|\z)|\z)", "")
    steps = F.filter(F.split(outside, "\n"), lambda x: x.rlike(r"^(?:[-*]\s+|\d+[.)]\s+)"))
    at = at.withColumn("name", name).withColumn("steps", steps)
    n, k = F.size("steps"), F.size(F.filter("steps", lambda x: F.lower(x).rlike(REASONS)))
    band = F.lit(3)
    for bound, score in reversed(REASON_BANDS):
        band = F.when(k / n <= bound, score).otherwise(band)
    return at.select(
        "path",
        F.when(F.size("faults") > 0, 0).when(F.col("told") == "", 1).otherwise(2).alias("fields"),
        "faults",
        "name",
        (F.col("name").rlike(r"\A[a-z0-9-]{1,64}\z") & ~F.lower("name").rlike("|".join(RESERVED_WORDS))).alias("name_ok"),
        ((F.col("told") != "") & (F.length("told") + F.length("when") <= MOST_CHARS) & ~F.col("told").rlike(PERSON)).alias("told_ok"),
        n.alias("instructions"),
        k.alias("reasons"),
        F.when(n > 0, band).alias("reason_score"),
    )


def banded(total: Column, bands: tuple[tuple[float, str], ...] = ((90, "strong"), (70, "sound"), (50, "weak")), low: str = "poor") -> Column:
    """The label of the first band that the total reaches."""
    chain = None
    for least, name in bands:
        chain = F.when(total >= least, name) if chain is None else chain.when(total >= least, name)
    return chain.otherwise(low)


def recent_activity(rows: DataFrame) -> DataFrame:
    """Projects by activity (commits, pull requests and tickets), ties by commits."""
    score = F.col("commits") + F.col("prs") + F.col("tickets")
    return rows.withColumn("activity", score).orderBy(F.desc("activity"), F.desc("commits"), "project")


#: Error codes of the download log by what they mean, and how many of them are normal. Fixed values.
SATURATED, CRASHED, FAILED = "P3RM_GENERIC", "APP_02", "DLW_11"
NOISE = {"HART_04": 5, "APP_01": 0, "APP_02": 1}


def log_triage(log: DataFrame, stall_seconds: int = 300) -> DataFrame:
    """``session`` and ``finding`` of a download log (``session``, ``ts`` in seconds, ``event``, ``code``, ``status``).

    A request that started and never completed; three or more path worker errors; a crash at the start with no
    download behind it; counters that stop well before the log does; no failed downloads although the request did not
    complete; twenty or more failed downloads; progress behind an ERROR status.
    """
    ts = F.col("ts")
    event = lambda name: F.col("event") == name
    code = lambda name: F.coalesce(F.col("code") == name, F.lit(False))
    many = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    last = lambda c: F.max(F.when(c, ts))
    rows = log.groupBy("session").agg(
        many(event("request.download.started")).alias("started"), many(event("request.download.completed")).alias("completed"),
        many(code(SATURATED)).alias("saturated"), many(code(FAILED)).alias("failed"), F.min(F.when(code(CRASHED), ts)).alias("crashed"),
        last(F.col("event").startswith("request.download") | event("batch.counter.increment")).alias("download"),
        last(event("batch.counter.increment")).alias("counted"), F.min(F.when(F.col("status") == "ERROR", ts)).alias("wrong"), F.max(ts).alias("log_end"), F.min(ts).alias("log_start"),
    )
    stalled = (F.col("started") > 0) & (F.col("completed") == 0)
    rules = [
        ("stalled request", stalled),
        ("path worker saturated", F.col("saturated") >= 3),
        ("startup crash", (F.col("crashed") == F.col("log_start")) & F.coalesce(F.col("download") <= F.col("crashed"), F.lit(True))),
        ("stall point", F.col("log_end") - F.col("counted") > stall_seconds),
        ("downloads work", stalled & (F.col("failed") == 0)),
        ("many failures", F.col("failed") >= 20),
        ("status stuck", F.col("counted") > F.col("wrong")),
    ]
    found = F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in rules)))
    return rows.select("session", F.explode(found).alias("finding"))


def notable_codes(log: DataFrame) -> DataFrame:
    """``session``, ``code``, ``n`` of error codes without the usual noise: lifecycle codes count only above their
    normal number, consent ones only where a promise was not handled."""
    noisy = F.lit(None).cast("int")
    for name, normal in NOISE.items():
        noisy = F.when(F.col("code") == name, normal).otherwise(noisy)
    limit = F.coalesce(noisy, F.when(F.col("code").startswith("HART_"), 5), F.lit(0))
    told = log.where(F.col("code").isNotNull() & ((F.col("code") != "APP_01") | F.col("message").contains("unhandled Promise rejection")))
    return told.groupBy("session", "code").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def counter_faults(batches: DataFrame) -> DataFrame:
    """``batch`` and ``fault`` of batches whose counters cannot be right."""
    c = F.col
    rules = [
        ("more done than there are", c("downloaded") + c("failed") > c("items")),
        ("counted twice", c("downloaded") > c("items")),
        ("verified before downloaded", c("verified") > c("downloaded")),
        ("no completion", (c("downloaded") == c("items")) & ~c("completed")),
    ]
    found = F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in rules)))
    return batches.select("batch", F.explode(found).alias("fault"))
