"""The tools as functions that return DataFrames. Reads never write; writes return what they append or change.

``Memory`` holds the tables: observations, vectors, access events, flags and flag events, episodes and entries.
Nothing is written behind a reader's back: the access bump of a search is a table that the caller appends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberloom import config as C
from emberloom.functions import python, text
from emberloom.operators import events, flags, fulltext, reports, scratch, search, similarity, themes
from emberloom.sources import files


@dataclass
class Memory:
    """The tables that the tools read. ``observations``: id, source_type, source_path, project, title, content,
    indexed_at, topic. ``vectors``: vec_id, embedding. ``access``: user_id (an observation's id), ts. ``index``: a full-text
    index of stemmed titles, contents and topics, where there is one."""

    spark: SparkSession
    root: str
    observations: DataFrame
    vectors: DataFrame
    access: DataFrame
    index: fulltext.Index | None = None


def held(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def search_memory(m: Memory, query: str, query_vector: list[float] | None, now: int, limit: int = 10, source_filter: list[str] | None = None, project: str | None = None) -> DataFrame:
    """Hybrid search. Without a vector, or with a query that has no words, the other retriever serves alone."""
    if not query:
        raise ValueError("the query is empty")
    limit = held(limit, 50)
    where: Column = F.lit(True)
    if source_filter:
        where = where & F.col("source_type").isin(*source_filter)
    if project is not None:
        where = where & (F.col("project") == project)
    o = m.observations
    columns = tuple(c for c in ("title", "content", "topic") if c in o.columns)
    kw = search.keyword_candidates(o, query, limit, where, "id", columns, stemmed=True, index=m.index)
    allowed = o.where(where).select("id")
    vec = m.spark.createDataFrame([], "id long, vec_pos int") if query_vector is None else search.vector_candidates(m.vectors, query_vector, limit, allowed)
    found = search.hybrid(kw, vec, o.select("id", "title", "content", "indexed_at"), search.access_stats(m.access), query, now, limit)
    parsed = fulltext.parse(query, python.stem_word, columns)
    phrases = fulltext.phrases_of(parsed) if parsed else []
    terms = sorted({w for p in phrases for w in (p.words[:-1] if p.prefix else p.words)})
    hit = text.hit_snippet(F.col("content"), terms, prefixes=sorted({p.words[-1] for p in phrases if p.prefix}), stems=python.stems)
    words = text.word_snippet(F.col("content"))
    return found.withColumn("snippet", F.when(F.col("fts_pos").isNotNull(), hit).otherwise(words) if phrases else words)


def access_bump(results: DataFrame, now: int) -> DataFrame:
    """The access events of returned rows, to be appended to the access log."""
    return results.select(F.col("id").alias("user_id"), F.timestamp_seconds(F.lit(now)).alias("ts"))


def get_topic(m: Memory, name: str) -> str | None:
    return files.topic_file(m.spark, f"{m.root}/context", name)


def list_topics(m: Memory) -> tuple[DataFrame, DataFrame]:
    """(topics with their titles, in order; warnings where index and folder differ)."""
    index = files.topic_index(files.small_text(m.spark, f"{m.root}/context/_index.md")).dropDuplicates(["file"])
    disk = files.markdown(m.spark, f"{m.root}/context", r"(?:^|/)_", recursive=False).select(text.basename(F.col("path")).alias("file"), text.first_heading(F.col("content")).alias("title"))
    topics = index.join(disk, "file", "left").orderBy("name")
    gone = index.join(disk, "file", "left_anti").select("file", F.lit("in the index, not in the folder").alias("warning"))
    new = disk.join(index, "file", "left_anti").select("file", F.lit("in the folder, not in the index").alias("warning"))
    return topics, gone.unionByName(new)


def entries_of(m: Memory, scope: str = "all", project: str | None = None) -> DataFrame:
    """Dated entries of the agent's and the projects' learnings; a project's scope has the agent's, too."""
    found = files.markdown(m.spark, m.root).where(F.col("path").rlike(r"/agent/learnings\.md$|/projects/[^/]+/(?:.*/)?learnings\.md$"))
    agent = F.col("path").rlike(r"/agent/learnings\.md$")
    if scope == "agent":
        found = found.where(agent)
    elif scope == "project" or project is not None:
        found = found.where(F.col("path").contains(f"/projects/{project}/") | (agent if scope != "project" else F.lit(False)))
    return events.entries(found)


def get_recent_learnings(m: Memory, scope: str = "all", limit: int = 5, project: str | None = None) -> DataFrame:
    return entries_of(m, scope, project).orderBy(F.desc("date"), "path", "place").limit(held(limit, 20))


def append_learning(m: Memory, scope: str, content: str, date: str, project: str | None = None, title: str | None = None) -> DataFrame:
    """The entry to append with its ``block`` of text and ``bytes``, and its best match of 0.8 or more among the
    file's entries (equal hashes are 1)."""
    if scope == "project" and not project:
        raise ValueError("a project's learning needs a project")
    if project is not None and not re.fullmatch(r"[a-z0-9][a-z0-9-]*", project):
        raise ValueError("a project is named by lower-case letters, digits and hyphens")
    path = f"{m.root}/agent/learnings.md" if scope == "agent" else f"{m.root}/projects/{project}/learnings.md"
    title, content = title if title is not None else "Learning", content.strip()
    raw = f"## {date} — {title}\n\n{content}"
    block = f"\n\n{raw}\n"
    row = (0, path, date, title, content, raw, block, len(block.encode()))
    fresh = m.spark.createDataFrame([row], "id long, path string, date string, title string, body string, raw string, block string, bytes long")
    fresh = fresh.withColumn("hash", F.sha2("raw", 256))
    own = entries_of(m).where(F.col("path").endswith(path.removeprefix("file:").lstrip("/")))
    known = own.select(F.xxhash64("path", "place").alias("id"), "path", "date", "hash", "body")
    sets = [x.select("id", text.token_set(F.col("body")).alias("tokens")) for x in (fresh, known)]
    best = similarity.best_match(*sets)
    prior = known.select(F.col("id").alias("match"), F.col("path").alias("match_path"), F.col("date").alias("match_date"), F.col("hash").alias("match_hash"))
    out = fresh.join(best, "id", "left").join(prior, "match", "left")
    return out.withColumn("similarity", F.when(F.col("hash") == F.col("match_hash"), 1.0).otherwise(F.col("similarity"))).drop("id", "match")


def list_episodes(m: Memory, limit: int = 10, project: str | None = None, promoted: bool | None = None) -> DataFrame:
    """Episodes one level deep, newest first, then by session."""
    found = files.episodes(files.markdown(m.spark, f"{m.root}/episodes", r"(?:^|/)_", recursive=False))
    if project is not None:
        found = found.where(F.col("project") == project)
    if promoted is not None:
        found = found.where(F.col("promoted") == promoted)
    return found.orderBy(F.desc("date"), F.desc(F.coalesce("session_id", F.lit("")))).limit(held(limit, 50))


def mark_episode_promoted(m: Memory, path: str) -> DataFrame:
    """The promotion event of an episode below the memory root; other paths are refused."""
    if ".." in path or f"{m.root.removeprefix('file://')}/episodes/" not in path or not path.endswith(".md"):
        raise ValueError("not an episode")
    found = files.episodes(files.markdown(m.spark, f"{m.root}/episodes").where(F.col("path").endswith(path.removeprefix("file://"))))
    return found.select("path", F.lit(True).alias("promoted"))


def with_promotions(episodes: DataFrame, promotions: DataFrame) -> DataFrame:
    """Episodes with the promotion events applied."""
    new = promotions.groupBy("path").agg(F.max("promoted").alias("_new"))
    return episodes.join(new, "path", "left").withColumn("promoted", F.coalesce("_new", "promoted")).drop("_new")


def scan_novelty(m: Memory, entry_vectors: DataFrame, known_flags: DataFrame, at: int, project: str | None = None, threshold: float = C.COSINE_DUPLICATE) -> tuple[DataFrame, DataFrame]:
    """(new flags to append, pending flags with where their entries are). ``entry_vectors``: hash, embedding."""
    entries = entries_of(m, project=project)
    side = F.struct("path", "date", "hash")
    rows = entries.join(entry_vectors, "hash").select(F.xxhash64("path", "place").alias("vec_id"), "embedding", side.alias("side"))
    # entries of one vector are duplicates of each other: pair each with the class's first
    classes = similarity.vector_classes(rows)
    heads = classes.where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    pairs = heads.unionByName(similarity.cosine_links(rows, threshold))
    ends = [rows.select(F.col("vec_id").alias(n), F.col("side").alias(f"s{n}")) for n in ("a", "b")]
    found = pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"), F.col("cosine").alias("similarity"))
    fresh = flags.insert_or_ignore(known_flags, flags.from_pairs(found, "duplicate", "scan_novelty", at))
    pending = flags.relocate(known_flags.unionByName(fresh.select(*known_flags.columns)), entries)
    return fresh, pending


def resolve_novelty_flag(status_events: DataFrame, flag_id: int, status: str, at: int) -> DataFrame:
    """The status event of a known flag; an unknown id gives none."""
    if status not in ("dismissed", "superseded"):
        raise ValueError("the status is dismissed or superseded")
    known = status_events.where(F.col("flag_id") == flag_id).select("flag_id").distinct()
    return known.select("flag_id", F.lit(status).alias("status"), F.lit(at).cast("long").alias("at"))


def scan_experience(m: Memory, episode_vectors: DataFrame, max_episodes: int = C.MAX_EPISODES, project: str | None = None, live: bool = False, episode_floor: int | None = None, cluster_floor: int | None = None, threshold: float = C.THEME_COSINE) -> tuple[DataFrame, DataFrame]:
    """(themes of the backlog, histogram of its values). ``episode_vectors``: path, embedding.

    The cap comes before the join with vectors, so fewer than the cap may cluster; in shadow mode no gate acts.
    """
    found = files.episodes(files.markdown(m.spark, f"{m.root}/episodes", r"(?:^|/)_", recursive=False))
    if project is not None:
        found = found.where(F.col("project") == project)
    some = themes.backlog(found, held(max_episodes, 1000), live)
    if live:
        some = some.where(themes.gate(F.col("value_score"), episode_floor))
    rows = some.join(episode_vectors, "path").select(F.xxhash64("path").alias("vec_id"), "embedding", "path", F.col("value_score").alias("value"))
    classes = similarity.vector_classes(rows)
    same = classes.where("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"))
    edges = similarity.cosine_links(rows, threshold).select("a", "b").union(same)
    members = themes.themes(edges)
    best = themes.max_value(members, rows.select(F.col("vec_id").alias("id"), "value"), cluster_floor if live else None)
    named = members.join(rows.select(F.col("vec_id").alias("id"), "path"), "id").groupBy("root").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # a theme of a capped backlog
    out = themes.cohesion(members, rows).join(best.select("root", "max_value"), "root").join(named, "root")
    histogram = themes.value_histogram(some.select(F.col("value_score").alias("value"), "date"), F.col("date"))
    return out.orderBy(F.desc("n"), "root"), histogram


def proposal_faults(p: Column) -> Column:
    """Messages of what is wrong with the shape of a proposal (a struct), empty if nothing is."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    minutes = p["estimated_weekly_savings_minutes"]
    evidence, change = p["evidence"], p["proposed_change"]
    rules = [
        (holds(p["id"].rlike(r"\AP\d{3}\z")), "id is not P and three digits"),
        (holds(p["priority"].isin("HIGH", "MEDIUM", "LOW")), "priority is not HIGH, MEDIUM or LOW"),
        (holds(p["category"] == "EXPERIENCE_LEARNING"), "category is not EXPERIENCE_LEARNING"),
        (holds(F.length(p["title"]).between(1, 120)), "title is empty or longer than 120 characters"),
        (holds(F.length(p["description"]) >= 50), "description is shorter than 50 characters"),
        (holds((F.size(evidence) >= 2) & ~F.exists(evidence, lambda x: x.isNull())), "evidence is not two texts or more"),
        (change.isNotNull(), "there is no proposed change"),
        (change.isNull() | holds(F.length(change["file"]) > 0), "the change names no file"),
        (change.isNull() | holds(change["action"] == "APPEND_LEARNING"), "the change's action is not APPEND_LEARNING"),
        (holds((minutes == F.floor(minutes)) & minutes.between(0, 600)), "savings are not whole minutes from 0 to 600"),
    ]
    return F.array_compact(F.array(*(F.when(~sound, F.lit(message)) for sound, message in rules)))


def _paths_in(citation: Column) -> Column:
    """Every piece of a citation that may be the path of a Markdown file: from a slash, or from where a word starts,
    to an ending ``.md``."""
    places = F.sequence(F.lit(1), F.greatest(F.length(citation), F.lit(1)))
    starts = F.filter(places, lambda i: (F.substr(citation, i, F.lit(1)) == "/") | (i == 1) | F.substr(citation, i - 1, F.lit(1)).rlike(r"[^A-Za-z0-9._/:-]"))
    ends = F.filter(places, lambda i: F.substr(citation, i, F.lit(3)) == ".md")
    pieces = F.flatten(F.transform(ends, lambda e: F.transform(F.filter(starts, lambda s: s <= e), lambda s: F.substr(citation, s, e - s + 3))))
    return F.array_distinct(pieces)


def resolve_citations(evidence: DataFrame, episodes: DataFrame) -> DataFrame:
    """``citation``, ``path``: the first episode, in path order, whose path stands in the citation, or else whose
    session id does, as any part of it; null if none does. Paths are cut out of a citation and joined by equality. Session
    ids are tried in blocks against every citation, as :func:`reports.containing` does, in either case and then exactly."""
    cited = evidence.select("citation").distinct()
    bare = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    by_path = cited.select("citation", F.explode(_paths_in(F.col("citation"))).alias("k")).join(episodes.select(bare.alias("k"), "path"), "k").select("citation", "path", F.lit(0).alias("rank"))
    known = episodes.where(F.length("session_id") > 0).groupBy("session_id").agg(F.min("path").alias("path"))
    held = reports.containing(known, cited.where("citation is not null"), "session_id", "citation")
    by_session = held.where(F.contains("citation", "session_id")).select("citation", "path", F.lit(1).alias("rank"))
    first = by_path.unionByName(by_session).groupBy("citation").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return cited.join(first, "citation", "left")


def validate_experience_proposal(m: Memory, proposals: DataFrame) -> DataFrame:
    """``id``, ``faults``, ``cited`` (distinct episodes), ``unknown``, ``duplicate_of`` and ``ok`` of each proposal, a row for
    each, whether it has an id or shares it with others."""
    p = F.struct(*proposals.columns)
    rows = proposals.select(F.monotonically_increasing_id().alias("n"), "id", proposal_faults(p).alias("faults"), "evidence", F.col("proposed_change.content").alias("content"))
    rows = scratch.written(rows, "proposals")  # their numbers stay as they are
    eps = files.episodes(files.markdown(m.spark, f"{m.root}/episodes"))
    cites = rows.select("n", F.explode("evidence").alias("citation"))
    cited = cites.join(resolve_citations(cites, eps), "citation", "left").groupBy("n").agg(F.count_distinct("path").alias("cited"), F.sum(F.col("path").isNull().cast("int")).alias("unknown"))
    known = entries_of(m).select(F.xxhash64("path", "place").alias("id"), text.token_set(F.col("body")).alias("tokens"))
    dup = similarity.best_match(rows.select(F.col("n").alias("id"), text.token_set(F.col("content")).alias("tokens")), known).select(F.col("id").alias("n"), F.col("match").alias("duplicate_of"))
    out = rows.join(cited, "n", "left").join(dup, "n", "left")
    ok = (F.size("faults") == 0) & (F.coalesce("cited", F.lit(0)) >= C.THEME_SIZE) & (F.coalesce("unknown", F.lit(0)) == 0) & F.col("duplicate_of").isNull()
    return out.select("id", "faults", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("unknown", F.lit(0)).alias("unknown"), "duplicate_of", ok.alias("ok"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
