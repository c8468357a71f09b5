"""The registered queries over the given tables, and the SQL that DuckDB holds them against.

Tables play the roles of the data model: documents are observations, embeddings their vectors, events the access
and guard logs, conversations the transcripts, orders and lineitem the work items. Doubles are rounded to six
places, as the order of sums differs between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberloom.functions import scores, text
from emberloom.operators import evaluate, events, flags, fulltext, ingest, metrics, reports, scratch, search, similarity, telemetry, themes
from emberloom.plans import api

NOW = 1_706_745_600  # 2024-02-01, behind the last event
THEME_COSINE = 0.40  # no pair of the given vectors comes near the default
LINK_COSINE = 0.35
TERMS = ["the", "thtion", "eau"]
QUERY = "the that"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """Rows that a statement over one table makes, which Spark and DuckDB both read."""
    return spark.sql(sql.replace(f"from {name}", "from {source}"), source=t(spark, sf_dir, name))


def six(column):
    return F.round(column, 6)


_BM25 = """
with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w, lang, source from documents),
n as (select doc_id, lang, source, len(w) as n, {tf} from w),
s as (select count(*) as docs, avg(n) as mean, {df} from n)
"""


def _bm25_sql(terms: list[str], need: int, where: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) as tf{i}" for i, x in enumerate(terms))
    df = ", ".join(f"sum(case when tf{i} > 0 then 1 else 0 end) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    hits = " + ".join(f"(tf{i} > 0)::int" for i in range(len(terms)))
    return _BM25.format(tf=tf, df=df) + f", found as (select doc_id as id, {score} as score from n, s where {hits} >= {need} and {where})"


@query(_bm25_sql(TERMS, 1) + " select id, round(score, 6) as score, row_number() over (order by score desc, id) as pos from found order by score desc, id limit 10")
def bm25_search(spark, sf_dir):
    """The ten best documents for three words, any of them."""
    found = search.numbered(search.bm25(t(spark, sf_dir, "documents"), fulltext.any_of(TERMS)), [F.desc("score"), F.asc("id")], "pos", 10)
    return found.select("id", six("score").alias("score"), F.col("pos").cast("long").alias("pos"))


@query(_bm25_sql(["the", "that"], 2, "lang = 'en' and source in ('src0', 'src1')") + " select id, row_number() over (order by score desc, id) as fts_pos from found order by score desc, id limit 40")
def keyword_prefilter(spark, sf_dir):
    """Keyword candidates of two sources: the filter comes before the limit, the statistics from all rows."""
    where = F.col("source").isin("src0", "src1") & (F.col("lang") == "en")
    return search.keyword_candidates(t(spark, sf_dir, "documents"), QUERY, 10, where).select("id", F.col("fts_pos").cast("long").alias("fts_pos"))


def _first_vector(spark, sf_dir) -> list[float]:
    return t(spark, sf_dir, "embeddings").orderBy("vec_id").first().embedding


_KNN = """
with q as (select embedding::double[] as q from embeddings order by vec_id limit 1),
near as (select vec_id as id, list_dot_product(embedding::double[], q) as cosine from embeddings, q order by 2 desc, 1 limit {k})
"""


@query(_KNN.format(k=20) + " select id, round(cosine, 6) as cosine, row_number() over (order by cosine desc, id) as vec_pos from near")
def knn_search(spark, sf_dir):
    """The 20 nearest vectors to the first one."""
    near = search.nearest(t(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 20)
    return near.select("id", six("cosine").alias("cosine"), F.col("vec_pos").cast("long").alias("vec_pos"))


@query(_KNN.format(k=40) + " select id, row_number() over (order by cosine desc, id) as vec_pos from near semi join (select vec_id as id from embeddings where label < 5) using (id)")
def vector_postfilter(spark, sf_dir):
    """Vector candidates of some labels: nearest first, then the filter, then positions."""
    e = t(spark, sf_dir, "embeddings")
    allowed = e.where("label < 5").select(F.col("vec_id").alias("id"))
    return search.vector_candidates(e, _first_vector(spark, sf_dir), 10, allowed).select("id", F.col("vec_pos").cast("long").alias("vec_pos"))


_BONUS = "0.01 * (exp(-greatest(0, ({now} - coalesce(last_accessed, indexed_at)) / 86400.0) / 30) + least(1, ln(1 + coalesce(access_count, 0)) / ln(21))) / 2"
_STATS = "select user_id as id, max(floor(epoch(ts)))::bigint as last_accessed, count(*) as access_count from events group by 1"


@query(
    _bm25_sql(["the", "that"], 2)
    + f""", kw as (select id, row_number() over (order by score desc, id) as fts_pos from found order by score desc, id limit 40),
near as (select vec_id as id, list_dot_product(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1)) as cosine from embeddings order by 2 desc, 1 limit 40),
vec as (select id, row_number() over (order by cosine desc, id) as vec_pos from near),
pair as (select coalesce(kw.id, vec.id) as id, fts_pos, vec_pos from kw full join vec on kw.id = vec.id),
stats as ({_STATS}),
rows as (select b.*, 'Document ' || d.doc_id as title, d.text, {NOW} - 86400 * (d.doc_id % 90) as indexed_at, last_accessed, access_count
  from pair b join documents d on d.doc_id = b.id left join stats s on s.id = b.id),
scored as (select id, fts_pos, vec_pos, coalesce(1.0 / (60 + fts_pos), 0) + coalesce(1.0 / (60 + vec_pos), 0) as rrf, indexed_at,
  {_BONUS.format(now=NOW)} as bonus,
  case when contains(lower(title), 'the that') then 0.016 when contains(lower(text), 'the that') then 0.008 else 0 end as exact from rows)
select id, fts_pos, vec_pos, round(rrf, 6) as rrf, round(rrf + bonus + exact, 6) as score from scored order by rrf + bonus + exact desc, rrf desc, indexed_at desc, id limit 10"""
)
def hybrid_search(spark, sf_dir):
    """Keyword and vector candidates fused, and ranked by access history and exact match."""
    d, e = t(spark, sf_dir, "documents"), t(spark, sf_dir, "embeddings")
    rows = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), F.col("text").alias("content"), (NOW - 86400 * (F.col("doc_id") % 90)).alias("indexed_at"))
    found = search.hybrid(search.keyword_candidates(d, QUERY, 10), search.vector_candidates(e, _first_vector(spark, sf_dir), 10), rows, search.access_stats(t(spark, sf_dir, "events")), QUERY, NOW, 10)
    return found.select("id", F.col("fts_pos").cast("long").alias("fts_pos"), F.col("vec_pos").cast("long").alias("vec_pos"), six("rrf").alias("rrf"), six("score").alias("score"))


@query(f"with s as (select *, id as i from ({_STATS})) select id, access_count, round({_BONUS.format(now=NOW).replace('coalesce(last_accessed, indexed_at)', 'last_accessed')}, 6) as bonus from s")
def reinforcement_score(spark, sf_dir):
    """The access bonus of every id of the log."""
    s = search.access_stats(t(spark, sf_dir, "events"))
    bonus = scores.reinforcement(F.lit(NOW), F.col("last_accessed"), F.lit(None).cast("long"), F.col("access_count"))
    return s.select("id", "access_count", six(bonus).alias("bonus"))


@query("select lang, case when contains(lower(source), 'the that') then 0.016 when contains(lower(text), 'the that') then 0.008 else 0.0 end::double as boost, count(*) as n from documents group by 1, 2")
def exact_match_boost(spark, sf_dir):
    """How many documents of each language hold the whole query."""
    return t(spark, sf_dir, "documents").groupBy("lang", scores.exact_match(QUERY, F.col("source"), F.col("text")).alias("boost")).agg(F.count("*").alias("n"))


_PATH = """case doc_id % 11 when 0 then 'context/' || source || '.md' when 1 then 'agent/learnings.md' when 2 then 'projects/' || source || '/decisions.md'
 when 3 then 'projects/' || source || '/notes/learnings.md' when 4 then 'episodes/2026/' || doc_id || '.md' when 5 then 'projects/' || source || '/plan.md'
 when 6 then 'archive/' || source || '.md' when 7 then 'context/_index.md' when 8 then 'projects/' || source || '/CLAUDE.md' when 9 then 'agent/CLAUDE.md'
 else 'context/deep/' || lang || '.md' end"""


def _paths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("path", F.expr(_PATH))


@query(f"""
with p as (select {_PATH} as path from documents), f as (select path, string_split(path, '/') as part from p),
k as (select path, case
  when part[1] = 'archive' or path = 'context/_index.md' or right(path, 3) <> '.md' then null
  when path = 'agent/CLAUDE.md' then 'agent' when path = 'agent/learnings.md' then 'learning' when part[1] = 'context' then 'context'
  when part[1] = 'projects' and len(part) > 2 then case part[-1] when 'CLAUDE.md' then 'project_claude_md' when 'learnings.md' then 'learning' when 'decisions.md' then 'decision' end
  when part[1] = 'episodes' then 'episode' end as source_type,
  replace(part[-1], '.md', '') as stem, part from f)
select source_type, case when source_type = 'context' then stem end as topic, case when source_type is not null and part[1] = 'projects' then part[2] end as project, count(*) as n from k group by all""")
def doc_classify(spark, sf_dir):
    """Documents by the classification of paths made from their ids."""
    kind = ingest.classify(F.col("path"))
    return _paths(t(spark, sf_dir, "documents")).select(kind.alias("k")).groupBy("k.source_type", "k.topic", "k.project").agg(F.count("*").alias("n"))


_OLD = "select doc_id, sha256(case when doc_id % 7 = 0 then text || '!' else text end) as h from documents where doc_id % 5 <> 0 union all select doc_id + 100000000, 'x' from documents where doc_id % 11 = 0"


@query(f"""
with old as ({_OLD}), new as (select doc_id, sha256(text) as h from documents),
s as (select case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' when o.h = n.h then 'unchanged' else 'changed' end as status
  from old o full join new n on o.doc_id = n.doc_id)
select status, count(*) as n from s group by 1 union all select 'total', count(*) from s""")
def upsert_status(spark, sf_dir):
    """Counters of a reindex run against a snapshot with changed, missing and extra rows."""
    d = t(spark, sf_dir, "documents")
    new = d.select("doc_id", F.sha2("text", 256).alias("h"))
    old = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.expr("case when doc_id % 7 = 0 then text || '!' else text end"), 256).alias("h"))
    old = old.union(d.where("doc_id % 11 = 0").select(F.col("doc_id") + 100000000, F.lit("x")))
    return ingest.counters(ingest.compare(old, new, "doc_id", "h"))


@query(f"""
with old as ({_OLD}), new as (select doc_id, sha256(text) as h from documents)
select n.doc_id, n.h, case when o.doc_id is null then 1 else 0 end as fresh from new n left join old o on o.doc_id = n.doc_id and o.h = n.h""")
def upsert_snapshot(spark, sf_dir):
    """The snapshot after the run: which rows stayed and which are fresh."""
    d = t(spark, sf_dir, "documents")
    new = d.select("doc_id", F.sha2("text", 256).alias("h"), F.lit(1).alias("fresh"))
    old = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.expr("case when doc_id % 7 = 0 then text || '!' else text end"), 256).alias("h"), F.lit(0).alias("fresh"))
    old = old.union(d.where("doc_id % 11 = 0").select(F.col("doc_id") + 100000000, F.lit("x"), F.lit(0)))
    return ingest.upsert(old, new, "doc_id", "h")


@query("select sha256(text) as content_hash, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_duplicates(spark, sf_dir):
    """Groups of equal texts."""
    return similarity.exact_duplicates(t(spark, sf_dir, "documents"))


_SETS = "select doc_id as id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as s from documents"


@query(f"""
with sets as ({_SETS}), classes as (select id, s, min(id) over (partition by s) as class_id from sets),
heads as (select id, s, len(s) as n from classes where id = class_id),
pairs as (select a.id as a, b.id as b from heads a join heads b on a.id < b.id and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9
  where len(list_intersect(a.s, b.s))::double / (a.n + b.n - len(list_intersect(a.s, b.s))) >= 0.8),
ends as (select id, count(*) as n from (select a as id from pairs union all select b from pairs) group by id)
select c.id, c.class_id, coalesce(e.n, 0) as n_links from classes c left join ends e on e.id = c.class_id""")
def jaccard_near_duplicates(spark, sf_dir):
    """Every document's class of equal token sets, and the classes within 0.8 of it."""
    return similarity.near_duplicates(t(spark, sf_dir, "documents"))


@query("""
with b as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as s from benchmark),
d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as s from documents),
p as (select item_id, doc_id, len(list_intersect(b.s, d.s))::double / (len(b.s) + len(d.s) - len(list_intersect(b.s, d.s))) as j from b, d
  where least(len(b.s), len(d.s)) >= 0.3 * greatest(len(b.s), len(d.s)))
select item_id as id, arg_max(doc_id, {'j': j, 'k': -doc_id}) as match, round(max(j), 6) as similarity from p where j >= 0.3 group by 1""")
def benchmark_best_match(spark, sf_dir):
    """For each benchmark item the most similar document's token set at 0.3 or more."""
    sets = [t(spark, sf_dir, n).select(F.col(i).alias("id"), text.token_set(F.col("text")).alias("tokens")) for n, i in (("benchmark", "item_id"), ("documents", "doc_id"))]
    return similarity.best_match(*sets, threshold=0.3).select("id", "match", six("similarity").alias("similarity"))


_EDGES = """v as (select min(vec_id) as id, embedding::double[] as v from embeddings group by 2),
edge as (select a.id as a, b.id as b, list_dot_product(a.v, b.v) as c from v a join v b on a.id < b.id where list_dot_product(a.v, b.v) >= {cut})"""


@query(f"with {_EDGES.format(cut=LINK_COSINE)} select a, b, round(c, 6) as cosine from edge")
def cosine_pairs(spark, sf_dir):
    """Pairs of distinct vectors at a cosine of 0.35 or more."""
    return similarity.cosine_links(t(spark, sf_dir, "embeddings"), LINK_COSINE).select("a", "b", six("cosine").alias("cosine"))


_THEMES = f"""with recursive {_EDGES.format(cut=THEME_COSINE)},
link as (select a, b from edge union all select b, a from edge),
reach(id, other) as (select a, a from link union select r.id, l.b from reach r join link l on l.a = r.other),
label as (select id, min(other) as root from reach group by id),
theme as (select root, id, count(*) over (partition by root) as n from label qualify n >= 3)"""


def _themes(spark, sf_dir) -> DataFrame:
    return themes.vector_themes(t(spark, sf_dir, "embeddings"), THEME_COSINE)


@query(_THEMES + " select root, n, id from theme")
def theme_clusters(spark, sf_dir):
    """Members of the components of three vectors or more."""
    return _themes(spark, sf_dir)


@query(_THEMES + """ select x.root, x.n, round(avg(list_dot_product(a.v, b.v)), 6) as cohesion
from theme x join theme y on x.root = y.root and x.id < y.id join v a on a.id = x.id join v b on b.id = y.id group by 1, 2""")
def cluster_cohesion(spark, sf_dir):
    """Mean cosine over all member pairs of each theme."""
    return themes.cohesion(_themes(spark, sf_dir), t(spark, sf_dir, "embeddings")).select("root", "n", six("cohesion").alias("cohesion"))


_VALUES = "select vec_id as id, case when label % 5 > 0 then label % 5 end as value from embeddings"


@query(_THEMES + f" select t.root, t.n, max(value) as max_value from theme t left join ({_VALUES}) x on x.id = t.id group by 1, 2 having not coalesce(max(value) < 3, false)")
def cluster_gate(spark, sf_dir):
    """Themes whose highest known value is not under 3."""
    return themes.max_value(_themes(spark, sf_dir), t(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "case when label % 5 > 0 then label % 5 end as value"), 3)


@query("""
with v as (select case when (doc_id + quality) % 7 < 5 then (doc_id + quality) % 7 end as value, case when toxic = 1 then '2026-06-09' else '2026-06-01' end as day from labels),
b as (select case when value is not null then value::varchar when day < '2026-06-08' then 'unknown_before' else 'unknown_after' end as bucket from v),
e as (select unnest(['0', '1', '2', '3', '4', 'unknown_before', 'unknown_after']) as bucket)
select e.bucket, count(b.bucket) as n from e left join b on b.bucket = e.bucket group by 1""")
def value_histogram(spark, sf_dir):
    """Values with two unknown buckets; empty buckets are there."""
    v = t(spark, sf_dir, "labels").selectExpr("case when (doc_id + quality) % 7 < 5 then (doc_id + quality) % 7 end as value", "case when toxic = 1 then '2026-06-09' else '2026-06-01' end as day")
    return themes.value_histogram(v, F.col("day"))


_FLAG_ROWS = """select least(h, m) as a, greatest(h, m) as b, s from (
  select sha256(text) as h, sha256(lower(text)) as m, n_chars as s from documents)"""


@query(f"""select left(a, 1) as bucket, count(*) as n, count(*) filter (a < b) as distinct_sides from (select distinct a, b from ({_FLAG_ROWS})
 where (a, b) not in (select (least(sha256(text), sha256(lower(text))), greatest(sha256(text), sha256(lower(text)))) from documents where doc_id % 3 = 0)) group by 1""")
def flags_insert_ignore(spark, sf_dir):
    """Flags of (text, lower-case text) pairs that are not known yet, once each, by the first digit of their hash."""
    d = t(spark, sf_dir, "documents")
    side = lambda c: F.struct(F.lit("documents").alias("path"), F.lit("2026-01-01").alias("date"), F.sha2(c, 256).alias("hash"))
    pairs = lambda rows: flags.from_pairs(rows.select(side(F.col("text")).alias("a"), side(F.lower("text")).alias("b"), F.lit(1.0).alias("similarity")), "duplicate", "scan", NOW)
    fresh = flags.insert_or_ignore(pairs(d.where("doc_id % 3 = 0")), pairs(d))
    distinct = F.sum((F.col("entry_hash") < F.col("match_hash")).cast("long"))
    return fresh.groupBy(F.left("entry_hash", F.lit(1)).alias("bucket")).agg(F.count("*").alias("n"), distinct.alias("distinct_sides"))


_STATUS = "select event_id, user_id as flag_id, ts as tm, case event_type when 'click' then 'dismissed' when 'purchase' then 'superseded' else 'pending' end as status from events"


@query(f"with e as ({_STATUS}) select flag_id, arg_max(status, {{'a': tm, 'b': event_id}}) as status from e group by 1")
def flags_latest_status(spark, sf_dir):
    """Each flag's status after the last of its events."""
    return flags.latest_status(made(spark, sf_dir, _STATUS, "events").withColumnRenamed("tm", "at"))


@query(f"with e as (select *, lag(status) over (partition by flag_id order by tm, event_id) as was from ({_STATUS})) select status, was, count(*) as n from e where was is null or was <> status group by all")
def flags_status_changes(spark, sf_dir):
    """Transitions between statuses."""
    return flags.status_changes(made(spark, sf_dir, _STATUS, "events").withColumnRenamed("tm", "at")).groupBy("status", "was").agg(F.count("*").alias("n"))


@query("""
with q as (select vec_id as query, embedding::double[] as q, label from embeddings where vec_id % 100 = 0),
r as (select query, q.label, vec_id as id, row_number() over (partition by query order by list_dot_product(embedding::double[], q) desc, vec_id) as pos, e.label = q.label as rel from embeddings e, q where vec_id <> query),
s as (select query, coalesce(count(*) filter (rel and pos <= 5)::double / nullif(count(*) filter (rel), 0), 0) as recall, coalesce(1.0 / min(case when rel and pos <= 50 then pos end), 0) as rr from r group by query)
select count(*) as queries, round(avg(recall), 6) as recall, round(avg(rr), 6) as mrr from s""")
def retrieval_quality(spark, sf_dir):
    """Recall at 5 and reciprocal rank of every hundredth vector as a query against all, labels being relevance."""
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    q = e.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"), F.col("label").alias("wanted"))
    near = search.nearest_many(e.select("id", "v"), q.select("query", "q"), 51).where("id <> query")  # 50 and the query itself
    win = Window.partitionBy("query").orderBy("pos")
    ranked = near.join(e.select("id", "label"), "id").join(q.select("query", "wanted"), "query").select("query", F.row_number().over(win).alias("pos"), (F.col("label") == F.col("wanted")).alias("rel"))
    sizes = e.groupBy("label").agg(F.count("*").alias("c"))
    totals = q.join(sizes, q["wanted"] == sizes["label"]).select("query", (F.col("c") - 1).alias("n"))
    return evaluate.means(evaluate.per_query_counts(ranked.where("pos <= 50"), totals, 5)).select("queries", six("recall").alias("recall"), six("mrr").alias("mrr"))


_GUARD = """select event_id, ts, event_type as rule, case when value > 60 then 'BLOCKED' else 'ALLOWED' end as decision, cast(floor(value * 3) as bigint) as duration_ms,
 case when event_id % 9 = 0 then null else 'tool' || (user_id % 4) end as tool, case when event_id % 7 > 0 then '/home/p' || (user_id % 6) end as cwd,
 'git  push' || chr(9) || ' PROJ-' || (event_id % 50) || ' v' || (event_id % 3) as command from events"""


def _guard(spark, sf_dir) -> DataFrame:
    return made(spark, sf_dir, _GUARD, "events")


@query(f"""with g as ({_GUARD}) select case grouping_id(rule, tool, cwd) when 3 then 'rule' when 5 then 'tool' when 6 then 'cwd' else 'total' end as dimension,
 case grouping_id(rule, tool, cwd) when 3 then rule when 5 then tool when 6 then cwd else 'all' end as value, count(*) as n
from (select rule, coalesce(tool, 'unknown') as tool, coalesce(cwd, 'unknown') as cwd from g) group by grouping sets ((rule), (tool), (cwd), ())""")
def log_counts(spark, sf_dir):
    """Guard-log counts by rule, tool, folder and in total, in one pass."""
    return events.counts(_guard(spark, sf_dir), ["rule", "tool", "cwd"])


@query(f"""with g as (select *, regexp_replace(regexp_replace(command, '[A-Z]+-[0-9]+', 'XXX-NNN', 'g'), '[ \\t]+', ' ', 'g') as pattern from ({_GUARD}) where decision = 'BLOCKED')
select rule, pattern, count(*) as n, arg_min(command, {{'a': ts, 'b': event_id}}) as example, min(ts) as first_ts, max(ts) as last_ts from g group by 1, 2 having count(*) >= 2""")
def log_repeats(spark, sf_dir):
    """Blocked commands that recur but for ids and spaces."""
    return events.repeats(_guard(spark, sf_dir))


@query(f"with g as ({_GUARD}) select decision, count(*) as n from g where ts >= '2024-01-15' and rule = 'click' group by 1")
def log_window(spark, sf_dir):
    """Decisions of one rule since a day."""
    return events.window(_guard(spark, sf_dir), "ts", "2024-01-15", "click").groupBy("decision").agg(F.count("*").alias("n"))


RULES = [(r"PROJ-4\d", "block", "forties"), (r"v0$", "ask", "old version"), (r"PROJ-\d\b", "block", "short id")]


@query(f"""with g as ({_GUARD}), d as (select case when regexp_matches(command, 'PROJ-4\\d') then 'forties' when regexp_matches(command, 'v0$') then 'old version' when regexp_matches(command, 'PROJ-\\d\\b') then 'short id' end as rule from g)
select rule, case when rule is null then 'allow' when rule = 'old version' then 'ask' else 'block' end as decision, count(*) as n from d group by 1, 2""")
def command_rules(spark, sf_dir):
    """Commands by the first rule that matches."""
    return _guard(spark, sf_dir).select(events.decide(F.col("command"), RULES).alias("d")).groupBy("d.rule", "d.decision").agg(F.count("*").alias("n"))


@query(f"""with g as ({_GUARD}), r as (select rule, count(*) filter (duration_ms > 200) as slow, max(duration_ms) as most_ms, count(*) filter (decision = 'BLOCKED') as blocks from g group by 1)
select rule, slow, most_ms, blocks, 'slow' as finding from r where slow > 0 union all select rule, slow, most_ms, blocks, 'frequent block' from r where blocks >= 3""")
def guard_findings(spark, sf_dir):
    """Slow decisions and frequent blocks of a guard log by rule."""
    return events.thresholds(_guard(spark, sf_dir))


@query("""with l as (select *, upper(role) || ': ' || coalesce(text, '') || chr(10) || chr(10) as whole from conversations),
c as (select *, case when length(whole) > 2000 then left(whole, 2000) || '[truncated]' || chr(10) || chr(10) else whole end as line from l),
w as (select *, sum(length(line)) over (partition by conv_id order by turn desc) as size, row_number() over (partition by conv_id order by turn desc) as rn from c)
select conv_id, count(*) as turns, sum(length(line))::bigint as chars, md5(string_agg(line, '' order by turn)) as said from w where size <= 2000 or rn = 1 group by 1""")
def transcript_budget(spark, sf_dir):
    """The text of each conversation's latest turns within 2,000 characters, roles and blank lines included."""
    kept = events.keep_recent_turns(t(spark, sf_dir, "conversations"), "conv_id", "turn", budget=2000)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "")  # 2,000 characters and a line
    return kept.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("line").cast("long")).alias("chars"), F.md5(said).alias("said"))


@query("select conv_id, count(*) as turns from conversations group by 1 having count(*) >= 3")
def transcript_signal(spark, sf_dir):
    """Conversations with enough turns for a summary."""
    return events.enough_turns(t(spark, sf_dir, "conversations"), "conv_id")


#: An observation as a model might return it: the text as summary, sometimes nothing to say, and fields of odd shapes.
_SAID = """to_json(named_struct('summary', case when doc_id % 5 = 0 then 'No significant decisions made.' else text end, 'project', concat(' ', source),
 'decisions', case when doc_id % 5 = 1 then array(lang, source) end, 'corrections', case when doc_id % 5 = 2 then concat(lang, char(9), source) end, 'value_score', doc_id % 7))"""


@query("""with o as (select doc_id, case when doc_id % 5 = 0 then 'No significant decisions made.' else left(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g')), 2000) end as summary,
 left(trim(source), 64) as project, case when doc_id % 5 = 1 then [lang, source] else [] end as decisions, case when doc_id % 5 = 2 then [lang || ' ' || source] else [] end as corrections,
 case when doc_id % 7 <= 4 then (doc_id % 7)::int end as value_score from documents)
select doc_id, md5(summary) as summary, project, array_to_string(decisions, '|') as decisions, array_to_string(corrections, '|') as corrections, value_score,
 len(decisions) + len(corrections) > 0 or (summary <> '' and summary <> 'No significant decisions made.') as signal from o""")
def observation_coercion(spark, sf_dir):
    """Observations of every document brought into shape, and whether they hold anything."""
    o = t(spark, sf_dir, "documents").select("doc_id", reports.observation(F.expr(_SAID)).alias("o"))
    return o.select("doc_id", F.md5("o.summary").alias("summary"), "o.project", F.array_join("o.decisions", "|").alias("decisions"), F.array_join("o.corrections", "|").alias("corrections"), "o.value_score", events.has_signal(F.col("o")).alias("signal"))


KEYWORDS = ("the", "tion", "des la", "er")


@query(" union all ".join(f"select '{k}' as topic, count(*) as n from documents where regexp_matches(lower(text), '(^|[^a-z0-9-]){k}($|[^a-z0-9-])')" for k in KEYWORDS))
def topic_keyword_hits(spark, sf_dir):
    """Documents that hold each keyword as a whole word."""
    d = t(spark, sf_dir, "documents")
    hits = F.filter(F.array(*(F.when(text.keyword_hit(F.col("text"), k), F.lit(k)) for k in KEYWORDS)), lambda x: x.isNotNull())
    every = spark.createDataFrame([(k,) for k in KEYWORDS], "topic string")
    found = d.select(F.explode(hits).alias("topic")).groupBy("topic").agg(F.count("*").alias("c"))
    return every.join(found, "topic", "left").select("topic", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


#: A Markdown file of each document: two entries, and headings that begin none.
_ENTRY = """'# Log' || chr(10) || '## 2026-01-' || lpad(cast(doc_id % 28 + 1 as varchar(2)), 2, '0') || ' — ' || source || ' ' || chr(13) || chr(10) || chr(10) || text || chr(10)
 || '## 2026-03-01 ' || lang || chr(10) || '## 2026-03-02: x' || chr(10) || '##  2026-02-01' || chr(10) || source || chr(10) || '### 2026-02-02' || chr(10)"""


@query(f"""with f as (select doc_id, replace({_ENTRY}, chr(13) || chr(10), chr(10)) as body from documents),
l as (select doc_id, unnest(range(1, len(x) + 1)) as n, unnest(x) as line from (select doc_id, string_split(body, chr(10)) as x from f)),
h as (select *, regexp_matches(line, '^##\\s+\\d{{4}}-\\d{{2}}-\\d{{2}}(?:\\s+—\\s+(.+?))?\\s*$') as head from l),
e as (select *, sum(head::int) over (partition by doc_id order by n) as entry from h),
b as (select doc_id, entry, arg_min(line, n) as first, regexp_replace(string_agg(line, chr(10) order by n), '^\\s+|\\s+$', '', 'g') as raw,
  regexp_replace(coalesce(string_agg(line, chr(10) order by n) filter (not head), ''), '^\\s+|\\s+$', '', 'g') as body from e where entry > 0 group by 1, 2)
select doc_id::varchar as path, regexp_extract(first, '\\d{{4}}-\\d{{2}}-\\d{{2}}') as date, nullif(trim(regexp_extract(first, '—\\s+(.+?)\\s*$', 1)), '') as title, sha256(raw) as hash, md5(body) as body from b""")
def entry_segmentation(spark, sf_dir):
    """Dated entries of a Markdown file made of each document."""
    files = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(_ENTRY).alias("content"))
    return events.entries(files).select("path", "date", "title", "hash", F.md5("body").alias("body"))


_SAMPLES = "select date_trunc('hour', ts) as sample, event_type as server, value as rss from events"


@query(f"""with known as (select distinct sample from ({_SAMPLES}) order by 1 desc limit 240), recent as (select * from ({_SAMPLES}) semi join known using (sample)),
live as (select distinct server from recent where sample = (select max(sample) from known)) select server, round(avg(rss), 6) as mean, round(stddev_pop(rss), 6) as stdev, count(*) as n from recent semi join live using (server) group by 1""")
def server_cost(spark, sf_dir):
    """Mean and deviation of each server over the last 240 samples."""
    s = t(spark, sf_dir, "events").selectExpr("date_trunc('hour', ts) as sample", "event_type as server", "value as rss")
    return telemetry.server_cost(s).select("server", six("mean").alias("mean"), six("stdev").alias("stdev"), "n")


@query(f"""with size as (select server, avg(rss) as m from ({_SAMPLES}) group by 1), many as (select server, avg(copies) as c from (select sample, server, count(*) as copies from ({_SAMPLES}) group by 1, 2) group by 1)
select server, round(m, 6) as mean_rss, round(c, 6) as concurrency, round(m * c, 6) as lever from size join many using (server) order by m * c desc, server limit 1""")
def biggest_lever(spark, sf_dir):
    """The server with the largest mean size times concurrency."""
    s = t(spark, sf_dir, "events").selectExpr("date_trunc('hour', ts) as sample", "event_type as server", "value as rss")
    return telemetry.biggest_lever(s).select("server", *(six(c).alias(c) for c in ("mean_rss", "concurrency", "lever")))


_REG = """case when var_pop(x) = 0 then 0 else regr_slope(y, x) end as slope, case when var_pop(x) = 0 then avg(y) else regr_intercept(y, x) end as intercept,
 case when var_pop(x) = 0 or var_pop(y) = 0 then 0 else regr_r2(y, x) end as r2, count(*) as n"""


@query(f"with r as (select l_returnflag, l_linestatus, {_REG} from (select *, l_quantity as x, l_extendedprice as y from lineitem) group by 1, 2) select l_returnflag, l_linestatus, round(slope, 6) as slope, round(intercept, 4) as intercept, round(r2, 6) as r2, n from r")
def regression_by_group(spark, sf_dir):
    """Price by quantity, by least squares."""
    r = telemetry.regression(t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", "l_linestatus", six("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), six("r2").alias("r2"), "n")


@query("""with d as (select user_id, ts, event_id, value, coalesce(value - lag(value) over w, 0) > 0 as up from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum((not up)::int) over (partition by user_id order by ts, event_id) as run from d), u as (select *, row_number() over w as n, min(value) over w as low from r where up window w as (partition by user_id, run order by ts, event_id))
select user_id, round(arg_min(low, {'a': ts, 'b': event_id}), 6) as onset, min(ts) as reached from u where n = 3 group by 1""")
def onset_runs(spark, sf_dir):
    """Per user the first three growing values in a row, and the least of them."""
    o = telemetry.onset_runs(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", "value")
    return o.select("user_id", six("onset").alias("onset"), "reached")


@query(f"""with r as (select l_suppkey, {_REG} from (select *, l_quantity as x, l_extendedprice as y from lineitem) group by 1)
select l_suppkey, case when slope > 0 then greatest(0, floor((30000000 - 1000000 - greatest(0, intercept)) / slope))::bigint end as sessions from r""")
def session_ceiling(spark, sf_dir):
    """How many units fit below a bound, projected from each supplier's regression."""
    r = telemetry.regression(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return r.select("l_suppkey", scores.ceiling(F.lit(None), F.lit(30000000), F.col("slope"), F.col("intercept"), 1000000).alias("sessions"))


_TREE = "select vec_id as pid, vec_id // 3 as ppid, vec_id % 40 = 0 as is_root, (label + 1) * 100 as rss, case when label % 2 = 0 then 's' || label end as server from embeddings"


@query(f"""with recursive p as ({_TREE}), tree(pid, root) as (select pid, pid from p where is_root union all select p.pid, t.root from p join tree t on p.ppid = t.pid where not p.is_root and p.pid <> p.ppid)
select root, count(*) as procs, sum(rss)::bigint as total, sum(case when p.pid = root then rss else 0 end)::bigint as own, sum(case when p.pid <> root and server is not null then rss else 0 end)::bigint as servers,
 sum(case when p.pid <> root and server is null then rss else 0 end)::bigint as other from tree join p using (pid) group by 1""")
def process_rollup(spark, sf_dir):
    """Sizes below each root of a process forest."""
    p = t(spark, sf_dir, "embeddings").selectExpr("vec_id as pid", "vec_id div 3 as ppid", "vec_id % 40 = 0 as is_root", "cast((label + 1) * 100 as bigint) as rss", "case when label % 2 = 0 then 's' || label end as server")
    return telemetry.tree_rollup(p)


@query("""select user_id, max(floor(epoch(ts))) filter (event_type = 'purchase')::bigint as last_progress, max(floor(epoch(ts)))::bigint as log_end,
 coalesce(max(floor(epoch(ts))::bigint) - max(floor(epoch(ts))::bigint) filter (event_type = 'purchase') > 300, true) as stalled from events group by 1""")
def stall_point(spark, sf_dir):
    """Users whose last purchase is long before their last event."""
    e = t(spark, sf_dir, "events").withColumn("progress", F.col("event_type") == "purchase")
    return telemetry.stall_point(e, "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")))


@query("""with w as (select user_id, count(*) over (partition by user_id order by floor(epoch(ts))::bigint range between 7200 preceding and current row) as n from events) select user_id, max(n) as burst from w group by 1 having max(n) >= 3""")
def bursts(spark, sf_dir):
    """Users with three events or more in two hours."""
    e = t(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return telemetry.bursts(e, "user_id", "at", 7200, 3)


@query("""with n as (select user_id, floor(epoch(ts))::bigint as tm, event_id from events), s as (select *, coalesce(tm - lag(tm) over w > 7200, true)::int as new from n window w as (partition by user_id order by tm, event_id)),
k as (select user_id, sum(new) over (partition by user_id order by tm, event_id) as session, tm from s)
select user_id, max(session)::bigint as sessions, count(*) as n from k group by 1""")
def user_sessions(spark, sf_dir):
    """Sessions of each user, parted by two silent hours."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return events.sessionize(e, "user_id", "at", 7200).groupBy("user_id").agg(F.max("session").alias("sessions"), F.count("*").alias("n"))


@query("""with m as (select o_custkey, date_trunc('month', o_orderdate) as month, avg((o_orderstatus = 'F')::int) as done from orders group by 1, 2)
select o_custkey, month, round(avg(done) over (partition by o_custkey order by month rows between 2 preceding and current row), 6) as rolling from m""")
def rolling_completion(spark, sf_dir):
    """Share of finished orders, averaged over three months of each customer."""
    m = t(spark, sf_dir, "orders").groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("done"))
    return metrics.rolling_mean(m, "o_custkey", "month", "done").select("o_custkey", F.col("month").cast("timestamp_ntz").alias("month"), six("rolling").alias("rolling"))


@query("""with p as (select plan, row_number() over (order by plan) as rank from (select distinct date_trunc('month', o_orderdate) as plan from orders)),
i as (select distinct o_custkey as item, rank from orders join p on p.plan = date_trunc('month', o_orderdate)), s as (select item, rank - row_number() over (partition by item order by rank) as island from i),
r as (select item, island, count(*) as n from s group by 1, 2) select item, max(n) as streak from r group by 1 having max(n) >= 3""")
def chronic_carryover(spark, sf_dir):
    """Customers with orders in three months running or more."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.date_trunc("month", "o_orderdate").alias("plan"))
    plans = o.select("plan").distinct().withColumn("rank", F.row_number().over(Window.orderBy("plan")))  # a row for each month
    return metrics.carryover(o, plans)


_COMMITS = "select l_suppkey as repo, case when l_discount < 0.04 then 'fix' when l_tax > 0.07 then 'revert' else 'feature' end as kind, case when l_linenumber < 6 then l_partkey % 50 end as ticket from lineitem"


@query(f"""with c as ({_COMMITS}), k as (select repo, ticket, count(*) filter (kind = 'fix') as fixes from c where ticket is not null group by 1, 2 having bool_or(kind = 'feature')), f as (select repo, avg(fixes) as m from k group by 1)
select c.repo, count(*) as commits, round(avg((kind = 'fix')::int), 6) as fix_ratio, count(*) filter (kind = 'revert') as reverts, round(any_value(f.m), 6) as fixes_per_ticket from c left join f using (repo) group by 1""")
def commit_scorecard(spark, sf_dir):
    """Fix share, reverts and fixes per feature ticket of each repository."""
    return metrics.scorecard(made(spark, sf_dir, _COMMITS, "lineitem"), "repo").select("repo", "commits", six("fix_ratio").alias("fix_ratio"), "reverts", six("fixes_per_ticket").alias("fixes_per_ticket"))


@query("""with e as (select p_brand, p_size as lo, p_size + 2 as ml, p_size * 2 + 5 as hi from part), s as (select p_brand, sum((lo + 4 * ml + hi) / 6) as expected, sqrt(sum(((hi - lo) / 6) * ((hi - lo) / 6))) as deviation,
 sum(ceil(((lo + 4 * ml + hi) / 6 + (hi - lo) / 6) * 2) / 2) as task_commitments from e group by 1)
select p_brand, round(expected, 6) as expected, round(deviation, 6) as deviation, round(task_commitments, 6) as task_commitments, ceil(round((expected + deviation) * 2, 9)) / 2 as commitment from s""")
def pert_estimates(spark, sf_dir):
    """Three-point estimates summed by brand."""
    p = t(spark, sf_dir, "part").selectExpr("p_brand", "p_size as low", "p_size + 2 as likely", "p_size * 2 + 5 as high")
    return metrics.estimates(p, "p_brand").select("p_brand", *(six(c).alias(c) for c in ("expected", "deviation", "task_commitments")), F.col("commitment").cast("double").alias("commitment"))


_RISK = "0.25 * least(10, l_quantity / 5) + 0.25 * least(10, l_discount * 100) + 0.2 * least(10, l_tax * 100) + 0.15 * least(10, l_linenumber) + 0.15 * least(10, l_extendedprice / 10000)"


@query(f"with r as (select round({_RISK}, 9) as s from lineitem) select case when s < 3 then 'low' when s < 6 then 'medium' when s < 8 then 'high' else 'critical' end as label, count(*) as n, round(avg(s), 6) as mean from r group by 1")
def risk_scores(spark, sf_dir):
    """Weighted risk of line items, by label."""
    c = F.col
    s = F.round(scores.weighted_risk(c("l_quantity") / 5, c("l_discount") * 100, c("l_tax") * 100, c("l_linenumber"), c("l_extendedprice") / 10000), 9)
    return t(spark, sf_dir, "lineitem").select(s.alias("s")).groupBy(scores.risk_label(c("s")).alias("label")).agg(F.count("*").alias("n"), six(F.avg("s")).alias("mean"))


@query("select l_shipmode, p50, p85, median from (select l_returnflag as l_shipmode, quantile_disc(l_extendedprice, 0.5) as p50, quantile_disc(l_extendedprice, 0.85) as p85, round(median(l_extendedprice), 6) as median from lineitem group by 1)")
def nearest_rank_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of prices by flag."""
    r = metrics.nearest_rank(t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return r.select(F.col("l_returnflag").alias("l_shipmode"), "p50", "p85", six("median").alias("median"))


@query("""with c as (select distinct l_partkey as k from lineitem where l_quantity > 49), s as (select distinct p_partkey as k from part where p_size > 25)
select k, 'part' as missing_in from c anti join s using (k) union all select k, 'lineitem' from s anti join c using (k)""")
def drift_warnings(spark, sf_dir):
    """Parts of large orders that are not large themselves, and the other way."""
    c = t(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k"))
    return metrics.drift(c, t(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("k")), "k", ("lineitem", "part"))


@query("""with o as (select distinct l_partkey as p, l_suppkey as s from lineitem where l_shipdate < '1996-01-01'), n as (select distinct l_partkey as p, l_suppkey as s from lineitem where l_shipdate >= '1995-01-01')
select case when o.p is null then 'create' when n.p is null then 'delete' else 'update' end as action, count(*) as n from o full join n on o.p = n.p and o.s = n.s group by 1""")
def sync_diff(spark, sf_dir):
    """create, update and delete between two years' sets of keys."""
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), "l_shipdate")
    return metrics.three_way(rows.where("l_shipdate < '1996-01-01'"), rows.where("l_shipdate >= '1995-01-01'"), ["p", "s"]).groupBy("action").agg(F.count("*").alias("n"))


@query("""with o as (select o_custkey as k, max(o_totalprice) as a, case when count(*) > 8 then min(o_orderpriority) end as b from orders where o_orderkey % 2 = 0 group by 1),
n as (select o_custkey as k, case when count(*) > 7 then max(o_totalprice) end as a, max(o_orderpriority) as b from orders where o_orderkey % 2 = 1 group by 1)
select coalesce(n.k, o.k) as k, coalesce(n.a, o.a) as a, coalesce(n.b, o.b) as b from n full join o on o.k = n.k""")
def snapshot_merge(spark, sf_dir):
    """Two snapshots of customers merged field by field; what is not told stays as it was."""
    o = t(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("a"), F.expr("case when count(*) > 8 then min(o_orderpriority) end").alias("b"))
    new = o.where("o_orderkey % 2 = 1").groupBy(F.col("o_custkey").alias("k")).agg(F.expr("case when count(*) > 7 then max(o_totalprice) end").alias("a"), F.max("o_orderpriority").alias("b"))
    return metrics.merge_snapshots(old, new, "k", ["a", "b"])


@query("""select case when event_type = 'view' then 'orphan' when value > 90 then 'graduate' when user_id % 2 = 0 and date_diff('day', ts::date, date '2024-02-20') > 30 then 'prune' else 'keep' end as action, count(*) as n from events group by 1""")
def memory_lifecycle(spark, sf_dir):
    """What becomes of memory entries."""
    e = t(spark, sf_dir, "events").select((F.col("event_type") != "view").alias("linked"), (F.col("value") > 90).alias("durable"), (F.col("user_id") % 2 == 0).alias("closed"), F.col("ts").cast("date").alias("updated"))
    return metrics.lifecycle(e, F.lit("2024-02-20").cast("date")).groupBy("action").agg(F.count("*").alias("n"))


@query("""with f as (select lang as ext, n_chars as size, doc_id % 97 as born from documents) select ext, count(*) as files, sum(size)::bigint as bytes, round(sum(size) * 100.0 / (select sum(size) from f), 2) as share,
 round(avg(size), 6) as mean_size, min(born) as oldest, max(born) as newest, count(distinct born) as times from f group by 1""")
def extension_report(spark, sf_dir):
    """Sizes by kind of file."""
    f = t(spark, sf_dir, "documents").selectExpr("lang as ext", "n_chars as size", "doc_id % 97 as born")
    return metrics.extension_report(f).withColumn("mean_size", six("mean_size"))


@query("select o_orderpriority as status, count(*) as n from orders where o_orderpriority in ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM') group by 1")
def forward_advance(spark, sf_dir):
    """Items that may move forward to high: those below it."""
    ranks = {"5-LOW": 0, "4-NOT SPECIFIED": 1, "3-MEDIUM": 2, "2-HIGH": 3, "1-URGENT": 4}
    items = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("status"))
    return metrics.advance(items, ranks, "2-HIGH").groupBy("status").agg(F.count("*").alias("n"))


@query("select page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') as title from pages")
def html_title(spark, sf_dir):
    """Titles of pages (an extension)."""
    return t(spark, sf_dir, "pages").select("page_id", F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"))


@query("""with k as (select unnest(list_distinct(regexp_extract_all(command || ' and PROJ-' || (event_id % 7), '\\b[A-Z][A-Z0-9]+-[0-9]+\\b'))) as ticket from (""" + _GUARD + """)) select ticket, count(*) as n from k group by 1""")
def ticket_mentions(spark, sf_dir):
    """Distinct ticket ids of a command and its trailer."""
    g = _guard(spark, sf_dir)
    keys = text.ticket_keys(F.col("command"), F.concat(F.lit("and PROJ-"), (F.col("event_id") % 7).cast("string")))
    return g.select(F.explode(keys).alias("ticket")).groupBy("ticket").agg(F.count("*").alias("n"))


@query("""select u.user_id, u.event_id, (select max(p.ts) from events p where p.user_id = u.user_id and p.event_type = 'purchase' and p.ts <= u.ts) as last_purchase from events u where u.event_type = 'click'""")
def clicks_as_of_purchase(spark, sf_dir):
    """Each click with the last purchase before it (an extension: as-of join)."""
    e = t(spark, sf_dir, "events")
    win = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(win))
    return seen.where("event_type = 'click'").select("user_id", "event_id", "last_purchase")


_LOG = """select user_id as session, user_id * 10 + event_id % 10 as request, event_id as line, ts, event_type as status,
 case when value > 80 then 'ERROR' else 'INFO' end as level, 10 as total, event_id % 7 as done, event_id % 3 as failed, 10 - event_id % 7 - event_id % 3 - case when event_id % 11 = 0 then 1 else 0 end as pending from events"""


@query(f"""with l as ({_LOG}), r as (select session, request, count(*) as lines, min(ts) as first_ts, max(ts) as last_ts, arg_max(status, {{'a': ts, 'b': line}}) as status, count(*) filter (level = 'ERROR') as errors,
 arg_max(total = done + failed + pending, {{'a': ts, 'b': line}}) as adds_up from l group by 1, 2) select * from r""")
def request_rollup(spark, sf_dir):
    """Lines, span, last status, errors and counter integrity of each request of a log."""
    return reports.request_rollup(made(spark, sf_dir, _LOG, "events"))


@query("""with m as (select distinct l_orderkey as ticket from lineitem where l_shipdate >= '1996-01-01' and l_returnflag = 'N'), v as (select distinct o_orderkey as ticket from orders where o_orderpriority = '1-URGENT')
select case when m.ticket is null then 'not merged' when v.ticket is null then 'not in the version' else 'released' end as state, count(*) as n from m full join v using (ticket) group by 1""")
def release_audit(spark, sf_dir):
    """Tickets merged since a day against those of a version."""
    merged = t(spark, sf_dir, "lineitem").where("l_shipdate >= '1996-01-01' and l_returnflag = 'N'").select(F.col("l_orderkey").alias("ticket"))
    tickets = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket"), F.col("o_orderpriority").alias("version"))
    return reports.release_audit(merged, tickets, "1-URGENT").groupBy("state").agg(F.count("*").alias("n"))


@query("""with p as (select user_id as item, min(ts) as promised from events where event_type = 'click' group by 1), d as (select user_id as item, max(ts) as done from events where event_type = 'purchase' group by 1)
select p.item, p.promised, d.done, coalesce(d.done > p.promised, false) as kept from p left join d using (item)""")
def report_continuity(spark, sf_dir):
    """What was promised first, and whether it was done later."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("ts").alias("date"), "event_type")
    return reports.continuity(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"))


@query("""with a as (select distinct user_id as k from events where event_type = 'view'), b as (select distinct c_custkey as k from customer where c_mktsegment = 'BUILDING')
select k, 'unmentioned' as kind from b anti join a using (k) union all select k, 'phantom' from a anti join b using (k)""")
def report_cross_reference(spark, sf_dir):
    """Items without a report, and reports without an item."""
    seen = t(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("k"))
    known = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return reports.cross_reference(seen, known, "k")


@query("""select signal, count(*) as n, min(event_id) as first_id from (
  select 'review-requested' as signal, event_id from events where user_id % 5 = 1 or event_type = 'click'
  union all select 'ci-failed', event_id from events where event_type = 'purchase' or value > 90
  union all select 'merge-conflict', event_id from events where user_id % 4 = 2) group by 1""")
def item_signals(spark, sf_dir):
    """Signals of pull requests, one row each, counted."""
    e, user = t(spark, sf_dir, "events"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))
    reviewers = F.when(F.col("event_type") == "click", F.array(F.lit("u1"), user)).otherwise(F.array(user))
    check = lambda conclusion, state: F.struct(conclusion.cast("string").alias("conclusion"), state.cast("string").alias("state"))
    checks = F.array(check(F.lit("SUCCESS"), F.lit(None)), check(F.when(F.col("event_type") == "purchase", "FAILURE"), F.when(F.col("value") > 90, "ERROR")))
    mergeable = F.when(F.col("user_id") % 4 == 2, "CONFLICTING").when(F.col("user_id") % 4 == 1, "UNKNOWN")
    found = reports.signals(e.select("event_id", reviewers.alias("reviewers"), checks.alias("checks"), mergeable.alias("mergeable")), "u1")
    return found.groupBy("signal").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("select event_type, floor((1706745600 - floor(epoch(ts))) / 86400)::bigint as days, count(*) as n from events group by 1, 2")
def days_stale(spark, sf_dir):
    """Events by their age in whole days."""
    e = t(spark, sf_dir, "events").select("event_type", reports.days_since(F.timestamp_seconds(F.lit(NOW)), F.col("ts").cast("timestamp")).alias("days"))
    return e.groupBy("event_type", "days").agg(F.count("*").alias("n"))


@query("""with w as (select distinct '/' || split_part(url, '/', 3) as path, split_part(split_part(url, '/', 3), '.', 1) as project, min(page_id) over (partition by split_part(url, '/', 3)) as rank from pages where page_id % 2 = 0)
select coalesce(w.project, 'en') as project, count(*) as n from (select distinct page_id, '/' || split_part(url, '/', 3) || '/x/en' as cwd from pages) p
left join w on p.cwd = w.path || '/x/en' group by 1""")
def project_of_folder(spark, sf_dir):
    """Folders by the project whose path stands above them."""
    host = F.split_part(F.col("url"), F.lit("/"), F.lit(3))
    pages = t(spark, sf_dir, "pages")
    watched = pages.where("page_id % 2 = 0").groupBy(F.concat(F.lit("/"), host).alias("path")).agg(F.min(F.split_part(host, F.lit("."), F.lit(1))).alias("project"), F.min("page_id").alias("rank"))
    rows = pages.select("page_id", F.concat(F.lit("/"), host, F.lit("/x/en")).alias("cwd"))
    return reports.project_of_folder(rows, watched).groupBy("project").agg(F.count("*").alias("n"))


@query("""select b.item_id, count(*) as n from benchmark b join documents d on contains(lower(d.text), lower(b.text)) group by 1""")
def ground_truth(spark, sf_dir):
    """Rows that hold each label of an evaluation set."""
    found = reports.containing(t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("label")), t(spark, sf_dir, "documents").select("doc_id", "text"), "label", "text")
    return found.groupBy("item_id").agg(F.count("*").alias("n"))


_WORDS = "select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents"
_PHRASE = "len(list_filter(range(1, len(w)), lambda i: w[i] = '{a}' and w[i + 1] = '{b}'))"


@query(f"""with d as ({_WORDS}), n as (select id, len(w) as n, {_PHRASE.format(a='of', b='the')} as tf0, len(list_filter(w, lambda x: x = 'tion')) as tf1, len(list_filter(w, lambda x: x = 'eau')) as tf2 from d),
s as (select count(*) as docs, avg(n) as mean, {', '.join(f'sum((tf{i} > 0)::int) as df{i}' for i in range(3))} from n)
select id, round({' + '.join(f'ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))' for i in range(3))}, 6) as score from n, s where tf0 > 0 and not tf1 > 0 or tf2 > 0""")
def phrase_search(spark, sf_dir):
    """All documents with two words in a row and without a third, or with a fourth, and their scores."""
    found = search.bm25(t(spark, sf_dir, "documents"), fulltext.parse('"of the" NOT tion OR eau'))
    return found.select("id", six("score").alias("score"))


@query(_bm25_sql(TERMS, 1) + " select id, round(score, 6) as score from found")
def index_search(spark, sf_dir):
    """All documents with any of three words, from an index of postings that is written first."""
    index = fulltext.Index(scratch.new_path(spark, "index"))
    fulltext.apply_changes(spark, index, t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return search.search_index(spark, index, fulltext.any_of(TERMS)).select("id", six("score").alias("score"))


def _grammar_sql(counts: list[str], wanted: str, rows: str = _WORDS, length: str = "len(w)") -> str:
    """Scores of rows by the number of times that each phrase of a query occurs in them."""
    tf = ", ".join(f"{c} as tf{i}" for i, c in enumerate(counts))
    df = ", ".join(f"sum((tf{i} > 0)::int) as df{i}" for i in range(len(counts)))
    score = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(counts)))
    return f"with d as ({rows}), n as (select id, {length} as n, {tf} from d), s as (select count(*) as docs, avg(n) as mean, {df} from n) select id, round({score}, 6) as score from n, s where {wanted}"


_WORD = "len(list_filter(w, lambda x: x = '{}'))"
_BEGINS = "len(list_filter(w, lambda x: starts_with(x, '{}')))"
_NEXT = "len(list_filter(range(1, len(w)), lambda i: w[i] = '{}' and starts_with(w[i + 1], '{}')))"


@query(_grammar_sql([_WORD.format("tion"), _WORD.format("eau"), _WORD.format("thtion"), _WORD.format("ing"), _PHRASE.format(a="of", b="the")], "(tf0 > 0 or tf1 > 0) and not (tf2 > 0 or tf3 > 0 and not tf4 > 0)"))
def bracket_search(spark, sf_dir):
    """All documents for a query with brackets in brackets, found in their texts."""
    query_ = fulltext.parse('(tion OR eau) NOT (thtion OR (ing NOT "of the"))')
    return search.bm25(t(spark, sf_dir, "documents"), query_).select("id", six("score").alias("score"))


@query(_grammar_sql([_BEGINS.format("thti"), _NEXT.format("of", "th"), _BEGINS.format("eau")], "(tf0 > 0 or tf1 > 0) and not tf2 > 0"))
def prefix_search(spark, sf_dir):
    """All documents with words that begin in some way, alone and at the end of a phrase, from an index of segments."""
    index = fulltext.Index(scratch.new_path(spark, "index"))
    fulltext.apply_changes(spark, index, t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return search.search_index(spark, index, fulltext.parse('(thti* OR "of th"*) NOT eau*')).select("id", six("score").alias("score"))


_TITLED = "select doc_id as id, regexp_extract_all(lower(left(text, 60)), '[a-z0-9]+') as a, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents"


@query(_grammar_sql(["len(list_filter(a, lambda x: x = 'the'))", _WORD.format("ing"), "(a[1] = 'the')::int + (w[1] = 'the')::int"], "tf0 > 0 and tf1 > 0 or coalesce(tf2, 0) > 0", _TITLED, "len(a) + len(w)"))
def column_search(spark, sf_dir):
    """All documents for words in one column or the other, or at the beginning of any, from an index of two columns."""
    index = fulltext.Index(scratch.new_path(spark, "index"), ("title", "body"))
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(60)).alias("title"), F.col("text").alias("body"))
    fulltext.apply_changes(spark, index, docs)
    query_ = fulltext.parse("title : the AND {body} : (ing) OR ^ the", columns=index.columns)
    return search.search_index(spark, index, query_).select("id", six("score").alias("score"))


_HYBRID_TERMS = 3


@query(f"""
with w as (select doc_id as id, text, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
d as (select id, text, len(w) as n, w from w), s as (select count(*) as docs, avg(n) as mean from d),
item as (select item_id as query, text, regexp_extract_all(lower(text), '[a-z0-9]+')[1:{_HYBRID_TERMS}] as terms from benchmark),
asked as (select distinct query, unnest(terms) as term from item),
freq as (select term, count(*) as df from (select distinct id, unnest(w) as term from d) group by 1),
hit as (select a.query, d.id, d.n, a.term, len(list_filter(w, lambda x: x = a.term)) as tf, f.df from asked a join freq f using (term) join d on list_contains(d.w, a.term)),
found as (select query, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as score
  from hit, s group by query, id having count(*) = (select count(*) from asked a where a.query = hit.query)),
kw as (select query, id, row_number() over (partition by query order by score desc, id) as fts_pos from found qualify fts_pos <= 40),
near as (select i.query, e.vec_id as id, row_number() over (partition by i.query order by list_dot_product(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) as vec_pos
  from item i join embeddings q on q.vec_id = i.query, embeddings e qualify vec_pos <= 40),
pair as (select coalesce(kw.query, near.query) as query, coalesce(kw.id, near.id) as id, fts_pos, vec_pos from kw full join near on kw.id = near.id and kw.query = near.query),
stats as ({_STATS}),
rows as (select p.query, p.id, coalesce(1.0 / (60 + fts_pos), 0) + coalesce(1.0 / (60 + vec_pos), 0) as rrf, {NOW} - 86400 * (p.id % 90) as indexed_at, last_accessed, access_count,
  case when contains(lower('Document ' || p.id), array_to_string(terms, ' ')) then 0.016 when contains(lower(w.text), array_to_string(terms, ' ')) then 0.008 else 0 end as exact
  from pair p join w on w.id = p.id join item using (query) left join stats s on s.id = p.id),
best as (select query, id, row_number() over (partition by query order by rrf + {_BONUS.format(now=NOW)} + exact desc, rrf desc, indexed_at desc, id) as pos from rows qualify pos <= 10),
relevant as (select item_id as query, doc_id as id from benchmark b join documents d on contains(lower(d.text), lower(b.text))),
each as (select i.query, coalesce((select count(*) filter (b.pos <= 5)::double / count(*) from relevant r left join best b on b.query = r.query and b.id = r.id where r.query = i.query), 0) as recall,
  coalesce(1.0 / (select min(b.pos) from relevant r join best b on b.query = r.query and b.id = r.id where r.query = i.query), 0) as rr from item i)
select count(*) as queries, round(avg(case when isnan(recall) then 0 else recall end), 6) as recall, round(avg(rr), 6) as mrr from each""")
def hybrid_evaluation(spark, sf_dir):
    """Recall at 5 and reciprocal rank of the whole hybrid search: the first words of each benchmark item and a vector as
    the query, the documents that hold the item as what is relevant. All queries are searched at once."""
    docs, items = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    index = fulltext.Index(scratch.new_path(spark, "index"))
    fulltext.apply_changes(spark, index, docs.select(F.col("doc_id").alias("id"), "text"))
    asked = items.select(F.col("item_id").alias("query"), F.slice(text.tokens(F.col("text")), 1, _HYBRID_TERMS).alias("terms"))
    asked = asked.withColumn("words", F.array_join("terms", " "))
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = search.nearest_many(e, e.join(items.select(F.col("item_id").alias("id")), "id").select(F.col("id").alias("query"), F.col("v").alias("q")), search.pool_size(10))
    rows = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), F.col("text").alias("content"), (NOW - 86400 * (F.col("doc_id") % 90)).alias("indexed_at"))
    ranked = search.hybrid_many(fulltext.search_many(spark, index, asked, search.pool_size(10)), near, asked, rows, search.access_stats(t(spark, sf_dir, "events")), NOW, 10)
    truth = reports.containing(items.select(F.col("item_id").alias("query"), F.col("text").alias("label")), docs.select(F.col("doc_id").alias("id"), "text"), "label", "text")
    scored = evaluate.per_query(ranked, truth, 5)
    every = asked.select("query").join(scored, "query", "left").fillna(0.0, ["recall", "rr"])
    return evaluate.means(every).select("queries", six("recall").alias("recall"), six("mrr").alias("mrr"))


_CHANGED = "select doc_id as id, regexp_extract_all(lower(case when doc_id % 5 = 1 then text || ' eau tion' else text end), '[a-z0-9]+') as w from documents where doc_id % 7 > 0"


@query(_grammar_sql([_WORD.format("tion"), _WORD.format("eau")], "tf0 > 0 and tf1 > 0", _CHANGED))
def changed_index_search(spark, sf_dir):
    """All documents with two words, from an index that was written in parts: some rows then changed, others were deleted."""
    index = fulltext.Index(scratch.new_path(spark, "index"))
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    for part in range(4):
        fulltext.apply_changes(spark, index, docs.where(F.pmod("id", F.lit(4)) == part))
    changed = docs.where("id % 5 = 1").withColumn("text", F.concat("text", F.lit(" eau tion")))
    fulltext.apply_changes(spark, index, changed, deleted=docs.where("id % 7 = 0 and id % 5 <> 1"))
    fulltext.apply_changes(spark, index, deleted=docs.where("id % 7 = 0"))
    return search.search_index(spark, index, fulltext.parse("tion eau")).select("id", six("score").alias("score"))


_ENTRIES = "select doc_id as id, source as path, '2026-01-' || lpad(cast(doc_id % 28 + 1 as varchar(2)), 2, '0') as date, sha256(text) as hash, doc_id as place from documents"


@query(f"""with e as ({_ENTRIES}), f as (select a.path as source_path, a.date as entry_date, case when a.id % 9 = 0 then 'edited' else a.hash end as entry_hash, b.path as match_path, b.date as match_date, b.hash as match_hash,
 case when a.id % 4 = 0 then 'dismissed' else 'pending' end as status from e a join e b on b.id = a.id + 1 where a.id % 3 = 0)
select f.entry_hash, f.match_hash, a.place as entry_place, b.place as match_place from f join e a on a.path = f.source_path and a.date = f.entry_date and a.hash = f.entry_hash
 join e b on b.path = f.match_path and b.date = f.match_date and b.hash = f.match_hash where f.status = 'pending'""")
def flags_relocate(spark, sf_dir):
    """Pending flags with the places where both of their entries are now; those with an edited side are gone."""
    sha = "sha2(text, 256)"
    e = t(spark, sf_dir, "documents").selectExpr("doc_id as id", "source as path", "'2026-01-' || lpad(cast(doc_id % 28 + 1 as string), 2, '0') as date", f"{sha} as hash", "doc_id as place")
    a = e.where("id % 3 = 0").selectExpr("id + 1 as next", "path as source_path", "date as entry_date", "case when id % 9 = 0 then 'edited' else hash end as entry_hash", "case when id % 4 = 0 then 'dismissed' else 'pending' end as status")
    b = e.selectExpr("id as next", "path as match_path", "date as match_date", "hash as match_hash")
    return flags.relocate(a.join(b, "next"), e).select("entry_hash", "match_hash", "entry_place", "match_place")


@query("""select vec_id as id, round(case when label = 0 then -embedding[1]::double else embedding[1]::double end, 6) as x from embeddings
 union all select vec_id + 1000000, round(-embedding[1]::double, 6) from embeddings where label = 0 and vec_id % 2 = 0""")
def vector_replace(spark, sf_dir):
    """Vectors after those of one label, and some that were not there, have been embedded again."""
    v = t(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "cast(embedding[0] as double) as x", "label")
    again = v.where("label = 0").selectExpr("id", "-x as x")
    fresh = again.union(again.where("id % 2 = 0").selectExpr("id + 1000000", "x"))
    return ingest.replace_vectors(v.select("id", "x"), fresh).select("id", six("x").alias("x"))


@query(f"""with s as (select user_id as id, ts from events union all select distinct user_id, timestamp '2024-02-01' from events where event_type = 'purchase')
select id, count(*) as access_count, max(floor(epoch(ts)))::bigint as last_accessed from s group by 1""")
def access_bump(spark, sf_dir):
    """The access log's sums after some ids have been returned by a search."""
    e = t(spark, sf_dir, "events")
    hits = e.where("event_type = 'purchase'").select(F.col("user_id").alias("id")).distinct()
    bump = api.access_bump(hits, NOW).select("user_id", F.col("ts").cast("timestamp"))
    return search.access_stats(e.select("user_id", F.col("ts").cast("timestamp")).unionByName(bump)).select("id", "access_count", "last_accessed")


_NOTE = """case when doc_id % 6 > 0 then '---' || chr(10) || 'project: "' || source || '"' || chr(10) || case when doc_id % 4 > 0 then 'date: 2026-02-0' || cast(doc_id % 9 + 1 as varchar(2)) || chr(10) else '' end
 || 'value_score: ' || cast(doc_id % 7 as varchar(2)) || chr(10) || '---' || chr(10) else '' end || case when doc_id % 5 > 0 then '# Note of ' || lang || ' ' || chr(10) else '' end
 || '## Summary' || chr(10) || replace(substr(text, 1, 500), '#', '') || chr(10) || '## Next' || chr(10) || 'x'"""


@query(f"""with n as (select doc_id, {_NOTE} as note, 'e/2026-03-0' || (doc_id % 9 + 1) || '-' || doc_id || '.md' as path from documents),
f as (select *, regexp_extract(note, '^---\\n((?s:.*?))\\n---\\n', 1) as block, regexp_replace(note, '^---\\n(?s:.*?)\\n---\\n', '') as body from n)
select doc_id, nullif(regexp_extract(block, '(?m)^project: "(.*)"$', 1), '') as project, case when regexp_extract(block, '(?m)^value_score: (\\d)$', 1) in ('0', '1', '2', '3', '4') then regexp_extract(block, '(?m)^value_score: (\\d)$', 1)::int end as value_score,
 coalesce(nullif(regexp_extract(block, '(?m)^date: (\\S+)$', 1), ''), path[3:12]) as date, coalesce(nullif(regexp_extract(body, '(?m)^# (.+?) *$', 1), ''), split_part(path, '/', 2)) as title,
 md5(left(regexp_replace(regexp_extract(body, '(?s)## Summary\\n(.*)\\n## Next', 1), '^\\s+|\\s+$', '', 'g'), 300)) as summary, md5(case when length(body) > 240 then left(body, 240) || '…' else body end) as snippet from f""")
def note_fields(spark, sf_dir):
    """Front matter, date, title, summary and snippet of a Markdown note made of each document."""
    n = t(spark, sf_dir, "documents").select("doc_id", F.expr(_NOTE).alias("note"), F.expr("concat('e/2026-03-0', doc_id % 9 + 1, '-', doc_id, '.md')").alias("path")).withColumn("f", text.front_matter(F.col("note")))
    block, body = F.col("f.block"), F.col("f.body")
    get = lambda name: text.front_matter_field(block, name)
    return n.select("doc_id", get("project").alias("project"), text.value_score(get("value_score")).alias("value_score"), text.entry_date(get("date"), F.col("path")).alias("date"), text.title_of(body, F.col("path")).alias("title"), F.md5(text.summary_of(body)).alias("summary"), F.md5(text.char_snippet(body)).alias("snippet"))


_EPISODES = "select '2026-0' || (doc_id % 3 + 4) || '-1' || (doc_id % 10) as date, case when (doc_id + quality) % 6 < 5 then ((doc_id + quality) % 6)::int end as value_score, 's' || doc_id as session_id, 'e/' || doc_id || '.md' as path, toxic = 1 as promoted from labels"


@query(f"with e as ({_EPISODES}) select row_number() over (order by coalesce(value_score, 4) desc, date desc, path) as place, path from e where not promoted order by 1 limit 50")
def backlog_order(spark, sf_dir):
    """The fifty episodes that a live scan of a long backlog takes."""
    some = themes.backlog(_episodes(spark, sf_dir), 50, live=True)
    return search.numbered(some, [F.desc(F.coalesce("value_score", F.lit(4))), F.desc("date"), F.asc("path")], "place", 50).select(F.col("place").cast("long").alias("place"), "path")


def _episodes(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "labels").selectExpr("concat('2026-0', doc_id % 3 + 4, '-1', doc_id % 10) as date", "case when (doc_id + quality) % 6 < 5 then cast((doc_id + quality) % 6 as int) end as value_score", "concat('s', doc_id) as session_id", "concat('e/', doc_id, '.md') as path", "toxic = 1 as promoted")


@query(f"with e as ({_EPISODES}) select date, session_id, count(*) over () as n from e where date >= '2026-05-12' and not promoted order by date desc, session_id desc limit 20")
def stale_episodes(spark, sf_dir):
    """The latest of the episodes of some weeks that have not been promoted, by date and session, and how many there are."""
    found = reports.stale(_episodes(spark, sf_dir), F.lit("2026-06-30").cast("date"), 49)
    n = F.broadcast(found.agg(F.count("*").alias("n")))  # one row
    return found.crossJoin(n).orderBy(F.desc("date"), F.desc("session_id")).limit(20).select("date", "session_id", "n")


_COMMANDS = """case label when 0 then 'npx -y @scope/slack-mcp@1.2.0 --port ' || vec_id when 1 then 'node /srv/t' || (vec_id % 5) || '-mcp/dist/index.js' when 2 then '/home/u/.local/bin/agent --x'
 when 3 then '/opt/versions/1.2.' || (vec_id % 3) || ' --session-id a --resume' when 4 then '/home/u/.local/bin/agent daemon run' when 5 then 'node /x/resource-sampler.js'
 when 6 then '/opt/bin/mcp-files-darwin-arm64 --root /' when 7 then 'uvx mcp-time@latest' when 8 then 'node /tools/mcp-sonar/index.mjs' else '/usr/bin/python serve.py' end"""


@query(f"""with p as (select vec_id as pid, label, {_COMMANDS} as command from embeddings)
select case label when 2 then 'interactive' when 3 then 'forked' when 4 then 'infra' when 5 then 'self' when 9 then 'other' else 'server' end as kind,
 case label when 0 then 'slack-mcp' when 1 then 't' || (pid % 5) || '-mcp' when 6 then 'mcp-files' when 7 then 'mcp-time' when 8 then 'mcp-sonar' end as server, count(*) as n from p group by all""")
def process_kinds(spark, sf_dir):
    """Processes by kind and server, told by their command lines."""
    p = t(spark, sf_dir, "embeddings").select(F.expr(_COMMANDS).alias("command"))
    return telemetry.process_kinds(p).groupBy("kind", "server").agg(F.count("*").alias("n"))


@query("""select vec_id, (vec_id % 100 + 1) * 4096 as free_bytes, (vec_id % 100 + 1 + case when vec_id % 3 > 0 then label else 0 end + vec_id % 7 + 5) * 4096 as available_bytes, label * 2 * 4096 as compressor_bytes from embeddings""")
def memory_arithmetic(spark, sf_dir):
    """Free, available and compressed bytes from page counts."""
    m = t(spark, sf_dir, "embeddings").selectExpr("vec_id", "named_struct('page_size', 4096L, 'pages_free', vec_id % 100 + 1, 'pages_inactive', case when vec_id % 3 > 0 then cast(label as bigint) end, 'pages_speculative', vec_id % 7, 'pages_purgeable', 5L, 'pages_occupied_by_compressor', cast(label as bigint) * 2) as m")
    return m.select("vec_id", telemetry.memory_of(F.col("m")).alias("b")).select("vec_id", "b.*")


@query("""with p as (select user_id % 40 as project, count(*) filter (event_type = 'click') as commits, count(*) filter (event_type = 'view') as prs, count(*) filter (event_type = 'signup') as tickets from events group by 1),
r as (select *, row_number() over (order by commits + prs + tickets desc, commits desc, project) as place from p)
select place, project, commits + prs + tickets as activity, (select count(*) from p) - 8 as more from r where place <= 8""")
def top_projects(spark, sf_dir):
    """The eight most active projects, and how many more there are."""
    count = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    p = t(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("project")).agg(count("click").alias("commits"), count("view").alias("prs"), count("signup").alias("tickets"))
    order = [F.desc("activity"), F.desc("commits"), F.asc("project")]
    top, more = reports.top_with_rest(reports.recent_activity(p), order)
    return search.numbered(top, order, "place", 8).select(F.col("place").cast("long").alias("place"), "project", "activity", F.lit(more).cast("long").alias("more"))


@query("select conv_id, count(distinct role) as roles, count(distinct left(text, 3)) as files from conversations group by 1")
def distinct_projects(spark, sf_dir):
    """Distinct roles and first letters of each conversation."""
    return events.distinct_counts(t(spark, sf_dir, "conversations").withColumn("start", F.left("text", F.lit(3))), "conv_id", {"role": "roles", "start": "files"})


@query("select case when s >= 90 then 'strong' when s >= 70 then 'sound' when s >= 50 then 'weak' else 'poor' end as band, count(*) as n from (select l_quantity * 2 as s from lineitem) group by 1")
def quality_bands(spark, sf_dir):
    """Scores by the band that they reach."""
    return t(spark, sf_dir, "lineitem").groupBy(reports.banded(F.col("l_quantity") * 2).alias("band")).agg(F.count("*").alias("n"))


@query("""with was as (select o_custkey as item, max(o_orderpriority) as status from orders where o_orderkey % 2 = 0 group by 1), now as (select distinct o_custkey as item from orders where o_orderkey % 3 = 0)
select coalesce(was.status, 'new') as status, count(*) as n from now left join was using (item) group by 1""")
def plan_items(spark, sf_dir):
    """The next list of items with the status that each had before."""
    o = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "item")
    was = o.where("o_orderkey % 2 = 0").groupBy("item").agg(F.max("o_orderpriority").alias("status"))
    now = o.where("o_orderkey % 3 = 0").select("item").distinct().withColumn("status", F.lit("new"))
    return metrics.plan_items(was, now, "item").groupBy("status").agg(F.count("*").alias("n"))


@query("select count(distinct case when n > 1 then h end) as twice, max(s)::bigint as most from (select count(*) over (partition by sha256(text)) as n, sha256(text) as h, count(*) over (partition by source) as s from documents)")
def most_sessions(spark, sf_dir):
    """Texts that occur twice or more, and the most documents of any source."""
    d = t(spark, sf_dir, "documents")
    most = telemetry.most_sessions(d.groupBy("source").agg(F.count("*").alias("sessions")))
    return similarity.exact_duplicates(d).agg(F.count("*").alias("twice")).crossJoin(most)  # a row each


_SKILL = """case doc_id % 6 when 0 then '' else '---' || chr(10) end || case doc_id % 6 when 1 then 'colour: red' || chr(10) when 2 then 'name: Bad Name' || chr(10) else 'name: ' || source || chr(10) end
 || case doc_id % 6 when 3 then 'model: x' || chr(10) when 4 then 'description: >' || chr(10) || '  I can help.' || chr(10) || '  ' || lang || chr(10) else 'description: checks ' || lang || chr(10) end
 || case doc_id % 6 when 5 then '' else '---' || chr(10) end || '- one because' || chr(10) || '* ' || replace(substr(text, 1, 300), chr(10), chr(10) || '- ') || chr(10) || '```' || chr(10) || '- code' || chr(10) || '```' || chr(10) || '3) so that' || chr(10)"""


@query(f"""with d as (select doc_id, {_SKILL} as content, source from documents),
l as (select doc_id, unnest(range(len(x))) as i, unnest(x) as line from (select doc_id, string_split(content, chr(10)) as x from d)),
e as (select doc_id, min(i) filter (i > 0 and line = '---') as close, bool_or(i = 0 and line = '---') as open from l group by 1),
b as (select l.*, e.open, case when open then close end as close from l join e using (doc_id)),
steps as (select doc_id, count(*) as n, count(*) filter (regexp_matches(lower(line), 'because|so that|to avoid|to prevent|to ensure|since |otherwise|this ensures|this prevents|which ensures')) as k
 from b where (close is null or i > close) and regexp_matches(rtrim(line), '^(?:[-*]\\s+|\\d+[.)]\\s+)') and line <> '- code' group by 1)
select doc_id, case when doc_id % 6 in (0, 5, 1) then 0 when doc_id % 6 = 3 then 1 else 2 end as fields, doc_id % 6 not in (2) as name_ok, doc_id % 6 in (1, 2) as told_ok,
 n as instructions, k as reasons, case when k = 0 then 0 when k::double / n <= 0.25 then 1 when k::double / n <= 0.5 then 2 else 3 end as reason_score from d join steps using (doc_id) where doc_id % 6 <> 5""")
def lint_documents(spark, sf_dir):
    """The lint of a skill document made of each document, as far as its front matter is closed."""
    d = t(spark, sf_dir, "documents").where("doc_id % 6 <> 5").select("doc_id", F.concat(F.lit("s/own/"), F.col("doc_id")).alias("path"), F.expr(_SKILL).alias("content"))
    found = reports.lint(d.select("path", "content"))
    cut = found.select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("doc_id"), *found.columns[1:])
    return cut.select("doc_id", "fields", "name_ok", "told_ok", *(F.col(c).cast("long").alias(c) for c in ("instructions", "reasons")), "reason_score")


_DOWNLOADS = """select user_id as session, cast(floor(epoch(ts)) as bigint) as ts, case event_type when 'click' then 'request.download.started' when 'view' then 'batch.counter.increment' when 'signup' then 'request.download.completed' else 'x' end as event,
 case when value > 85 then 'P3RM_GENERIC' when value > 60 then 'DLW_11' when value < 5 then 'APP_02' end as code, case when value between 50 and 52 then 'ERROR' end as status from events"""


@query(f"""with l as ({_DOWNLOADS}), s as (select session, count(*) filter (event = 'request.download.started') as started, count(*) filter (event = 'request.download.completed') as completed, count(*) filter (code = 'P3RM_GENERIC') as saturated,
 count(*) filter (code = 'DLW_11') as failed, min(ts) filter (code = 'APP_02') as crashed, max(ts) filter (event like 'request.download%' or event = 'batch.counter.increment') as download, max(ts) filter (event = 'batch.counter.increment') as counted,
 min(ts) filter (status = 'ERROR') as wrong, max(ts) as log_end, min(ts) as log_start from l group by 1)
select session, unnest(list_filter([case when started > 0 and completed = 0 then 'stalled request' end, case when saturated >= 3 then 'path worker saturated' end, case when crashed = log_start and coalesce(download <= crashed, true) then 'startup crash' end,
 case when log_end - counted > 300 then 'stall point' end, case when started > 0 and completed = 0 and failed = 0 then 'downloads work' end, case when failed >= 20 then 'many failures' end, case when counted > wrong then 'status stuck' end], lambda x: x is not null)) as finding from s""")
def log_triage(spark, sf_dir):
    """What a download log made of each user's events shows."""
    e = t(spark, sf_dir, "events").withColumn("epoch_s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return reports.log_triage(spark.sql(_DOWNLOADS.replace("cast(floor(epoch(ts)) as bigint)", "epoch_s").replace("from events", "from {source}"), source=e))


@query(f"with l as ({_DOWNLOADS}) select session, code, count(*) as n from l where code is not null group by 1, 2 having count(*) > case when code = 'APP_02' then 1 else 0 end")
def notable_codes(spark, sf_dir):
    """Error codes of that log that are not its usual noise."""
    e = t(spark, sf_dir, "events").withColumn("epoch_s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    log = spark.sql(_DOWNLOADS.replace("cast(floor(epoch(ts)) as bigint)", "epoch_s").replace("from events", "from {source}"), source=e)
    return reports.notable_codes(log.withColumn("message", F.lit("")))


_MESSAGES = "select lang as author, doc_id as day, case when doc_id % 7 = 0 then 2 else 1 end as parents, case doc_id % 5 when 0 then 'Fix: ' || source when 1 then 'Revert ' || source when 2 then 'Add' || chr(10) || 'Fix lint of ' || source else substr(text, 1, 60) end as message from documents"


@query(f"""with m as ({_MESSAGES}) select author, count(*) as n, count(*) filter (regexp_matches(message, '(?m)^Fix')) as fixes, count(*) filter (regexp_matches(message, 'SonarQube|sonar|[Ll]int|[Pp]rettier|[Cc]heckstyle|Copilot|unused import|unused variable|[Rr]emove unused')) as reactive,
 count(*) filter (regexp_matches(message, '(?m)^Revert')) as reverts from m where parents < 2 and day >= 100 and day < 900 group by 1""")
def commit_kinds(spark, sf_dir):
    """Fixes, clean-ups and reverts of commits made of documents, merges left out, by author."""
    found = metrics.commit_kinds(made(spark, sf_dir, _MESSAGES, "documents").withColumnRenamed("day", "at"), since=100, until=900)
    return found.groupBy("author").agg(F.count("*").alias("n"), F.sum(F.col("is_fix").cast("long")).alias("fixes"), F.sum(F.col("is_reactive").cast("long")).alias("reactive"), F.sum(F.col("is_revert").cast("long")).alias("reverts"))


@query("""with c as (select distinct o_custkey as ticket from orders where o_orderstatus = 'F'), s as (select c_custkey as ticket from customer where c_mktsegment = 'BUILDING')
select count(*) as total, count(s.ticket) as sprint, (count(*) - count(s.ticket))::double / count(*) as share, (count(*) - count(s.ticket))::double / count(*) > 0.6 and count(s.ticket) = 0 as warning from c left join s using (ticket)""")
def sprint_drift(spark, sf_dir):
    """How much of what was completed was of the sprint."""
    done = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("ticket")).distinct()
    return metrics.sprint_drift(done, t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ticket")))


@query("""with s as (select user_id as item, count(distinct ts::date) as days from events where event_type = 'view' group by 1 having count(distinct ts::date) >= 5)
select item, days from s where item not in (select user_id from events where event_type = 'purchase' and value > 80)""")
def stale_stack(spark, sf_dir):
    """Items on five days or more that were never taken up."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("ts").cast("date").alias("day"), "event_type", "value")
    return metrics.stale_stack(e.where("event_type = 'view'"), e.where("event_type = 'purchase' and value > 80"))


@query("select user_id % 50 as person, event_type as ticket, date_diff('day', min(ts)::date, max(ts)::date) as days from events where value > 97 group by 1, 2 having date_diff('day', min(ts)::date, max(ts)::date) > 2")
def blocker_stalls(spark, sf_dir):
    """Blockers that stand for more than two days."""
    e = t(spark, sf_dir, "events").where("value > 97").select((F.col("user_id") % 50).alias("person"), F.col("event_type").alias("ticket"), F.col("ts").cast("date").alias("day"))
    return metrics.blocker_stalls(e).withColumn("days", F.col("days").cast("long"))


@query("select o_custkey as who, count(*) as n from orders where o_orderstatus = 'O' group by 1 having count(*) > 1")
def open_work(spark, sf_dir):
    """Customers with more than one open order."""
    return metrics.open_work(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), (F.col("o_orderstatus") == "O").alias("open")), "who")


@query("""with m as (select user_id as ticket, event_type as "to", lag(event_type) over (partition by user_id order by ts, event_id) as "from" from events)
select ticket, count(*) as bounces from m where "from" = 'purchase' and "to" = 'click' and ticket % 2 = 0 group by 1""")
def qa_bounces(spark, sf_dir):
    """Tickets that went back from test, of those in flight."""
    win = Window.partitionBy("user_id").orderBy("ts", "event_id")
    name = lambda c: F.when(c == "purchase", "In Test").when(c == "click", "In Progress").otherwise(c)
    m = t(spark, sf_dir, "events").select(F.col("user_id").alias("ticket"), name(F.col("event_type")).alias("to"), name(F.lag("event_type").over(win)).alias("from"))
    return metrics.qa_bounces(m, m.where("ticket % 2 = 0").select("ticket").distinct())


@query("""with w as (select case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 else 4 end as rank, o_orderstatus as priority, o_orderkey as ticket from orders where o_orderpriority <> '5-LOW')
select rank, priority, ticket from w order by 1, 2, 3 limit 7""")
def priority_order(spark, sf_dir):
    """The seven items of the day."""
    kinds = {"1-URGENT": "sprint", "2-HIGH": "in progress", "3-MEDIUM": "labelled defect", "4-NOT SPECIFIED": "unassigned defect"}
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("o_orderpriority")]
    return metrics.priority_order(t(spark, sf_dir, "orders").select(kind.alias("kind"), F.col("o_orderstatus").alias("priority"), F.col("o_orderkey").alias("ticket"))).select("rank", "priority", "ticket")


@query("""with b as (select l_orderkey * 10 + l_linenumber as batch, l_quantity::bigint as items, case when l_linenumber = 2 then l_quantity::bigint else (l_quantity - l_linenumber)::bigint + 2 end as downloaded, l_linenumber - 1 as failed, (l_tax * 700)::bigint as verified, l_linestatus = 'F' as completed from lineitem)
select fault, count(*) as n from (select unnest(list_filter([case when downloaded + failed > items then 'more done than there are' end, case when downloaded > items then 'counted twice' end, case when verified > downloaded then 'verified before downloaded' end,
 case when downloaded = items and not completed then 'no completion' end], lambda x: x is not null)) as fault from b) group by 1""")
def counter_faults(spark, sf_dir):
    """Counters that cannot be right."""
    b = t(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as batch", "cast(l_quantity as bigint) as items", "case when l_linenumber = 2 then cast(l_quantity as bigint) else cast(l_quantity - l_linenumber as bigint) + 2 end as downloaded", "l_linenumber - 1 as failed", "cast(round(l_tax * 700) as bigint) as verified", "l_linestatus = 'F' as completed")
    return reports.counter_faults(b).groupBy("fault").agg(F.count("*").alias("n"))


@query("select l_returnflag, round(median(l_extendedprice / (l_quantity * 1500)), 6) as bias from lineitem where l_quantity > 0 group by 1")
def estimate_bias(spark, sf_dir):
    """Prices against an estimate by quantity."""
    rows = t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500).alias("estimate"))
    return metrics.estimate_bias(rows, "l_returnflag").select("l_returnflag", six("bias").alias("bias"))


@query(f"""with l as ({_LOG}), r as (select session, count(*) as lines, min(ts) as first_ts, max(ts) as last_ts, arg_max(status, {{'a': ts, 'b': line}}) as status, count(*) filter (level = 'ERROR') as errors,
 arg_max(total = done + failed + pending, {{'a': ts, 'b': line}}) as adds_up from l group by 1) select * from r""")
def session_rollup(spark, sf_dir):
    """The same of each session of the log."""
    return reports.request_rollup(made(spark, sf_dir, _LOG, "events"), ("session",))


@query("""select doc_id, regexp_replace(source, '^0+([0-9])', '\\1') as project, case when doc_id % 7 <= 4 then (doc_id % 7)::varchar end as value_score, case when doc_id % 2 = 0 then 'true' else 'false' end as promoted, 3 + (doc_id % 7 <= 4)::int as n from documents""")
def front_matter_values(spark, sf_dir):
    """Known front-matter values of a block made of each document."""
    block = F.expr("concat('project: ', source, '\n', 'value_score: 0', doc_id % 7, '\n', 'turns: x\nturns: 007\nother: 1\ndate:\nno colon\npromoted: ', if(doc_id % 2 = 0, 'True', 'FALSE'))")
    rows = t(spark, sf_dir, "documents").select("doc_id", text.front_matter_map(block).alias("m"))
    return rows.select("doc_id", *(F.col("m")[k].alias(k) for k in ("project", "value_score", "promoted")), F.size("m").alias("n"))
