"""Operators on small tables with expectations worked out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberloom import config as C
from emberloom.functions import scores, text
from emberloom.operators import evaluate, events, flags, ingest, metrics, search, similarity, telemetry, themes

NOW = 1_800_000_000


def one(spark, column, value=None, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first().r


def test_constants():
    assert (C.RRF_K, C.OVERSAMPLE, C.POOL_CAP, C.DECAY_DAYS, C.SATURATION, C.REINFORCEMENT) == (60, 4, 100, 30.0, 20, 0.01)
    assert (C.TITLE_BONUS, C.CONTENT_BONUS, C.LEXICAL_DUPLICATE, C.COSINE_DUPLICATE, C.COSINE_BAND, C.NEIGHBORS) == (0.016, 0.008, 0.8, 0.92, 0.82, 5)
    assert (C.THEME_COSINE, C.THEME_SIZE, C.MAX_EPISODES, C.SHIP_DATE) == (0.7, 3, 200, "2026-06-08")
    assert (C.WINDOW_SAMPLES, C.ONSET_RUN, C.FREE_FLOOR_BYTES, C.TURN_BUDGET_CHARS, C.MIN_TURNS, C.INJECT_CHARS) == (240, 3, 2147483648, 30000, 3, 1600)


def ranked(spark, rows, query="zzz", limit=10):
    """rows: id, fts_pos, vec_pos, last_accessed, access_count."""
    docs = spark.createDataFrame([(r[0], "title", "body", NOW) for r in rows], "id long, title string, content string, indexed_at long")
    kw = spark.createDataFrame([(r[0], r[1]) for r in rows if r[1]], "id long, fts_pos int")
    vec = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2]], "id long, vec_pos int")
    stats = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows if r[4]], "id long, last_accessed long, access_count long")
    return [(r.id, r.score) for r in search.hybrid(kw, vec, docs, stats, query, NOW, limit).collect()]


def test_fusion_and_reinforcement(spark):
    got = ranked(spark, [(1, 1, 1, None, 0), (2, 1, None, None, 0)])
    assert [i for i, _ in got] == [1, 2] and got[0][1] == pytest.approx(2 / 61 + 0.005)
    assert [i for i, _ in ranked(spark, [(1, None, 3, None, 0), (2, 3, None, NOW, 50)])] == [2, 1]
    assert [i for i, _ in ranked(spark, [(1, 1, 1, None, 0), (2, 1, None, NOW, 50)])] == [1, 2]
    assert [i for i, _ in ranked(spark, [(5, 1, None, None, 0), (2, None, 1, None, 0)])] == [2, 5]


def test_reinforcement_bounds(spark):
    r = lambda last, at, n: one(spark, scores.reinforcement(F.lit(NOW), F.lit(last).cast("long"), F.lit(at), F.lit(n)))
    assert r(NOW, NOW, 100) == pytest.approx(0.01) and r(None, NOW, 0) == pytest.approx(0.005)
    assert 0 <= r(NOW - 3650 * 86400, NOW, 0) < 1e-6 and r(NOW + 99, NOW, 0) == pytest.approx(0.005)


def test_exact_match(spark):
    get = lambda q: one(spark, scores.exact_match(q, F.lit("A Title"), F.lit("some body")))
    assert [get(q) for q in (" title ", "BODY", "none", "  ")] == [0.016, 0.008, 0, 0]


def test_keyword_query(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue dog"), (4, None), (5, "a blue fox and a red dog")], "doc_id long, text string")
    ids = lambda q: [r.id for r in search.keyword_candidates(docs, q, 5).orderBy("fts_pos").collect()]
    assert ids("red")[0] == 2 and set(ids("dog NOT (red OR fox)")) == {3} and ids("fox-red") == []
    where = search.keyword_candidates(docs, "red", 5, F.col("doc_id") == 1).collect()
    assert [(r.id, r.fts_pos) for r in where] == [(1, 1)]
    words = spark.createDataFrame([(1, "Running écoles"), (2, "he runs"), (3, "run on")], "doc_id long, text string")
    stemmed = lambda q: {r.id for r in search.keyword_candidates(words, q, 5, stemmed=True).collect()}
    assert stemmed("run") == {1, 2, 3} and stemmed("ecole") == {1} and stemmed("runs NOT he") == {1, 3} and stemmed("runn*") == set() and stemmed("ecol*") == {1}


def test_many_nearest(spark):
    dice = np.random.default_rng(3)
    v = dice.normal(size=(90, 5))
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    queries = rows.where("id % 9 = 3").select(F.col("id").alias("query"), F.col("v").alias("q"))
    for block in (16, 4096):
        got = {(r.query, r.pos): r.id for r in search.nearest_many(rows, queries, 4, block).collect()}
        want = {(q, p): i for q in range(3, 90, 9) for p, i in enumerate(sorted(range(90), key=lambda i: (-float(v[q] @ v[i]), i))[:4], 1)}
        assert got == want


def test_vector_filter_is_behind_the_limit(spark):
    v = spark.createDataFrame([(i, [math.cos(i / 30), math.sin(i / 30)]) for i in range(60)], "vec_id long, embedding array<float>")
    allowed = spark.createDataFrame([(3,), (5,), (59,)], "id long")
    got = search.vector_candidates(v, [1.0, 0.0], 10, allowed).orderBy("vec_pos").collect()
    assert [(r.id, r.vec_pos) for r in got][:2] == [(3, 1), (5, 2)] and len(got) == 2


def test_jaccard(spark):
    get = lambda a, b: one(spark, text.jaccard(text.token_set(F.lit(a)), text.token_set(F.lit(b))))
    assert get("a b c", "C b A") == 1 and get("a", "b") == 0 and get("", "") == 1 and 0 < get("a b", "b c") < 1
    assert get("x y z", "y q") == get("y q", "x y z")


def test_jaccard_join_against_all_pairs(spark):
    dice = random.Random(2)
    sets = {i: set(dice.sample("abcdefghij", dice.randint(0, 9))) for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()] + [(99, None)], "doc_id long, text string")
    sets[99] = set()
    first = {frozenset(s): min(j for j, x in sets.items() if x == s) for s in sets.values()}
    heads = {i: set(s) for s, i in first.items()}
    sim = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.id: (r.class_id, r.n_links) for r in similarity.near_duplicates(docs, 0.6).collect()}
    assert got == {i: (first[frozenset(s)], sum(j != first[frozenset(s)] and sim(s, x) >= 0.6 for j, x in heads.items())) for i, s in sets.items()}


def angles(spark, degrees):
    return spark.createDataFrame([(i, [math.cos(math.radians(d)), math.sin(math.radians(d))]) for i, d in enumerate(degrees)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize(("degrees", "size", "want"), [([0, 40, 80, 180], 3, [3]), ([0, 40], 3, []), ([0, 40], 2, [2]), ([0, 80, 160], 2, []), ([0, 10, 20, 180, 185, 190, 195], 3, [3, 4])])
def test_themes_by_angle(spark, degrees, size, want):
    v = angles(spark, degrees)
    for rows in (2, 2048):
        members = themes.themes(similarity.cosine_links(v, 0.7, block_rows=rows), size)
        assert sorted(r.n for r in members.select("root", "n").distinct().collect()) == want


def test_cohesion_counts_far_pairs_too(spark):
    v = angles(spark, [0, 40, 80])
    got = themes.cohesion(themes.themes(similarity.cosine_links(v, 0.7)), v).first()
    want = (2 * math.cos(math.radians(40)) + math.cos(math.radians(80))) / 3
    assert got.n == 3 and got.cohesion == pytest.approx(want)


def test_components_do_not_depend_on_order(spark):
    edges = [(i, i + 1) for i in range(12)] + [(50, 60), (60, 55)]
    for seed in range(2):
        random.Random(seed).shuffle(edges)
        got = {r.id: r.root for r in themes.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {**dict.fromkeys(range(13), 0), 50: 50, 55: 50, 60: 50}


def test_unknown_is_never_low(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (5, 5), (7, 7)], "root long, id long")
    values = spark.createDataFrame([(1, 1), (2, 4), (5, 1)], "id long, value int")
    got = {r.root: r.max_value for r in themes.max_value(members, values, 3).collect()}
    assert got == {1: 4, 7: None}
    hist = themes.value_histogram(spark.createDataFrame([(1, "2026-01-01"), (None, "2026-01-01"), (None, "2026-06-08")], "value int, day string"), F.col("day"))
    assert {r.bucket: r.n for r in hist.collect()} == {"0": 0, "1": 1, "2": 0, "3": 0, "4": 0, "unknown_before": 1, "unknown_after": 1}


def test_backlog_order(spark):
    e = spark.createDataFrame([("2026-01-03", 0, "c", False), ("2026-01-02", None, "b", False), ("2026-01-01", 3, "a", False), ("2026-01-09", 4, "z", True)], "date string, value_score int, path string, promoted boolean")
    assert [r.path for r in themes.backlog(e, 2).collect()] == ["c", "b"]
    assert [r.path for r in themes.backlog(e, 2, live=True).collect()] == ["b", "a"]


def test_flags(spark):
    side = "struct<path:string,date:string,hash:string>"
    a, b = ("p", "d", "h1"), ("q", "e", "h2")
    pairs = spark.createDataFrame([(a, b, 1.0), (b, a, 1.0)], f"a {side}, b {side}, similarity double")
    rows = flags.from_pairs(pairs, "duplicate", "scan", 5)
    none = rows.limit(0)
    fresh = flags.insert_or_ignore(none, rows)
    assert fresh.count() == 1 and flags.insert_or_ignore(fresh, rows).count() == 0 and fresh.first().status == "pending"
    entries = spark.createDataFrame([("p", "d", "h1", 0), ("q", "e", "h2", 4)], "path string, date string, hash string, place int")
    found = flags.relocate(fresh, entries).first()
    assert (found.entry_place, found.match_place) == (0, 4)
    assert flags.relocate(fresh, entries.where("path = 'p'")).count() == 0
    log = spark.createDataFrame([(1, 1, 10, "pending"), (2, 1, 10, "dismissed"), (3, 2, 4, "pending")], "event_id long, flag_id long, at long, status string")
    assert {r.flag_id: r.status for r in flags.latest_status(log).collect()} == {1: "dismissed", 2: "pending"}


def test_retrieval_measures(spark):
    ranked_rows = spark.createDataFrame([("q", 3, 1), ("q", 1, 2), ("q", 2, 3), ("none", 9, 1)], "query string, id long, pos int")
    relevant = spark.createDataFrame([("q", 1), ("q", 2)], "query string, id long")
    got = {r["query"]: (r.recall, r.rr) for r in evaluate.per_query(ranked_rows, relevant, 2).collect()}
    assert got == {"q": (0.5, 0.5), "none": (0.0, 0.0)}
    assert tuple(evaluate.means(evaluate.per_query(ranked_rows.limit(0), relevant.limit(0), 2)).first()) == (0, 0.0, 0.0)


def test_regression(spark):
    rows = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 3.0, 7.0), ("x", 2.0, 1.0), ("x", 2.0, 3.0), ("y", 1.0, 4.0), ("y", 2.0, 4.0)], "k string, x double, y double")
    got = {r.k: (r.slope, r.intercept, r.r2) for r in telemetry.regression(rows, ["k"], "x", "y").collect()}
    assert got["a"] == pytest.approx((2, 1, 1)) and got["x"] == (0, 2, 0) and got["y"] == pytest.approx((0, 4, 0))


def test_onset(spark):
    rows = [("h", i, c, n) for i, (c, n) in enumerate(zip((100, 100, 110, 130, 150, 170), (3, 4, 5, 5, 5, 5)))] + [("flat", i, 7, 1) for i in range(5)]
    s = spark.createDataFrame(rows, "host string, ts long, counter long, load long")
    assert [tuple(r) for r in telemetry.onset_runs(s, "host", ["ts"], "counter", "load").collect()] == [("h", 5, 4)]


def test_server_cost_and_lever(spark):
    s = spark.createDataFrame([(1, "a", 400_000), (2, "a", 600_000), (1, "gone", 900_000), (1, "gone", 900_000)], "sample long, server string, rss long")
    assert [tuple(r) for r in telemetry.server_cost(s).collect()] == [("a", 500_000.0, 100_000.0, 2)]
    assert telemetry.biggest_lever(s).first().server == "gone"
    many = spark.createDataFrame([(1, "a", 100)] * 3 + [(2, "a", 400)], "sample long, server string, rss long")
    assert tuple(telemetry.server_cost(many).first()) == ("a", 175.0, pytest.approx(129.9038), 4)
    assert tuple(telemetry.biggest_lever(many).first()) == ("a", 175.0, 2.0, 350.0)
    assert telemetry.most_sessions(spark.createDataFrame([(3,), (7,)], "sessions int")).first().most == 7


def test_process_tree(spark):
    rows = [(1, 0, True, 10, None), (2, 1, False, 5, "s"), (3, 2, False, 6, "s"), (4, 1, False, 7, None), (5, 1, True, 8, None), (6, 5, False, 9, None), (9, 8, False, 1, None)]
    p = spark.createDataFrame(rows, "pid long, ppid long, is_root boolean, rss long, server string")
    got = {r.root: (r.procs, r.total, r.own, r.servers, r.other) for r in telemetry.tree_rollup(p).collect()}
    assert got == {1: (4, 28, 10, 11, 7), 5: (2, 17, 8, 0, 9)}


def test_processes_on_a_cycle_have_no_root(spark):
    rows = [(1, 3, False, 1, None), (2, 1, False, 1, None), (3, 2, False, 1, None), (9, 0, True, 1, None), (10, 9, False, 2, None)]
    p = spark.createDataFrame(rows, "pid long, ppid long, is_root boolean, rss long, server string")
    assert {r.pid: r.root for r in telemetry.process_roots(p).collect()} == {9: 9, 10: 9}


def test_process_kinds(spark):
    rules = telemetry.ProcessRules(known=(("/own/tool/", "own"),))
    want = {
        "/home/u/.local/bin/agent --x": ("interactive", None),
        "/opt/versions/1.2.3 --session-id a --resume": ("forked", None),
        "/opt/versions/1.2.3 --session-id a --resume --bg-pty-host": ("infra", None),
        "/home/u/.local/bin/agent daemon run": ("infra", None),
        "node resource-sampler.js": ("self", None),
        "npx -y slack-mcp-server": ("server", "slack-mcp-server"),
        "node /own/tool/run.js": ("server", "own"),
        "caffeinate": ("other", None),
    }
    rows = spark.createDataFrame([(c, 10) for c in want], "command string, rss long")
    found = telemetry.process_kinds(rows, rules)
    assert {r.command: (r.kind, r.server) for r in found.collect()} == want
    assert {r.kind: (r.procs, r.rss) for r in telemetry.kind_totals(found).collect()} == {"interactive": (1, 10), "forked": (1, 10), "infra": (2, 20), "server": (2, 20), "other": (1, 10)}


def test_ceiling(spark):
    get = lambda onset, slope, b: one(spark, scores.ceiling(F.lit(onset).cast("int"), F.lit(10 * 1024**3), F.lit(slope), F.lit(b)))
    assert get(5, 1.0, 0.0) == 5 and get(None, float(1024**3), -7.0) == 8 and get(None, 0.0, 0.0) is None and get(None, 1e9, 9e10) == 0


def test_entries(spark):
    body = "# Log\n\n##  2026-04-15  —  Second \r\n\r\nText two.\n## 2026-04-16 Not one\n## 2026-04-17: nor this\nmore\n\n## 2026-04-01\nText one.\n"
    files = spark.createDataFrame([("a.md", body), ("b.md", "none"), ("c.md", None)], "path string, content string")
    got = events.entries(files).orderBy("place").collect()
    assert [(r.date, r.title, r.body) for r in got] == [("2026-04-15", "Second", "Text two.\n## 2026-04-16 Not one\n## 2026-04-17: nor this\nmore"), ("2026-04-01", None, "Text one.")]
    twice = events.entries(spark.createDataFrame([("a", "## 2026-04-01 — x\ny\n\n## 2026-04-01 — x\ny\n")], "path string, content string")).collect()
    assert twice[0].hash == twice[1].hash


def test_keywords_need_their_boundaries(spark):
    hit = lambda t, k: one(spark, text.keyword_hit(F.lit(t), k))
    assert not hit("an orchestration", "orch") and not hit("the approach", "pr") and hit("a PR, please", "pr") and hit("do Code Review now", "code review") and not hit("pre-pr-x", "pr")


def test_front_matter(spark):
    body = "---\ndate: 2026-01-02\nproject: \"web\"\nvalue_score: 7\npromoted: true\n---\n# Head \n\n## Summary\nGood work.\n\n## Next\nx"
    row = spark.createDataFrame([(body,), ("no front",)], "c string").select(text.front_matter(F.col("c")).alias("f"))
    got = row.select("f.block", text.front_matter_field(F.col("f.block"), "project").alias("p"), text.value_score(text.front_matter_field(F.col("f.block"), "value_score")).alias("v"), text.first_heading(F.col("f.body")).alias("h"), text.summary_of(F.col("f.body")).alias("s")).collect()
    assert got[0][1:] == ("web", None, "Head", "Good work.") and got[1][0] is None


def test_small_text_functions(spark):
    assert one(spark, text.word_snippet(F.lit("a  b"), 2)) == "a b…" and one(spark, text.word_snippet(F.lit("a b"), 2)) == "a b"
    assert [one(spark, text.is_slug(F.lit(x))) for x in ("my-project", "2026-x", "-a", "A", "a b", "")] == [True, True, False, False, False, False]
    assert one(spark, text.normal_command(F.lit("a \t b\nAB-12 x"))) == "a b\nXXX-NNN x" and one(spark, text.normal_command(F.lit(None).cast("string"))) == ""
    assert one(spark, text.entry_date(F.lit(None).cast("string"), F.lit("x/2026-03-04-s.md"))) == "2026-03-04"
    assert one(spark, text.collapse(F.lit("a\x00\n  b c"), 3)) == "a b"
    names = {
        "npx -y @scope/slack-mcp@1.2.0 --port 1": "slack-mcp",
        "npm exec sonar-mcp-darwin-arm64": "sonar-mcp",
        "node /x/issue-tool/dist/index.js": "issue-tool",
        "node /a/b/own-mcp/index.mjs --flag": "own-mcp",
        "/opt/bin/mcp-files --root /": "mcp-files",
        "/usr/bin/python serve.py": "python",
        "node /srv/my-tool/dist/index.js": "ours",
        "uvx vendor-time": "time",
    }
    rows = spark.createDataFrame([(c,) for c in names] + [(None,)], "c string").select("c", text.server_name(F.col("c"), (("/srv/my-tool/", "ours"),), "vendor-").alias("n"))
    assert {r.c: r.n for r in rows.collect()} == {**names, None: None}


def test_classification(spark):
    below = {
        "context/java.md": ("context", "java", None), "context/deep/er.md": ("context", "er", None), "context/_index.md": None, "archive/context/java.md": None,
        "projects/archive/learnings.md": ("learning", None, "archive"), "agent/CLAUDE.md": ("agent", None, None), "agent/identity.md": None, "agent/learnings.md": ("learning", None, None),
        "projects/web/notes/learnings.md": ("learning", None, "web"), "projects/web/decisions.md": ("decision", None, "web"), "projects/web/CLAUDE.md": ("project_claude_md", None, "web"),
        "projects/web/plan.md": None, "projects/learnings.md": None, "episodes/2026/a.md": ("episode", None, None), "context/x.txt": None,
    }
    paths = {f"/m/{p}": k for p, k in below.items()} | {"/w/CLAUDE.md": ("project_claude_md", None, "own"), "/w/README.md": ("project_readme", None, "own"), "/w/docs/README.md": None, "/other/context/java.md": None}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ingest.classify(F.col("p"), "/m", (("/w", "own"),)).alias("k")).collect()
    assert {r.p: None if r.k is None else tuple(r.k) for r in rows} == paths


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], "source_path string, content_hash string, v int")
    new = spark.createDataFrame([("a", "1", 2), ("b", "9", 2), ("d", "4", 2)], "source_path string, content_hash string, v int")
    assert {r.source_path: r.status for r in ingest.compare(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    assert {r.source_path: r.v for r in ingest.upsert(old, new).collect()} == {"a": 1, "b": 2, "d": 2}
    ids = ingest.upsert(old.withColumn("id", F.col("content_hash").cast("long")), new, keep=["id"])
    assert {r.source_path: (r.v, r.id) for r in ids.collect()} == {"a": (1, 1), "b": (2, 2), "d": (2, None)}
    vectors, fresh = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z"), (3, "n")], "id int, v string")
    assert {tuple(r) for r in ingest.replace_vectors(vectors, fresh).collect()} == {(1, "x"), (2, "z"), (3, "n")}
    assert tuple(ingest.rebuild_report(vectors, fresh.limit(1)).first()) == (2, 1)


def test_turn_budget(spark):
    turns = spark.createDataFrame([(1, 1, "user", "aaaa"), (1, 2, "user", "bbb"), (1, 3, "bot", "cc"), (2, 1, "bot", "x" * 20), (2, 0, "bot", "x")], "c long, n long, role string, text string")
    got = {(r.c, r.n): r.line for r in events.keep_recent_turns(turns, "c", "n", budget=20).collect()}
    assert got == {(1, 3): "BOT: cc\n\n", (1, 2): "USER: bbb\n\n", (2, 1): "BOT: " + "x" * 15 + "[truncated]\n\n"}
    assert [tuple(r) for r in events.enough_turns(turns, "c").collect()] == [(1, 3)]


def test_guard_log(spark):
    rows = [(1, 1, "r", "t", "/a", "BLOCKED", "push AB-1", 10), (2, 2, "r", None, "/a", "BLOCKED", "push  AB-22", 300), (3, 3, None, "t", None, "ALLOWED", "x", 5), (4, 4, "s", "t", "/a", "BLOCKED", None, 5), (5, 5, "r", "t", "/a", "BLOCKED", "y", 5)]
    log = spark.createDataFrame(rows, "event_id int, ts int, rule string, tool string, cwd string, decision string, command string, duration_ms int")
    got = {(r.dimension, r.value): r.n for r in events.counts(log, ["rule", "tool", "cwd"]).collect()}
    assert got[("rule", "none")] == 1 and got[("tool", "unknown")] == 1 and got[("cwd", "unknown")] == 1 and got[("total", "all")] == 5
    assert [(r.rule, r.pattern, r.n, r.example) for r in events.repeats(log).collect()] == [("r", "push XXX-NNN", 2, "push AB-1")]
    assert {(r.rule, r.finding, r.most_ms, r.blocks) for r in events.thresholds(log).collect()} == {("r", "slow", 300, 3), ("r", "frequent block", 300, 3)}


def test_metrics(spark):
    tasks = spark.createDataFrame([("k", 1.0, 2.0, 3.0), ("k", 2.0, 2.0, 8.0)], "k string, low double, likely double, high double")
    e = metrics.estimates(tasks, "k").first()
    assert e.expected == pytest.approx(5) and e.deviation == pytest.approx(math.sqrt(1 / 9 + 1)) and float(e.commitment) == 6.5
    items = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3), ("b", 4)], "item string, plan long")
    plans = spark.createDataFrame([(i, i) for i in range(1, 5)], "plan long, rank long")
    assert [tuple(r) for r in metrics.carryover(items, plans).collect()] == [("a", 3)]
    old = spark.createDataFrame([("k", 1, "x", ["p"]), ("o", 2, None, None)], "k string, a int, b string, l array<string>")
    new = spark.createDataFrame([("k", None, "y", ["q", "p"]), ("n", 3, None, ["z"])], "k string, a int, b string, l array<string>")
    got = {r.k: (r.a, r.b, r.l) for r in metrics.merge_snapshots(old, new, "k", ["a", "b"], ["l"]).collect()}
    assert got == {"k": (1, "y", ["p", "q"]), "o": (2, None, []), "n": (3, None, ["z"])}
    assert one(spark, metrics.progress_bar(F.lit(0.5))) == "█" * 7 + "░" * 7
    assert one(spark, metrics.target_status(F.lit(None).cast("double"), 1, 2)) == "unknown"
