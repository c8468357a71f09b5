"""The smaller rules, by hand."""

import json

from pyspark.sql import functions as F

from emberloom.functions import python, text
from emberloom.operators import events, metrics, reports


def test_python_functions(spark):
    said = ['Sure: {"a": {"b": "}"}} and {"c": 1}', "none {bad", None, '{bad} then {"x": [1, "{"]}']
    df = spark.createDataFrame([(x,) for x in said], "t string")
    assert [r.j for r in df.select(python.balanced_json("t").alias("j")).collect()] == ['{"a": {"b": "}"}}', None, None, '{"x": [1, "{"]}']
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {w: python.porter(w) for w in words} == words
    assert df.limit(1).select(python.stems(text.words(F.lit("Éclairs are RUNNING")))).first()[0] == ["eclair", "ar", "run"]
    assert df.limit(1).select(python.fold_accents(F.lit("Ünïcode"))).first()[0] == "unicode"
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, content string")
    assert {r.id: list(r.embedding) for r in python.embed(rows, lambda: lambda texts: [[float(len(t))] for t in texts], prefix="q:").collect()} == {1: [4.0], 2: [2.0]}


def test_project_of_folder(spark):
    watched = spark.createDataFrame([("/w/app", "app", 1), ("/w", "all", 2)], "path string, project string, rank int")
    rows = spark.createDataFrame([("/w/app/src",), ("/w/apple",), ("/x/own",), ("/w/app",)], "cwd string")
    assert {r.cwd: r.project for r in reports.project_of_folder(rows, watched).collect()} == {"/w/app/src": "app", "/w/apple": "all", "/x/own": "own", "/w/app": "app"}


def test_cross_reference_and_continuity(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("ab", "bc"))
    assert {(r.k, r.kind) for r in reports.cross_reference(a, b, "k").collect()} == {("a", "phantom"), ("c", "unmentioned")}
    p = spark.createDataFrame([("x", 1), ("y", 2)], "item string, date int")
    d = spark.createDataFrame([("x", 3), ("y", 2)], "item string, date int")
    assert {r.item: r.kept for r in reports.continuity(p, d).collect()} == {"x": True, "y": False}


def test_request_rollup(spark):
    rows = [("s", "r", 1, 1, "RUN", "INFO", 3, 1, 0, 2), ("s", "r", 2, 5, "DONE", "ERROR", 3, 2, 1, 0), ("s", "q", 3, 1, "RUN", "INFO", 3, 1, 0, 0)]
    log = spark.createDataFrame(rows, "session string, request string, line int, ts int, status string, level string, total int, done int, failed int, pending int")
    assert {r.request: (r.lines, r.status, r.errors, r.adds_up) for r in reports.request_rollup(log).collect()} == {"r": (2, "DONE", 1, True), "q": (1, "RUN", 0, False)}


def test_health_and_release(spark):
    refs = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("gone", "x")], "server string, tool string")
    tools = spark.createDataFrame([("a", "x"), ("a", "y")], "server string, tool string")
    calls = spark.createDataFrame([("a", "y", True)], "server string, tool string, denied boolean")
    assert {(r.server, r.tool): r.state for r in reports.reference_health(refs, calls, tools).collect()} == {("a", "x"): "healthy", ("a", "y"): "permission-gap", ("a", "z"): "tool-miss", ("gone", "x"): "dead"}
    merged = spark.createDataFrame([("T-1",), ("T-2",)], "ticket string")
    t = spark.createDataFrame([("T-1", "1.0"), ("T-3", "1.0"), ("T-2", "2.0")], "ticket string, version string")
    assert {r.ticket: r.state for r in reports.release_audit(merged, t, "1.0").collect()} == {"T-1": "released", "T-2": "not in the version", "T-3": "not merged"}


def test_signals_and_threads(spark):
    checks = "array<struct<conclusion:string,state:string>>"
    rows = [(1, ["me", "you"], [("SUCCESS", None), (None, "ERROR")], "CONFLICTING"), (2, ["you"], [("FAILURE", None)], "MERGEABLE"), (3, None, None, None), (4, ["me"], [], "UNKNOWN")]
    prs = spark.createDataFrame(rows, f"pr int, reviewers array<string>, checks {checks}, mergeable string")
    got = {(r.pr, r.signal) for r in reports.signals(prs, "me").collect()}
    assert got == {(1, "review-requested"), (1, "ci-failed"), (1, "merge-conflict"), (2, "ci-failed"), (4, "review-requested")}
    at = lambda x: F.to_timestamp(F.lit(x))
    assert prs.limit(1).select(reports.days_since(at("2026-01-10 00:00:00"), at("2026-01-08 12:00:00")).alias("d")).first().d == 1
    th = spark.createDataFrame([(1, True), (1, False)], "pr int, resolved boolean")
    co = spark.createDataFrame([(1, 1, "scan old"), (1, 2, "scan new"), (2, 1, "scan x")], "pr int, at int, body string")
    assert {r.pr: (r.unresolved, r.scan) for r in reports.open_threads(th, co).collect()} == {1: (1, "scan new"), 2: (0, "scan x")}


def test_observation_digest_and_bands(spark):
    said = [
        {"summary": " a\n\x01b ", "project": " web ", "decisions": ["x", 5, None, " "] + ["y" * 600] * 30, "corrections": " one\tmore ", "discoveries": {"a": 1}, "files_of_note": [{"path": "p", "reason": "r", "z": 1}, {"path": "q"}, "no"], "value_score": 3},
        {"summary": 7, "project": "", "decisions": "", "value_score": 2.5},
        {"summary": "No significant decisions made.", "value_score": 9},
        [1],
    ]
    rows = spark.createDataFrame([(json.dumps(x),) for x in said] + [("{bad",), (None,)], "raw string").select(reports.observation(F.col("raw")).alias("o"))
    a, b, c, *none = (r.o for r in rows.collect())
    assert none == [None, None, None]
    assert (a.summary, a.project, a.corrections, a.discoveries, a.value_score) == ("a b", "web", ["one more"], [], 3)
    assert a.decisions[:3] == ["x", "", "y" * 500] and len(a.decisions) == 20 and [tuple(f) for f in a.files_of_note] == [("p", "r")]
    assert (b.summary, b.project, b.decisions, b.files_of_note, b.value_score) == ("", None, [], [], None) and c.value_score is None
    assert [r.s for r in rows.where("o is not null").select(events.has_signal(F.col("o")).alias("s")).collect()] == [True, False, False]
    item = "struct<pr_number:int,title:string,type:string,key:string,days_stale:int,status:string>"
    queue = [("pr-surveillance", "ok", "2026-01-02T03:04", [(7, "Fix", "ci-failed", None, None, None)]), ("sprint-staleness", "ok", None, [(None, None, None, "T-1", 4, "Open"), (None, None, None, "T-2", 9, "Open")]), ("x", "error", "2026-01-03T00:00", []), ("y", "ok", "2026-01-04T00:00", None), ("z", "ok", "2026-01-05T00:00", [(1, "", "", "", 1, "")])]
    d = reports.digest(spark.createDataFrame(queue, f"agent string, status string, run_at string, items array<{item}>"), {"pr-surveillance": "Reviews"})
    assert d.first().text.split("\n") == ["[Background Digest — 5 run(s) since last session]", "sprint-staleness (unknown): T-1 4d stale (Open), T-2 9d stale (Open)", 'Reviews (2026-01-02): 1 flagged — #7 "Fix" (ci-failed)', "x (2026-01-03): ERROR — skipped run", "y (2026-01-04): nothing flagged", "z (2026-01-05): 1 item(s)"]
    assert reports.digest(spark.createDataFrame([], f"agent string, status string, run_at string, items array<{item}>")).count() == 0
    long = " ".join(f"w{i}" for i in range(100)) + " Hit, end"
    cut = spark.createDataFrame([(long,), ("a hit",), ("none here",), (None,)], "t string").select(text.hit_snippet(F.col("t"), ["hit"], 8).alias("s"))
    assert [r.s for r in cut.collect()] == ["…w94 w95 w96 w97 w98 w99 <mark>Hit</mark>, end", "a <mark>hit</mark>", "none here", None]
    assert [r[0] for r in spark.createDataFrame([(95,), (70,), (10,)], "x int").select(reports.banded(F.col("x"))).collect()] == ["strong", "sound", "poor"]


def test_lint(spark):
    good = "---\nname: my-skill\ndescription: >\n  Checks things.\n\tTwice.\nmodel: x\n---\n- You must test, because it breaks.\n* Plain.\n  - nested\n1. Step so that it runs.\n```\n- code because\n```\n| - table |\n2) Last.\n"
    docs = {
        "a/good/S.md": good,
        "a/odd/S.md": "---\nname: Claude-x\ncolour: red\ndescription: I can help\n---\ntext",
        "a/no-name/S.md": "---\nmodel: x\n---\n- one\n",
        "a/open/S.md": "---\nname: x\n- never closed",
        "a/bad/S.md": "---\nno value here\n---\n",
        "a/none/S.md": "nothing",
        "a/long/S.md": "---\ndescription: " + "x" * 1000 + "\nwhen_to_use: " + "y" * 600 + "\n---\n",
    }
    rows = spark.createDataFrame(list(docs.items()), "path string, content string")
    got = {r.path.split("/")[1]: tuple(r)[1:] for r in reports.lint(rows).collect()}
    assert got == {
        "good": (2, [], "my-skill", True, True, 4, 2, 2),
        "odd": (0, ["unknown key colour"], "Claude-x", False, False, 0, 0, None),
        "no-name": (1, [], "no-name", True, False, 1, 0, 0),
        "open": (0, ["front matter is not closed"], "open", True, False, 1, 0, 0),
        "bad": (0, ["a line is not 'key: value'"], "bad", True, False, 0, 0, None),
        "none": (0, ["no front matter"], "none", True, False, 0, 0, None),
        "long": (2, [], "long", True, False, 0, 0, None),
    }


def test_log_triage(spark):
    rows = [("a", 0, "request.download.started", None, None), ("a", 5, "batch.counter.increment", None, None), ("a", 400, "x", None, None)]
    rows += [("b", i, "x", "P3RM_GENERIC", None) for i in range(3)] + [("b", 3, "x", "DLW_11", None)] * 20
    rows += [("c", 0, "x", "APP_02", None), ("c", 1, "x", None, None), ("d", 0, "x", None, "ERROR"), ("d", 2, "batch.counter.increment", None, None), ("d", 3, "request.download.started", None, None), ("d", 4, "request.download.completed", None, None)]
    log = spark.createDataFrame(rows, "session string, ts long, event string, code string, status string")
    assert {tuple(r) for r in reports.log_triage(log).collect()} == {("a", "stalled request"), ("a", "stall point"), ("a", "downloads work"), ("b", "path worker saturated"), ("b", "many failures"), ("c", "startup crash"), ("d", "status stuck")}
    said = [("s", "HART_04", "x")] * 5 + [("t", "HART_04", "x")] * 6 + [("s", "APP_01", "consent"), ("s", "APP_01", "an unhandled Promise rejection"), ("s", "APP_02", ""), ("s", "DLW_11", None), ("s", None, "x")]
    codes = reports.notable_codes(spark.createDataFrame(said, "session string, code string, message string"))
    assert {tuple(r) for r in codes.collect()} == {("t", "HART_04", 6), ("s", "APP_01", 1), ("s", "DLW_11", 1)}
    batches = spark.createDataFrame([(1, 5, 5, 1, 2, True), (2, 5, 6, 0, 0, True), (3, 5, 3, 0, 4, True), (4, 5, 5, 0, 5, False), (5, 5, 5, 0, 5, True)], "batch int, items int, downloaded int, failed int, verified int, completed boolean")
    assert {tuple(r) for r in reports.counter_faults(batches).collect()} == {(1, "more done than there are"), (2, "more done than there are"), (2, "counted twice"), (3, "verified before downloaded"), (4, "no completion")}


def test_plan_signals(spark):
    rows = [("Fix: a", "me", "2026-01-02", 1), ("Feature\nFix it", "me", "2026-01-02", 1), ("Remove unused x", "me", "2026-01-03", 1), ("Revert y", "me", "2026-01-03", 1), ("Fix merge", "me", "2026-01-03", 2), ("Fix z", "you", "2026-01-03", 1), ("Fix late", "me", "2026-02-01", 1), ("Prefix", "me", "2026-01-04", 1)]
    commits = spark.createDataFrame(rows, "message string, author string, at string, parents int")
    got = metrics.commit_kinds(commits, "me", "2026-01-01", "2026-02-01").collect()
    assert [(r.is_fix, r.is_reactive, r.is_revert) for r in got] == [(True, False, False), (True, False, False), (False, True, False), (False, False, True), (False, False, False)]
    assert metrics.commit_kinds(commits).count() == 7
    tickets = lambda *x: spark.createDataFrame([(t,) for t in x], "ticket string")
    assert tuple(metrics.sprint_drift(tickets("A", "B"), tickets("C")).first()) == (2, 0, 1.0, True)
    assert tuple(metrics.sprint_drift(tickets("A", "B", "C"), tickets("C")).first()) == (3, 1, 2 / 3, False)
    assert tuple(metrics.sprint_drift(tickets("A").limit(0), tickets("C")).first()) == (0, 0, 0.0, False)
    stack = spark.createDataFrame([(x, d) for x in "abc" for d in range(5 if x != "c" else 4)], "item string, day int")
    assert [tuple(r) for r in metrics.stale_stack(stack, spark.createDataFrame([("b",)], "item string")).collect()] == [("a", 5)]
    blockers = spark.createDataFrame([("P", "T", "2026-01-01"), ("P", "T", "2026-01-04"), ("Q", "T", "2026-01-01"), ("Q", "T", "2026-01-03")], "person string, ticket string, day string")
    assert [tuple(r) for r in metrics.blocker_stalls(blockers).collect()] == [("P", "T", 3)]
    work = spark.createDataFrame([("me", True), ("me", True), ("you", True), ("you", False)], "who string, open boolean")
    assert [tuple(r) for r in metrics.open_work(work, "who").collect()] == [("me", 2)]
    moves = spark.createDataFrame([("A", "In Test", "Open"), ("A", "In Test", "In Progress"), ("B", "In Test", "Done"), ("C", "In Test", "Open")], "ticket string, from string, to string")
    assert {tuple(r) for r in metrics.qa_bounces(moves).collect()} == {("A", 2), ("C", 1)} and [tuple(r) for r in metrics.qa_bounces(moves, tickets("A", "B")).collect()] == [("A", 2)]
    todo = spark.createDataFrame([("unassigned defect", 1, "U"), ("sprint", 2, "S2"), ("sprint", 1, "S1"), ("labelled defect", 1, "L"), ("in progress", 3, "P"), ("other", 1, "O")] + [("unassigned defect", 2, f"V{i}") for i in range(5)], "kind string, priority int, ticket string")
    assert [r.ticket for r in metrics.priority_order(todo).collect()] == ["S1", "S2", "P", "L", "U", "V0", "V1"] and metrics.priority_order(todo, True).count() == 5


def test_stale_and_unknown_projects(spark, monkeypatch):
    e = spark.createDataFrame([("2026-01-05", False, "a"), ("2026-01-05", True, "a"), ("2025-12-01", False, None)], "date string, promoted boolean, project string")
    assert reports.stale(e, F.lit("2026-01-10").cast("date"), 7).count() == 1
    assert e.where(reports.same_or_unknown(F.col("project"), F.lit("b"))).count() == 1
    rows = spark.createDataFrame([("p1", 1, 2, 0), ("p2", 2, 1, 0), ("p3", 0, 0, 9)], "project string, commits int, prs int, tickets int")
    assert [r.project for r in reports.recent_activity(rows).collect()] == ["p3", "p2", "p1"]
    top, rest = reports.top_with_rest(rows, [F.desc("commits")], 2)
    assert top.count() == 2 and rest == 1
    needles = spark.createDataFrame([("P1", 1), ("p", 2), ("P1", 1), (None, 3), ("", 4)], "n string, k int")
    for chars in (reports.NEEDLE_CHARS, 1):
        monkeypatch.setattr(reports, "NEEDLE_CHARS", chars)
        got = sorted((r.k, r.project) for r in reports.containing(needles, rows.union(rows.limit(1)), "n", "project").collect())
        assert got == [(1, "p1"), (2, "p1"), (2, "p2"), (2, "p3"), (4, "p1"), (4, "p2"), (4, "p3")]
