"""Readers, writers, tools and streams on a small tree of files."""

import json

import pytest
from pyspark.sql import functions as F

from emberloom.operators import ingest, telemetry
from emberloom.plans import api
from emberloom.sources import files, sinks
from emberloom.streaming import streams

EPISODE = "---\ndate: {d}\nsession_id: {s}\nproject: web\nturns: 4\npromoted: {p}\n{v}---\n# E\n\n## Summary\nDid {s}.\n"


@pytest.fixture
def root(tmp_path):
    m = tmp_path / "memory"
    for d in ("context", "agent/_legacy", "projects/web", "episodes", "projects/archive"):
        (m / d).mkdir(parents=True)
    (m / "context/_index.md").write_text("# Topics\n- **java** — keywords: jvm, spring boot — file: java.md\n- **lost** — keywords: x, — file: lost.md\n- java (jvm) -> java.md\n")
    (m / "context/java.md").write_text("# Java\n\nAbout the JVM and its garbage.\n")
    (m / "context/extra.md").write_text("# Extra\n")
    (m / "agent/learnings.md").write_text("# L\n\n## 2026-04-01\n\nAlways close the files you open.\n\n## 2026-04-15 — Two\n\nTests first then code.\n")
    (m / "agent/_legacy/old.md").write_text("old")
    (m / "projects/web/learnings.md").write_text("## 2026-05-01 — Web\n\nCache the fonts.\n")
    (m / "projects/big.md").write_text("x" * 1_100_000)
    for i, (s, p, v) in enumerate((("s1", "false", "value_score: 3\n"), ("s2", "false", ""), ("s3", "false", "value_score: 9\n"), ("s4", "true", ""))):
        (m / f"episodes/2026-06-0{1 + i // 2}-{s}.md").write_text(EPISODE.format(d=f"2026-06-0{1 + i // 2}", s=s, p=p, v=v))
    return str(m)


@pytest.fixture
def memory(spark, root):
    rows = [(1, "context", "a/java.md", None, "Java", "About the JVM", 100), (2, "learning", "b.md", "web", "Fonts", "Cache the fonts of the JVM", 200), (3, "context", "c.md", None, "Other", "Nothing", 300)]
    o = spark.createDataFrame(rows, "id long, source_type string, source_path string, project string, title string, content string, indexed_at long")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    return api.Memory(spark, root, o, v, spark.createDataFrame([], "user_id long, ts timestamp"))


def test_candidates_and_parse(spark, root):
    found = files.candidates(spark, root)
    names = {r.path.rsplit("/memory/", 1)[1] for r in found.collect()}
    assert "agent/_legacy/old.md" not in names and "projects/big.md" not in names and "context/java.md" in names
    rows = {r.source_path.rsplit("/memory/", 1)[1]: r for r in ingest.parse_files(found, 7, "file:" + root).collect()}
    assert "context/_index.md" not in rows
    assert rows["context/java.md"].title == "Java" and rows["episodes/2026-06-01-s1.md"].project == "web"
    assert files.markdown(spark, root + "/none").count() == 0


def test_episodes_and_topics(spark, root, memory):
    got = api.list_episodes(memory).collect()
    assert [(r.session_id, r.value_score, r.promoted) for r in got] == [("s4", None, True), ("s3", None, False), ("s2", None, False), ("s1", 3, False)]
    assert got[0].summary == "Did s4." and api.list_episodes(memory, promoted=True).count() == 1
    topics, warnings = api.list_topics(memory)
    assert [(r.name, r.keywords, r.title) for r in topics.collect()] == [("java", ["jvm", "spring boot"], "Java"), ("lost", ["x"], None)]
    assert {r.file for r in warnings.collect()} == {"lost.md", "extra.md"}
    assert api.get_topic(memory, "java").startswith("# Java") and api.get_topic(memory, "../agent") is None
    path = got[3].path
    event = api.mark_episode_promoted(memory, path)
    assert [r.promoted for r in api.with_promotions(api.list_episodes(memory), event).where(F.col("path") == path).collect()] == [True]
    with pytest.raises(ValueError):
        api.mark_episode_promoted(memory, "/etc/passwd.md")


def test_learnings(memory):
    assert [r.date for r in api.get_recent_learnings(memory).collect()] == ["2026-05-01", "2026-04-15", "2026-04-01"]
    assert api.get_recent_learnings(memory, "agent").count() == 2 and api.get_recent_learnings(memory, "project", project="web").count() == 1
    near = api.append_learning(memory, "agent", "always close the files that you open", "2026-07-01").first()
    assert near.similarity >= 0.8 and near.match_date == "2026-04-01"
    same = api.append_learning(memory, "agent", " Tests first then code.\n", "2026-04-15", title="Two").first()
    assert same.similarity == 1.0 and same.block == "\n\n## 2026-04-15 — Two\n\nTests first then code.\n" and same.bytes == len(same.block.encode())
    other = api.append_learning(memory, "agent", "Nothing like it at all", "2026-07-01").first()
    assert other.similarity is None and other.title == "Learning"
    assert api.append_learning(memory, "project", "always close the files that you open", "2026-07-01", "web").first().similarity is None  # another file
    with pytest.raises(ValueError):
        api.append_learning(memory, "project", "x", "2026-07-01", "My Project")
    with pytest.raises(ValueError):
        api.append_learning(memory, "project", "x", "2026-07-01")


def test_search(memory):
    got = api.search_memory(memory, "jvm", [1.0, 0.0], 1000).collect()
    assert got[0].id == 1 and {r.id for r in got} == {1, 2, 3}
    assert {r.id for r in api.search_memory(memory, "jvm", None, 1000).collect()} == {1, 2}
    assert [r.id for r in api.search_memory(memory, "jvm", [1.0, 0.0], 1000, project="web").collect()] == [2]
    assert {r.id for r in api.search_memory(memory, '"(', [1.0, 0.0], 1000, source_filter=["context"]).collect()} == {1, 3}
    assert api.access_bump(api.search_memory(memory, "jvm", None, 1000), 5).count() == 2
    with pytest.raises(ValueError):
        api.search_memory(memory, "", None, 1)


def test_novelty_and_experience(spark, memory):
    entries = api.entries_of(memory).collect()
    vectors = spark.createDataFrame([(e.hash, [1.0, 0.0] if "files" in e.body or "fonts" in e.body else [0.0, 1.0]) for e in entries], "hash string, embedding array<double>")
    known = spark.createDataFrame([], "source_path string, entry_date string, entry_hash string, match_path string, match_date string, match_hash string, similarity double, kind string, detected_by string, status string, detected_at long")
    fresh, pending = api.scan_novelty(memory, vectors, known, 9)
    assert fresh.count() == 1 and pending.count() == 1
    again, _ = api.scan_novelty(memory, vectors, fresh, 10)
    assert again.count() == 0
    eps = [r.path for r in api.list_episodes(memory).collect()]
    ev = spark.createDataFrame([(p, [1.0, 0.0]) for p in eps], "path string, embedding array<double>")
    found, histogram = api.scan_experience(memory, ev)
    assert [(r.n, round(r.cohesion, 6), r.max_value) for r in found.collect()] == [(3, 1.0, 3)]
    assert {r.bucket: r.n for r in histogram.collect() if r.n} == {"3": 1, "unknown_before": 2}
    assert api.scan_experience(memory, ev, live=True, cluster_floor=4)[0].count() == 0


def test_proposals(spark, memory):
    kind = "id string, priority string, category string, title string, description string, evidence array<string>, proposed_change struct<file:string,action:string,scope:string,content:string,rationale:string>, estimated_weekly_savings_minutes int"
    change = ("f", "APPEND_LEARNING", "agent", "Write the plan down before any work.", "r")
    told, root = "A description that is long enough to tell what is meant here.", memory.root
    cited = [f"{root}/episodes/2026-06-01-s1.md", "session s2", "(s3)"]
    rows = [
        ("P001", "HIGH", "EXPERIENCE_LEARNING", "T", told, cited, change, 10),
        ("P002", "HIGH", "OTHER", "T", told, ["s1", "made-up", "s2"], change, 10),
        ("P003", "LOW", "EXPERIENCE_LEARNING", "T", told, ["s1", "s2", "s3"], ("f", "APPEND_LEARNING", "agent", "always close the files you open", "r"), 1),
        ("p4", "high", "experience", "T" * 121, "short", ["s1"], ("", "append", None, None, None), 601),
        ("P005", None, None, None, None, None, None, None),
        ("P006", "MEDIUM", "EXPERIENCE_LEARNING", "T", told, ["s1", "s1 again", f"in {root}/episodes/2026-06-01-s1.md"], change, 600),
    ]
    got = {r.id: r for r in api.validate_experience_proposal(memory, spark.createDataFrame(rows, kind)).collect()}
    assert got["P001"].ok and not got["P001"].faults and got["P001"].cited == 3
    assert not got["P002"].ok and got["P002"].unknown == 1 and got["P002"].faults == ["category is not EXPERIENCE_LEARNING"]
    assert not got["P003"].ok and got["P003"].duplicate_of is not None
    assert len(got["p4"].faults) == 9 and len(got["P005"].faults) == 7
    assert not got["P006"].ok and got["P006"].faults == [] and got["P006"].cited == 1  # one episode, cited three times


def test_proposals_without_id_or_with_a_shared_one_have_a_row_each(spark, memory):
    kind = "id string, priority string, category string, title string, description string, evidence array<string>, proposed_change struct<file:string,action:string,scope:string,content:string,rationale:string>, estimated_weekly_savings_minutes int"
    told, change = "A description that is long enough to tell what is meant here.", ("f", "APPEND_LEARNING", "agent", "Write the plan down before any work.", "r")
    sound = ("P001", "HIGH", "EXPERIENCE_LEARNING", "T", told, [f"{memory.root}/episodes/2026-06-01-s1.md", "session s2", "(s3)"], change, 10)
    double = (*sound[:7][:6], ("f", "APPEND_LEARNING", "agent", "always close the files you open", "r"), 1)
    found = api.validate_experience_proposal(memory, spark.createDataFrame([sound, double, (None, *sound[1:])], kind)).collect()
    assert sorted((r.id or "", r.ok, r.duplicate_of is None, len(r.faults)) for r in found) == [("", False, True, 1), ("P001", False, False, 0), ("P001", True, True, 0)]


def test_citations_hold_session_ids_anywhere(spark):
    episodes = spark.createDataFrame([("/m/b.md", "s-1.2"), ("/m/a.md", "s-1.2"), ("/m/c.md", "Q"), ("/m/d.md", None), ("/m/e.md", "")], "path string, session_id string")
    cited = spark.createDataFrame([("xs-1.2y",), ("q",), ("aQb",), (None,)], "citation string")
    got = {r.citation: r.path for r in api.resolve_citations(cited, episodes).collect()}
    assert got == {"xs-1.2y": "/m/a.md", "q": None, "aQb": "/m/c.md", None: None}


def test_candidates_by_their_own_names(spark, tmp_path):
    root = tmp_path / "episodes" / "_x.y(" / "memory"
    for name in ("episodes/old_drafts/2026-01-01-a.md", "episodes/2026-01-02-b.md", "episodes/_c.md", "agent/x_legacy/d.md", "agent/_legacy-e.md", "context/f.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("# t")
    found = {r.path.split("/memory/")[1] for r in files.candidates(spark, str(root)).collect()}
    assert found == {"episodes/old_drafts/2026-01-01-a.md", "episodes/2026-01-02-b.md", "agent/x_legacy/d.md", "context/f.md"}
    assert {(r.path.rsplit("/", 1)[1], r.project) for r in files.recent_files(spark, str(root), "2000-01-01T00:00:00").collect()} >= {("2026-01-02-b.md", "episodes"), ("d.md", "agent")}


def test_citations_of_any_of_many_episodes(spark):
    episodes = spark.createDataFrame([(f"/m/e/2026-06-01-s{i:05}.md", f"s{i:05}") for i in range(1500)], "path string, session_id string")
    cited = spark.createDataFrame([(f"session s{i:05}",) for i in range(1500)] + [("made-up",), ("s00007 beside /m/e/2026-06-01-s00009.md",)], "citation string")
    got = {r.citation: r.path for r in api.resolve_citations(cited, episodes).collect()}
    assert len(got) == 1502 and got["made-up"] is None and got["s00007 beside /m/e/2026-06-01-s00009.md"] == "/m/e/2026-06-01-s00009.md"
    assert all(got[f"session s{i:05}"] == f"/m/e/2026-06-01-s{i:05}.md" for i in range(1500))


def test_transcripts_and_process_tables(spark):
    said = [{"type": "user", "message": {"role": "x", "content": " hi\n"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "a "}, {"type": "tool", "x": 1}, {"type": "text", "text": " "}, {"type": "text", "text": "b"}]}}, {"type": "system", "content": "x"}, {"type": "user", "content": []}, {"type": "user", "message": {"content": None}, "content": "y"}, {"role": "user", "content": "untyped"}]
    lines = [json.dumps(x) for x in said] + ["{bad", ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in files.transcript(df).collect()] == [("user", "hi"), ("assistant", "a\nb"), ("user", "y")]
    ps = spark.createDataFrame([("  PID PPID RSS",), (" 12  1 2048 0.5 01:02 node a b ",)], "value string")
    assert [tuple(r) for r in files.process_table(ps).collect()] == [(12, 1, 2048, 0.5, "01:02", "node a b")]
    report = spark.createDataFrame([("Pages free:   12.\nSwapouts: 7.\n",)], "r string").select(files.counters(F.col("r"), {"free": "Pages free", "out": "Swapouts", "gone": "None"}).alias("c")).first().c
    assert tuple(report) == (12, 7, None)


def test_system_reports(spark):
    vm = "Mach Virtual Memory Statistics: (page size of 4096 bytes)\nPages free:   12.\nPages inactive: 5.\nDecompressions: 9.\nCompressions: 3.\nSwapouts: 7.\n"
    row = lambda column, value: spark.createDataFrame([(value,)], "r string").select(column.alias("c")).first().c
    m = row(files.memory_report(F.col("r")), vm)
    assert (m.page_size, m.pages_free, m.pages_inactive, m.c_swapouts, m.c_compressions, m.c_decompressions, m.pages_wired) == (4096, 12, 5, 7, 3, 9, None)
    assert row(files.memory_report(F.col("r")), "").page_size == 16384
    assert tuple(row(files.swap_usage(F.col("r")), "total = 2048.00M  used = 1.50M  free = 2046.50M (encrypted)")) == (2048.0, 1.5, 2046.5)
    assert tuple(row(files.swap_usage(F.col("r")), "none")) == (None, None, None)
    assert tuple(row(files.load_average(F.col("r")), "{ 1.50 2.00 3.25 }")) == (1.5, 2.0, 3.25)
    assert row(files.memory_size(F.col("r")), " 17179869184\n") == 17179869184 and row(files.memory_size(F.col("r")), "x") is None
    held = spark.createDataFrame([(vm,)], "r string").select(files.memory_report(F.col("r")).alias("m")).select(telemetry.memory_of(F.col("m")).alias("b")).first().b
    assert tuple(held) == (12 * 4096, 17 * 4096, 0)


def test_project_config(spark, tmp_path):
    for name, body in (("a.json", '[{"path": "/w/a", "slug": "a"}, {"slug": "b"}]'), ("b.json", '{"projects": [{"path": "/w/c", "slug": "c"}]}'), ("c.json", "{bad")):
        (tmp_path / name).write_text(body)
    assert [files.project_config(spark, str(tmp_path / n)) for n in ("a.json", "b.json", "c.json", "none.json")] == [[("/w/a", "a")], [("/w/c", "c")], [], []]


def test_json_lines_exports_and_sinks(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "l.json"), "a int").collect() if r.a) == [1, 2]
    (tmp_path / "e.csv").write_text("Time,Msg\n1,x\n")
    assert files.log_export(spark, str(tmp_path / "e.csv"), {"ts": ["time"], "message": ["msg"], "level": []}).first() == ("1", "x", None)
    table = str(tmp_path / "t")
    sinks.publish(spark.range(3).toDF("id"), table)
    sinks.publish(spark.range(5).toDF("id"), table)
    assert sinks.published(spark, table).count() == 5
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, str(tmp_path / "nothing"))
    owned = spark.createDataFrame([((1, 2, [("me", 1), ("you", 2), (None, 3)]),)], "s struct<a:int,b:int,l:array<struct<owner:string,x:int>>>")
    left = sinks.clear_owned(owned, "s", ["a"], {"l": lambda x: x["owner"] == "me"}).first().s
    assert left.asDict(True) == {"b": 2, "l": [{"owner": "you", "x": 2}, {"owner": None, "x": 3}]}
    pending = spark.createDataFrame([('{"scope": "agent", "content": "x"}',), ('[{"scope": "agent", "content": "y"}, {"scope": "who"}]',), ("{bad",)], "value string")
    assert sorted(r.ok for r in sinks.flush_pending(pending).collect()) == [False, False, True, True]
    md = spark.range(1).select(sinks.episode_markdown(F.lit("2026-01-01"), F.lit("s"), F.lit(None).cast("string"), F.lit(None).cast("int"), {"Summary": F.lit("ok"), "None": F.lit(" ")}).alias("m")).first().m
    assert md == "---\ndate: 2026-01-01\nsession_id: s\npromoted: false\n---\n\n## Summary\n\nok\n"


def test_index_stream(spark, root, tmp_path):
    table, check = str(tmp_path / "table"), str(tmp_path / "check")
    run = lambda: streams.index_stream(streams.file_changes(spark, root), table, check, lambda: 5, "file:" + root).awaitTermination()
    run()
    first = sinks.published(spark, table)
    n = first.count()
    assert n >= 6
    with open(root + "/context/new.md", "w") as f:
        f.write("# New\n")
    run()
    now = sinks.published(spark, table)
    assert now.count() == n + 1
    left = streams.reconcile(now, files.markdown(spark, root).where(~F.col("path").endswith("new.md")))
    assert left.count() == n


def test_streams_of_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"host": "h", "ts": f"2026-01-01T00:00:{i:02d}Z", "counter": c, "load": n} for i, (c, n) in enumerate(zip((100, 100, 110, 130, 150, 170), (3.0, 4, 5, 5, 6, 5)))]
    (tmp_path / "in/a.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    source = spark.readStream.schema("host string, ts timestamp, counter double, load double").json(str(tmp_path / "in"))
    q = streams.onset_stream(source).writeStream.format("memory").queryName("onset").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.host, r.onset) for r in spark.table("onset").collect()] == [("h", 5.0)]
    q = streams.windowed_counts(source, "ts", "host").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("counts").collect()] == [6]
    q = streams.once_in_lookback(source, ["host"], "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1
    for _ in range(2):
        streams.deliver_queue(spark, str(tmp_path / "in"), "host string", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 6
