import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.api import Vault
from marginalia.functions import text
from marginalia.operators import access, audit, evaluate, fusion, graph, history, lanes, linking, structure, temporal
from marginalia.operators import index as ix
from marginalia.sources import sinks
from marginalia.sources import vault as src
from marginalia.streaming import upkeep

NOTES = "note_id long, path string, note_type string, frontmatter string, aliases array<string>, body string, no_frontmatter boolean, mtime timestamp, synced_at timestamp"
T = datetime.datetime(2021, 6, 1)


@pytest.fixture(scope="module")
def notes(spark):
    rows = [
        (50, "Knowledge/Espresso Ratios.md", "knowledge", "type: knowledge\ntags: [a]\nstatus: active\nupdated: 2021-06-02", ["Coffee Guide"], "# Espresso\n\nGrind the arabica beans for a balanced extraction. See [[Ana Diaz]] and [[Missing Note]].", False, T, T),
        (100, "People/Ana Diaz.md", "person", "type: person\ntags: []\nstatus: active\nupdated: 2021-06-02", None, "Ana roasts arabica beans. [[Coffee Guide]] [[Home]]", False, T, T),
        (150, "Home.md", "moc", "type: moc\ntags: [x]\nstatus: active\nupdated: 2021-06-02", None, "[[Espresso Ratios]]", False, T, T),
        (200, "Logs/Bot/Session 5 June 2021.md", "log", None, None, "We met on 7 Jul 2021 about invoices.\n```\n[[Home]]\n```", True, T, T),
        (250, "Knowledge/Espresso Ratios (conflicted copy 2021-06-01 0).md", None, "type: knowledge", None, "# Espresso\n\nGrind the arabica beans for a balanced extraction. See [[Ana Diaz]] and [[Missing Note]].", False, T, T),
        (300, "Private/Secret.md", None, None, None, None, True, None, None),
        (301, "Knowledge/Milk.md", "knowledge", "type: knowledge\ntags: [m]\nstatus: odd\nupdated: ", None, "Ana Diaz steams milk.", False, T, T),
    ]
    return spark.createDataFrame([*rows, rows[0]], NOTES)


@pytest.fixture(scope="module")
def vault(notes):
    return Vault(src.corpus(notes.dropDuplicates(["note_id"])))


def test_graph(vault):
    e = {(r.src.split("/")[-1], r.dst.split("/")[-1], r.unresolved) for r in vault.edges.collect()}
    assert ("Espresso Ratios.md", "Ana Diaz.md", False) in e and ("Ana Diaz.md", "Espresso Ratios.md", False) in e and ("Espresso Ratios.md", "Missing Note", True) in e
    assert not any(s.startswith("Session") for s, _, _ in e)  # links in code are none
    assert {r.path: r.backlinks for r in graph.backlinks(vault.edges).collect()}["Knowledge/Espresso Ratios.md"] == 2
    old = vault.corpus.select("path", F.substring(F.sha1("raw"), 1, 16).alias("hash")).where("path != 'Home.md'")
    again = graph.rebuild(vault.edges, old, vault.corpus)
    assert sorted(map(tuple, again.select("src", "dst", "unresolved").collect())) == sorted(map(tuple, vault.edges.select("src", "dst", "unresolved").collect()))
    moved = vault.spark.createDataFrame([("People/Ana Diaz.md", "People/Ana D.md")], "old string, new string")
    assert all("[[Ana D]]" in r.body for r in graph.repoint(vault.corpus, moved).collect())


def test_recall_finds_and_refuses(spark, vault):
    q = spark.createDataFrame([(1, "espresso ratios"), (2, "zzqx wvvk qqqq"), (3, "arabica beans extraction")], "qid long, question string")
    answers, outcomes = vault.recall(q)
    top = {r.qid: r.path for r in answers.where("rank = 1").collect()}
    assert top[1].startswith("Knowledge/Espresso") and top[3].startswith("Knowledge/Espresso")
    found = {r.qid: r.found for r in outcomes.collect()}
    assert found[1] and found[3] and not found[2]
    assert vault.search(q).where("qid = 1").count() > 0 and vault.gather(q).count() > 0


def test_proximity_against_brute_force(spark, vault):
    from itertools import product

    q = lanes.with_idf(ix.question_terms(spark.createDataFrame([(1, "arabica beans extraction milk")], "qid long, question string")), vault.doc_freq, vault.stats)
    pool = vault.corpus.select(F.lit(1).cast("long").alias("qid"), "note_id")
    got = {r.note_id: r.score for r in lanes.proximity(q, pool, vault.terms).collect()}
    for r in vault.fields.collect():
        at = [[i for i, t in enumerate(r.body) if t == w] for w in ("arabica", "beans", "extraction", "milk")]
        at = [a for a in at if a]
        want = 0 if len(at) < 2 else len(at) / 4 / (1 + min(max(c) - min(c) for c in product(*at)) / len(at))
        assert got.get(r.note_id, 0) == pytest.approx(want)


def test_fusion_pieces(spark, vault):
    listed = spark.createDataFrame([(1, n, i + 1) for i, n in enumerate([10, 20, 30, 40])], "qid long, note_id long, rank int")
    pins = spark.createDataFrame([(1, 40, 8, 3, 3), (1, 99, 13, 1, 1), (1, 10, 11, 4, 5)], "qid long, note_id long, stage int, slot int, unless int")
    assert [r.note_id for r in fusion.splice(listed, pins).orderBy("rank").collect()] == [99, 10, 20, 40, 30]
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "qid long, note_id long, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "qid long, note_id long, rank int")
    assert [r.note_id for r in fusion.interleave(a, b).orderBy("rank").collect()] == [5, 6, 7]
    s = fusion.compare_sides(spark.createDataFrame([(1, "tea vs coffee?"), (2, "difference between mocha and latte"), (3, "tea")], "qid long, question string"))
    assert sorted((r.qid, r.question) for r in s.collect()) == [(1, "coffee"), (1, "tea"), (2, "latte"), (2, "mocha")]


def test_typos_and_variants(spark):
    df = spark.createDataFrame([("espresso", 3), ("extraction", 2), ("reports", 9), ("report", 2)], "term string, df long")
    stats = spark.createDataFrame([(100,)], "n long")
    q = spark.createDataFrame([(1, "espreso", 0), (1, "extration", 0)], "qid long, term string, df long")
    assert {r.term: r.correction for r in lanes.corrections(q, ix.vocabulary(df), stats).collect()} == {"espreso": "espresso", "extration": "extraction"}
    assert {r.term: r.variant for r in lanes.morph_variants(df, spark.createDataFrame([("report",)], "term string")).collect()} == {"report": "reports"}


def test_audit(vault):
    kinds = {(r.kind, r.path) for r in vault.check().collect()}
    assert ("broken-wikilink", "Knowledge/Espresso Ratios.md") in kinds
    assert ("sync-conflict-copy", "Knowledge/Espresso Ratios (conflicted copy 2021-06-01 0).md") in kinds
    assert ("missing-frontmatter", "Private/Secret.md") in kinds and ("orphan-note", "Private/Secret.md") in kinds
    assert ("invalid-status", "Knowledge/Milk.md") in kinds
    details = {(r.path, r.detail) for r in vault.check().where("kind = 'invalid-frontmatter'").collect()}
    assert ("Knowledge/Milk.md", "empty updated") in details and ("People/Ana Diaz.md", "empty tags") in details
    assert 40 <= audit.health(vault.check(), vault.corpus).first().score <= 100
    dismissed = vault.check().select(audit.finding_key(F.col("kind"), F.col("path"), F.col("detail")).alias("key"))
    assert audit.without_dismissed(vault.check(), dismissed).count() == 0


def test_time(spark, vault):
    ev = temporal.body_events(vault.corpus).collect()
    assert [(r.path, r.date) for r in ev] == [("Logs/Bot/Session 5 June 2021.md", datetime.date(2021, 7, 7))]
    texts = ["see [[Log 7 Jul 2021]]", "`7 Jul 2021`", "http://x/2021-07-07", "v2021-07-07-final", "merged from old, 7 Jul 2021", "31 Feb 2021", "On July 9, 2021 and 2021-07-08."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    assert sorted((r.id, str(r.date)) for r in temporal.body_events(df, "id", "body").collect()) == [(6, "2021-07-08"), (6, "2021-07-09")]
    got = {r.path: r.tier for r in temporal.recent(vault.corpus, "2021-06-01", "2021-06-30", limit=None).collect()}
    assert got["Logs/Bot/Session 5 June 2021.md"] == 0 and got["Knowledge/Espresso Ratios.md"] == 1


def test_structure(spark, vault):
    roll = {r.folder: r.n for r in structure.folder_rollup(vault.corpus).collect()}
    assert roll["Knowledge"] == 3 and roll["Logs"] == 1 and roll["Logs/Bot"] == 1
    out = [(r.heading, r.level, r.offset) for r in structure.outline(spark.createDataFrame([("p", "# A\n```\n# no\n```\n## B")], "path string, body string")).orderBy("nth").collect()]
    assert out == [("A", 1, 0), ("B", 2, 17)]
    req = spark.createDataFrame([(1, "memory", "Plan", "Bot", datetime.date(2021, 6, 5)), (2, "nope", "x/y", None, datetime.date(2021, 6, 5))], "id int, type string, title string, source string, date date")
    assert {r.id: r.path for r in structure.route(req).collect()} == {1: "Memory/Bot/2021/06 Jun/Bot Plan 05 Jun 2021.md", 2: "Inbox/x - y.md"}
    assert structure.folder_document(vault.corpus, "Knowledge", 100).agg(F.sum(F.length("text"))).first()[0] == 100
    assert vault.map().count() > 0 and vault.overview().first().notes == 7


def test_linking(vault):
    s = {(r.path, r.target) for r in vault.suggest_links().collect()}
    assert ("Knowledge/Milk.md", "People/Ana Diaz.md") in s
    done = linking.apply_links(vault.corpus, vault.suggest_links().where("path = 'Knowledge/Milk.md'")).first()
    assert done.body == "[[Ana Diaz|Ana Diaz]] steams milk."
    assert [(r.path, r.keep) for r in vault.cleanup().collect()] == [("Knowledge/Espresso Ratios.md", "Knowledge/Espresso Ratios (conflicted copy 2021-06-01 0).md")] or vault.cleanup().count() == 1


def test_access(spark, notes):
    agents = spark.createDataFrame([("a", [], ["Private/"]), ("b", ["Knowledge"], None), ("c", ["Know"], None), (None, [], [])], "agent_id string, read_scopes array<string>, deny_read array<string>")
    n = notes.dropDuplicates(["note_id"])
    want = {a: access.scoped(n, agents.where(F.col("agent_id") == a)).count() for a in "abc"}
    assert {r.agent_id: r.n for r in access.readable_counts(n, agents).collect()} == want == {"a": 6, "b": 3, "c": 0}


def test_history(spark):
    v = spark.createDataFrame([("a", "1", T, "x", "m", "one"), ("a", "2", T + datetime.timedelta(1), "x", "m", "two\nl"), ("b", "3", T, "x", "m", "gone")], "path string, oid string, ts timestamp, source string, message string, text string")
    disk = spark.createDataFrame([("a", "two\nm"), ("c", "new")], "path string, text string")
    got = {r.path: r.message for r in history.capture(v, disk, "2021-07-01 00:00:00").collect()}
    assert got == {"a": "edited +1 -1", "b": "deleted +0 -1", "c": "added +1 -0"}
    assert history.head(v, "2021-06-01 00:00:00").where("path = 'a'").first().text == "one"
    assert history.snapshot(v, spark.createDataFrame([("a", "two\nl"), ("b", "x")], "path string, text string")).count() == 1
    notes = spark.createDataFrame([("a", "t", "me", "me", None)], "path string, text string, created_by string, updated_by string, updated date")
    w = spark.createDataFrame([("a", "u", "bad", "bot"), ("n", "x", None, "bot")], "path string, text string, base_hash string, agent string")
    after = {r.path: (r.text, r.created_by) for r in history.upsert(notes, w, "2021-07-01").collect()}
    assert after == {"a": ("t", "me"), "n": ("x", "bot")}


def test_folder_source_and_sinks(spark, tmp_path):
    (tmp_path / "v/Sub").mkdir(parents=True)
    (tmp_path / "v/.git").mkdir()
    (tmp_path / "v/Sub/a.md").write_text("---\ntype: x\n---\nhello e\u0301")
    (tmp_path / "v/.git/b.md").write_text("no")
    (tmp_path / "v/big.md").write_text("x" * 100)
    files = src.read_folder(spark, str(tmp_path / "v"), max_bytes=50)
    got = {r.path: (r.text, r.unreadable) for r in files.collect()}
    assert got == {"Sub/a.md": ("---\ntype: x\n---\nhello \u00e9", False), "big.md": (None, True)}
    assert src.parse_notes(files).where("path = 'Sub/a.md'").first().frontmatter == "type: x"
    assert src.freshness(files).first().n == 2
    log = spark.createDataFrame([(1, "a", "A", "read", "p", "d" * 600), (2, "a", "A", "write", None, None)], src.ACTION)
    sinks.append_actions(log, str(tmp_path / "log"))
    back = src.read_actions(spark, str(tmp_path / "log"), 1).collect()
    assert [r.at_ms for r in back] == [2]
    assert sinks.write_changed(log, str(tmp_path / "t"), "at_ms", None) and not sinks.write_changed(log, str(tmp_path / "t"), "at_ms", spark.read.parquet(str(tmp_path / "t")))
    y = spark.createDataFrame([("a: b", "true", "plain")], "x string, y string, z string").select(sinks.front_yaml([("x", "x"), ("y", "y"), ("z", "z")]).alias("o")).first().o
    assert y == 'x: "a: b"\ny: "true"\nz: plain'


def test_streaming(spark, tmp_path, notes):
    n = notes.select("note_id", "path", "frontmatter", "body", "mtime", "synced_at")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    n.where("note_id <= 100").write.parquet(source)
    go = lambda: upkeep.keep_notes(upkeep.note_stream(spark, source, 100), target, str(tmp_path / "cp"), 4).awaitTermination()
    at = lambda days, body: n.where("note_id = 100").dropDuplicates().withColumn("body", F.lit(body)).withColumn("synced_at", F.lit(T + datetime.timedelta(days)))
    state = lambda: {r.note_id: r.body for r in upkeep.latest(spark, target).collect()}
    go()
    assert len(state()) == 2
    at(2, "edited").unionByName(n.where("note_id = 150")).write.mode("append").parquet(source)
    go()
    assert set(state()) == {50, 100, 150} and state()[100] == "edited"
    at(1, "late and older").write.mode("append").parquet(source)
    go()
    assert state()[100] == "edited"
    upkeep.compact(spark, target)
    before = state()
    assert before[100] == "edited" and upkeep._numbers(spark, f"{target}/changes") == []
    at(3, "newest").write.mode("append").parquet(source)
    go()
    assert state() == {**before, 100: "newest"}


def test_streamed_graph(spark, tmp_path, notes):
    n = notes.select("note_id", "path", "frontmatter", "body", "mtime", "synced_at").dropDuplicates(["note_id"])
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    go = lambda: upkeep.keep_edges(upkeep.note_stream(spark, source, 100), target, str(tmp_path / "cp")).awaitTermination()
    n.where("note_id != 100").write.parquet(source)
    go()
    edges = lambda v: {(r.src, r.dst, r.unresolved) for r in spark.read.parquet(f"{target}/edges/v={v}").collect()}
    assert ("Knowledge/Espresso Ratios.md", "Ana Diaz", True) in edges(0)
    n.where("note_id = 100").write.mode("append").parquet(source)
    go()
    every = src.corpus(n.withColumn("aliases", F.when(F.col("note_id") == 50, F.array().cast("array<string>"))))
    assert edges(1) == {(r.src, r.dst, r.unresolved) for r in graph.build(every).collect()}


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    rows = [(i, 10**12 + at, "a", k) for i, at, k in ((1, 0, "Write "), (1, 0, "write"), (2, 60_000, "read"), (3, 4_000_000, "read"))]
    spark.createDataFrame(rows, "entry_id long, at_ms long, agent_id string, action_kind string").write.parquet(str(tmp_path / "in"))
    stream = lambda: upkeep.action_stream(spark, str(tmp_path / "in"), "entry_id long, at_ms long, agent_id string, action_kind string")

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name != "once" else "append").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert len(run(upkeep.once(stream()), "once")) == 3
    for name, df in (("windows", upkeep.activity_windows(stream())), ("sessions", upkeep.live_sessions(stream()))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None


def test_evaluation(spark, vault):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert {r.point: r.value for r in evaluate.percentiles(df, "v").collect()} == {50: 50.0, 90: 90.0, 99: 99.0}
    assert evaluate.percentiles(df.where("v < 0"), "v").count() == 0
    s = spark.createDataFrame([(1, "known", "q", 5), (2, "negative", "q", None)], "id long, family string, question string, target long")
    a = spark.createDataFrame([(1, 5, 2), (2, 9, 1)], "id long, note_id long, rank int")
    o = spark.createDataFrame([(1, True), (2, False)], "id long, found boolean")
    assert {r.family: r["pass"] for r in evaluate.grade(s, a, o).collect()} == {"known": True, "negative": True}


def test_empty_vault(spark):
    v = Vault(src.corpus(spark.createDataFrame([], NOTES)))
    assert v.edges.count() == v.check().count() == v.related().count() == v.suggest_links().count() == 0
    q = spark.createDataFrame([(1, "anything here")], "qid long, question string")
    answers, outcomes = v.recall(q)
    assert answers.count() == 0 and not any(r.found for r in outcomes.collect())


def test_tables_kept_and_deleted(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.md", "x"), (2, "b.md", "y")], "note_id long, path string, text string")
    sinks.write_table(df, str(tmp_path / "t"))
    gone = spark.createDataFrame([("a.md",), ("z.md",)], "path string")
    assert sinks.delete_notes(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"), gone) == 1
    assert [r.path for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["b.md"]
    assert sinks.delete_notes(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"), gone) == 0
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "note_id long, vec array<float>")
    for build in ("b1", "b2"):
        sinks.write_vectors(v.where(f"'{build}' = 'b1' or note_id = 1"), str(tmp_path / "v"), build)
    assert sinks.read_built_vectors(spark, str(tmp_path / "v")).count() == 1
    sinks.write_map(spark.createDataFrame([("Work", 1, 3, 0), ("Work/A", 2, 2, 1)], "folder string, depth int, n long, hubs long"), str(tmp_path / "map"))
    assert [r.value for r in spark.read.text(str(tmp_path / "map")).collect()] == ["- Work/ (3)", "  - A/ (2) · hubs: 1"]
    live, old = sinks.rotate_actions(spark.createDataFrame([(i, "a") for i in range(5)] + [(None, "a")], "at_ms long, agent_id string"), 2)
    assert sorted(r.at_ms for r in live.collect()) == [3, 4] and old.count() == 4


def test_configuration():
    good = {"schemaVersion": 1, "partitions": {"core": [{"path": "Work//Clients/", "job": "work"}, {"path": "Private", "job": "own", "gated": True, "gateTopics": ["health"]}]}, "noteTypes": ["log"], "frontmatter": {"required": ["type"]}}
    s = structure.validate_schema(good)
    assert structure.partition_paths(s) == ["Work/Clients", "Private"]
    assert "Private/" in structure.filing_rules(s) and "Private" not in structure.filing_rules(s, ["Work"])
    for bad in ({}, {**good, "noteTypes": []}, {**good, "partitions": {"core": [{"path": "../x", "job": "j"}]}}, {**good, "partitions": {"core": [{"path": "/x", "job": "j"}]}}, {**good, "frontmatter": {}}, {**good, "partitions": {"core": [{"path": "x"}]}}):
        with pytest.raises(ValueError):
            structure.validate_schema(bad)


def test_pruning_keeps_the_newest_of_the_store(spark):
    rows = [("p", str(i), T + datetime.timedelta(hours=i)) for i in range(120)] + [("q", "x", None)]
    v = spark.createDataFrame(rows, "path string, oid string, ts timestamp")
    got = {r.oid for r in history.prune(v, 60).collect()}
    assert got == {str(i) for i in range(60, 120)}
    assert history.prune(v, 3).count() == 50 and history.prune(v).count() == 121


def test_relaxed_and_semantic_recall(spark, vault):
    q = spark.createDataFrame([(1, "zzqxw espresso ratios knowledge"), (2, "how does espresso ratios compare to Ana Diaz?")], "qid long, question string")
    answers, outcomes = vault.recall(q, as_of="2021-07-01")
    found = {r.qid: r for r in outcomes.collect()}
    assert found[2].found and {r.path for r in answers.where("qid = 2 and rank <= 2").collect()} >= {"People/Ana Diaz.md"}
    chunks = spark.createDataFrame([(50, [1.0, 0.0], None), (301, [0.0, 1.0], "stale")], "note_id long, vec array<float>, note_hash string")
    v = Vault(vault.corpus, chunks)
    ask = spark.createDataFrame([(7, "zzqxw espresso ratios knowledge")], "qid long, question string")
    near = spark.createDataFrame([(7, [1.0, 0.1])], "qid long, vec array<float>")
    assert v.recall(ask, near)[0].where("rank = 1").first().path.startswith("Knowledge/Espresso")
    assert lanes.semantic(near, chunks).count() == 2 and lanes.semantic(near.where("false"), chunks).count() == 0


def test_unreadable_notes_keep_their_edges(spark, vault):
    lost = spark.createDataFrame([("Knowledge/Espresso Ratios.md",)], "path string")
    left = vault.corpus.where("path != 'Knowledge/Espresso Ratios.md'")
    old = vault.corpus.select("path", F.substring(F.sha1("raw"), 1, 16).alias("hash"))
    kept = graph.rebuild(vault.edges, old, left, unreadable=lost)
    assert {r.dst for r in kept.where("src = 'Knowledge/Espresso Ratios.md'").collect()} == {"People/Ana Diaz.md", "Missing Note"}


def test_unused_words_of_the_functions(spark, vault):
    from marginalia.functions import text as tx
    from marginalia.functions import udfs

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.money(F.lit("$ 1,200 and $5 and $300"))) == 2 and one(tx.is_status(F.lit("where did we stop"))) and not one(tx.is_status(F.lit("tea")))
    assert one(tx.relative_time(F.lit(0), F.lit(3_600_000))) == "60 min ago" and one(tx.defang(F.lit("<!-- written by x"))).startswith("<!- ")
    assert one(tx.boundary_hits(F.lit("Acme, acme-x acme"), F.lit("acme"))) == 2 and one(tx.rewrite_token(F.lit("a tea b"), F.lit("tea"), F.lit("milk"))) == "a milk b"
    assert access.live(spark.createDataFrame([(T,), (None,)], "expires_at timestamp"), F.lit(T + datetime.timedelta(1)).cast("timestamp")).count() == 1
    agents = spark.range(1).select(access.can_write(F.lit("Work/a.md"), F.array().cast("array<string>"), None_(), F.array(F.lit("Work"))).alias("x"))
    assert agents.first().x
    assert not one(access.can_read(F.lit("./System/x.md"), F.array().cast("array<string>"), F.array().cast("array<string>"))) and not one(access.can_read(F.lit("a/../../x"), F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert evaluate.rank_histogram(spark.createDataFrame([(1,), (4,), (9,)], "rank int")).count() == 3
    assert {r["class"] for r in evaluate.taxonomy(spark.createDataFrame([(1, None, None, None), (2, 4, False, None), (3, 1, True, None), (4, None, False, True)], "id long, rank int, same_question boolean, same_text boolean")).collect()} == {"miss", "near-rank", "doubled-key", "equivalent"}
    assert evaluate.threshold_sweep(spark.createDataFrame([(0.2, False), (0.9, True)], "score double, positive boolean"), 10).count() == 10
    assert evaluate.contaminated(spark.createDataFrame([(1, "negative", "arabica zzz")], "id long, family string, question string"), vault.doc_freq).count() == 1
    assert audit.skipped_checks(False, False) and not audit.skipped_checks(True, True)
    assert one(udfs.yaml_json(F.lit("a: ["))) is None
    r = linking.related_sections(spark.createDataFrame([("a", "b", 0.1, "both", 1), ("a", "c", 0.1, "text", 2), ("d", "e", 0.1, "both", 1)], "a string, b string, score double, via string, nth int"))
    assert sorted(x.b for x in r.collect()) == ["b", "c"]
    v = spark.createDataFrame([("a", "1", T, "x", "m", "one")], "path string, oid string, ts timestamp, source string, message string, text string")
    assert history.restore(v, "a", "1", "2021-07-01").first().text == "one" and history.list_versions(v, "a").count() == 1 and history.purge(v, spark.createDataFrame([("a",)], "path string")).count() == 0
    found = spark.createDataFrame([("k", "a.md", "b/c.md"), ("k", "z.md", "x")], "kind string, path string, detail string")
    assert [r.detail for r in access.redact(found, spark.createDataFrame([("a.md",)], "path string")).collect()] == ["(outside your scope)"]


def None_():
    return F.lit(None).cast("array<string>")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_of_a_note_are_counted_where_it_lies(spark):
    f = spark.createDataFrame([(1, ["a"], [], ["b", "a", "b", "b"]), (2, [], ["c", "c"], []), (3, [], [], [])], "note_id long, title array<string>, head array<string>, body array<string>")
    t = ix.terms(f, cap=2)
    assert "Exchange" not in _plan(t)
    assert sorted(map(tuple, t.collect())) == [(1, "a", 1, 0, 1, 1, [1]), (1, "b", 0, 0, 3, 0, [0, 2]), (2, "c", 0, 2, 0, None, [])]


def test_best_notes_by_blocks_are_those_of_all_hits(spark, vault):
    rows = [(n, f"Logs/N {n}.md", [f"w{n % 3}"], [f"w{n % 5}"] * (n % 2), [f"w{k % 7}" for k in range(n % 11)]) for n in range(300)]
    f = spark.createDataFrame(rows, "note_id long, path string, title array<string>, head array<string>, body array<string>").repartition(3)
    lengths, terms = ix.lengths(f), ix.terms(f)
    stats = ix.stats(lengths)
    asked = spark.createDataFrame([(k, f"w{k} w{k + 2} w{k} absent") for k in range(7)], "qid long, question string")
    q = lanes.with_idf(ix.question_terms(asked), ix.doc_freq(terms), stats)
    priors = f.select("note_id", text.source_prior(F.col("path")).alias("prior"))
    want = lanes.ranked(lanes.bm25f(q, terms, lengths, stats, priors), 9)
    for block, cells in ((4096, 1_000_000), (2, 10)):
        best = lanes.bm25f_best(q, f, stats, 9, block, cells)
        assert {(r.qid, r.note_id, r["rank"], round(r.score, 9)) for r in best.collect()} == {(r.qid, r.note_id, r["rank"], round(r.score, 9)) for r in want.collect()}
        assert "Join" not in _plan(best)  # no hit meets its term by a shuffle
    assert lanes.bm25f_best(q.where("false"), f, stats, 9).count() == 0


def test_coverage_of_a_note_that_many_questions_ask_for(spark, vault):
    asked = spark.createDataFrame([(k, "arabica beans" if k % 2 else "grind the arabica beans for a balanced extraction") for k in range(600)], "qid long, question string")
    q = lanes.with_idf(ix.question_terms(asked), vault.doc_freq, vault.stats)
    pool = asked.select("qid", F.lit(50).cast("long").alias("note_id"))
    got = {r.qid: r.cov for r in lanes.coverage(q, pool, vault.corpus, vault.priors).collect()}
    assert len(got) == 600 and got[1] == 1.0 and got[2] == 0.25  # the second quotes the note


def test_a_text_stays_one_row_while_names_are_looked_for(spark):
    c = spark.createDataFrame([("a.md", "Ana Diaz met Ana. Not ana-x, see Ana Diaz Ruiz.md; ana\nDiaz"), ("b.md", ""), ("c.md", "nobody")], "path string, body string")
    p = spark.createDataFrame([("ana", "A", 1), ("ana diaz", "B", 2), ("ana diaz ruiz", "C", 3)], "phrase string, path string, words int")
    m = linking.mentions(c, p)
    assert sorted((r.phrase, r.at, r.shown) for r in m.collect()) == [("ana", 1, "Ana"), ("ana", 4, "Ana"), ("ana", 9, "Ana"), ("ana", 13, "ana"), ("ana diaz", 1, "Ana Diaz"), ("ana diaz", 9, "Ana Diaz")]
    assert "Generate posexplode" not in _plan(m)  # which put the whole text beside each of its words
