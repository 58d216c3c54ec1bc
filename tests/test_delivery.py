import datetime

from pyspark.sql import functions as F

from marginalia.operators import delivery as dl


def test_densest():
    text = "aaa " * 300 + "needle and thread " + "bbb " * 300
    assert "needle and thread" in dl.densest(text, ["needle", "thread"], [2.0, 2.0], 400) and len(dl.densest(text, ["needle"], [1.0], 400)) <= 400
    assert dl.densest("short", ["x"], [1.0], 400) == "short" and dl.densest(text, ["zzz"], [1.0], 10) == text[:10]


def test_chunks():
    assert dl.chunks_of("") == [] and dl.chunks_of("one\n\ntwo") == [("", "one\n\ntwo")]
    big = "# A\n" + "para one. " * 200 + "\n\n## tiny\nx\n\n## B\n" + "para two. " * 200
    got = dl.chunks_of(big)
    assert {h for h, _ in got} == {"A", "B"} and all(len(t) <= 1400 for _, t in got)


BODY = "# One\nbeans beans beans beans\n" + "x " * 2500 + "\n## Two\nbeans and [[B]]"


def test_sections_and_checks(spark):
    corpus = spark.createDataFrame([(1, "K/A.md", "A", "type: note", [], BODY, BODY, None), (2, "P/B.md", "B", "type: person", [], "b", "b", datetime.datetime(2021, 1, 1))], "note_id long, path string, title string, front string, aliases array<string>, body string, raw string, mtime timestamp")
    q = spark.createDataFrame([(1, "beans", 1.0)], "qid long, term string, idf double")
    pool = spark.createDataFrame([(1, 1)], "qid long, note_id long")
    s = dl.best_sections(q, pool, corpus)
    rows = s.orderBy("nth").collect()
    assert [round(r.score, 1) for r in rows] == [3.0, 1.0] and len(rows[0].section) <= 1800
    ans = spark.createDataFrame([(1, 1, 1)], "qid long, note_id long, rank int")
    assert dl.deliver(ans, s, chars=100).count() == 1 and dl.deliver(ans, s, chars=5000).count() == 2
    names = spark.createDataFrame([("b", "P/B.md")], "name string, path string")
    assert [r.target for r in dl.pointers(s, names).collect()] == ["P/B.md"]
    qs = spark.createDataFrame([(1, "who is our accountant"), (2, "beans")], "qid long, question string")
    assert [(r.qid, r.honest) for r in dl.relationship_check(qs, ans, corpus).collect()] == [(1, True)]
    assert dl.embedding_chunks(corpus).where("note_id = 2").first().passage == "B\nb"
    known = spark.createDataFrame([(1, 1, 1, 0.6, 0.6, 2), (1, 2, 2, 0.6, 0.6, 2)], "qid long, note_id long, nth int, cover double, cover_idf double, matches long")
    series = corpus.withColumn("path", F.concat(F.lit("Logs/Standup "), F.col("note_id").cast("string"), F.lit(" Jul 2021.md")))
    assert [(r.series, r.n) for r in dl.sibling_clarify(q, known, series).collect()] == [("standup", 2)]
