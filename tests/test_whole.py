import datetime
import itertools

from marginalia.api import Vault
from marginalia.functions.udfs import osa_distance
from marginalia.operators import delivery, temporal
from marginalia.operators import index as ix
from marginalia.sources import vault as src


def test_dates_late_in_a_long_note(spark):
    body = "word " * 6000 + "\n```\n" + "code 2021-01-01\n" * 10 + "```\nWe met on 2021-07-08."
    df = spark.createDataFrame([(1, body)], "id long, body string")
    assert [str(r.date) for r in temporal.body_events(df, "id", "body").collect()] == ["2021-07-08"]
    assert temporal.body_events(df, "id", "body", scan=20_000).count() == 0
    corpus = spark.createDataFrame([(1, "Notes/a.md", body, body, "", datetime.datetime(2020, 1, 1))], "note_id long, path string, body string, raw string, front string, mtime timestamp")
    assert [r.note_id for r in temporal.recent(corpus, "2021-07-01", "2021-07-31", ["word"]).collect()] == [1]


def test_one_edit_pairs_of_rare_words_in_any_script(spark):
    words = {"seminar": 40, "seminra": 1, "team": 9, "tean": 1, "café": 3, "cafés": 1, "مكتب": 7, "مكتبة": 2, "x" * 30: 1, "x" * 31: 1, "other": 5, "oth": 5}
    v = ix.vocabulary(spark.createDataFrame([*words.items()], "term string, df long"))
    got = {(r.term, r.other) for r in ix.one_edit_pairs(v).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and min(len(a), len(b)) >= 4 and osa_distance(a, b, 1) == 1}
    assert len(got) == 5


def test_one_edit_pairs_of_all_short_words_and_runs(spark):
    words = {"".join(w) for n in (3, 4, 5) for w in itertools.product("abc", repeat=n)} | {"aaaa" + "b" * n for n in range(5)} | {"12345", "12354", "13245", "1234", "😀bcd", "b😀cd"}
    got = [(r.term, r.other) for r in ix.one_edit_pairs(spark.createDataFrame([(w,) for w in words], "term string")).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and osa_distance(a, b, 1) == 1)


def test_one_edit_pairs_of_long_words(spark, monkeypatch):
    """Words of thousands of letters, whose delete-one forms hold millions; and short ones taken the long way."""
    w = "".join(f"{i:x}" for i in range(9000))
    words = [w, w[:99] + w[100:], w[:99] + "q" + w[100:], w[:50] + w[51] + w[50] + w[52:], w[::-1], "x" * 24, "x" * 25, "x" * 23, "ab" * 12, "ab" * 11 + "ba", "ab" * 12 + "é"]
    df = spark.createDataFrame([(x,) for x in words], "term string")
    got = sorted((words.index(r.term), words.index(r.other)) for r in ix.one_edit_pairs(df).collect())
    assert sorted(tuple(sorted(p)) for p in got) == [(0, 1), (0, 2), (0, 3), (1, 2), (5, 6), (5, 7), (8, 9), (8, 10)]
    monkeypatch.setattr(ix, "LONG", 3)
    words = ["".join(x) for n in (4, 5) for x in itertools.product("abc", repeat=n)]
    got = [(r.term, r.other) for r in ix.one_edit_pairs(spark.createDataFrame([(x,) for x in words], "term string")).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and osa_distance(a, b, 1) == 1)


def test_one_edit_pairs_send_words_once_and_broadcast_nothing(spark, tmp_path):
    """The words and their delete-one forms travel, the pairs don't; a side that unfolds isn't broadcast, whatever its estimate."""
    spark.createDataFrame([("seminar",), ("seminra",)], "term string").write.parquet(str(tmp_path / "words"))
    plan = ix.one_edit_pairs(spark.read.parquet(str(tmp_path / "words")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "hashpartitioning(k#" in plan and not [x for x in plan.split("\n") if "BroadcastHashJoin [k#" in x or "BroadcastHashJoin [h#" in x]


def test_words_without_the_index(spark):
    corpus = src.corpus(src.notes(spark, "/root/testdata/sf0.001"))
    v = Vault(corpus)
    got = sorted(r.term for r in v.words.collect())
    assert not {"terms", "fields", "doc_freq", "vocabulary"} & set(v.__dict__)
    assert got == sorted(r.term for r in v.vocabulary.collect()) == sorted(r.term for r in v.words.collect())


def test_passages_of_a_long_note_have_no_cap(spark):
    body = "\n".join(f"## Part {i}\n" + f"sentence {i} " * 12 for i in range(60))
    c = spark.createDataFrame([(1, "a.md", "A", body)], "note_id long, path string, title string, body string")
    assert sorted(r.heading for r in delivery.embedding_chunks(c, cap=None).collect()) == sorted(f"Part {i}" for i in range(60))
    assert delivery.embedding_chunks(c).count() == 40
