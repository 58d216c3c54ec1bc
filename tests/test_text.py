import datetime

from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions import udfs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("o")).first().o


def test_tokens(spark):
    t = lambda s: one(spark, s, tx.tokens)
    assert t("The Phase 2 rollout on 16th of July") == ["phase", "phase 2", "2", "rollout", "16", "july"]
    assert t("Zürich <!-- written by x --> c 5") == ["zürich", "c 5", "5"]
    assert t("محـمد كتب؟ ١٢ كتاب") == ["محمد", "كتب", "كتب 12", "12", "كتاب"]
    assert t("") == [] and t(None) is None


def test_dates(spark):
    d = lambda p, f=None: tuple(spark.createDataFrame([(p, f)], "p string, f string").select(tx.note_date(F.col("p"), F.col("f")).alias("d")).first().d)
    assert d("a/Phase 2 rollout 2026 26 Jul 2026.md") == (datetime.date(2026, 7, 26), "name")
    assert d("a/x 2026-13-05 2026-02-03.md") == (datetime.date(2026, 2, 3), "name")
    assert d("a/x 31 Feb 2026.md", "updated: 2026-01-05") == (datetime.date(2026, 1, 5), "front")
    assert d("Logs/2026/07 Jul/x.md") == (datetime.date(2026, 7, 1), "path")
    assert d("x.md") == (None, None)


def test_front_matter_and_aliases(spark):
    raw = "---\r\ntype: note\r\naliases:\r\n  - \"A, B\"\r\n  - it's\r\n---\r\nbody"
    assert one(spark, raw, tx.file_body) == "body"
    assert one(spark, one(spark, raw, tx.front_matter), tx.aliases) == ["A, B", "it's"]
    assert one(spark, "aliases: [\"x, y\", z]", tx.aliases) == ["x, y", "z"]
    assert one(spark, "no block", tx.front_matter) is None


def test_paths(spark):
    assert one(spark, "a/./b//c/../d.md", tx.normalize_rel) == "a/b/d.md"
    assert one(spark, "a/../../x", tx.normalize_rel) is None and one(spark, "/etc", tx.normalize_rel) is None and one(spark, "C:\\x", tx.normalize_rel) is None
    assert one(spark, "x/Project Index.md", tx.source_prior) == 0.5 and one(spark, "Landing Mockups.md", tx.source_prior) == 1.0
    assert one(spark, "Logs/x 5 Jul 2026.md", tx.date_key) == "x"
    assert one(spark, " a:b?.. ", tx.sanitize_segment) == "a - b -"


def test_links_and_words(spark):
    body = "see [[One|1]] and ![[pic.png]] `[[no]]`\n```\n[[never]]\n```\n[[Two#part]] [[ ]]"
    assert one(spark, body, tx.wikilinks) == ["One", "Two"]
    assert one(spark, "ab", tx.deletes1) == ["ab", "b", "a"] and one(spark, "", tx.deletes1) == [""]
    assert one(spark, "abc", tx.trigrams) == ["  a", " ab", "abc", "bc "]
    assert one(spark, "letter", tx.skeleton) == "ltr"
    assert one(spark, "Who is our accountants", tx.relationship_role) == "accountants"
    assert one(spark, "can you pull up the budget", tx.strip_frames) == "the budget"
    assert one(spark, "# Head", lambda c: tx.note_title(F.lit("a/b.md"), c)) == "Head"


def test_arrow_functions(spark):
    assert [udfs.osa_distance(a, b) for a, b in (("ca", "abc"), ("abcd", "acbd"), ("", "ab"), ("x" * 9, "y"))] == [3, 1, 2, 4]
    assert udfs.min_span([[1, 9, 30], [4, 29]]) == 1 and udfs.min_span([[1], []]) is None
    assert udfs.line_diff("a\nb", "a\nc") == [(" ", "a"), ("-", "b"), ("+", "c")]
    assert udfs.line_diff(None, "x") == [("+", "x")] and udfs.line_diff("a\nb", "c", 1) == [("-", "a"), ("-", "b"), ("+", "c")]
    assert one(spark, "e\u0301", udfs.nfc) == "\u00e9"
