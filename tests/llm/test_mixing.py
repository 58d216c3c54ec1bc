import os

import pytest
from pyspark.sql import functions as F

from marginalia.llm import bpe, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


def tables(spark):
    docs = [(i, f"text number {i} " + "word " * (i % 37), "a") for i in range(300)] + [(1000 + i, f"other {i} " + "long " * (i % 11), "b") for i in range(40)] + [(2000 + i, f"small {i}", "c") for i in range(5)]
    docs += [(3000, None, "a"), (3001, "", "b"), (3002, "text number 1 word ", None), (3003, "text number 5 " + "word " * 5, "b"), (3004, "no target", "z")]
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, slot int, copy string"), spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("c", 0.05, 8), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    docs, targets = tables(spark)
    have = mixing.stock(docs, targets, "doc_id", "text", F.col("source"))
    m = mixing.mix(docs, targets, stocked=have, block_tokens=64).cache()
    s = {r.source: r for r in mixing.shares(m, targets, have).collect()}
    assert s["none"].mixed_tokens == 0 and all(s[k].most_copies <= s[k].max_repeats for k in s)
    total = sum(s[k].target_share for k in "abc")
    assert all(abs(s[k].share - s[k].target_share / total) < 0.01 for k in "abc")
    assert m.where("slot is null").count() == 0
    assert m.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    # every stretch of the mix holds the sources in their weights
    half = m.where(F.col("slot") <= m.agg(F.max("slot")).first()[0] / 2)
    share = half.where("source = 'a'").agg(F.sum("n_tokens")).first()[0] / half.agg(F.sum("n_tokens")).first()[0]
    assert abs(share - 0.6 / total) < 0.08


def test_one_text_under_two_ids_counts_once(spark):
    docs, targets = tables(spark)
    ids = {r.key for r in mixing.stock(docs, targets, "doc_id", "text", F.col("source")).collect()}
    assert 5 in ids and 3003 not in ids and not ids & {3000, 3001, 3002, 3004}


def test_quotas():
    t = {"a": (0.5, 2), "b": (0.5, 1), "c": (0.0, 9)}
    assert mixing.quotas({"a": 100, "b": 50}, t) == {"a": 50, "b": 50}
    assert mixing.quotas({"a": 100, "b": 50}, t, 160) == {"a": 110, "b": 50}
    assert mixing.quotas({"a": 100, "b": 50}, t, 10**6) == {"a": 200, "b": 50}
    assert mixing.quotas({}, t) == {}


def test_empty(spark):
    docs, targets = tables(spark)
    assert mixing.mix(docs.where("false"), targets).count() == 0 and mixing.mix(docs, targets.where("false")).count() == 0


def test_no_text_without_a_slot(spark):
    """A source too small for the schedule's slack still gets a slot for each block."""
    docs = spark.createDataFrame([(i, f"word{i} " * 400, "big") for i in range(300)] + [(1000 + i, f"rare{i} " * 40, "tiny") for i in range(3)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.9999, 2), ("tiny", 0.0001, 9)], "source string, target_share double, max_repeats int")
    out = mixing.mix(docs, targets, block_tokens=8)
    assert out.where("slot is null").count() == 0 and out.where("source = 'tiny'").count() > 0
