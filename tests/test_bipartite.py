import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.operators import bipartite, graph


@pytest.mark.parametrize(("pairs", "held"), [(bipartite.PAIRS, bipartite.HELD), (300, 40)])
def test_best_of_each_without_a_shuffled_pair(spark, pairs, held):
    r = random.Random(5)
    rows = [(r.choice([*range(95, 125), None]), r.choice([*range(5, 45), None])) for _ in range(400)] + [(200, k) for k in range(300, 470)] + [(201, k) for k in range(460, 480)] + [(-7, 300), (10**18, 300)]
    edges = spark.createDataFrame(rows, "left long, right long")
    e = edges.select(F.concat(F.lit("c"), F.col("left").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("right").cast("string")).alias("dst")).distinct()
    adj = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    w = Window.partitionBy("a").orderBy(F.round("score", 9).desc(), "b")
    want = graph.both_ways(graph.link_relatedness(adj, 40)).withColumn("nth", F.row_number().over(w)).where("nth <= 8").select("a", "b", "nth", F.round("score", 6)).collect()
    df = bipartite.related(edges, ("c", "p"), most_degree=40, pairs=pairs, held=held)
    assert sorted(map(tuple, df.select("a", "b", "nth", F.round("score", 6)).collect())) == sorted(map(tuple, want)) and want
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_edges(spark):
    assert bipartite.related(spark.createDataFrame([], "left long, right long"), ("c", "p")).count() == 0


@pytest.mark.parametrize(("pairs", "held"), [(bipartite.PAIRS, bipartite.HELD), (300, 40)])
def test_partners_through_hubs(spark, pairs, held):
    """What more than 150 bought relates its buyers, and who bought more than 150 things relates these."""
    r = random.Random(6)
    rows = [(k, 1) for k in range(230)] + [(k, 2) for k in range(200, 420)] + [(500, k) for k in range(2, 190)] + [(r.randrange(600), r.randrange(900)) for _ in range(500)]
    edges = spark.createDataFrame(rows, "left long, right long")
    e = edges.select(F.concat(F.lit("c"), F.col("left").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("right").cast("string")).alias("dst")).distinct()
    adj = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    w = Window.partitionBy("a").orderBy(F.round("score", 9).desc(), "b")
    want = graph.both_ways(graph.link_relatedness(adj, len(rows))).withColumn("nth", F.row_number().over(w)).where("nth <= 8").select("a", "b", "nth", F.round("score", 6)).collect()
    got = sorted(map(tuple, bipartite.related(edges, ("c", "p"), pairs=pairs, held=held).select("a", "b", "nth", F.round("score", 6)).collect()))
    assert got == sorted(map(tuple, want)) and len({a for a, *_ in got if a[0] == "c"}) > 400
