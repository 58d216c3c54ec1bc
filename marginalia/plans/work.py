"""Registered queries: costs, contexts, hubs, maps, views, writes, filing, grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import audit, delivery, evaluate, graph, history, lanes, structure
from marginalia.plans import sql
from marginalia.plans.cases import _notes, values
from marginalia.plans.catalog import query, table
from marginalia.plans.knowledge import corpus
from marginalia.plans.retrieval import _asked, _bm, vault


def _first(v):
    q = _asked(v)
    return _bm(v, q, 5)


_COSTS = sql.BM25 + """, sz as (select note_id, length(raw) n from c), rk as (select qid, bm.note_id, rank, n from bm join sz using (note_id) where rank <= 5), hf as (select qid, min(rank) f from rk where note_id = qid group by qid),
arms as (select qid, 'snippets' arm, sum(ceil(least(n, 4000) / 4))::bigint tokens from rk left join hf using (qid) where rank <= coalesce(f, 5) group by qid union all select qid, 'whole', sum(ceil(n / 4))::bigint from rk group by qid union all select q0.qid, 'oracle', ceil(n / 4)::bigint from (select distinct qid from q) q0 join sz on note_id = qid),
od as (select arm, tokens, row_number() over (partition by arm order by tokens) - 1 i, count(*) over (partition by arm) n from arms)"""


@query(_COSTS + " select arm, count(*) n, max(tokens) filter (i = floor(n / 2)) median, floor(avg(tokens) + 0.5)::bigint as mean, max(tokens) filter (i = least(n - 1, floor(n * 0.9))) p90 from od group by arm")
def reading_costs(spark, sf):
    """What three ways of reading cost, in tokens of four characters: median, mean, 90th percentile."""
    v = vault(spark, sf)
    gold = _asked(v).select("qid", F.col("qid").alias("note_id")).distinct()
    return evaluate.token_costs(evaluate.cost_arms(_first(v), gold, v.corpus), "arm", "tokens")


@query()
def context_usefulness(spark, sf):
    v = vault(spark, sf)
    top = v._keep(_first(v).join(v.corpus.select("note_id", "path"), "note_id").select("qid", "path", "rank"), "first-answers")
    truth = v.corpus.where("note_id % 50 = 0").select(F.col("note_id").alias("qid"), "path")
    return evaluate.context_useful(top, v.context(top), truth, graph.adjacency(v.edges))


@query("with e as (select distinct 'c' || o_custkey::varchar c, 'p' || l_partkey::varchar p from lineitem join orders on l_orderkey = o_orderkey), n as (select path, count(*) links from (select c path from e union all select p from e) group by path) select path, links from n where links >= 10 order by links desc, path limit 12")
def graph_hubs(spark, sf):
    """The hubs of the graph of who bought what."""
    e = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    n = e.select(F.col("src").alias("path")).unionByName(e.select(F.col("dst").alias("path"))).groupBy("path").agg(F.count("*").alias("links"))
    return structure.map_hubs(n)


@query("""with p as (select embedding[1]::double x, embedding[2]::double y from embeddings), o as (select x, row_number() over (order by x) - 1 i, count(*) over () n from p where x is not null), u as (select y, row_number() over (order by y) - 1 i, count(*) over () n from p where y is not null)
select round((select x from o where i = floor(n * 0.02)) - 60, 6) min_x, round((select y from u where i = floor(n * 0.02)) - 60, 6) min_y, round((select x from o where i = least(n - 1, floor(n * 0.98))) + 60, 6) max_x, round((select y from u where i = least(n - 1, floor(n * 0.98))) + 60, 6) max_y""")
def map_bounds(spark, sf):
    """The crop of a layout: here the first two numbers of each vector."""
    p = table(spark, sf, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return structure.layout_bounds(p).select(*(F.round(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


@query("""with v as (select note_id, path, mtime, any_value(frontmatter) f from notes where note_id is not null group by all), d as (select *, coalesce(mtime::date, date '0001-01-01') d from v), r as (select *, row_number() over (order by d desc, mtime desc nulls last, note_id::varchar desc, path desc) n from d) select note_id, path from r where n <= 100""")
def newest_versions(spark, sf):
    """The hundred newest versions of a store; here each note's last writing is one."""
    from marginalia.sources import vault as src

    v = src.notes(spark, sf).select("note_id", "path", F.col("note_id").cast("string").alias("oid"), F.col("mtime").alias("ts"))
    return history.prune(v, 100).select("note_id", "path")


SECTIONS = [("A.md", None, "# One\nintro\n```\n# no\n```\n## Next steps\ncall Ann\n### Later\nx\n## Cost\n5\n# Two\nend")]


@query(values("want, heading, section", [("next steps", "Next steps", "## Next steps\ncall Ann\n### Later\nx"), ("cos", "Cost", "## Cost\n5"), ("two", "Two", "# Two\nend"), ("one", "One", SECTIONS[0][2].split("\n# Two")[0])]))
def section_cases(spark, sf):
    """A section from its heading to the next of its level, by its name or a part of it; none for what no heading has."""
    c = _notes(spark, SECTIONS)
    found = None
    for want in ("next steps", "cos", "two", "one", "zzz"):
        part = structure.extract_section(c, spark.createDataFrame([("A.md", want)], "path string, want string")).select(F.lit(want).alias("want"), "heading", "section")
        found = part if found is None else found.unionByName(part)
    return found


@query(values("path, chars, start_, end_, more, text_", [("A.md", 30, 0, 10, 20, "a" * 10), ("B.md", 5, 0, 5, 0, "bbbbb")], "path, chars::int chars, start_::int as start, end_::int as \"end\", more::int more, text_ as text"))
def view_cases(spark, sf):
    """A large note's opening, a small note whole."""
    return structure.note_view(_notes(spark, [("A.md", None, "a" * 30), ("B.md", None, "bbbbb")]), large=20, opening=10)


@query(values("path, text_, updated_by", [("A.md", "one\n\nmore\n", "bot"), ("Archive/B.md", "two", "me"), ("New.md", "three", "me")], "path, text_ as text, updated_by"))
def write_cases(spark, sf):
    """Additions, a note put away, a move; a move to a path that is taken is refused."""
    n = spark.createDataFrame([(p, t, "me", "me", None) for p, t in (("A.md", "one"), ("B.md", "two"), ("C.md", "three"))], "path string, text string, created_by string, updated_by string, updated date")
    n = history.append_notes(n, spark.createDataFrame([("A.md", "more", "bot"), ("Z.md", "lost", "bot")], "path string, text string, agent string"), "2026-07-15")
    n = history.archive_notes(n, spark.createDataFrame([("B.md",)], "path string"))
    n = history.move_notes(n, spark.createDataFrame([("C.md", "New.md"), ("A.md", "Archive/B.md")], "old string, new string"))
    return n.select("path", "text", "updated_by")


@query(values("path, agent, reason", [("A.md", "late", "the note has changed since it was read"), ("N.md", "two", "another write to the note came first")]))
def refused_writes(spark, sf):
    n = spark.createDataFrame([("A.md", "text")], "path string, text string")
    w = spark.createDataFrame([("A.md", "new", "0000", "late"), ("N.md", "a", None, "one"), ("N.md", "b", None, "two")], "path string, text string, base_hash string, agent string")
    return history.refused(n, w)


@query(values("mode, n, passed", [("typed", 2, 1), ("explicit", 1, 1), ("sensitive", 1, 0)], "mode, n::bigint n, passed::bigint passed"))
def filing_cases(spark, sf):
    cases = spark.createDataFrame([("1", "typed", "Knowledge"), ("2", "typed", "People"), ("3", "explicit", None), ("4", "sensitive", "Private")], "id string, mode string, expected string")
    return evaluate.filing_score(spark.createDataFrame([("1", "Knowledge/x.md"), ("2", "Work/x.md"), ("3", "Inbox/y.md")], "id string, path string"), cases)


GRADED = [
    (1, "not-in-brain", None, None, [], [], False, [], False), (2, "top1", 5, None, [], [5, 6], True, [], False), (3, "top3", 5, None, [], [1, 2, 3, 5], True, [], False), (4, "top5", 5, None, [], [1, 2, 3, 5], True, [], False),
    (5, "top1-noclarify", 5, None, [], [5], True, [5, 6], False), (6, "both-top5", 5, 6, [], [6, 1, 5], True, [], False), (7, "clarify-or-multi", 5, None, [5, 6, 7], [6, 9, 7], True, [], False), (8, "recent-group", 5, None, [5, 6], [9, 6], True, [], False),
    (9, "cluster", 5, None, [1, 2, 3, 4, 6], [5, 1, 2], True, [], True), (10, "paraphrase", 5, None, [], [5], False, [], False),
]


@query(values("id, passed", [(1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (7, True), (8, True), (9, True), (10, False)], "id::bigint id, passed"))
def grading_cases(spark, sf):
    """Each accept rule once; the cluster of 9 is filled up by the context."""
    s = spark.createDataFrame([(i, "f", t, t2, g, a) for i, a, t, t2, g, *_ in GRADED], "id long, family string, target long, target2 long, `group` array<long>, accept string")
    a = spark.createDataFrame([(i, n, k + 1) for i, _, _, _, _, p, *_ in GRADED for k, n in enumerate(p)], "id long, note_id long, rank int")
    o = spark.createDataFrame([(i, f, c) for i, *_, f, c, _ in GRADED], "id long, found boolean, clarify array<long>")
    more = spark.createDataFrame([(9, 3)], "id long, note_id long")
    return evaluate.grade_rules(s, a, o, more).select("id", F.col("pass").alias("passed"))


@query(values("card, weight, n", [("links", "warn", 1), ("format", "notice", 2), ("copies", "ok", 0), ("wiring", "ok", 0), ("dates", "ok", 0)], "card, weight, n::bigint n"))
def health_card_cases(spark, sf):
    return audit.health_cards(spark.createDataFrame([("broken-wikilink", "a"), ("invalid-status", "a"), ("missing-frontmatter", "b")], "kind string, path string"))


@query(values("heading, words", [("Pricing", "## Pricing\nbeans cost five")]))
def best_section_cases(spark, sf):
    """The section whose heading is what the question asks for, in a long note."""
    body = "# Beans\n" + "beans and more words here. " * 120 + "\n## Pricing\nbeans cost five\n## History\n" + "old tales follow. " * 120
    c = _notes(spark, [("Beans.md", None, body)])
    q = spark.createDataFrame([(1, 0, "beans", 1.0), (1, 1, "price", 2.0)], "qid long, at int, term string, idf double")
    best = delivery.best_section(q, spark.createDataFrame([(1, 1)], "qid long, note_id long"), c)
    return best.select("heading", F.regexp_replace(F.substring_index("section", "\n\n", 1), r"\s+$", "").alias("words"))


@query()
def scenario_groups(spark, sf):
    """Questions of the families that rest on several notes."""
    v = vault(spark, sf)
    return evaluate.more_scenarios(v.corpus, graph.adjacency(v.edges)).withColumn("group", F.array_join(F.transform("group", lambda x: x.cast("string")), "|"))


@query(values("note_id, known", [(1, True), (2, False)], "note_id::bigint note_id, known"))
def reuse_cases(spark, sf):
    """Passages an earlier build has a vector for, and those without."""
    p = spark.createDataFrame([(1, 0, "same"), (2, 0, "new")], "note_id long, nth int, passage string")
    old = spark.createDataFrame([("same", [1.0]), ("other", None)], "t string, vec array<float>").select(tx.content_hash(F.col("t")).alias("hash"), "vec")
    kept, missing = delivery.reusable_vectors(p, old)
    return kept.select("note_id", F.lit(True).alias("known")).unionByName(missing.select("note_id", F.lit(False).alias("known")))


@query(values("id, name, path", [("1", "Ana Diaz", "People/Ana Diaz.md"), ("1", "north", "Partners/North.md")]))
def writer_hint_cases(spark, sf):
    """Entities a new text names without a link."""
    from marginalia.operators import linking

    e = spark.createDataFrame([("Ana Diaz", "People/Ana Diaz.md"), ("North", "Partners/North.md"), ("Bo", "People/Bo.md")], "name string, path string")
    return linking.suggest_for(spark.createDataFrame([(1, "Ana Diaz met north? No: North, and [[Bo Li]] and Bo."), (2, "none")], "id long, body string"), e)


@query(sql.CORPUS + "select path, length(raw)::int chars from c where starts_with(path, 'Work/') order by path")
def folder_texts(spark, sf):
    """All notes of a folder put one after the other: each with its length."""
    return structure.folder_document(corpus(spark, sf), "Work", None).select("path", F.length("text").alias("chars"))


@query(sql.CORPUS + ", w as (select path, raw, coalesce(sum(length(raw)) over (order by path rows between unbounded preceding and 1 preceding), 0)::bigint as \"before\" from c where starts_with(path, 'Work/')) select path, \"before\", substring(raw, 1, (60000 - \"before\")::int) as text from w where \"before\" < 60000")
def folder_reading(spark, sf):
    """A folder's first 60,000 characters."""
    return structure.folder_document(corpus(spark, sf), "Work", 60_000).withColumn("before", F.col("before").cast("long"))
