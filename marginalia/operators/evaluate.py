"""Evaluation of retrieval: question families from a corpus, graders, recall, reciprocal rank, latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as tx
from marginalia.session import materialize


def eligible(corpus: DataFrame, least: int = 300) -> DataFrame:
    """Notes fit for questions: long enough, no template, system note, copy or untitled one."""
    base = F.lower("title")
    return corpus.where((F.length("raw") >= least) & ~F.col("path").rlike("^(Templates|System)/") & ~base.rlike(r"^untitled|\([0-9]+\)$|conflicted copy| copy$"))


def perturb(word: Column, seed: Column) -> Column:
    """One letter deleted, doubled, exchanged with the next, or the last one cut, at a place chosen by the seed."""
    n = F.length(word)
    at = (F.pmod(seed, F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    head, rest = word.substr(F.lit(1), at - 1), word.substr(at + 1, n)
    one, two = word.substr(at, F.lit(1)), word.substr(at + 1, F.lit(1))
    kind = F.pmod(F.shiftright(seed, 8), F.lit(4))
    return F.when(n < 4, word).when(kind == 0, F.concat(head, rest)).when(kind == 1, F.concat(head, one, one, rest)).when(kind == 2, F.concat(head, two, one, word.substr(at + 2, n))).otherwise(word.substr(F.lit(1), n - 1))


def scenarios(corpus: DataFrame, terms: DataFrame, doc_freq: DataFrame, seed: int = 7, rare: int = 8) -> DataFrame:
    """(id, family, question, target): from every eligible note whose id is divisible by 50, a question by its title (known), one
    with its rarest word perturbed (typo), one from three rare words of its body, in at most eight notes (content), and one on
    invented words (negative)."""
    c = eligible(corpus).where("note_id % 50 = 0")
    few = terms.where("tf_body > 0").select("note_id", "term", "first_pos").join(doc_freq.where(F.col("df") <= rare).select("term"), "term").where((F.instr("term", " ") == 0) & ~F.col("term").rlike("^[0-9]+$"))
    few = few.join(c.select("note_id"), "note_id", "left_semi").groupBy("note_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first_pos", "term"))), lambda x: x["term"]).alias("few"))
    named = c.select("note_id", F.explode(F.array_distinct(F.filter(tx.tokens(F.col("title")), lambda w: F.length(w) >= 4))).alias("term")).join(doc_freq, "term", "left").groupBy("note_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("rarest"))
    c = c.join(few, "note_id", "left").join(named, "note_id", "left")
    h = F.xxhash64("note_id", F.lit(seed))
    words = F.filter(tx.tokens(F.col("title")), lambda w: F.length(w) >= 4)
    start = F.pmod(h, F.greatest(F.size("few") - 2, F.lit(1))).cast("int") + 1
    body = F.when(F.size("few") >= 3, F.slice("few", start, F.lit(3))).otherwise(F.array().cast("array<string>"))
    typo = F.array_join(F.transform(words, lambda w: F.when(w == F.col("rarest"), perturb(w, F.pmod(h, F.lit(1 << 40)))).otherwise(w)), " ")
    each = F.array(
        F.struct(F.lit("known").alias("family"), F.col("title").alias("question"), F.col("note_id").alias("target")),
        F.struct(F.lit("typo").alias("family"), typo.alias("question"), F.col("note_id").alias("target")),
        F.struct(F.lit("content").alias("family"), F.array_join(body, " ").alias("question"), F.col("note_id").alias("target")),
        F.struct(F.lit("negative").alias("family"), F.concat_ws(" ", F.substring(F.sha1(F.concat(F.lit("a"), F.col("note_id").cast("string"))), 1, 9), F.substring(F.sha1(F.concat(F.lit("b"), F.col("note_id").cast("string"))), 1, 9)).alias("question"), F.lit(None).cast("bigint").alias("target")),
    )
    x = c.select(F.posexplode(each).alias("k", "s"), "note_id").select((F.col("note_id") * 4 + F.col("k")).alias("id"), "s.*")
    return x.where("trim(question) != ''")


def contaminated(scenarios: DataFrame, doc_freq: DataFrame) -> DataFrame:
    """Negative questions that hold a word of the corpus after all."""
    t = scenarios.where("family = 'negative'").select("id", F.explode(tx.tokens(F.col("question"))).alias("term"))
    return t.join(doc_freq.select("term"), "term", "left_semi").select("id").distinct()


def more_scenarios(corpus: DataFrame, adjacency: DataFrame, freshest: int = 60) -> DataFrame:
    """(id, family, question, target, target2, group, accept) of the families that rest on several notes, asked of every eligible
    note whose id is divisible by 50: temporal (the freshest notes that share three words of its title), compare (with the next
    such note of its folder), ambiguous (three or more dated siblings), clean (a title no other note shares), richness (a note
    with three links or more and its neighbours)."""
    c = eligible(corpus)
    words = F.filter(tx.tokens(F.col("title")), lambda w: ~F.contains(w, F.lit(" ")) & ~tx.is_dateish(w))
    c = c.select("note_id", "path", "title", "mtime", words.alias("w"), tx.date_key(F.col("path")).alias("series"), tx.top_folder(F.col("path")).alias("top"))
    asked = c.where("note_id % 50 = 0")
    fresh = c.where("mtime is not null").orderBy(F.desc("mtime"), "path").limit(freshest)
    near = fresh.where(F.size("w") >= 2).select("note_id", F.slice("w", 1, 3).alias("key"))
    group = near.join(fresh.select(F.col("note_id").alias("other"), F.col("w").alias("ow")), F.size(F.array_except("key", "ow")) == 0).groupBy("note_id", "key").agg(F.sort_array(F.collect_list("other")).alias("group"))
    none = F.lit(None).cast("bigint")
    nobody = F.array().cast("array<bigint>")
    out = lambda d, family, question, accept, target=F.col("note_id"), two=none, g=nobody: d.select("note_id", F.lit(family).alias("family"), question.alias("question"), target.alias("target"), two.alias("target2"), g.alias("group"), F.lit(accept).alias("accept"))
    temporal = out(group, "temporal", F.concat(F.lit("latest on "), F.array_join("key", " "), F.lit("?")), "recent-group", g=F.col("group"))
    both = asked.where(F.size("w") >= 1).withColumn("two", F.lead(F.struct("note_id", "w")).over(Window.partitionBy("top").orderBy("path"))).where("two is not null and top != ''")
    first = lambda w: F.array_join(F.slice(w, 1, 2), " ")
    compare = out(both, "compare", F.concat(F.lit("how does "), first(F.col("w")), F.lit(" compare to "), first(F.col("two.w")), F.lit("?")), "both-top5", two=F.col("two.note_id"))
    sib = c.where(F.size(F.split("series", " ")) >= 2).groupBy("series").agg(F.count("*").alias("k"), F.slice(F.sort_array(F.collect_list("note_id")), 1, 6).alias("group"), F.min("note_id").alias("note_id"))
    ambiguous = out(sib.where("k >= 3"), "ambiguous", F.concat(F.lit("what do we know about "), F.col("series")), "clarify-or-multi", g=F.col("group"))
    clean = out(asked.where(F.size("w") >= 3).join(sib.where("k = 1").select("series"), "series", "left_semi"), "clean", F.array_join("w", " "), "top1-noclarify")
    ids = c.select("note_id", "path")
    links = adjacency.join(ids.select(F.col("path").alias("src"), "note_id"), "src").join(ids.select(F.col("path").alias("dst"), F.col("note_id").alias("other")), "dst").groupBy("note_id").agg(F.slice(F.sort_array(F.collect_set("other")), 1, 6).alias("cluster"))
    rich = out(asked.join(links.where(F.size("cluster") >= 3), "note_id"), "richness", F.concat(F.lit("build me a plan based on what we know about "), F.array_join("w", " ")), "cluster", g=F.col("cluster"))
    every = temporal.unionByName(compare).unionByName(ambiguous).unionByName(clean).unionByName(rich)
    return every.select((-(F.col("note_id") * 8 + F.array_position(F.array(*map(F.lit, ("temporal", "compare", "ambiguous", "clean", "richness"))), F.col("family")))).alias("id"), "family", "question", "target", "target2", "group", "accept")


def grade_rules(scenarios: DataFrame, answers: DataFrame, outcomes: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(id, family, pass) by each scenario's accept rule: not-in-brain, top1, top3, top5, top1-noclarify, both-top5, clarify-or-multi,
    recent-group, cluster (target among three, 60 % of the group among answers and context) and paraphrase (found, among five).

    answers: (id, note_id, rank); outcomes: (id, found, clarify); context: (id, note_id). An unknown rule is null."""
    top = answers.where("rank <= 8").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "note_id"))), lambda x: x["note_id"]).alias("p"))
    x = scenarios.join(top, "id", "left").join(outcomes.select("id", "found", (F.size("clarify") > 0).alias("choice")), "id", "left")
    x = x.join(context.groupBy("id").agg(F.collect_set("note_id").alias("more")), "id", "left") if context is not None else x.withColumn("more", F.array().cast("array<bigint>"))
    x = x.withColumn("p", F.coalesce("p", F.array().cast("array<bigint>"))).withColumn("more", F.coalesce("more", F.array().cast("array<bigint>"))).na.fill(False, ["found", "choice"])
    first = lambda k: F.slice("p", 1, k)
    among = lambda k, c="target": F.coalesce(F.array_contains(first(k), F.col(c)), F.lit(False))
    shared = lambda a: F.size(F.array_intersect(a, F.col("group")))
    rule = F.col("accept")
    ok = F.when(rule == "not-in-brain", ~F.col("found"))
    for k in (1, 3, 5):
        ok = ok.when(rule == f"top{k}", among(k))
    ok = ok.when(rule == "top1-noclarify", among(1) & ~F.col("choice")).when(rule == "both-top5", among(5) & among(5, "target2")).when(rule == "clarify-or-multi", F.col("choice") | (shared(first(5)) >= 2))
    ok = ok.when(rule == "recent-group", shared(first(5)) >= 1).when(rule == "cluster", among(3) & (shared(F.array_union("p", "more")) >= 0.6 * F.size("group"))).when(rule == "paraphrase", F.col("found") & among(5))
    return x.select("id", "family", ok.alias("pass"))


def grade(scenarios: DataFrame, answers: DataFrame, outcomes: DataFrame, top: int = 3) -> DataFrame:
    """(id, family, pass): a target among the first three; for negatives, a refusal. answers: (id, note_id, rank); outcomes: (id, found)."""
    hit = answers.where(F.col("rank") <= top).join(scenarios.select("id", "target"), "id").where("note_id = target").select("id", F.lit(True).alias("hit")).distinct()
    x = scenarios.join(hit, "id", "left").join(outcomes.select("id", "found"), "id", "left")
    ok = F.when(F.col("family") == "negative", ~F.coalesce("found", F.lit(False))).otherwise(F.coalesce("hit", F.lit(False)) & F.coalesce("found", F.lit(True)))
    return x.select("id", "family", ok.alias("pass"))


def report(graded: DataFrame) -> DataFrame:
    return graded.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.col("pass").cast("long")).alias("passed"), F.round(F.avg(F.col("pass").cast("double")), 6).alias("rate"))


def recall_mrr(answers: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """One row (questions, recall_at_k, mrr_at_k): the first accepted note within k; truth: (qid, target)."""
    wanted = truth.select("qid", F.col("target").alias("note_id")).distinct()
    first = answers.where(F.col("rank") <= k).select("qid", "note_id", "rank").join(wanted, ["qid", "note_id"]).groupBy("qid").agg(F.min("rank").alias("r"))
    x = truth.select("qid").distinct().join(first, "qid", "left")
    return x.agg(F.count("*").alias("questions"), F.round(F.avg(F.col("r").isNotNull().cast("double")), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr_at_k"))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    r = F.col("rank")
    return ranks.groupBy(F.when(r == 1, "1").when(r <= 3, "2-3").when(r <= 5, "4-5").when(r <= 20, "6-20").otherwise("20+").alias("bucket")).agg(F.count("*").alias("n"))


def places(values: DataFrame, value: str, at: dict[str, Column]) -> DataFrame:
    """(point, value): the entries at given places of the sorted values, counted from 0; a place is a column of n, how many there
    are. Values are put together, range-partitioned and numbered within partitions, so that no task sorts them all."""
    by = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    by = materialize(by.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "sorted-values")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    base = by.groupBy("part").agg(F.sum("k").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumn("upto", F.sum("k").over(within)).join(base, "part").withColumn("upto", F.col("upto") + F.col("base"))
    n = by.agg(F.sum("k").alias("n")).where("n is not null")
    wanted = n.select(F.explode(F.array(*[F.struct(F.lit(p).alias("point"), c.cast("long").alias("place")) for p, c in at.items()])).alias("x")).select("x.*")
    return run.join(F.broadcast(wanted), F.col("upto") > F.col("place")).groupBy("point").agg(F.min("v").alias("value"))


def percentiles(times: DataFrame, value: str, points: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """(point, value): the entry at place floor(n * p / 100) of the sorted values, counted from 0."""
    found = places(times, value, {str(p): F.floor(F.col("n") * p / 100) for p in points})
    return found.select(F.col("point").cast("int").alias("point"), "value")


def token_costs(rows: DataFrame, by: str, value: str) -> DataFrame:
    """One row a group (by, n, median, mean, p90): the entry at floor(n / 2) of the sorted values, the rounded mean, the entry at
    floor(0.9 n). Groups hold one row a question; their values are put in order by a window, not gathered."""
    w = Window.partitionBy(by)
    x = rows.where(F.col(value).isNotNull()).withColumn("at", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    pick = lambda place: F.max(F.when(F.col("at") == place, F.col(value)))
    return x.groupBy(by).agg(F.count("*").alias("n"), pick(F.floor(F.col("n") / 2)).alias("median"), F.floor(F.avg(value) + 0.5).cast("long").alias("mean"), pick(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9))).alias("p90"))


def cost_arms(ranked: DataFrame, gold: DataFrame, corpus: DataFrame, snippet: int = 4000, reads: int = 5) -> DataFrame:
    """(qid, arm, tokens): what three ways of reading cost in tokens of four characters: `snippets` of the ranked notes until a right
    one is met, at most five; the first five notes `whole`; the right notes alone (`oracle`). ranked: (qid, note_id, rank); gold: (qid, note_id)."""
    tok = lambda n: F.ceil(n / 4).cast("long")
    size = corpus.select("note_id", F.length("raw").alias("n"))
    r = ranked.where(F.col("rank") <= reads).select("qid", "note_id", "rank").join(size, "note_id")
    hit = r.join(gold.select("qid", "note_id").distinct(), ["qid", "note_id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    cut = r.join(hit, "qid", "left").where(F.col("rank") <= F.coalesce("first", F.lit(reads))).groupBy("qid").agg(F.sum(tok(F.least(F.col("n"), F.lit(snippet)))).alias("tokens"))
    whole = r.groupBy("qid").agg(F.sum(tok(F.col("n"))).alias("tokens"))
    oracle = gold.select("qid", "note_id").distinct().join(size, "note_id").groupBy("qid").agg(F.sum(tok(F.col("n"))).alias("tokens"))
    arm = lambda d, name: d.select("qid", F.lit(name).alias("arm"), "tokens")
    return arm(cut, "snippets").unionByName(arm(whole, "whole")).unionByName(arm(oracle, "oracle"))


def context_useful(answers: DataFrame, context: DataFrame, truth: DataFrame, adjacency: DataFrame) -> DataFrame:
    """One row (probes, useful): of the questions whose target comes first and that have a context, how many contexts hold a true
    neighbour of the target. answers: (qid, path, rank); context: (qid, path); truth: (qid, path); adjacency: (src, dst) of paths."""
    first = answers.where("rank = 1").select("qid", "path").join(truth.select("qid", "path"), ["qid", "path"]).join(context.select("qid").distinct(), "qid", "left_semi")
    good = first.join(adjacency, F.col("path") == F.col("src")).select("qid", F.col("dst").alias("path")).join(context.select("qid", "path"), ["qid", "path"], "left_semi").select("qid").distinct().withColumn("ok", F.lit(1))
    return first.join(good, "qid", "left").agg(F.count("*").alias("probes"), F.count("ok").alias("useful"))


def filing_score(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """(mode, n, passed): labelled filing cases (id, mode, expected) by where they went (id, path): typed notes to the expected
    partition, explicit ones to the Inbox, sensitive ones to theirs. A case without a decision is not passed."""
    top = tx.top_folder(F.col("path"))
    ok = F.coalesce(top == F.when(F.col("mode") == "explicit", "Inbox").otherwise(F.col("expected")), F.lit(False))
    return cases.join(decisions.select("id", "path"), "id", "left").groupBy("mode").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("passed"))


def keyword_baseline(queries: DataFrame, postings: DataFrame, top: int = 5) -> DataFrame:
    """(qid, note_id, hits, rank): notes by how many of a question's distinct words they hold."""
    t = queries.select("qid", F.explode(F.array_distinct(tx.tokens(F.col("question")))).alias("term"))
    hits = t.join(postings.select("term", "note_id"), "term").groupBy("qid", "note_id").agg(F.count("*").alias("hits"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), "note_id"))).where(F.col("rank") <= top)


def taxonomy(ranks: DataFrame) -> DataFrame:
    """(id, class) of failed questions: doubled-key where another right one has the same question, equivalent where the first answer
    has the target's text, near-rank up to 10, else miss. ranks: (id, rank, same_question, same_text), rank null if not found."""
    c = F.when(F.coalesce("same_question", F.lit(False)), "doubled-key").when(F.coalesce("same_text", F.lit(False)), "equivalent").when(F.col("rank") <= 10, "near-rank").otherwise("miss")
    return ranks.select("id", c.alias("class"))


def threshold_sweep(scores: DataFrame, steps: int = 20) -> DataFrame:
    """(threshold, negatives_kept, positives_kept) of (score, positive) for thresholds from 0 to 1 in one aggregate."""
    s = scores.select(F.least(F.greatest(F.floor(F.col("score") * steps), F.lit(0)), F.lit(steps)).cast("int").alias("b"), F.col("positive").cast("int").alias("p"))
    by = s.groupBy("b").agg(F.sum("p").alias("pos"), F.sum(1 - F.col("p")).alias("neg"))
    grid = by.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("t"), "pos", "neg")
    return grid.groupBy("t").agg(F.sum("neg").alias("negatives_kept"), F.sum("pos").alias("positives_kept")).select((F.col("t") / F.lit(float(steps))).alias("threshold"), "negatives_kept", "positives_kept")
