"""Fusion of lanes by weighted reciprocal ranks, what follows it, and the gate that refuses."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.config import RANKING, Ranking
from marginalia.functions import text as tx
from marginalia.operators import index as ix
from marginalia.session import ready


def rrf(lanes: dict[str, DataFrame], weights: Column, limit: int = 20, r: Ranking = RANKING) -> DataFrame:
    """(qid, note_id, rrf, rank): the sum of weight / (60 + rank) over ranked lanes. weights: a column of `lane`."""
    all_ = None
    for name, lane in lanes.items():
        part = lane.select("qid", "note_id", "rank", F.lit(name).alias("lane"))
        all_ = part if all_ is None else all_.unionByName(part)
    fused = all_.withColumn("w", weights).groupBy("qid", "note_id").agg(F.sum(F.col("w") / (r.rrf_k + F.col("rank"))).alias("rrf"))
    order = Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), "note_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def content_words(questions: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, content array): each question's single words that are no dates; empty where it has none."""
    some = q.where((F.instr("term", " ") == 0) & ~tx.is_dateish(F.col("term"))).groupBy("qid").agg(F.array_sort(F.collect_list("term")).alias("content"))
    return questions.select("qid").join(some, "qid", "left").select("qid", F.coalesce("content", F.array().cast("array<string>")).alias("content"))


def lane_weights(profile: dict[str, float], constant: dict[str, float] = RANKING.constant) -> Column:
    every = {**constant, **profile}
    return F.create_map(*[x for k, v in sorted(every.items()) for x in (F.lit(k), F.lit(float(v)))])[F.col("lane")]


def known_item(q: DataFrame, terms: DataFrame, lengths: DataFrame, doc_freq: DataFrame, stats: DataFrame, corpus: DataFrame, top: int = 5) -> DataFrame:
    """(qid, note_id, cover, cover_idf, matches, date_hits, nth): notes whose title holds all of a question's words that are no
    dates, of at least two distinct words (or all its dates, two or more, where there are no others).

    cover is the share of the title's words they make up, cover_idf the share of its words' idf; a date and its month as one
    token count as dates. System/ is left out. Order: dates, cover_idf, cover, fewest words left, path."""
    single = F.instr("term", " ") == 0
    asked = q.select("qid", "term", "idf_bm", single.alias("single"), (single & tx.is_dateish(F.col("term"))).alias("date"))
    need = asked.groupBy("qid").agg(F.sum(F.col("single").cast("int")).alias("all"), F.sum((F.col("single") & ~F.col("date")).cast("int")).alias("content"), F.sum(F.col("date").cast("int")).alias("dates"))
    need = need.where((F.col("all") >= 2) & ((F.col("content") > 0) | (F.col("dates") >= 2)))
    titles = terms.where("tf_title > 0").select("note_id", "term", "tf_title").join(corpus.where(~F.col("path").startswith("System/")).select("note_id", "path"), "note_id")
    count = lambda c, n=F.lit(1): F.sum(F.when(c, n).otherwise(F.lit(0)))
    one = F.col("single")
    hits = asked.join(titles, "term").groupBy("qid", "note_id", "path").agg(count(one & ~F.col("date")).alias("hit"), count(F.col("date")).alias("dated"), count(~one, F.col("tf_title")).alias("combos"), F.sum(F.when(one, F.col("tf_title") * F.col("idf_bm")).otherwise(0.0)).alias("mass"))
    full = hits.join(need, "qid").where(F.when(F.col("content") > 0, F.col("hit") == F.col("content")).otherwise(F.col("dated") == F.col("dates")))
    full = full.join(lengths.select("note_id", "title_len"), "note_id")
    words = titles.where(single).join(full.select("note_id").distinct(), "note_id", "left_semi").join(doc_freq, "term").join(F.broadcast(stats.select(F.col("n").alias("nn"))))
    whole = words.groupBy("note_id").agg(F.sum(F.col("tf_title") * ix.idf_bm25(F.col("nn"), F.col("df"))).alias("whole"))
    date_hits = F.col("dated") + F.col("combos")
    rated = full.join(whole, "note_id", "left").select("qid", "note_id", "path", date_hits.alias("date_hits"), ((F.col("hit") + date_hits) / F.greatest("title_len", F.lit(1))).alias("cover"), F.coalesce(F.col("mass") / F.nullif("whole", F.lit(0.0)), F.lit(0.0)).alias("cover_idf"), (F.col("title_len") - F.col("hit") - date_hits).alias("extra"))
    w = Window.partitionBy("qid")
    order = w.orderBy(F.desc("date_hits"), F.round("cover_idf", 9).desc(), F.round("cover", 9).desc(), "extra", "path")
    return rated.withColumn("matches", F.count("*").over(w)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top).select("qid", "note_id", "cover", "cover_idf", "matches", "date_hits", "nth")


def rescale(fused: DataFrame, notes: DataFrame, asked: DataFrame, r: Ranking = RANKING) -> DataFrame:
    """Fused scores after demotion of archived notes (but for questions about past talks), of catalogues, and of the second and
    later notes of one dated series. notes: (note_id, path); asked: (qid, episodic, content), content being the question's
    words that are no dates: a catalogue whose name holds them all was asked for."""
    x = fused.join(notes.select("note_id", "path"), "note_id").join(asked, "qid")
    score = F.col("rrf") * F.when(tx.is_archived(F.col("path")) & ~F.col("episodic"), r.archived).otherwise(1.0) * F.when(tx.is_catalogue(F.col("path")) & (F.size("content") > 0) & (F.size(F.array_except("content", tx.tokens(tx.basename(F.col("path"))))) > 0), r.catalogue).otherwise(1.0)
    x = x.withColumn("score", score).withColumn("series", tx.date_key(F.col("path")))
    nth = F.row_number().over(Window.partitionBy("qid", "series").orderBy(F.round("score", 12).desc(), "note_id"))
    x = x.withColumn("score", F.col("score") * F.when((F.col("series") != "") & (nth > 1), r.sibling).otherwise(1.0))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "note_id")
    return x.select("qid", "note_id", "path", "score").withColumn("rank", F.row_number().over(order))


def recency_boost(fused: DataFrame, dates: DataFrame, covered: DataFrame, temporal: DataFrame, as_of: Column, r: Ranking = RANKING) -> DataFrame:
    """(qid, note_id, rrf): for temporal questions, the scores of the notes that hold most of the content words times 1 + what
    is left of 60 days since the freshest note of the list that has happened by as_of. covered: (qid, note_id, hit)."""
    x = fused.join(dates.select("note_id", "date"), "note_id", "left").join(covered, ["qid", "note_id"], "left").na.fill(0.0, ["hit"]).join(temporal.select("qid", F.lit(True).alias("temporal")), "qid", "left")
    w = Window.partitionBy("qid")
    now = F.coalesce(F.max(F.when(F.col("date") <= as_of, F.col("date"))).over(w), as_of)
    left = F.greatest(F.lit(0.0), 1 - F.greatest(F.datediff(now, F.col("date")), F.lit(0)) / F.lit(float(r.recency_days)))
    best = F.col("hit") >= F.max("hit").over(w) - 1e-9
    return x.select("qid", "note_id", (F.col("rrf") * F.when(F.coalesce("temporal", F.lit(False)) & best & F.col("date").isNotNull(), 1 + left).otherwise(1.0)).alias("rrf"))


def word_hits(q: DataFrame, listed: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, note_id, hit): the share of a question's content words of three letters or more in a listed note's title or text; 1 where
    it has fewer than two."""
    words = q.where((F.instr("term", " ") == 0) & (F.length("term") >= 3) & ~tx.is_dateish(F.col("term"))).select("qid", "term")
    k = words.groupBy("qid").agg(F.count("*").alias("k"))
    pairs = listed.select("qid", "note_id").distinct()
    held = pairs.join(words, "qid").join(terms.where("tf_title > 0 or tf_body > 0").select("note_id", "term"), ["note_id", "term"]).groupBy("qid", "note_id").agg(F.count("*").alias("h"))
    x = pairs.join(k, "qid", "left").join(held, ["qid", "note_id"], "left").na.fill(0, ["k", "h"])
    return x.select("qid", "note_id", F.when(F.col("k") < 2, 1.0).otherwise(F.col("h") / F.col("k")).alias("hit"))


def splice(listed: DataFrame, pins: DataFrame) -> DataFrame:
    """Puts pinned notes into each question's list: pins (qid, note_id, stage, slot, unless) are taken in order of stage, each
    goes to its slot unless it stands among the first `unless` already. Each stage reads the list the one before it left;
    a question has a few dozen rows, so that its list is one small group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        have = rows[rows.stage == 0].sort_values("slot").note_id.tolist()
        for r in rows[rows.stage > 0].sort_values(["stage", "slot", "note_id"]).itertuples():
            if r.note_id in have[: r.unless]:
                continue
            if r.note_id in have:
                have.remove(r.note_id)
            have.insert(min(r.slot - 1, len(have)), r.note_id)
        return pd.DataFrame({"qid": key[0], "note_id": have, "rank": range(1, len(have) + 1)})

    ready()
    kinds = {f.name: f.dataType.simpleString() for f in listed.schema}
    rows = listed.select("qid", "note_id", F.lit(0).alias("stage"), F.col("rank").cast("int").alias("slot"), F.lit(0).alias("unless")).unionByName(pins.select("qid", "note_id", F.col("stage").cast("int"), F.col("slot").cast("int"), F.col("unless").cast("int")))
    return rows.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, note_id {kinds['note_id']}, rank int")


def rare_pins(q: DataFrame, postings: DataFrame, priors: DataFrame, r: Ranking = RANKING) -> DataFrame:
    """Pins for notes that hold all of two or more rare words of a question: up to two, at slots 3 and 4."""
    few = q.where((F.col("df") > 0) & (F.col("df") <= r.pin_df) & (F.instr("term", " ") == 0) & ~tx.is_dateish(F.col("term"))).select("qid", "term")
    need = few.groupBy("qid").agg(F.count("*").alias("k")).where("k >= 2")
    got = few.join(postings.select("term", "note_id"), "term").groupBy("qid", "note_id").agg(F.count("*").alias("k")).join(need, ["qid", "k"]).join(priors, "note_id")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("prior"), "note_id"))
    return got.withColumn("nth", nth).where("nth <= 2").select("qid", "note_id", F.lit(8).alias("stage"), (F.col("nth") + 2).alias("slot"), F.lit(3).alias("unless"))


def title_subset_pins(q: DataFrame, terms: DataFrame, lengths: DataFrame) -> DataFrame:
    """Pins for the note whose two to six title words all stand in a question, the rarest title first: slot 4 unless among 5."""
    titles = terms.where(F.col("tf_title") > 0).select("note_id", "term")
    size = titles.groupBy("note_id").agg(F.count("*").alias("k")).where("k between 2 and 6")
    hit = q.select("qid", "term", F.log2(1 + F.col("n_notes") / F.greatest("df", F.lit(1))).alias("m")).join(titles, "term").groupBy("qid", "note_id").agg(F.count("*").alias("k"), F.sum("m").alias("m")).join(size, ["note_id", "k"])
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("m", 9).desc(), "note_id"))
    return hit.withColumn("nth", nth).where("nth = 1").select("qid", "note_id", F.lit(11).alias("stage"), F.lit(4).alias("slot"), F.lit(5).alias("unless"))


def known_pins(known: DataFrame, r: Ranking = RANKING) -> DataFrame:
    """Pins to slot 1 for the best known item with a cover, by words or idf, of at least 0.45, or 0.25 where it is the only match."""
    cover = F.greatest("cover", "cover_idf")
    ok = (cover >= r.pin_cover) | ((F.col("matches") == 1) & (cover >= r.pin_unique_cover))
    return known.where((F.col("nth") == 1) & ok).select("qid", "note_id", F.lit(13).alias("stage"), F.lit(1).alias("slot"), F.lit(1).alias("unless"))


def absent_mass(q: DataFrame) -> DataFrame:
    """(qid, absent): the share of a question's idf in words of no note."""
    return q.groupBy("qid").agg((F.sum(F.when(F.col("df") == 0, F.col("idf")).otherwise(0.0)) / F.sum("idf")).alias("absent"), F.array_sort(F.collect_set(F.when(F.col("df") == 0, F.col("term")))).alias("absent_terms"))


def gate(absent: DataFrame, cover: DataFrame, rescue: DataFrame | None = None, r: Ranking = RANKING) -> DataFrame:
    """(qid, found, gate_cover, absent, reason): refuses without results, below a cover of 0.2, or where over 0.35 of the idf is
    absent and the cover below 0.6; a fresh semantic match (rescue: qid) speaks for it while under half is absent.
    cover: (qid, note_id, cov)."""
    top = cover.groupBy("qid").agg(F.max("cov").alias("gate_cover"))
    x = absent.join(top, "qid", "left")
    x = x.join(rescue.select("qid", F.lit(True).alias("rescued")), "qid", "left") if rescue is not None else x.withColumn("rescued", F.lit(False))
    fires = F.col("gate_cover").isNull() | (F.col("gate_cover") < r.gate_low) | ((F.col("absent") > r.gate_absent) & (F.col("gate_cover") < r.gate_cover))
    found = ~fires | (F.coalesce("rescued", F.lit(False)) & (F.col("absent") < r.gate_rescue_absent))
    reason = F.when(found, F.lit(None)).when(F.size("absent_terms") > 0, F.concat(F.lit("no note has: "), F.concat_ws(", ", "absent_terms"))).otherwise("no note covers the question")
    return x.select("qid", found.alias("found"), F.coalesce("gate_cover", F.lit(0.0)).alias("gate_cover"), "absent", reason.alias("reason"))


def create_safety(known: DataFrame, absent: DataFrame, cover: DataFrame) -> DataFrame:
    """(qid, safety): exists if a title holds at least 60 % of the question, probable from a cover of 0.4, else unknown."""
    k = known.where("nth = 1").select("qid", F.col("cover").alias("title_cover"))
    top = cover.groupBy("qid").agg(F.max("cov").alias("c"))
    x = absent.select("qid").join(k, "qid", "left").join(top, "qid", "left")
    return x.select("qid", F.when(F.col("title_cover") >= 0.6, "exists").when(F.col("c") >= 0.4, "probable").otherwise("unknown").alias("safety"))


def clarify(fused: DataFrame, known: DataFrame, r: Ranking = RANKING) -> DataFrame:
    """(qid, contenders, options, series): questions with no known item of which at least two of the first four lie within 0.88 of the
    best, the options in order; series where all differ in nothing but their date. fused: (qid, note_id, path, score, rank)."""
    top = fused.join(known.select("qid").distinct(), "qid", "left_anti").where("rank <= 4")
    near = top.withColumn("best", F.max("score").over(Window.partitionBy("qid"))).where(F.round(F.col("score"), 12) >= F.round(r.clarify_band * F.col("best"), 12))
    option = F.sort_array(F.collect_list(F.struct("rank", "note_id")))
    by = near.groupBy("qid").agg(F.count("*").alias("contenders"), F.transform(option, lambda x: x["note_id"]).alias("options"), F.collect_set(tx.date_key(F.col("path"))).alias("keys"))
    return by.where("contenders >= 2").select("qid", "contenders", "options", (F.size("keys") == 1).alias("series"))


def scattered(unsure: DataFrame, outcomes: DataFrame, q: DataFrame, terms: DataFrame, r: Ranking = RANKING) -> DataFrame:
    """(qid): unsure questions (clarify()) whose cover is below 0.42 and of whose contenders none has a distinctive word, one of at
    least the average idf, in its title or headings: noise instead of a choice."""
    weak = unsure.join(outcomes.where(F.col("found") & (F.col("gate_cover") < r.clarify_floor)).select("qid"), "qid", "left_semi").select("qid", F.explode("options").alias("note_id"))
    words = q.where(~tx.is_dateish(F.col("term"))).select("qid", "term", "idf").withColumn("mean", F.avg("idf").over(Window.partitionBy("qid"))).where(F.round("idf", 9) >= F.round("mean", 9))
    anchored = weak.join(words, "qid").join(terms.where("tf_title > 0 or tf_head > 0").select("note_id", "term"), ["note_id", "term"]).select("qid").distinct()
    return weak.select("qid").distinct().join(anchored, "qid", "left_anti")


def relax(q: DataFrame, refused: DataFrame) -> DataFrame:
    """(qid, term): of each refused question with three words or more that are no dates, the word with the least idf, which is dropped
    for the retry; ties: the first in the question."""
    singles = q.where((F.instr("term", " ") == 0) & ~tx.is_dateish(F.col("term"))).join(refused.select("qid"), "qid", "left_semi")
    w = Window.partitionBy("qid")
    return singles.withColumn("k", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.round("idf", 9), "at", "term"))).where("k >= 3 and nth = 1").select("qid", "term")


def interleave(left: DataFrame, right: DataFrame, most: int = 6) -> DataFrame:
    """Two ranked lists (qid, note_id, rank) in turn, the left first, each note once, at most six."""
    both = left.select("qid", "note_id", "rank", F.lit(0).alias("side")).unionByName(right.select("qid", "note_id", "rank", F.lit(1).alias("side")))
    first = both.groupBy("qid", "note_id").agg(F.min(F.struct("rank", "side")).alias("x"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("x.rank", "x.side", "note_id"))).where(F.col("rank") <= most).select("qid", "note_id", "rank")


def compare_sides(questions: DataFrame) -> DataFrame:
    """(qid, side, question) of questions that compare two things ("a vs b", "difference between a and b"), both of which have words."""
    q = F.col("question")
    # How comparisons are asked for.
    vs = r"(?i)^(.*?)\s+(?:vs\.?|versus|compared?\s+(?:to|with|than)|different\s+(?:than|from))\s+(.*?)\??$"
    between = r"(?i)differences? between\s+(.*?)\s+and\s+(.*?)\??$"
    bare = lambda c: F.trim(F.regexp_replace(c, r"(?i)^(how|what|was|is|are|does|did|the|a|an|were)\b\s*", ""))
    pair = lambda i: F.coalesce(F.when(q.rlike(between), bare(F.regexp_extract(q, between, i))), F.when(q.rlike(vs), bare(F.regexp_extract(q, vs, i))))
    both = questions.select("qid", F.array(pair(1), pair(2)).alias("s")).where(F.get("s", F.lit(0)).isNotNull() & ~F.exists("s", lambda x: F.size(tx.tokens(x)) == 0))
    return both.select("qid", F.posexplode("s").alias("side", "question"))


def budget(rows: DataFrame, chars: int, by: str = "qid", order: str = "rank", text: str = "section") -> DataFrame:
    """Rows in order as long as what came before them leaves some of the budget."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < chars).drop("before")
