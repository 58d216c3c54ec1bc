"""Registered queries: tokens, index, lanes, fusion, gate, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.api import Vault
from marginalia.functions import text as tx
from marginalia.operators import evaluate, fusion, graph, lanes
from marginalia.operators import index as ix
from marginalia.plans import sql
from marginalia.plans.catalog import query, table
from marginalia.session import token
from marginalia.sources import vault as src


_vaults: dict[tuple[str, str], tuple[str, Vault]] = {}


def vault(spark: SparkSession, sf: str) -> Vault:
    """The vault of a folder of tables. Its index is built by the first query that needs it and serves the application's later
    ones as long as the tables' files stay as they are."""
    where, state = (spark.sparkContext.applicationId, sf), " ".join(token(spark, f"{sf}/{t}.parquet") for t in ("notes", "note_chunks", "entity_names"))
    if _vaults.get(where, ("",))[0] != state:
        _vaults[where] = state, _vault(spark, sf)
    return _vaults[where][1]


def _vault(spark: SparkSession, sf: str) -> Vault:
    named = table(spark, sf, "entity_names").where("origin = 'mention'").select("path", F.col("name_text").alias("name"))
    return Vault(src.corpus(src.notes(spark, sf)), table(spark, sf, "note_chunks"), named)


def _asked(v: Vault) -> DataFrame:
    if "asked" not in v.__dict__:
        q = ix.question_terms(src.questions(v.corpus))
        v.asked = v._index(lanes.with_idf(q, v.doc_freq, v.stats), "question-terms")
    return v.asked


def _bm(v: Vault, q: DataFrame, depth: int) -> DataFrame:
    return v._keep(lanes.bm25f_best(q, v.fields, v.stats, depth), "bm25")


def _out(lane: DataFrame) -> DataFrame:
    return lane.select("qid", "note_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(sql.INDEX + "select note_id, array_to_string(title, ' ') title, array_to_string(head, ' ') head, array_to_string(body, ' ') body from f")
def tokenize_notes(spark, sf):
    f = ix.fields(src.corpus(src.notes(spark, sf)))
    return f.select("note_id", *(F.array_join(c, " ").alias(c) for c in ("title", "head", "body")))


@query(sql.INDEX + "select note_id, term, tf from post")
def postings_tf(spark, sf):
    return ix.postings(ix.fields(src.corpus(src.notes(spark, sf))))


@query(sql.INDEX + "select note_id, term, coalesce(tt.tf, 0) tf_title, coalesce(ht.tf, 0) tf_head, coalesce(post.tf, 0) tf_body from keys left join tt using (note_id, term) left join ht using (note_id, term) left join post using (note_id, term)")
def field_terms(spark, sf):
    return ix.terms(ix.fields(src.corpus(src.notes(spark, sf)))).drop("first_pos", "positions")


@query(sql.INDEX + "select term, df, round(greatest(least(log2(n / df) / 3, 3.0), 0.5), 6) idf_clamped, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) idf_bm25 from df cross join st")
def doc_freq_idf(spark, sf):
    v = vault(spark, sf)
    n = F.col("n")
    return v.doc_freq.join(F.broadcast(v.stats.select("n"))).select("term", "df", F.round(ix.idf_clamped(n, F.col("df")), 6).alias("idf_clamped"), F.round(ix.idf_bm25(n, F.col("df")), 6).alias("idf_bm25"))


@query(sql.INDEX + "select n, round(avg_title, 6) avg_title, round(avg_head, 6) avg_head, round(avg_body, 6) avg_body from st")
def corpus_stats(spark, sf):
    return vault(spark, sf).stats.select("n", *(F.round(c, 6).alias(c) for c in ("avg_title", "avg_head", "avg_body")))


@query(sql.CORPUS + "," + sql.PRIOR + "select note_id, prior, coalesce(lower(title) = 'home' or list_has_any(words, ['index', 'moc', 'map']), false) catalogue from priors join pw using (note_id) join c using (note_id)")
def source_priors(spark, sf):
    p = F.col("path")
    return src.corpus(src.notes(spark, sf)).select("note_id", tx.source_prior(p).alias("prior"), tx.is_catalogue(p).alias("catalogue"))


@query(sql.BM25 + "select qid, note_id, rank, round(score, 6) score from bm where rank <= 5")
def bm25f_topk(spark, sf):
    v = vault(spark, sf)
    return _out(_bm(v, _asked(v), 5))


def bm25f_by_titles(spark, sf):
    """The best five notes for each note's title; for small vaults, whose ids hold no question of the query set."""
    v = vault(spark, sf)
    q = ix.question_terms(v.corpus.select(F.col("note_id").alias("qid"), F.col("title").alias("question")))
    q = v._keep(lanes.with_idf(q, v.doc_freq, v.stats), "title-terms")
    return _out(_bm(v, q, 5))


@query(sql.BM25 + "select qid, note_id, rank, round(score, 6) score from rare where rank <= 30")
def rare_term_lane(spark, sf):
    v = vault(spark, sf)
    return _out(lanes.ranked(lanes.rare(_asked(v), v.postings, v.priors), 30, F.desc("prior")))


_TITLE = sql.BM25 + f""",
nw as (select note_id, lower(title) base, lower(path) low, list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') words, regexp_matches(lower(path), '(^|/)archive/') archived from c where not starts_with(path, 'System/')),
seq as (select qid, term, idf, pos, lead(term) over w next_term, lead(idf) over w next_idf from q window w as (partition by qid order by pos, term)),
th as (select qid, note_id, sum(case when list_contains(words, term) then 4 * idf when contains(base, term) then 2 * idf when contains(low, term) then idf else 0 end
   + case when next_term is null or regexp_matches(term || ' ' || next_term, '[0-9]|  ') then 0 when contains(base, term || ' ' || next_term) then 6 * greatest(idf, next_idf) when contains(low, term || ' ' || next_term) then 3 * greatest(idf, next_idf) else 0 end) raw,
   count(*) filter (not contains(term, ' ')) singles, count(*) filter (not contains(term, ' ') and list_contains(words, term)) whole, max(idf) filter (not contains(term, ' ')) single_idf,
   max(idf) max_idf, coalesce(max(idf) filter (contains(low, term)), 0) best, max(len(list_distinct(words))) n_words, bool_or(archived) archived, bool_or(contains(low, term)) hit
   from seq cross join nw group by qid, note_id),
ti as (select qid, note_id, (raw + case when singles >= 2 and whole = singles then (10 + 15 * least(singles / greatest(n_words, 1), 1.0)) * single_idf else 0 end) * case when max_idf > 1 and best < 0.6 * max_idf then 0.55 else 1 end * case when archived then 0.45 else 1 end score from th where hit),
title as (select qid, note_id, score, row_number() over (partition by qid order by round(score, 9) desc, note_id) rank from ti where score > 0)
"""


@query(_TITLE + "select qid, note_id, rank, round(score, 6) score from title where rank <= 50")
def title_lane(spark, sf):
    v = vault(spark, sf)
    return _out(lanes.ranked(lanes.title(_asked(v), v.corpus), 50))


_COVERAGE = sql.BM25 + f""",
pool as (select qid, note_id from bm where rank <= 50 union select qid, note_id from rare where rank <= 30),
cw as (select qid, term, idf, pos, {sql.dateish("term")} d from q),
uw as (select qid, term, idf, pos from cw where not d or qid not in (select qid from cw where not d)),
us as (select qid, list(term order by pos, term) w from uw group by qid), up as (select qid, case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) else [] end pairs from us),
sec as (select note_id, unnest(case when length(raw) < 4000 then [raw] else string_split(regexp_replace(raw, '(?m)^(#{{1,4}} )', chr(1) || '\\1', 'g'), chr(1)) end) s from c),
sp as (select note_id, s, {sql.plain("s")} p from (select distinct note_id, s from sec semi join pool using (note_id) where trim(s) <> '')), sn as (select note_id, s, {sql.tokens("p")} tk from sp),
cs as (select p.qid, p.note_id, s, sum(case when contains(lower(s), term) then idf else 0 end) / sum(idf) cov from pool p join sec using (note_id) join uw on uw.qid = p.qid where trim(s) <> '' group by p.qid, p.note_id, s),
cv as (select qid, note_id, max(cov * case when len(pairs) >= 4 and len(list_intersect(pairs, list_transform(generate_series(1, len(tk) - 1), lambda i: tk[i] || ' ' || tk[i + 1]))) >= 0.6 * len(pairs) then 0.25 else 1 end) cov from cs join up using (qid) join sn using (note_id, s) group by all),
cover as (select qid, note_id, cov, cov * prior score, row_number() over (partition by qid order by round(cov * prior, 9) desc, note_id) rank from cv join priors using (note_id) where cov * prior > 0.1)
"""


def _pool_cover(v: Vault, q: DataFrame, bm: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """bm: _bm() of the questions at 50, if it is there already."""
    bm = _bm(v, q, 50) if bm is None else bm
    rare = lanes.ranked(lanes.rare(q, v.postings, v.priors), 30, F.desc("prior")).select("qid", "note_id")
    pool = v._keep(bm.select("qid", "note_id").unionByName(rare).distinct(), "pool")
    return pool, v._keep(lanes.coverage(q, pool, v.corpus, v.priors), "coverage")


@query(_COVERAGE + "select qid, note_id, rank, round(score, 6) score from cover where rank <= 50")
def coverage_lane(spark, sf):
    v = vault(spark, sf)
    return _out(lanes.ranked(_pool_cover(v, _asked(v))[1], 50))


@query()
def proximity_lane(spark, sf):
    v = vault(spark, sf)
    q = _asked(v)
    return _out(lanes.ranked(lanes.proximity(q, _pool_cover(v, q)[0], v.terms), 50))


@query()
def tsmatch_lane(spark, sf):
    v = vault(spark, sf)
    q = _asked(v)
    pool = _pool_cover(v, q)[0]
    return _out(lanes.ranked(lanes.ts_match(q, pool, v.terms, lanes.proximity(q, pool, v.terms), v.priors), 50))


@query(sql.BM25 + """, sp as (select qid, note_id, case when contains(lower(title), term) then 4 * idf else 1.5 * idf end s from q join c on contains(lower(path), term) union all select qid, note_id, idf from q join post using (term)),
ss as (select qid, note_id, sum(s) * case when regexp_matches(lower(any_value(path)), '(^|/)archive/') then 0.45 else 1 end score from sp join c using (note_id) group by all),
sr as (select *, row_number() over (partition by qid order by round(score, 9) desc, note_id) rank from ss) select qid, note_id, rank, round(score, 6) score from sr where rank <= 20""")
def search_lane(spark, sf):
    v = vault(spark, sf)
    return _out(lanes.search(src.questions(v.corpus), v.corpus, _asked(v), v.postings))


@query(_COVERAGE + """, lane as (select qid, note_id, 1.2 / (60 + rank) s from bm where rank <= 50 union all select qid, note_id, 1.1 / (60 + rank) from rare where rank <= 30 union all select qid, note_id, 1.5 / (60 + rank) from cover where rank <= 50),
fu as (select qid, note_id, sum(s) rrf from lane group by all), fr as (select *, row_number() over (partition by qid order by round(rrf, 12) desc, note_id) rank from fu) select qid, note_id, rank, round(rrf, 9) rrf from fr where rank <= 20""")
def rrf_fusion(spark, sf):
    v = vault(spark, sf)
    q = _asked(v)
    bm = _bm(v, q, 50)
    rare = lanes.ranked(lanes.rare(q, v.postings, v.priors), 30, F.desc("prior"))
    cover = lanes.ranked(_pool_cover(v, q, bm)[1], 50)
    fused = fusion.rrf({"bm25": bm, "rare": rare, "coverage": cover}, fusion.lane_weights({"bm25": 1.2, "coverage": 1.5}))
    return fused.select("qid", "note_id", F.col("rank").cast("long").alias("rank"), F.round("rrf", 9).alias("rrf"))


_GATE = _COVERAGE + """, ab as (select qid, sum(case when df = 0 then idf else 0 end) / sum(idf) absent from q group by qid), gc as (select qid, max(cov) gate_cover from cover group by qid)"""


@query(_GATE + " select qid, not (gate_cover is null or gate_cover < 0.2 or (absent > 0.35 and gate_cover < 0.6)) as found, round(coalesce(gate_cover, 0), 6) gate_cover, round(absent, 6) absent from ab left join gc using (qid)")
def honesty_gate(spark, sf):
    v = vault(spark, sf)
    q = _asked(v)
    out = fusion.gate(fusion.absent_mass(q), _pool_cover(v, q)[1])
    return out.select("qid", "found", F.round("gate_cover", 6).alias("gate_cover"), F.round("absent", 6).alias("absent"))


_KNOWN = sql.BM25 + f""", sg as (select qid, term, idf_bm, not contains(term, ' ') single, {sql.dateish("term")} and not contains(term, ' ') d from q),
nd as (select qid, count(*) filter (single) a, count(*) filter (single and not d) content, count(*) filter (d) dates from sg group by qid having count(*) filter (single) >= 2 and (count(*) filter (single and not d) > 0 or count(*) filter (d) >= 2)),
tn as (select tt.note_id, tt.term, tt.tf, ln(1 + (n - df.df + 0.5) / (df.df + 0.5)) m from tt join df using (term) cross join st join c on c.note_id = tt.note_id where not starts_with(c.path, 'System/')),
tm as (select note_id, sum(tf * m) whole from tn where not contains(term, ' ') group by note_id),
kh as (select qid, note_id, count(*) filter (single and not d) hit, count(*) filter (d) dated, coalesce(sum(tf) filter (not single), 0) combos, coalesce(sum(tf * m) filter (single), 0) mass from sg join tn using (term) group by all),
kk as (select qid, note_id, path, dated + combos date_hits, (hit + dated + combos) / greatest(title_len, 1) cover, coalesce(mass / nullif(whole, 0), 0) cover_idf, title_len - hit - dated - combos extra from kh join nd using (qid) join lens using (note_id) join c using (note_id) left join tm using (note_id) where case when content > 0 then hit = content else dated = dates end),
kn as (select *, count(*) over (partition by qid) matches, row_number() over (partition by qid order by date_hits desc, round(cover_idf, 9) desc, round(cover, 9) desc, extra, path) nth from kk)"""


def _known(v: Vault, q: DataFrame) -> DataFrame:
    return fusion.known_item(q, v.terms, v.lengths, v.doc_freq, v.stats, v.corpus)


def _titles(v: Vault) -> DataFrame:
    q = ix.question_terms(v.corpus.where("note_id % 50 = 0").select(F.col("note_id").alias("qid"), F.col("title").alias("question")))
    return v._keep(lanes.with_idf(q, v.doc_freq, v.stats), "title-terms")


@query(_KNOWN.replace("concat_ws(' ', title, substring(regexp_replace(body, '[^\\p{L}\\p{N}\\p{M} ]+', ' ', 'g'), 1, 120))", "title") + " select qid, note_id, round(cover, 6) as cover, round(cover_idf, 6) as cover_idf, matches, nth from kn where nth <= 5")
def known_item(spark, sf):
    v = vault(spark, sf)
    return _known(v, _titles(v)).select("qid", "note_id", F.round("cover", 6).alias("cover"), F.round("cover_idf", 6).alias("cover_idf"), "matches", F.col("nth").cast("long").alias("nth"))


@query(sql.BM25 + """, ts as (select note_id, count(*) k from tt group by note_id having count(*) between 2 and 6), sh as (select qid, note_id, count(*) k, sum(log2(1 + n_notes / greatest(df, 1))) m from q join tt using (term) group by all),
sr as (select qid, note_id, row_number() over (partition by qid order by round(m, 9) desc, note_id) nth from sh join ts using (note_id, k)) select qid, note_id from sr where nth = 1""")
def title_subset(spark, sf):
    v = vault(spark, sf)
    return fusion.title_subset_pins(_asked(v), v.terms, v.lengths).select("qid", "note_id")


@query(sql.BM25 + f""", fw as (select qid, term from q where df between 1 and 25 and not contains(term, ' ') and not {sql.dateish("term")}), fk as (select qid, count(*) k from fw group by qid having count(*) >= 2),
fg as (select qid, note_id, count(*) k from fw join post using (term) group by all), fx as (select qid, note_id, row_number() over (partition by qid order by prior desc, note_id) nth from fg join fk using (qid, k) join priors using (note_id)) select qid, note_id, nth + 2 as slot from fx where nth <= 2""")
def rare_pins(spark, sf):
    v = vault(spark, sf)
    return fusion.rare_pins(_asked(v), v.postings, v.priors).select("qid", "note_id", F.col("slot").cast("long").alias("slot"))


@query(sql.BM25 + """, rx as (select qid, term, row_number() over (partition by qid order by round(idf, 9), pos, term) nth, count(*) over (partition by qid) k from q where not contains(term, ' ') and not """ + sql.dateish("term") + """) select qid, term from rx where nth = 1 and k >= 3""")
def relaxation(spark, sf):
    q = _asked(vault(spark, sf))
    return fusion.relax(q, q.select("qid").distinct())


@query()
def recall_answers(spark, sf):
    v = vault(spark, sf)
    return v.recall(src.questions(v.corpus))[0].select("qid", "note_id", "path", "rank")


@query()
def recall_outcomes(spark, sf):
    v = vault(spark, sf)
    out = v.recall(src.questions(v.corpus))[1]
    return out.select("qid", "found", F.round("gate_cover", 6).alias("gate_cover"), F.round("absent", 6).alias("absent"), "reason")


@query(sql.BM25 + """, fi as (select q0.qid, min(rank) r from (select distinct qid from q) q0 left join bm on bm.qid = q0.qid and bm.note_id = q0.qid and rank <= 5 group by q0.qid) select count(*) questions, round(avg(case when r is not null then 1.0 else 0.0 end), 6) recall_at_k, round(avg(coalesce(1.0 / r, 0.0)), 6) mrr_at_k from fi""")
def eval_recall_mrr(spark, sf):
    v = vault(spark, sf)
    q = _asked(v)
    answers = _bm(v, q, 5)
    return evaluate.recall_mrr(answers, q.select("qid", F.col("qid").alias("target")).distinct())


@query(sql.BM25 + """, kb as (select qid, note_id, count(*) hits from q join post using (term) group by all), kr as (select *, row_number() over (partition by qid order by hits desc, note_id) rank from kb) select qid, note_id, hits, rank from kr where rank <= 5""")
def keyword_baseline(spark, sf):
    v = vault(spark, sf)
    return evaluate.keyword_baseline(src.questions(v.corpus), v.postings).withColumn("rank", F.col("rank").cast("long"))


@query()
def eval_families(spark, sf):
    """Pass rates of the whole engine by family of questions."""
    v = vault(spark, sf)
    one = evaluate.scenarios(v.corpus, v.terms, v.doc_freq)
    rule = F.when(F.col("family") == "negative", "not-in-brain").otherwise("top3")
    one = one.withColumn("target2", F.lit(None).cast("long")).withColumn("group", F.array().cast("array<long>")).withColumn("accept", rule)
    s = v._keep(one.unionByName(evaluate.more_scenarios(v.corpus, graph.adjacency(v.edges))), "scenarios")
    answers, outcomes = v.recall(s.select(F.col("id").alias("qid"), "question"))
    answers = v._keep(answers, "graded-answers")
    rich = answers.join(s.where("family = 'richness'").select(F.col("id").alias("qid")), "qid", "left_semi")
    near = v.context(rich, cap=30).join(v.corpus.select("path", "note_id"), "path").select(F.col("qid").alias("id"), "note_id")
    return evaluate.report(evaluate.grade_rules(s, answers.withColumnRenamed("qid", "id"), outcomes.withColumnRenamed("qid", "id"), near))


@query("with s as (select value v, row_number() over (order by value) - 1 i, count(*) over () n from events where value is not null) select p.point, min(v) as value from s join (select unnest([50, 90, 99]) point) p on i = floor(n * point / 100) group by p.point")
def latency_percentiles(spark, sf):
    return evaluate.percentiles(table(spark, sf, "events"), "value")


@query("""with q as (select vec_id qid, embedding v from embeddings where vec_id % 50 = 0), s as (select qid, vec_id note_id, list_sum(list_transform(list_zip(v, embedding), lambda p: p[1]::double * p[2]::double)) score from q cross join embeddings),
r as (select qid, note_id, score, row_number() over (partition by qid order by round(score, 9) desc, note_id) rank from s) select qid, note_id, rank, round(score, 6) score from r where rank <= 10""")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return _out(lanes.ranked(lanes.semantic(q, e.select(F.col("vec_id").alias("note_id"), F.col("embedding").alias("vec"))), 10))


@query(sql.INDEX + """, vo as (select term, df from df where length(term) >= 4 and not contains(term, ' ')), tg as (select term, df, unnest(list_distinct(list_transform(generate_series(1, length(term) + 1), lambda i: substring('  ' || term || ' ', i, 3)))) gram from vo) select gram, count(*) terms, sum(df)::bigint as notes from tg group by gram""")
def trigram_index(spark, sf):
    v = ix.vocabulary(vault(spark, sf).doc_freq)
    return v.select("df", F.explode("trigrams").alias("gram")).groupBy("gram").agg(F.count("*").alias("terms"), F.sum("df").alias("notes"))


@query(sql.INDEX + """, w as (select term from df where length(term) >= 4 and not contains(term, ' ')),
d as (select term, unnest(list_distinct(list_concat([term], list_transform(generate_series(1, length(term)), lambda i: substring(term, 1, i - 1) || substring(term, i + 1))))) k from w),
p as (select distinct a.term, b.term as other from d a join d b using (k) where a.term < b.term),
x as (select *, list_filter(generate_series(1, length(term)), lambda i: substring(term, i, 1) <> substring(other, i, 1)) u from p)
select term, other from x where case when length(term) = length(other) then len(u) = 1 or (len(u) = 2 and u[2] = u[1] + 1 and substring(term, u[1], 1) = substring(other, u[2], 1) and substring(term, u[2], 1) = substring(other, u[1], 1))
 when length(term) = length(other) + 1 then list_contains(list_transform(generate_series(1, length(term)), lambda i: substring(term, 1, i - 1) || substring(term, i + 1)), other)
 when length(other) = length(term) + 1 then list_contains(list_transform(generate_series(1, length(other)), lambda i: substring(other, 1, i - 1) || substring(other, i + 1)), term) else false end""")
def typo_pairs(spark, sf):
    """The words one edit apart, over the whole vocabulary: rare words, which typos are, words of any script."""
    return ix.one_edit_pairs(vault(spark, sf).words)
