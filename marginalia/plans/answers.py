"""Registered queries: temporal lanes, rescaling, answer checks, further audit rules and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import audit, delivery, evaluate, fusion, graph, lanes, linking, structure
from marginalia.operators import index as ix
from marginalia.plans import sql
from marginalia.plans.catalog import query, table
from marginalia.plans.knowledge import corpus
from marginalia.plans.retrieval import _COVERAGE, _KNOWN, _asked, _bm, _known, _out, _pool_cover, _titles, vault
from marginalia.sources import vault as src

_BM_DATES = sql.BM25 + ", " + sql.DATES[len(sql.CORPUS) :].lstrip(", \n")


@query(_BM_DATES + f""", tw as (select qid, term from q where not {sql.dateish("term")}), need as (select qid, case when count(*) <= 3 then count(*) else ceil(0.6 * count(*)) end need from tw group by qid),
tg as (select qid, note_id, count(*) got from tw join post using (term) group by all), tl as (select qid, note_id, datediff('day', date '1970-01-01', date)::double score from tg join need using (qid) join dates using (note_id) where got >= need),
tr as (select *, row_number() over (partition by qid order by round(score, 9) desc, note_id) rank from tl) select qid, note_id, rank, score from tr where rank <= 30""")
def time_lane(spark, sf):
    v = vault(spark, sf)
    return _out(lanes.ranked(lanes.time_lane(_asked(v), v.postings, v.dates), 30))


@query(_BM_DATES + """, tm as (select distinct qid, note_id from q join c on contains(lower(path), term) where length(term) >= 3), tl as (select qid, note_id, datediff('day', date '1970-01-01', date)::double score from tm join dates using (note_id)),
tr as (select *, row_number() over (partition by qid order by round(score, 9) desc, note_id) rank from tl) select qid, note_id, rank, score from tr where rank <= 20""")
def title_recency_lane(spark, sf):
    v = vault(spark, sf)
    return _out(lanes.ranked(lanes.title_recency(_asked(v), v.corpus, v.dates), 20))


@query()
def entity_lane(spark, sf):
    v = vault(spark, sf)
    e = ix.entity_vocabulary(v.corpus).join(v.corpus.select("path", "note_id"), "path").select("note_id", "name")
    return _out(lanes.ranked(lanes.entity_fuzzy(_asked(v), e, v.stats), 15))


@query()
def typo_corrections(spark, sf):
    """Corrections of the perturbed words in the typo family's questions."""
    v = vault(spark, sf)
    s = evaluate.scenarios(v.corpus, v.terms, v.doc_freq).where("family = 'typo'").select(F.col("id").alias("qid"), "question")
    q = v._keep(lanes.with_idf(ix.question_terms(s), v.doc_freq, v.stats), "typo-terms")
    return lanes.corrections(q, v.vocabulary, v.stats)


_DROP = lambda end, k, more="": f"case when suffix(t, '{end}') then left(t, length(t) - {k}) || '{more}' end"
_FORMS = "list_filter([" + ", ".join([
    _DROP("ies", 3, "y"), _DROP("es", 2), _DROP("s", 1), _DROP("ing", 3), _DROP("ing", 3, "e"), _DROP("ed", 2), _DROP("ed", 1), _DROP("y", 1, "ies"), "case when not suffix(t, 's') then t || 's' end", "case when not suffix(t, 's') then t || 'es' end",
    "case when starts_with(t, 'ال') and length(t) > 5 then substring(t, 3) end", "case when regexp_matches(t, '^[؀-ۿ]') and not starts_with(t, 'ال') then 'ال' || t end", "case when starts_with(t, 'و') and length(t) > 4 and k < 2 then substring(t, 2) end",
    _DROP("ات", 2), _DROP("ات", 2, "ة"), _DROP("ين", 2), _DROP("ون", 2), _DROP("ة", 1), _DROP("ة", 1, "ات"),
]) + f"], lambda f: f is not null and f not in ({sql.MONTHS}))"


@query(sql.INDEX + f""", w as (select term t, df k from df where df < 3 and not contains(term, ' ') and length(term) >= 4), fl as (select t, k, {_FORMS} fs from w), fo as (select t, k, unnest(fs) v, generate_subscripts(fs, 1) pos from fl),
go as (select t, v, row_number() over (partition by t order by d.df desc, pos) nth from fo join df d on d.term = v where d.df > 2 * k and d.df >= 2) select t as term, v as variant from go where nth = 1""")
def morph_variants(spark, sf):
    v = vault(spark, sf)
    return lanes.morph_variants(v.doc_freq, v.doc_freq.where((F.col("df") < 3) & (F.instr("term", " ") == 0)))


_FUSED = _COVERAGE + f""", lane as (select qid, note_id, 1.2 / (60 + rank) s from bm where rank <= 50 union all select qid, note_id, 1.1 / (60 + rank) from rare where rank <= 30 union all select qid, note_id, 1.5 / (60 + rank) from cover where rank <= 50),
fu as (select qid, note_id, sum(s) rrf from lane group by all), f1 as (select *, row_number() over (partition by qid order by round(rrf, 12) desc, note_id) r0 from fu), f2 as (select * from f1 where r0 <= 20), cq as (select qid, term from q where not contains(term, ' ') and not {sql.dateish("term")}), bp0 as (select note_id, {sql.plain("title")} p from c), bt as (select note_id, {sql.tokens("p")} tk from bp0),
f3 as (select qid, note_id, path, rrf * case when regexp_matches(lower(path), '(^|/)archive/') and not regexp_matches(lower(question), '(discussed?|conversation|memor(y|ies)|remember|talked|chat(ted)?|we (said|spoke)|did we)') then 0.45 else 1 end
  * case when (lower(c.title) = 'home' or list_has_any(words, ['index', 'moc', 'map'])) and qid in (select qid from cq) and exists (select 1 from cq where cq.qid = f2.qid and not list_contains(bt.tk, cq.term)) then 0.45 else 1 end s, trim(array_to_string(list_filter(regexp_split_to_array(lower(c.title), '[\\s._-]+'), lambda t: t <> '' and not regexp_matches(t, '^([0-9]{{1,2}}|[0-9]{{4}})$') and t not in ({sql.MONTHS})), ' ')) series
  from f2 join c using (note_id, path) join pw using (note_id, path) join bt using (note_id) join qq using (qid)),
f4 as (select *, row_number() over (partition by qid, series order by round(s, 12) desc, note_id) n from f3), f5 as (select qid, note_id, s * case when series <> '' and n > 1 then 0.95 else 1 end score from f4),
f6 as (select *, row_number() over (partition by qid order by round(score, 12) desc, note_id) rank from f5)"""
_FUSED = _FUSED.replace("from f2 join c using (note_id, path)", "from f2 join c using (note_id)").replace("join pw using (note_id, path)", "join (select note_id, words from pw) pw using (note_id)")


def _rescaled(v, q):
    bm = _bm(v, q, 50)
    rare = lanes.ranked(lanes.rare(q, v.postings, v.priors), 30, F.desc("prior"))
    cover = lanes.ranked(_pool_cover(v, q, bm)[1], 50)
    fused = fusion.rrf({"bm25": bm, "rare": rare, "coverage": cover}, fusion.lane_weights({"bm25": 1.2, "coverage": 1.5}))
    asked = src.questions(v.corpus)
    asked = asked.select("qid", tx.is_episodic(F.col("question")).alias("episodic")).join(fusion.content_words(asked, q), "qid")
    return fusion.rescale(fused.select("qid", "note_id", "rrf"), v.corpus, asked)


@query(_FUSED + " select qid, note_id, rank, round(score, 9) score from f6")
def rescaled_fusion(spark, sf):
    v = vault(spark, sf)
    return _rescaled(v, _asked(v)).select("qid", "note_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(_FUSED + _KNOWN[len(sql.BM25) :] + ", cl as (select qid, score, max(score) over (partition by qid) best from f6 where rank <= 4 and qid not in (select qid from kn)) select qid, count(*) contenders from cl where round(score, 12) >= round(0.88 * best, 12) group by qid having count(*) >= 2")
def clarify_band(spark, sf):
    """Questions with no known item whose first answers lie close together."""
    v = vault(spark, sf)
    q = _asked(v)
    return fusion.clarify(_rescaled(v, q), _known(v, q)).select("qid", "contenders")


_TITLED = "concat_ws(' ', title, substring(regexp_replace(body, '[^\\p{L}\\p{N}\\p{M} ]+', ' ', 'g'), 1, 120))"


@query((_COVERAGE + _KNOWN[len(sql.BM25) :]).replace(_TITLED, "title") + ", cc as (select qid, max(cov) c from cover group by qid) select qid, case when max(kn.cover) filter (nth = 1) >= 0.6 then 'exists' when max(c) >= 0.4 then 'probable' else 'unknown' end safety from (select distinct qid from q) q0 left join kn using (qid) left join cc using (qid) group by qid")
def create_safety(spark, sf):
    """Whether a note may be made under each title: by title cover, else by what the notes' sections cover of it."""
    v = vault(spark, sf)
    q = _titles(v)
    return fusion.create_safety(_known(v, q), fusion.absent_mass(q), _pool_cover(v, q)[1])


@query(sql.BM25 + """, sc as (select note_id, unnest(case when length(raw) < 4000 then [raw] else string_split(regexp_replace(raw, '(?m)^(#{1,4} )', chr(1) || '\\1', 'g'), chr(1)) end) s, generate_subscripts(case when length(raw) < 4000 then [raw] else string_split(regexp_replace(raw, '(?m)^(#{1,4} )', chr(1) || '\\1', 'g'), chr(1)) end, 1) i from c),
ss as (select bm.qid, note_id, i, length(s) chars, sum(q.idf * least((length(lower(s)) - length(replace(lower(s), q.term, ''))) / length(q.term), 3.0)) score from bm join sc using (note_id) join q on q.qid = bm.qid where bm.rank <= 5 and trim(s) <> '' group by all),
sr as (select *, row_number() over (partition by qid, note_id order by round(score, 9) desc, i) nth from ss where score > 0) select qid, note_id, nth, round(score, 6) score from sr where nth <= 3""")
def answer_sections(spark, sf):
    """The best three sections of each of the first five answers, by their scores."""
    v = vault(spark, sf)
    q = _asked(v)
    best = delivery.best_sections(q, _bm(v, q, 5).select("qid", "note_id"), v.corpus)
    return best.select("qid", "note_id", F.col("nth").cast("long").alias("nth"), F.round("score", 6).alias("score"))


@query(sql.BM25 + """, a as (select qid, note_id from bm where rank <= 5), e as (select a.qid, a.note_id, q.term, case when contains(lower(title), q.term) then 'filename' when ht.tf > 0 then 'heading' when contains(lower(path), q.term) then 'path' when post.tf > 0 then 'body' end place
from a join q using (qid) join c using (note_id) left join ht on ht.note_id = a.note_id and ht.term = q.term left join post on post.note_id = a.note_id and post.term = q.term) select * from e where place is not null""")
def answer_evidence(spark, sf):
    v = vault(spark, sf)
    q = _asked(v)
    top = _bm(v, q, 5)
    return delivery.evidence(q, top, v.corpus, v.terms)


@query()
def embedding_chunks(spark, sf):
    return delivery.embedding_chunks(corpus(spark, sf), cap=None, least=None)


_MOVED = f"(regexp_matches(path, '(^|/)Quarantine\\b') or regexp_matches(lower(split_part(path, '/', -1)), '-[^/]*(macbook|imac|desktop|laptop|[''’]s )'))"


@query(sql.GRAPH + f""", cn as (select name, path from nm where name in (select name from nm group by name having count(*) > 1) and name not in ('home', 'overview', 'index', 'readme', 'skill', 'log index', 'moc') and not {_MOVED})
select min(struct_pack(d := len(string_split(path, '/')), path := path)).path as path, name || ' ' || count(*)::varchar detail from cn group by name having count(*) >= 2 and count(*) filter (regexp_matches(lower(path), '(^|/)raw/')) < count(*) and count(*) filter (regexp_matches(lower(path), '(^|/)meetings/')) < count(*)""")
def duplicate_aliases(spark, sf):
    return audit.duplicate_aliases(corpus(spark, sf)).select("path", "detail")


@query()
def moc_gaps(spark, sf):
    return audit.moc_gaps(corpus(spark, sf), vault(spark, sf).edges)


@query()
def area_gaps(spark, sf):
    return audit.area_gaps(corpus(spark, sf), vault(spark, sf).edges)


@query(sql.CORPUS + f"select path hub, {sql.FOLDER} dir from c where {sql.HUB}")
def hubs(spark, sf):
    return audit.hubs(corpus(spark, sf))


_PARTS = ("People", "Work", "Work/People", "Knowledge", "Memory", "Logs")


@query(sql.CORPUS + ", p as (select unnest([" + ", ".join(f"'{p}'" for p in _PARTS) + "]) part), h as (select path, part, row_number() over (partition by path order by length(part) desc) n from c join p on path = part or starts_with(path, part || '/')) select path, part as partition from h where n = 1")
def longest_partition(spark, sf):
    return structure.partition_of(corpus(spark, sf), spark.createDataFrame([(p,) for p in _PARTS], "partition string"))


@query(sql.CORPUS + ", e as (select path, unnest(list_concat([title], aliases)) as name from c where regexp_matches(path, '^(People|Partners|Work/People|Work/Partners)/') and len(string_split(path, '/')) <= 4 and not contains(lower(path), '/raw/')) select path, array_to_string(list_sort(list_distinct(list(name))), '|') as names from e where trim(name) <> '' group by path order by path limit 400")
def glossary(spark, sf):
    return vault(spark, sf).glossary().select("path", F.array_join("names", "|").alias("names"))


@query(sql.GRAPH + """, e as (select src, dst from edges where not unresolved and src <> dst and not starts_with(src, 'System/') and not starts_with(dst, 'System/')), dg as (select path, count(*) links from (select src path from e union all select dst from e) group by path),
t as (select path, title, coalesce(links, 0) links, case when lower(title) = 'garden' then 0 when starts_with(lower(title), 'garden') then 1 when contains(translate(lower(title), '-_', '  '), ' garden') then 2 when contains(lower(title), 'garden') then 3 end tier from c left join dg using (path))
select path, tier, links from t where tier is not null order by tier, links desc, title, path limit 8""")
def title_lookup(spark, sf):
    v = vault(spark, sf)
    return structure.title_lookup(v.corpus, structure.degrees(v.edges), "garden")


@query()
def phrase_statistics(spark, sf):
    v = vault(spark, sf)
    return linking.phrase_statistics(v.corpus, linking.mentions(v.corpus, linking.patterns(v.corpus)))


@query()
def orphan_links(spark, sf):
    v = vault(spark, sf)
    return linking.orphan_links(audit.orphans(v.corpus, v.edges), v.suggest_links())


@query("select agent_id, date_trunc('hour', epoch_ms(at_ms)) as start, lower(trim(action_kind)) kind, count(distinct entry_id) n from action_log where at_ms is not null group by all")
def hourly_activity(spark, sf):
    log = table(spark, sf, "action_log").where("at_ms is not null")
    hour = F.date_trunc("hour", F.timestamp_millis("at_ms")).cast("timestamp_ntz")
    return log.groupBy("agent_id", hour.alias("start"), F.lower(F.trim("action_kind")).alias("kind")).agg(F.count_distinct("entry_id").alias("n"))


@query("select entry_id, at_ms, agent_id, path from (select distinct entry_id, at_ms, agent_id, path from action_log where at_ms is not null) order by at_ms desc, agent_id nulls first, path nulls first, entry_id limit 30")
def newest_actions(spark, sf):
    log = table(spark, sf, "action_log").where("at_ms is not null").select("entry_id", "at_ms", "agent_id", "path").distinct()
    return log.orderBy(F.desc("at_ms"), F.asc_nulls_first("agent_id"), F.asc_nulls_first("path"), "entry_id").limit(30)


@query(sql.GRAPH + "select rel, source, unresolved, count(*) n from edges group by all")
def edge_summary(spark, sf):
    return vault(spark, sf).edges.groupBy("rel", "source", "unresolved").agg(F.count("*").alias("n"))


_CHANGED = "b as (select * replace (case when note_id % 10 = 4 then body || chr(10) || 'See [[Home]] and [[No such note]].' else body end as body) from b0 where note_id % 10 <> 9),\n"


@query(sql.GRAPH.replace("with b as (", "with b0 as (", 1).replace("c as (select *,", _CHANGED + "c as (select *,", 1).replace("and path is not null and trim(name_text)", "and path is not null and path not in (select path from b0 where note_id % 10 = 9) and trim(name_text)") + "select src, dst, rel, source, unresolved from edges")
def rebuilt_edges(spark, sf):
    """The graph after a tenth of the notes got new links and another tenth went: links are taken again from changed notes only,
    and all are resolved against what is left. The SQL builds it anew."""
    v = vault(spark, sf)
    old = v.corpus.select("path", tx.content_hash(F.col("raw")).alias("hash"))
    more = F.when(F.expr("note_id % 10 = 4"), F.lit("\nSee [[Home]] and [[No such note]].")).otherwise("")
    now = v.corpus.where("note_id % 10 != 9").withColumn("body", F.concat("body", more)).withColumn("raw", F.concat("raw", more))
    gone = v.corpus.where("note_id % 10 = 9").select("path")
    return graph.rebuild(v.edges.join(gone.withColumnRenamed("path", "src"), "src", "left_anti"), old, now, v.named.join(gone, "path", "left_anti"))
