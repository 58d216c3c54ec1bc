"""Registered queries: graph, linking, audit, time, structure, history, access."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions import udfs
from marginalia.operators import access, audit, bipartite, evaluate, graph, history, linking, structure, temporal
from marginalia.operators import index as ix
from marginalia.plans import sql
from marginalia.plans.catalog import query, table
from marginalia.plans.retrieval import vault
from marginalia.sources import vault as src


def corpus(spark, sf):
    return src.corpus(src.notes(spark, sf))


@query(sql.GRAPH + "select src, dst, rel, source, unresolved from edges")
def link_edges(spark, sf):
    return vault(spark, sf).edges


@query(sql.GRAPH + "select name, path from nmap")
def name_map(spark, sf):
    return graph.name_map(corpus(spark, sf))


@query(sql.GRAPH + "select name, array_to_string(list_transform(list_sort(list_distinct(list(struct_pack(d := len(string_split(path, '/')), path := path)))), lambda x: x.path), '|') paths from nm group by name having count(*) > 1")
def name_collisions(spark, sf):
    return graph.collisions(corpus(spark, sf)).select("name", F.array_join("paths", "|").alias("paths"))


@query(sql.GRAPH + "select dst as path, count(*) backlinks from edges where not unresolved group by dst")
def backlinks(spark, sf):
    return graph.backlinks(vault(spark, sf).edges)


@query(sql.GRAPH + "select src as path, count(*) neighbours from adj group by src")
def neighbour_sets(spark, sf):
    return graph.adjacency(vault(spark, sf).edges).groupBy(F.col("src").alias("path")).agg(F.count("*").alias("neighbours"))


_SEEDS = sql.GRAPH + ", s0 as (select note_id qid, path from c where note_id % 50 = 0), h1 as (select distinct qid, dst path from s0 join adj on src = path where (qid, dst) not in (select qid, path from s0)), h2 as (select distinct qid, dst path from h1 join adj on src = path where (qid, dst) not in (select qid, path from s0) and (qid, dst) not in (select qid, path from h1))"


@query(_SEEDS + " select qid, path, 1 hops from h1 union all select qid, path, 2 from h2")
def neighbourhood(spark, sf):
    v = vault(spark, sf)
    seeds = v.corpus.where("note_id % 50 = 0").select(F.col("note_id").alias("qid"), "path")
    return graph.neighbourhood(seeds, v._keep(graph.adjacency(v.edges), "adjacency"), hops=2, cap=None)


@query(sql.GRAPH + """, s0 as (select note_id qid, path from c where note_id % 50 = 0), dg as (select src, count(*) deg from adj group by src having count(*) <= 200), mv as (select adj.src, dst, 0.85 / deg share from adj join dg using (src)),
w1 as (select qid, dst path, sum(share) e from s0 join mv on src = path group by all), w2 as (select qid, dst path, sum(e * share) e from w1 join mv on src = path group by all),
al as (select qid, path, sum(e) e from (select qid, path, 1.0::double e from s0 union all select * from w1 union all select * from w2) group by all), bl as (select dst path, count(*) n from edges where not unresolved group by dst)
select qid, path, round(e * (1 + 0.2 * ln(1 + coalesce(n, 0))), 6) score from al left join bl using (path)""")
def spread_activation(spark, sf):
    from marginalia.operators import lanes

    v = vault(spark, sf)
    seeds = v.corpus.where("note_id % 50 = 0").select(F.col("note_id").alias("qid"), F.col("path").alias("note_id"), F.lit(1).alias("rank"))
    out = lanes.spread(seeds, v._keep(graph.adjacency(v.edges), "adjacency"), graph.backlinks(v.edges).withColumnRenamed("path", "note_id"))
    return out.select("qid", F.col("note_id").alias("path"), F.round("score", 6).alias("score"))


@query(sql.GRAPH + """, dg as (select src, count(*) deg from adj group by src), vi as (select adj.dst v, d.deg d, adj.src from adj join dg d on d.src = adj.dst where d.deg <= 150),
pr as (select x.src a, y.src b, sum(1 / ln(greatest(x.d, 2))) aa, count(*) k from vi x join vi y using (v) where x.src < y.src group by all)
select a, b, round(0.5 * aa + 3 * k / (da.deg + db.deg - k), 6) score from pr join dg da on da.src = a join dg db on db.src = b""")
def link_relatedness(spark, sf):
    v = vault(spark, sf)
    return graph.link_relatedness(v._keep(graph.adjacency(v.edges), "adjacency")).select("a", "b", F.round("score", 6).alias("score"))


@query("""with e as (select distinct 'c' || o_custkey c, 'p' || l_partkey p from lineitem join orders on l_orderkey = o_orderkey), adj as (select c src, p dst from e union all select p, c from e), dg as (select src, count(*) deg from adj group by src),
vi as (select adj.dst v, d.deg d, adj.src from adj join dg d on d.src = adj.dst), pr as (select x.src a, y.src b, sum(1 / ln(greatest(x.d, 2))) aa, count(*) k from vi x join vi y using (v) where x.src < y.src group by all),
sc as (select a, b, 0.5 * aa + 3 * k / (da.deg + db.deg - k) score from pr join dg da on da.src = a join dg db on db.src = b), bw as (select a, b, score from sc union all select b, a, score from sc),
rk as (select *, row_number() over (partition by a order by round(score, 9) desc, b) nth from bw) select a, b, nth, round(score, 6) score from rk where nth <= 8""")
def copurchase_related(spark, sf):
    """The eight most related customers or parts of each, over the graph of who bought what."""
    e = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    best = bipartite.related(e.select(F.col("o_custkey").cast("long").alias("left"), F.col("l_partkey").cast("long").alias("right")), ("c", "p"))
    return best.select("a", "b", "nth", F.round("score", 6).alias("score"))


_TOP = sql.INDEX + """, tw as (select note_id, term, (1 + ln(tf)) * ln(n / df) w from post join df using (term) cross join st where length(term) >= 3 and df <= 0.2 * n),
tn as (select *, row_number() over (partition by note_id order by round(w, 9) desc, term) nth from tw), top as (select * from tn where nth <= 15)"""


@query(_TOP + " select note_id, term, round(w, 6) weight, nth from top")
def tfidf_top_terms(spark, sf):
    v = vault(spark, sf)
    return graph.top_terms(v.postings, v.doc_freq, v.stats).select("note_id", "term", F.round("weight", 6).alias("weight"), F.col("nth").cast("long").alias("nth"))


@query(_TOP + ", sh as (select term from top group by term having count(*) between 2 and 100) select x.note_id a, y.note_id b, round(sum(x.w * y.w), 6) score from top x join top y using (term) join sh using (term) where x.note_id < y.note_id group by all")
def tfidf_related(spark, sf):
    v = vault(spark, sf)
    return graph.text_relatedness(v._keep(graph.top_terms(v.postings, v.doc_freq, v.stats), "top-terms")).select("a", "b", F.round("score", 6).alias("score"))


@query(_TOP + sql.GRAPH[len(sql.CORPUS) :] + """, dg as (select src, count(*) deg from adj group by src), vi as (select adj.dst v, d.deg d, adj.src from adj join dg d on d.src = adj.dst where d.deg <= 150),
pr as (select x.src a, y.src b, sum(1 / ln(greatest(x.d, 2))) aa, count(*) k from vi x join vi y using (v) where x.src < y.src group by all), lk as (select a, b, 0.5 * aa + 3 * k / (da.deg + db.deg - k) score from pr join dg da on da.src = a join dg db on db.src = b),
sh as (select term from top group by term having count(*) between 2 and 100), tx as (select x.note_id a, y.note_id b, sum(x.w * y.w) score from top x join top y using (term) join sh using (term) where x.note_id < y.note_id group by all),
tp as (select ca.path a, cb.path b, score from tx join c ca on ca.note_id = a join c cb on cb.note_id = b),
bw as (select a, b, score, 'links' via from lk union all select b, a, score, 'links' from lk union all select a, b, score, 'text' from tp union all select b, a, score, 'text' from tp),
rk as (select *, row_number() over (partition by a, via order by round(score, 9) desc, b) rank from bw), fu as (select a, b, sum(1.0 / (60 + rank)) s, case when count(*) = 2 then 'both' else min(via) end via from rk where rank <= 25 group by all),
fr2 as (select *, row_number() over (partition by a order by round(s, 12) desc, b) nth from fu) select a, b, via, nth from fr2 where nth <= 8""")
def related_notes(spark, sf):
    return vault(spark, sf).related().select("a", "b", "via", F.col("nth").cast("long").alias("nth"))


@query()
def link_suggestions(spark, sf):
    return vault(spark, sf).suggest_links()


@query(sql.CORPUS + """, h as (select path, sha256(body) h, regexp_matches(lower(path), '(^|/)(inbox|raw|imports?|archive)/')::int off, len(string_split(path, '/')) d from c where trim(body) <> ''),
k as (select h, min(struct_pack(off := off, d := d, path := path)) k from h group by h having count(*) > 1) select path, k.path keep from h join k using (h) where path <> k.path""")
def cleanup_plan(spark, sf):
    return linking.cleanup_plan(corpus(spark, sf)).select("path", "keep")


@query(sql.CORPUS + "select path, substring(sha1(raw), 1, 16) hash from c")
def content_hashes(spark, sf):
    return corpus(spark, sf).select("path", tx.content_hash(F.col("raw")).alias("hash"))


@query(sql.GRAPH + f"select src as path, dst as detail from edges where unresolved and source = 'wikilink' and not {sql.VERBATIM.replace('path', 'src')} and not starts_with(src, 'System/') and not regexp_matches(dst, '[<>*?\"{{}}]') and not (trim({sql.base('dst')}) = lower(trim({sql.base('dst')})) and lower(trim({sql.base('dst')})) in ({sql._q(audit.PLACEHOLDERS)}))")
def broken_wikilinks(spark, sf):
    return audit.broken_links(vault(spark, sf).edges).select("path", "detail")


@query(sql.GRAPH + f", ln as (select src path from edges where not unresolved union select dst from edges where not unresolved) select path from c where path not in (select path from ln) and not {sql.HUB} and not regexp_matches(path, '^(Templates|Inbox)/') and not {sql.VERBATIM} and not regexp_matches(path, '(^|/)Reference/Skills/')")
def orphan_notes(spark, sf):
    return audit.orphans(corpus(spark, sf), vault(spark, sf).edges).select("path")


_EXEMPT = f"({sql.VERBATIM} or starts_with(path, 'System/') or split_part(path, '/', -1) = 'SKILL.md' or regexp_matches(lower(path), '(^|/)transcripts?/') or regexp_matches(lower(split_part(path, '/', -1)), '(^|[^a-z0-9_])transcripts?([^a-z0-9_]|$)'))"
_LINE = "regexp_extract(front, '(?im)^' || f || ':[ \\t]*([^\\r\\n]*(?:\\r?\\n[ \\t]+-[^\\r\\n]*)*)', 1)"


@query(sql.CORPUS + f""", so as (select *, case when contains(path, '/') then split_part(path, '/', 1) else '' end top from c where not {_EXEMPT}),
rq as (select path, front, unnest(['type', 'tags', 'status', 'updated']) f from so where front is not null),
fv as (select path, {sql.front_value('type')} ty, {sql.front_value('status')} stt from so where front is not null),
vt as (select {sql.front_value('type')} v from c group by 1 having count(*) >= 3), vs as (select {sql.front_value('status')} v from c group by 1 having count(*) >= 3)
select 'missing-frontmatter' kind, path, top detail from so where front is null and top in ({sql._q(audit.PARTITIONS)}) and top not in ('Inbox', 'Reference')
union all select 'invalid-frontmatter', path, d from (select path, case when not regexp_matches(front, '(?im)^' || f || ':') then 'missing ' || f when regexp_replace({_LINE}, '[\\[\\]\\s"'']', '', 'g') = '' then 'empty ' || f end d from rq) where d is not null
union all select 'unknown-type', path, ty from fv where ty is not null and ty not in ({sql._q(audit.TYPES)}) and ty not in (select v from vt where v is not null)
union all select 'invalid-status', path, stt from fv where stt is not null and stt not in ({sql._q(audit.STATUSES)}) and stt not in (select v from vs where v is not null)""")
def conformance(spark, sf):
    return audit.conformance(corpus(spark, sf))


@query(sql.CORPUS + """, k as (select path, coalesce(nullif(regexp_extract(path, '^(.*)\\.sync-conflict-[0-9]{8}-[0-9]{6}-[^./]+\\.md$', 1), ''), nullif(regexp_extract(path, '^(.*) \\([^()]*?(?:conflicted copy|sync-conflict)[^)]*\\)\\.md$', 1), ''),
nullif(regexp_extract(path, '(?i)^(.*?)-(?:(?:desktop|laptop|macbook)[- ][^/]+|[^/]*[''’]s(?:\\s[^/]*)?)\\.md$', 1), '')) || '.md' o from c) select path, o detail from k where o <> path and o in (select path from c)""")
def sync_conflict_copies(spark, sf):
    return audit.conflict_copies(corpus(spark, sf)).select("path", "detail")


@query(sql.CORPUS + f", d as (select path, datediff('day', try_cast(nullif(regexp_extract({sql.front_value('date')}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') as date), try_cast(nullif(regexp_extract({sql.front_value('updated')}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') as date)) n from c where lower({sql.front_value('type')}) in ('memory', 'log')) select path, n::varchar detail from d where n >= 2")
def dated_note_drift(spark, sf):
    return audit.dated_drift(corpus(spark, sf)).select("path", "detail")


_SKIP = f"(regexp_matches(path, '^(System|Templates|Inbox)/') or {sql.VERBATIM} or regexp_matches(path, '(^|/)Reference/Skills/'))"


@query(sql.GRAPH + f""", hb as (select path hub, {sql.FOLDER} dir from c where {sql.HUB}), fh as (select distinct dst path from edges where not unresolved and src in (select hub from hb)),
n as (select path, {sql.FOLDER} dir from c where not {_SKIP} and path not in (select hub from hb)), g as (select dir, count(*) n, count(*) filter (path in (select path from fh)) wired, min(path) path from n where dir <> '' group by dir)
select path, dir || ' ' || n::varchar detail from g where n >= 3 and wired = 0 and dir not in (select dir from hb)""")
def hub_gaps(spark, sf):
    return audit.hub_gaps(corpus(spark, sf), vault(spark, sf).edges).select("path", "detail")


@query()
def audit_summary(spark, sf):
    v = vault(spark, sf)
    return audit.by_kind(v.check())


@query()
def health_score(spark, sf):
    v = vault(spark, sf)
    return audit.health(v.check(), v.corpus)


@query(sql.CORPUS + "select case when contains(path, '/') then split_part(path, '/', 1) else '' end as partition, count(*) n from c group by 1")
def partition_counts(spark, sf):
    return structure.partition_counts(corpus(spark, sf))


_MONTHS12 = "(" + "|".join(tx.MONTHS) + ")"


@query(sql.CORPUS + f""", p as (select string_split(path, '/') parts from c), q as (select list_slice(parts, 1, least(greatest(len(parts) - 1, 0), 6)) f from p),
s as (select f, list_position(list_transform(f, lambda x: regexp_matches(lower(x), '^[0-9]+$') or regexp_matches(lower(x), '^([0-9]{{1,2}}[ _-]*)?{_MONTHS12}$')), true) stop from q),
k as (select case when coalesce(stop, 0) > 0 then list_slice(f, 1, stop - 1) else f end f from s), e as (select array_to_string(list_slice(f, 1, i), '/') folder, i depth from k, lateral (select unnest(generate_series(1, len(f))) i))
select folder, depth::bigint as depth, count(*) n from e group by all""")
def folder_rollup(spark, sf):
    return structure.folder_rollup(corpus(spark, sf)).withColumn("depth", F.col("depth").cast("long"))


@query(sql.CORPUS + f""", hb as (select path hub, {sql.FOLDER} dir from c where {sql.HUB}), a as (select path, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') dir, i from c, lateral (select unnest(generate_series(1, len(string_split(path, '/')) - 1)) i) where contains(path, '/'))
select path, min(struct_pack(d := -i, hub := hub)).hub as hub from a join hb using (dir) where path <> hub group by path""")
def governing_hubs(spark, sf):
    c = corpus(spark, sf)
    return structure.governing_hub(c, audit.hubs(c))


@query(sql.DATES + "select note_id, date, source from dates")
def note_dates(spark, sf):
    return temporal.dated(corpus(spark, sf)).select("note_id", "date", "source")


@query(sql.DATES + "select date, count(*) n from dates where source = 'front' group by date having count(*) >= 8")
def bulk_days(spark, sf):
    return temporal.bulk_days(temporal.dated(corpus(spark, sf)))


@query()
def body_events(spark, sf):
    return temporal.body_events(corpus(spark, sf))


@query()
def recent_notes(spark, sf):
    return temporal.recent(corpus(spark, sf), "2021-06-01", "2021-06-30", None, None, now="2021-06-30")


@query("""with w as (select path, max(at_ms) as last from action_log where lower(trim(action_kind)) in ('write', 'append', 'move', 'archive', 'remember') and path is not null group by path),
b as (select note_id, any_value(path) path, any_value(mtime) mtime from notes where note_id is not null group by note_id)
select at_ms, path, lower(trim(action_kind)) what, count(*) n from action_log where at_ms is not null group by all
union all select epoch_ms(mtime) at_ms, path, 'changed outside', 1 from b left join w using (path) where mtime is not null and (w.last is null or epoch_ms(mtime) > w.last + 1000)""")
def activity_feed(spark, sf):
    return temporal.activity(table(spark, sf, "action_log"), src.notes(spark, sf), limit=None).groupBy("at_ms", "path", "what").agg(F.count("*").alias("n"))


@query("with b as (select note_id, any_value(path) path, any_value(mtime) mtime from notes where note_id is not null group by note_id) select path, mtime from b order by mtime desc nulls last, path limit 50")
def newest_notes(spark, sf):
    return structure.newest(src.notes(spark, sf), "", 50)


@query("""with o as (select distinct path from notes where path is not null and not starts_with(path, 'System/') and not starts_with(path, '/') and not regexp_matches(path, '(^|/)\\.\\.(/|$)')), a as (select agent_id, coalesce(read_scopes, []) r, coalesce(deny_read, []) d from agents where agent_id is not null)
select agent_id, count(*) filter (path is not null and (len(list_filter(r, lambda p: regexp_replace(p, '/+$', '') <> '')) = 0 or len(list_filter(r, lambda p: lower(path) = regexp_replace(lower(p), '/+$', '') or starts_with(lower(path), regexp_replace(lower(p), '/+$', '') || '/'))) > 0)
 and len(list_filter(d, lambda p: lower(path) = regexp_replace(lower(p), '/+$', '') or starts_with(lower(path), regexp_replace(lower(p), '/+$', '') || '/'))) = 0) n from a left join o on true group by agent_id""")
def readable_counts(spark, sf):
    return access.readable_counts(src.notes(spark, sf), table(spark, sf, "agents"))


_CDC = sql.CORPUS + ", hd as (select path, raw before from c where note_id % 10 <> 3), dk as (select path, case when note_id % 10 = 7 then raw || chr(10) || 'added' else raw end as after from c where note_id % 10 <> 5)"


@query(_CDC + " select path, case when before is null then 'added' when after is null then 'deleted' else 'edited' end as change from hd full join dk using (path) where before is distinct from after")
def change_capture(spark, sf):
    """Two states of the vault made from the notes: some notes missing in either, some edited."""
    c = corpus(spark, sf)
    head = c.where("note_id % 10 != 3").select("path", F.col("raw").alias("text"))
    disk = c.where("note_id % 10 != 5").select("path", F.when(F.expr("note_id % 10 = 7"), F.concat("raw", F.lit("\nadded"))).otherwise(F.col("raw")).alias("text"))
    return history.changes(head, disk).select("path", "change")


@query(sql.CORPUS + """, l as (select path, note_id % 3 k, note_id % 5 a, case when raw = '' then [] else string_split(raw, chr(10)) end l from c),
r as (select path, a, len(l) n, list_concat(list_slice(l, k + 1, len(l)), list_transform(generate_series(1, a), lambda i: 'added line ' || i::varchar)) r from l)
select path, a added, (n - case when array_to_string(r, chr(10)) = '' then 0 else len(r) - a end)::bigint as deleted from r where n > 0 or a > 0""")
def diff_statistics(spark, sf):
    """Every note against a version of it that lacks up to two lines at its head and has up to four new ones at its end."""
    c = corpus(spark, sf)
    lines = F.when(F.col("raw") == "", F.array().cast("array<string>")).otherwise(F.split("raw", "\n"))
    more = F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= F.col("a")), lambda i: F.concat(F.lit("added line "), i.cast("string")))
    x = c.select("path", "raw", F.expr("int(note_id % 3)").alias("k"), F.expr("int(note_id % 5)").alias("a"), lines.alias("l"))
    after = F.array_join(F.concat(F.slice("l", F.col("k") + 1, F.greatest(F.size("l"), F.lit(1))), more), "\n")
    return history.diff_stat(history.diff_lines(x.select("path", F.col("raw").alias("before"), after.alias("after"))))


@query(sql.CORPUS + f"""select note_id, {sql.front_value('type')} as type, {sql.front_value('status')} status, {sql.front_value('updated')} updated, regexp_matches(raw, '(?s)^---\\r?\\n.*?\\r?\\n---') as has_front from c""")
def front_matter_fields(spark, sf):
    c = corpus(spark, sf)
    return c.select("note_id", *(tx.front_value(F.col("front"), k).alias(k) for k in ("type", "status", "updated")), tx.front_matter(F.col("raw")).isNotNull().alias("has_front"))


@query("with b as (select note_id, any_value(aliases) a from notes where frontmatter is not null group by note_id) select note_id, array_to_string(coalesce(a, []), '|') aliases from b where note_id is not null")
def parsed_aliases(spark, sf):
    """Aliases parsed from the front matter's text; the table's own column is the truth."""
    return src.notes(spark, sf).where("frontmatter is not null").select("note_id", F.array_join(tx.aliases(F.col("frontmatter")), "|").alias("aliases"))


@query(sql.CORPUS + f"""select note_id, trim(array_to_string(list_filter(regexp_split_to_array(lower(title), '[\\s._-]+'), lambda t: t <> '' and not regexp_matches(t, '^([0-9]{{1,2}}|[0-9]{{4}})$') and t not in ({sql.MONTHS})), ' ')) series from c""")
def dated_series(spark, sf):
    return corpus(spark, sf).select("note_id", tx.date_key(F.col("path")).alias("series"))


@query()
def note_outlines(spark, sf):
    return structure.outline(corpus(spark, sf))


@query(sql.GRAPH + "select (select count(*) from c) notes, (select count(*) from edges) edges, (select count(*) from edges where unresolved) unresolved, (select count(*) from note_chunks) chunks")
def vault_overview(spark, sf):
    return vault(spark, sf).overview()


@query(sql.CORPUS + "select c.path, substring(sha1(c.raw), 1, 16) h, v.n_chunks from c join (select note_id, count(distinct chunk_id) n_chunks from note_chunks where vec is not null group by note_id) v using (note_id)")
def chunked_notes(spark, sf):
    ch = table(spark, sf, "note_chunks").where("vec is not null").groupBy("note_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    return corpus(spark, sf).join(ch, "note_id").select("path", tx.content_hash(F.col("raw")).alias("h"), "n_chunks")


@query(sql.CORPUS + ", e as (select path, unnest(list_concat([title], aliases)) as name from c where regexp_matches(path, '^(People|Partners|Work/People|Work/Partners)/') and len(string_split(path, '/')) <= 4 and not contains(lower(path), '/raw/')) select distinct name, path from e where trim(name) <> ''")
def entity_vocabulary(spark, sf):
    return ix.entity_vocabulary(corpus(spark, sf))


@query("select given_name, nickname, least(damerau_levenshtein(lower(given_name), lower(nickname)), 4) d from nicknames")
def edit_distances(spark, sf):
    """Edits between names and their short forms, 4 for more than three."""
    n = table(spark, sf, "nicknames")
    return n.select("given_name", "nickname", udfs.osa(F.lower("given_name"), F.lower("nickname"), 3).alias("d"))


@query("with s as (select vec_id, label, list_sum(list_transform(embedding, lambda x: x::double)) v from embeddings where label is not null) select least(greatest(floor(v / 8 * 20), 0), 20)::int as bucket, count(*) n from s group by 1")
def score_histogram(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf, "embeddings").where("label is not null").select(F.least(F.greatest(F.floor(total / 8 * 20), F.lit(0)), F.lit(20)).cast("int").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query()
def scenario_families(spark, sf):
    v = vault(spark, sf)
    return evaluate.scenarios(v.corpus, v.terms, v.doc_freq)
