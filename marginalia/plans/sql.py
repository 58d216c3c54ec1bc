"""SQL pieces for the queries' twins, written from the definitions: tokens, index tables, edges."""

from __future__ import annotations

from marginalia.functions import text as tx

_q = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
STOP = _q(tx.STOP)
MONTHS = _q(tx.ALL_MONTHS)


def plain(e: str) -> str:
    """The words of a text, no word dropped."""
    return (
        f"list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(translate(lower(regexp_replace({e}, '<!--[\\s\\S]*?-->', ' ', 'g')), '{tx.DIGITS[0]}', '{tx.DIGITS[1]}'), "
        "'[ـً-ٰٟۖ-ۭ]', '', 'g'), '[؟؛،۔٪٬]', ' ', 'g'), '[^\\p{L}\\p{N}\\p{M}]+'), lambda w: w <> ''), "
        "lambda w: case when regexp_matches(w, '^[0-9]+(st|nd|rd|th)$') then regexp_extract(w, '^([0-9]+)', 1) else w end)"
    )


def tokens(p: str) -> str:
    """The index tokens from a column of plain words."""
    return (
        f"flatten(list_transform({p}, lambda w, i: list_concat("
        f"case when (length(w) > 1 or regexp_matches(w, '^[0-9]$')) and w not in ({STOP}) then [w] else []::varchar[] end, "
        f"case when regexp_matches(w, '^\\p{{L}}+$') and w not in ({STOP}) and coalesce(regexp_matches({p}[i + 1], '^[0-9]{{1,3}}$'), false) then [w || ' ' || {p}[i + 1]] else []::varchar[] end)))"
    )


def dateish(w: str) -> str:
    return f"(regexp_matches({w}, '^[0-9]{{1,4}}$') or {w} in ({MONTHS}) or regexp_matches({w}, '^\\p{{L}}+ [0-9]{{1,3}}$'))"


def base(path: str) -> str:
    return f"regexp_replace(split_part({path}, '/', -1), '\\.md$', '')"


FENCES = "'(?s)```.*?(```|$)'"

#: One row per note.
CORPUS = f"""
with b as (select note_id, any_value(path) path, any_value(frontmatter) front, coalesce(any_value(aliases), []) aliases, coalesce(any_value(body), '') body, any_value(mtime) mtime from notes where note_id is not null group by note_id),
c as (select *, {base("path")} title, case when front is null then '' else '---' || chr(10) || front || chr(10) || '---' || chr(10) end || body raw from b)
"""

PRIOR = f"""
pw as (select note_id, path, lower(title) base, lower(path) low, regexp_split_to_array(lower(title), '[^a-z0-9؀-ۿ]+') words from c),
priors as (select note_id, case when list_has_any(words, ['index', 'moc']) then 0.5 when regexp_matches(low, '^(logs|inbox)/') then 0.7
  when regexp_matches(low, '/raw/|raw exports/|transcripts?/|recovered sessions?/') then 0.55 when regexp_matches(base, '\\.(docx|pdf|xlsx|pptx)( \\([0-9]+\\))?$') then 0.55
  when regexp_matches(base, '(^|[^a-z0-9_])(docs? raw|raw docs?)([^a-z0-9_]|$)|(^|[^a-z0-9_])raw$') then 0.55 when regexp_matches(base, 'audit|health check') then 0.6 else 1.0 end::double prior from pw)
"""

#: Tokens of each field, postings, document frequencies, lengths.
INDEX = CORPUS + f""",
fp as (select note_id, path, {plain("title")} tp, list_transform(aliases, lambda a: {plain("a")}) ap,
  list_transform(list_concat(regexp_extract_all(regexp_replace(body, {FENCES}, ' ', 'g'), '(?m)^#{{1,4}} +([^\\r\\n]+)', 1), list_filter(regexp_extract_all(regexp_replace(body, {FENCES}, ' ', 'g'), '(?m)^\\|[ \\t]*([^|\\r\\n]+?)[ \\t]*\\|', 1), lambda x: not regexp_matches(x, '^[:\\- ]+$'))), lambda h: {plain("h")}) hp,
  {plain("raw")} bp from c),
f as (select note_id, path, list_concat({tokens("tp")}, flatten(list_transform(ap, lambda z: {tokens("z")}))) title, flatten(list_transform(hp, lambda z: {tokens("z")})) head, {tokens("bp")} body from fp),
lens as (select note_id, len(title) title_len, len(head) head_len, len(body) body_len from f),
st as (select count(*) n, coalesce(nullif(avg(title_len), 0), 1) avg_title, coalesce(nullif(avg(head_len), 0), 1) avg_head, coalesce(nullif(avg(body_len), 0), 1) avg_body from lens),
post as (select note_id, term, count(*) tf from (select note_id, unnest(body) term from f) group by all),
tt as (select note_id, term, count(*) tf from (select note_id, unnest(title) term from f) group by all),
ht as (select note_id, term, count(*) tf from (select note_id, unnest(head) term from f) group by all),
keys as (select note_id, term from post union select note_id, term from tt union select note_id, term from ht),
df as (select term, count(*) df from keys group by term)
"""

QUESTIONS = INDEX + f""",
qq as (select note_id qid, concat_ws(' ', title, substring(regexp_replace(body, '[^\\p{{L}}\\p{{N}}\\p{{M}} ]+', ' ', 'g'), 1, 120)) question from c where note_id % 50 = 0),
qp as (select qid, {plain("question")} p from qq),
qe as (select qid, unnest({tokens("p")}) term, generate_subscripts({tokens("p")}, 1) - 1 pos from qp),
q as (select qid, e.term, count(*) times, min(pos) pos, coalesce(any_value(df), 0) df, any_value(n) n_notes,
  greatest(least(log2(any_value(n) / greatest(coalesce(any_value(df), 0), 1)) / 3, 3.0), 0.5) idf, ln(1 + (any_value(n) - coalesce(any_value(df), 0) + 0.5) / (coalesce(any_value(df), 0) + 0.5)) idf_bm
  from qe e left join df using (term) cross join st group by qid, e.term),
""" + PRIOR.strip()

BM25 = QUESTIONS + """,
bms as (select qid, k.note_id, sum(times * idf_bm * norm / (norm + 1.2)) s from (
  select q.qid, q.times, q.idf_bm, keys.note_id,
   4.0 * least(coalesce(tt.tf, 0), 1) / (1 - 0.45 + 0.45 * greatest(title_len, 1) / avg_title) + 2.0 * coalesce(ht.tf, 0) / (1 - 0.75 + 0.75 * greatest(head_len, 1) / avg_head) + 1.0 * coalesce(post.tf, 0) / (1 - 0.75 + 0.75 * greatest(body_len, 1) / avg_body) norm
  from q join keys using (term) left join tt on tt.note_id = keys.note_id and tt.term = keys.term left join ht on ht.note_id = keys.note_id and ht.term = keys.term left join post on post.note_id = keys.note_id and post.term = keys.term
  join lens on lens.note_id = keys.note_id cross join st) k group by all),
bm as (select qid, note_id, s * prior score, row_number() over (partition by qid order by round(s * prior, 9) desc, note_id) rank from bms join priors using (note_id)),
rares as (select qid, note_id, count(*)::double score from q join post using (term) where df between 1 and 15 and not contains(term, ' ') and not """ + dateish("term") + """ group by all),
rare as (select qid, note_id, score, row_number() over (partition by qid order by round(score, 9) desc, prior desc, note_id) rank from rares join priors using (note_id))
"""

#: Links before and after resolution.
_KEY = "lower(trim({0}))"
_FOLD = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\\\\+$', ''), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_NOCODE = f"regexp_replace(regexp_replace(body, {FENCES}, ' ', 'g'), '`[^`\\n]{{0,1000}}`', ' ', 'g')"


def _front(key: str, rel: str) -> str:
    return f"""select path src, trim(unnest(case when regexp_matches(front, '(?im)^{key}:[ \\t]*\\[[^\\]\\r\\n\\[]*\\]') then string_split(regexp_extract(front, '(?im)^{key}:[ \\t]*\\[([^\\]\\r\\n\\[]*)\\]', 1), ',')
      when trim(regexp_extract(front, '(?im)^{key}:[ \\t]*["'']?([^"''\\r\\n]+)', 1)) <> '' then [trim(regexp_extract(front, '(?im)^{key}:[ \\t]*["'']?([^"''\\r\\n]+)', 1))] else [] end)) raw, '{rel}' rel from c where front is not null"""


GRAPH = CORPUS + f""",
wl as (select path src, regexp_extract(m, '\\[\\[([^\\]|#]+)', 1) t from (select path, unnest(regexp_extract_all({_NOCODE}, '!?\\[\\[[^\\]|#]+(?:[|#][^\\]]*)?\\]\\]')) m from c) where not starts_with(m, '!')),
fr as ({" union all ".join(_front(k, r) for k, r in (("related", "related_to"), ("source", "sourced_from"), ("area", "in_area"), ("creator", "by_creator"), ("platform", "on_platform")))}),
cand0 as (select src, trim(t) to_text, 'mentions' rel, 'wikilink' source, false soft from wl where trim(t) <> ''
  union all select src, trim(regexp_replace(regexp_replace(regexp_replace(raw, '^["'']?\\[\\[|^["'']', ''), '\\]\\]["'']?$|["'']$', ''), '[|#].*$', '')), rel, 'frontmatter', not regexp_matches(raw, '^["'']?\\[\\[.*\\]\\]["'']?$') from fr
  union all select path, trim(name_text), 'named', 'mention', true from entity_names where origin = 'mention' and path is not null and trim(name_text) <> ''),
cand as (select src, rel, min(struct_pack(to_text := to_text, source := source, soft := soft)) x from cand0 where to_text <> '' group by src, rel, lower(to_text)),
nm as (select distinct {_KEY.format("n")} as name, path from (select path, unnest(list_concat([title], aliases)) n from c) where {_KEY.format("n")} <> ''),
nmap as (select name, min(struct_pack(weak := weak, d := len(string_split(path, '/')), path := path)).path as path from (select name, path, 0 weak from nm union all select lower(path), path, 1 from c union all select regexp_replace(lower(path), '\\.md$', ''), path, 1 from c) group by name),
own as (select folded, min(path) p3 from (select distinct {_FOLD.format("name")} folded, path from nm) where folded <> '' group by folded having count(*) = 1),
edges as (select src, coalesce(m1.path, m2.path, p3, x.to_text) dst, rel, x.source as source, coalesce(m1.path, m2.path, p3) is null unresolved from cand
  left join nmap m1 on m1.name = {_KEY.format("x.to_text")} left join nmap m2 on m2.name = regexp_replace({_KEY.format("x.to_text")}, '\\.md$', '') left join own on folded = {_FOLD.format("x.to_text")}
  where coalesce(m1.path, m2.path, p3) is not null or not x.soft),
adj as (select src, dst from edges where not unresolved and src <> dst union select dst, src from edges where not unresolved and src <> dst)
"""

_BASEL = "lower(regexp_replace(split_part(path, '/', -1), '\\.md$', ''))"


def front_value(key: str, of: str = "front") -> str:
    return f"nullif(trim(regexp_extract({of}, '(?im)^{key}:[ \\t]*[\"'']?([^\"''\\r\\n]+)', 1)), '')"


HUB = f"(coalesce(lower({front_value('type', 'substring(front, 1, 400)')}) = 'moc', false) or {_BASEL} in ('home', 'overview', 'index') or suffix({_BASEL}, ' index') or suffix({_BASEL}, ' moc'))"
VERBATIM = "(regexp_matches(lower(path), '(^|/)raw/') or regexp_matches(lower(path), '(^|/)recovered sessions/'))"
FOLDER = "case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end"

#: Content dates by name, front matter, folder.
_MON = "case when lower({0}) in (" + _q(tx.MONTHS) + ") then list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substring({0}, 1, 3))) end"


def _dmy(e: str, pattern: str = "([0-9]{1,2})\\s+([A-Za-z]+)\\s+(20[0-9]{2})") -> str:
    part = lambda i: f"regexp_extract({e}, '{pattern}', {i})"
    return f"try_cast({part(3)} || '-' || lpad(({_MON.format(part(2))})::varchar, 2, '0') || '-' || lpad({part(1)}, 2, '0') as date)"


def parse_date(e: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract({e}, '^(20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') as date), case when regexp_matches({e}, '^[0-9]{{1,2}}\\s+[A-Za-z]+\\s+20[0-9]{{2}}') then {_dmy(e)} end)"


DATES = CORPUS + f""",
dd as (select note_id, path, mtime, coalesce(
  list_filter(list_transform(regexp_extract_all(split_part(path, '/', -1), '\\b[0-9]{{1,2}}\\s+[A-Za-z]+\\s+20[0-9]{{2}}\\b'), lambda s: {_dmy("s")}), lambda d: d is not null)[1],
  list_filter(list_transform(regexp_extract_all(split_part(path, '/', -1), '\\b20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}\\b'), lambda s: try_cast(s as date)), lambda d: d is not null)[1]) nd,
  coalesce({", ".join(parse_date(front_value(k)) for k in ("updated", "date", "created"))}) fd,
  try_cast(nullif(regexp_extract(path, '/(20[0-9]{{2}})/([0-9]{{2}})\\s+[A-Za-z]{{3}}/', 1), '') || '-' || regexp_extract(path, '/(20[0-9]{{2}})/([0-9]{{2}})\\s+[A-Za-z]{{3}}/', 2) || '-01' as date) pd from c),
dates as (select note_id, path, coalesce(nd, fd, pd, mtime::date) date, case when nd is not null then 'name' when fd is not null then 'front' when pd is not null then 'path' else 'mtime' end source from dd)
"""
