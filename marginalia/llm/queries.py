"""The subpackage's registered queries and their SQL, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, languages, mixing, name_variants, near_duplicates, neighbours, splitting, truncation


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _languages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs, notes, codes = (_t(spark, sf, x) for x in ("documents", "notes", "lang_codes"))
    of_docs = languages.label_code(F.col("lang"), codes)
    of_notes = languages.label_code(languages.front_matter_label(F.col("frontmatter")), codes)
    rows = languages.sample(docs, "doc_id", "text", of_docs, languages.SAMPLE_ROWS) + languages.sample(notes, "note_id", "body", of_notes, languages.SAMPLE_ROWS)
    model = languages.fit(rows, sorted(r.code for r in codes.select("code").distinct().collect()))
    return languages.languages(notes, "note_id", "body", model, [of_notes]), languages.languages(docs, "doc_id", "text", model, [of_docs])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    notes, docs = _languages(spark, sf)
    both = languages.cases(notes).withColumn("tbl", F.lit("notes")).unionByName(languages.cases(docs).withColumn("tbl", F.lit("documents")))
    return both.select("tbl", "rec_id", "para_no", "lang")


def p1_languages(spark: SparkSession, sf: str) -> DataFrame:
    notes, docs = _languages(spark, sf)
    tagged = notes.withColumn("tbl", F.lit("notes")).unionByName(docs.withColumn("tbl", F.lit("documents")))
    return tagged.dropDuplicates(["tbl", "rec_id", "para_no"]).select("tbl", "rec_id", "para_no", "label", "lang", "confidence", "letters", "sentences")


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_t(spark, sf, "note_chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(p2_neighbours(spark, sf)).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(_t(spark, sf, "notes")).select(F.col("a").alias("note_a"), F.col("b").alias("note_b"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.groups(_t(spark, sf, "notes"), t=0.5)  # the similarity of p3_found


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.entities(_t(spark, sf, "entity_names"), _t(spark, sf, "nicknames"), _t(spark, sf, "notes").select("path", "aliases"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.variant_pairs(_entities(spark, sf), names=_t(spark, sf, "entity_names"))


def p4_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _entities(spark, sf)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_sections(_t(spark, sf, "notes")).select("note_id", "section_no").distinct()


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_sections(_t(spark, sf, "notes"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(_t(spark, sf, "documents"))


def _stock(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, targets = _t(spark, sf, "documents"), _t(spark, sf, "mix_targets")
    return docs, targets, mixing.stock(docs, targets, "doc_id", "text", truncation.normal_source(F.col("source")))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs, targets, have = _stock(spark, sf)
    return mixing.mix(docs, targets, stocked=have)


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    docs, targets, have = _stock(spark, sf)
    return mixing.shares(mixing.mix(docs, targets, stocked=have), targets, have)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_t(spark, sf, "documents")).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(truncation.truncated(_t(spark, sf, "documents")))


def p9_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_reasons(truncation.truncated(_t(spark, sf, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_languages, p2_found, p2_neighbours, p3_found, p3_groups, p4_found, p4_entities, p6_found, p6_pieces, p7_ids, p8_mix, p8_shares, p9_found, p9_rates, p9_reasons)
}

_COSINES = """
with v as (select chunk_id, any_value(vec)::double[] v from note_chunks where chunk_id is not null and len(vec) = 96 group by chunk_id),
u as (select chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from v where list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x)))),
w as (select chunk_id, list_transform(v, lambda x: x / n) v from u where n > 0),
s as (select a.chunk_id a, b.chunk_id b, round(list_inner_product(a.v, b.v), 9) cos from w a join w b on a.chunk_id <> b.chunk_id),
r as (select a, b, cos, row_number() over (partition by a order by cos desc, b) rank from s where cos >= 0.8)
"""

_SHINGLES = """
with n as (select note_id, any_value(body) body from notes where note_id is not null group by note_id),
w as (select note_id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') w from n where body is not null),
s as (select distinct note_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) s from w where len(w) >= 5),
k as (select note_id, count(*) k from s group by note_id),
p as (select x.note_id a, y.note_id b, count(*) o from s x join s y using (s) where x.note_id < y.note_id group by all)
"""

_SECTIONS = """
with recursive n as (select note_id, any_value(body) body from notes where note_id is not null group by note_id),
l as (select note_id, string_split(body, chr(10)) l from n where length(body) > 1400),
st(note_id, i, fence, section) as (
  select note_id, 0, '', 0 from l
  union all
  select st.note_id, i + 1,
    case when fence <> '' then (case when left(l[i + 1], 3) = fence then '' else fence end) when left(l[i + 1], 3) in ('```', '~~~') then left(l[i + 1], 3) else '' end,
    case when fence = '' and left(l[i + 1], 3) not in ('```', '~~~') and regexp_matches(l[i + 1], '^#{1,4} ') then section + 1 else section end
  from st join l using (note_id) where i < len(l)),
t as (select st.note_id, section, string_agg(l[i], chr(10) order by i) s from st join l using (note_id) where i > 0 group by all)
"""

#: What SQL can say about whole tables; the others are held against brute force in tests/llm.
SQL: dict[str, str] = {
    "p2_found": _COSINES + "select distinct least(a, b) chunk_a, greatest(a, b) chunk_b from r where rank <= 5",
    "p3_found": _SHINGLES + "select a note_a, b note_b from p join k ka on ka.note_id = a join k kb on kb.note_id = b where o / (ka.k + kb.k - o) >= 0.5",
    "p6_found": _SECTIONS + "select note_id, section::bigint section_no from t where length(regexp_replace(s, '\\s+$', '')) > 1400",
}
