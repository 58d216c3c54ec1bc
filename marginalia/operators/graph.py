"""The typed link graph of a corpus: extraction, resolution, neighbourhoods and relatedness, as joins of edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as tx

#: Front-matter keys that make edges, and their types.
FRONT_EDGES = {"related": "related_to", "source": "sourced_from", "area": "in_area", "creator": "by_creator", "platform": "on_platform"}


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def _separated(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_key(c), r"\\+$", ""), "[-_]+", " "), r"\s+", " "))


def candidates(corpus: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(src, to_text, rel, source, soft): links of a note before resolution, each target once per type. Front-matter values are
    soft unless written as [[link]], and so are names (path, name) that were found in notes by other means."""
    body = corpus.select(F.col("path").alias("src"), F.explode(tx.wikilinks(F.col("body"))).alias("to_text"), F.lit("mentions").alias("rel"), F.lit("wikilink").alias("source"), F.lit(False).alias("soft"))

    def values(key: str) -> Column:
        flow = F.regexp_extract("front", rf"(?im)^{key}:[ \t]*\[([^\]\r\n\[]*)\]", 1)
        one = tx.front_value(F.col("front"), key)
        return F.when(flow != "", F.transform(F.split(flow, ","), lambda t: F.trim(t))).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))

    def typed(key: str, rel: str) -> Column:
        return F.transform(values(key), lambda v: F.struct(v.alias("raw"), F.lit(rel).alias("rel")))

    every = F.flatten(F.array(*[typed(k, rel) for k, rel in FRONT_EDGES.items()]))
    front = corpus.where("front is not null").select(F.col("path").alias("src"), F.explode(every).alias("x")).select("src", "x.*")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", "^[\"']?\\[\\[|^[\"']", ""), "\\]\\][\"']?$|[\"']$", ""), "[|#].*$", ""))
    front = front.select("src", bare.alias("to_text"), "rel", F.lit("frontmatter").alias("source"), (~F.col("raw").rlike(r"^[\"']?\[\[.*\]\][\"']?$")).alias("soft")).where("to_text != ''")
    both = body.unionByName(front)
    if named is not None:
        both = both.unionByName(named.where("path is not null and trim(name) != ''").select(F.col("path").alias("src"), F.trim("name").alias("to_text"), F.lit("named").alias("rel"), F.lit("mention").alias("source"), F.lit(True).alias("soft")))
    first = both.groupBy("src", "rel", F.lower("to_text").alias("k")).agg(F.min(F.struct("to_text", "source", "soft")).alias("x"))
    return first.select("src", "x.to_text", "rel", "x.source", "x.soft")


def names(corpus: DataFrame) -> DataFrame:
    """(name, path): basename and aliases of each note, trimmed and in lower case."""
    each = corpus.select(F.explode(F.concat(F.array("title"), "aliases")).alias("n"), "path")
    return each.select(_key(F.col("n")).alias("name"), "path").where("name != ''").distinct()


def name_map(corpus: DataFrame) -> DataFrame:
    """(name, path): which note a name means: the shallowest that claims it, then the first path; whole paths mean themselves."""
    claim = names(corpus).select("name", "path", F.lit(0).alias("weak"))
    low = F.lower("path")
    whole = corpus.select(low.alias("name"), "path", F.lit(1).alias("weak")).unionByName(corpus.select(F.regexp_replace(low, r"\.md$", "").alias("name"), "path", F.lit(1).alias("weak")))
    return claim.unionByName(whole).groupBy("name").agg(F.min(F.struct("weak", tx.depth(F.col("path")).alias("d"), "path")).alias("x")).select("name", "x.path")


def collisions(corpus: DataFrame) -> DataFrame:
    """(name, paths): names that several notes claim, their paths shallowest first."""
    got = names(corpus).groupBy("name").agg(F.sort_array(F.collect_set(F.struct(tx.depth(F.col("path")).alias("d"), "path"))).alias("x")).where(F.size("x") > 1)
    return got.select("name", F.transform("x", lambda y: y["path"]).alias("paths"))


def resolve(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """(src, dst, rel, source, unresolved): a link's target by its exact name, without .md, or with separators folded where one
    note alone has that name. Strict links that resolve to nothing stay and are flagged, soft ones are labels and go."""
    exact = name_map(corpus)
    owners = names(corpus).select(_separated(F.col("name")).alias("folded"), "path").distinct().groupBy("folded").agg(F.count("*").alias("k"), F.min("path").alias("p3")).where("k = 1 and folded != ''").select("folded", "p3")
    c = candidates.withColumn("k1", _key(F.col("to_text"))).withColumn("k2", F.regexp_replace("k1", r"\.md$", "")).withColumn("folded", _separated(F.col("to_text")))
    x = c.join(exact.select(F.col("name").alias("k1"), F.col("path").alias("p1")), "k1", "left").join(exact.select(F.col("name").alias("k2"), F.col("path").alias("p2")), "k2", "left").join(owners, "folded", "left")
    dst = F.coalesce("p1", "p2", "p3")
    return x.where(dst.isNotNull() | ~F.col("soft")).select("src", F.coalesce(dst, F.col("to_text")).alias("dst"), "rel", "source", dst.isNull().alias("unresolved"))


def build(corpus: DataFrame, named: DataFrame | None = None) -> DataFrame:
    return resolve(candidates(corpus, named), corpus)


def rebuild(old_edges: DataFrame, old_notes: DataFrame, corpus: DataFrame, named: DataFrame | None = None, unreadable: DataFrame | None = None) -> DataFrame:
    """Edges after a change: links are extracted again only from notes whose hash is new or changed; the links of the others
    are taken from old_edges and resolved again, so that a target that came or went shows. old_notes: (path, hash).
    Notes that could not be read this time (unreadable: path) keep the edges they had."""
    now = corpus.withColumn("hash", tx.content_hash(F.col("raw")))
    same = now.join(old_notes, ["path", "hash"], "left_semi").select("path")
    fresh = candidates(now.join(same, "path", "left_anti"), None if named is None else named.join(same, "path", "left_anti"))
    kept = old_edges.join(same.withColumnRenamed("path", "src"), "src", "left_semi").select("src", F.col("dst").alias("to_text"), "rel", "source", (~F.col("unresolved") & (F.col("source") != "wikilink")).alias("soft"))
    out = resolve(fresh.unionByName(kept), corpus)
    if unreadable is None:
        return out
    lost = unreadable.select(F.col("path").alias("src")).distinct()
    return out.join(lost, "src", "left_anti").unionByName(old_edges.select(out.columns).join(lost, "src", "left_semi"))


def backlinks(edges: DataFrame) -> DataFrame:
    """(path, backlinks): resolved edges that point at a note, each counting."""
    return edges.where("not unresolved").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("backlinks"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways over resolved edges between two notes, each pair once."""
    e = edges.where("not unresolved and src != dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbourhood(seeds: DataFrame, adjacency: DataFrame, hops: int = 3, cap: int | None = 15) -> DataFrame:
    """(qid, path, hops): the notes within a few links of each question's seeds (qid, path), nearest first, at most `cap`, which
    is the size of an answer's context."""
    front = seeds.select("qid", "path").distinct()
    seen = front.withColumn("hops", F.lit(0))
    for h in range(1, hops + 1):
        front = front.join(adjacency, F.col("path") == F.col("src")).select("qid", F.col("dst").alias("path")).distinct().join(seen, ["qid", "path"], "left_anti")
        seen = seen.unionByName(front.withColumn("hops", F.lit(h)))
    out = seen.where("hops > 0")
    if cap is None:
        return out
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("hops", "path"))).where(F.col("nth") <= cap).drop("nth")


def link_relatedness(adjacency: DataFrame, most_degree: int = 150) -> DataFrame:
    """(a, b, score): half the Adamic-Adar index through neighbours of at most 150 links, and three times Jaccard, a < b.

    The guard is what the measure is defined with: a hub says nothing about two notes it lists; it also bounds each note's
    part in the self-join."""
    deg = adjacency.groupBy("src").agg(F.count("*").alias("deg"))
    via = adjacency.join(deg.where(F.col("deg") <= most_degree).select(F.col("src").alias("dst"), F.col("deg").alias("d")), "dst").select(F.col("dst").alias("v"), "d", "src")
    pairs = via.alias("x").join(via.select(F.col("v"), F.col("src").alias("other")).alias("y"), "v").where("src < other")
    got = pairs.groupBy(F.col("src").alias("a"), F.col("other").alias("b")).agg(F.sum(1 / F.ln(F.greatest(F.col("d"), F.lit(2)))).alias("aa"), F.count("*").alias("common"))
    got = got.join(deg.select(F.col("src").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("src").alias("b"), F.col("deg").alias("db")), "b")
    return got.select("a", "b", (0.5 * F.col("aa") + 3 * F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("score"))


def top_terms(postings: DataFrame, doc_freq: DataFrame, n_notes: DataFrame, top: int = 15) -> DataFrame:
    """(note_id, term, weight, nth): the 15 terms of each note with the largest (1 + ln tf) ln(N / df), of terms of three letters
    and more in at most a fifth of the notes."""
    x = postings.join(doc_freq, "term").join(F.broadcast(n_notes.select(F.col("n").alias("nn")))).where((F.length("term") >= 3) & (F.col("df") <= 0.2 * F.col("nn")))
    w = (1 + F.ln(F.col("tf").cast("double"))) * F.ln(F.col("nn") / F.col("df"))
    order = Window.partitionBy("note_id").orderBy(F.round("weight", 9).desc(), "term")
    return x.select("note_id", "term", w.alias("weight")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)


def text_relatedness(top_terms: DataFrame, most_notes: int = 100) -> DataFrame:
    """(a, b, score): the dot product over top terms that at most 100 notes share, a < b."""
    shared = top_terms.groupBy("term").agg(F.count("*").alias("k")).where(F.col("k").between(2, most_notes)).select("term")
    t = top_terms.join(shared, "term").select("term", "note_id", "weight")
    pairs = t.join(t.select("term", F.col("note_id").alias("other"), F.col("weight").alias("w2")), "term").where("note_id < other")
    return pairs.groupBy(F.col("note_id").alias("a"), F.col("other").alias("b")).agg(F.sum(F.col("weight") * F.col("w2")).alias("score"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def fuse_relatedness(by_link: DataFrame, by_text: DataFrame, top: int = 8, depth: int = 25, k: int = 60) -> DataFrame:
    """(a, b, score, via, nth): reciprocal-rank fusion of each note's best 25 by either measure; via tells which."""
    parts = None
    for via, pairs in (("links", by_link), ("text", by_text)):
        w = Window.partitionBy("a").orderBy(F.round("score", 9).desc(), "b")
        p = both_ways(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth).select("a", "b", "rank", F.lit(via).alias("via"))
        parts = p if parts is None else parts.unionByName(p)
    got = parts.groupBy("a", "b").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.when(F.count("*") == 2, "both").otherwise(F.min("via")).alias("via"))
    w = Window.partitionBy("a").orderBy(F.round("score", 12).desc(), "b")
    return got.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top)


def repoint(corpus: DataFrame, moved: DataFrame) -> DataFrame:
    """(path, body): bodies with links to moved notes under their new name; moved: (old, new) paths. Only names that one note
    alone has are rewritten, and only notes that link them are returned."""
    sole = names(corpus).groupBy("name").agg(F.count("*").alias("k")).where("k = 1").select("name")
    m = moved.select(_key(tx.basename(F.col("old"))).alias("name"), tx.basename(F.col("new")).alias("to")).join(sole, "name", "left_semi")
    links = corpus.select("path", F.explode(F.array_distinct(tx.wikilinks(F.col("body")))).alias("link")).withColumn("name", _key(F.col("link"))).join(m, "name").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("link", "to"))).alias("moves"))
    swap = lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"\[\[\s*\Q"), x["link"], F.lit(r"\E\s*(?=[|#\]])")), F.concat(F.lit("[["), F.regexp_replace(x["to"], r"([\\$])", r"\\$1")))
    return corpus.join(links, "path").select("path", F.aggregate("moves", F.col("body"), swap).alias("body"))
