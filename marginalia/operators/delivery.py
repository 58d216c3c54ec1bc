"""What an answer is made of: sections, windows, evidence, budgets; and checks of the answer against its question."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as tx
from marginalia.operators import fusion, lanes
from marginalia.session import ready

# Roles of persons, and types of notes that are no persons.
ROLES = (
    "manager boss supervisor mentor wife husband spouse fiance fiancee girlfriend boyfriend mother father mom dad mum parent sister brother "
    "sibling son daughter cousin aunt uncle colleague coworker assistant secretary doctor dentist lawyer attorney accountant therapist trainer "
    "coach tutor landlord physician nanny roommate"
).split()
NO_PERSON = "partner client organization organisation company venture initiative project vendor customer supplier team product platform opportunity deliverable".split()


def densest(text: str, words: list[str], weights: list[float], span: int, marks_each: int = 60, lead: int = 200) -> str:
    """The stretch of about `span` characters with the largest weight of words (each word's first 60 places count), begun a little
    before its first mark and at the start of a line or word. A text within the span is whole."""
    if len(text) <= span:
        return text
    low, marks = text.lower(), []
    for w, k in zip(words, weights, strict=True):
        at = low.find(w) if w else -1
        for _ in range(marks_each):
            if at < 0:
                break
            marks.append((at, w, k))
            at = low.find(w, at + max(1, len(w)))
    if not marks:
        return text[:span]
    marks.sort()
    places = [m[0] for m in marks]
    best, start = -1.0, 0
    for i, (at, _, _) in enumerate(marks):
        inside = marks[i : bisect.bisect_left(places, at + span - lead)]
        mass = sum({w: k for _, w, k in inside}.values()) + 0.01 * len(inside)
        if mass > best:
            best, start = mass, at
    start = max(0, min(start - lead, len(text) - span))
    if start:
        line, space = text.find("\n", start, start + lead), text.find(" ", start, start + lead)
        start = line + 1 if line >= 0 else space + 1 if space >= 0 else start
    return text[start : start + span]


def window(text: Column, words: Column, weights: Column, span: int) -> Column:
    def run(t: pd.Series, w: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else densest(x, list(a), [float(z) for z in b], span) for x, a, b in zip(t, w, k, strict=True)], dtype=object)

    ready()
    return F.pandas_udf(run, "string")(text, words, weights)


def best_sections(q: DataFrame, pool: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """(qid, note_id, nth, score, section): the k sections of each pooled note with the largest sum of idf times occurrences up to
    three; sections over 2,000 characters are cut to their densest 1,800."""
    words = q.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("w"))
    met = pool.join(words, "qid").join(lanes.sections(corpus, pool), "note_id")  # the words travel, the texts once
    low = F.lower("section")

    def each(s: Column, x: Column) -> Column:
        n = (F.length(low) - F.length(F.replace(low, x["term"], F.lit("")))) / F.length(x["term"])
        return s + x["idf"] * F.least(n, F.lit(3.0))

    scored = met.withColumn("score", F.aggregate("w", F.lit(0.0), each)).where("score > 0")
    top = scored.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "note_id").orderBy(F.round("score", 9).desc(), "section_no"))).where(F.col("nth") <= k)
    cut = F.when(F.length("section") > 2000, window(F.col("section"), F.transform("w", lambda x: x["term"]), F.transform("w", lambda x: x["idf"]), 1800)).otherwise(F.col("section"))
    return top.select("qid", "note_id", "nth", "score", tx.cap_section(cut).alias("section"))


# What a question asks for, and the headings under which it stands.
INTENTS = (
    (r"follow|commit|next|pending|todo|action|open item|agreed", r"action|next step|open|follow|todo|commit|agreed"),
    (r"cost|price|pricing|budget|commercial|monthly|fee", r"commercial|budget|pricing|cost|p&l|deliverable"),
    (r"decision|decide|verdict|chose|why", r"decision|verdict|diagnosis|why"),
)


def best_section(q: DataFrame, pool: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, note_id, heading, section): of each pooled note the section that answers best: 4 for each unit of idf of the words in it
    and 1.5 units for each in its heading (below the top level), 4 units where the heading is what the question asks for, and
    up to 6 for words per kilobyte. The second and third best that reach 0.55 of it follow; over 3,600 characters the densest
    3,200 stay. A note under 4,000 characters is its own section."""
    words = q.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("at", "term", "idf"))).alias("w"))
    met = pool.select("qid", "note_id").join(lanes.sections(corpus, pool), "note_id").join(words, "qid")
    low, head = F.lower("section"), F.lower(F.regexp_extract("section", "^#{1,4} ([^\\n]+)", 1))
    met = met.withColumn("low", low).withColumn("head", F.when(F.col("section").startswith("# "), "").otherwise(head)).withColumn("asked", F.array_join(F.transform("w", lambda x: x["term"]), " "))
    times = lambda x: (F.length("low") - F.length(F.replace(F.col("low"), x["term"], F.lit("")))) / F.length(x["term"])
    walk = F.aggregate("w", F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("o")), lambda s, x: F.struct((s["d"] + F.when(F.contains(F.col("low"), x["term"]), x["idf"]).otherwise(0.0) + F.when(F.contains(F.col("head"), x["term"]), 1.5).otherwise(0.0)).alias("d"), (s["o"] + times(x)).alias("o")))
    intent = F.lit(0.0)
    for ask, here in INTENTS:
        intent = F.when(F.col("asked").rlike(ask) & F.col("head").rlike(here), 4.0).otherwise(intent)
    score = 4 * (F.col("x.d") + intent) + F.least(F.col("x.o") / F.greatest(F.length("section") / 1024, F.lit(0.3)), F.lit(6.0))
    rated = met.withColumn("x", walk).withColumn("score", score)
    w = Window.partitionBy("qid", "note_id")
    top = rated.withColumn("nth", F.row_number().over(w.orderBy(F.round("score", 9).desc(), "section_no"))).where("nth <= 3").withColumn("best", F.max("score").over(w)).where((F.col("nth") == 1) | (F.col("score") >= 0.55 * F.col("best")))
    joined = top.groupBy("qid", "note_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "section"))), lambda x: x["section"]), "\n\n").alias("s"), F.first("w").alias("w"))
    cut = F.when(F.length("s") > 3600, window(F.col("s"), F.transform("w", lambda x: x["term"]), F.transform("w", lambda x: x["idf"]), 3200)).otherwise(F.col("s"))
    return joined.select("qid", "note_id", F.nullif(F.regexp_extract("s", "^#{1,4} ([^\\n]+)", 1), F.lit("")).alias("heading"), tx.cap_section(F.trim(cut)).alias("section"))


def guidance(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, anchor, advice): for questions that ask to build something, the first answer and how to go on from it."""
    asked = questions.where(tx.is_build(F.col("question"))).select("qid")
    return asked.join(answers.where("rank = 1").select("qid", F.col("path").alias("anchor")), "qid").withColumn("advice", F.lit("Read the anchor and the notes around it in full before you write; name what they leave open."))


def reusable_vectors(passages: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, missing): passages (note_id, nth, passage) with the vector an earlier build has for the same text, and those to be
    embedded now. old: (hash, vec), the hash being content_hash of the passage; equal texts share a vector."""
    p = passages.withColumn("hash", tx.content_hash(F.col("passage")))
    known = old.where("vec is not null").groupBy("hash").agg(F.first("vec").alias("vec"))
    return p.join(known, "hash"), p.join(known.select("hash"), "hash", "left_anti")


def deliver(answers: DataFrame, sections: DataFrame, results: int = 5, chars: int = 14_000) -> DataFrame:
    """(qid, rank, nth, note_id, section): the sections of the first results in order until the characters are spent."""
    x = answers.where(F.col("rank") <= results).select("qid", "note_id", "rank").join(sections, ["qid", "note_id"]).withColumn("order", F.struct("rank", "nth"))
    return fusion.budget(x, chars, order="order").select("qid", "rank", "nth", "note_id", "section")


def evidence(q: DataFrame, answers: DataFrame, corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, note_id, term, place): where an answer has each word of its question: filename, heading, path or body."""
    a = answers.select("qid", "note_id").join(q.select("qid", "term"), "qid").join(corpus.select("note_id", F.lower("title").alias("base"), F.lower("path").alias("low")), "note_id")
    x = a.join(terms.select("note_id", "term", "tf_head", "tf_body"), ["note_id", "term"], "left")
    place = F.when(F.contains("base", "term"), "filename").when(F.col("tf_head") > 0, "heading").when(F.contains("low", "term"), "path").when(F.col("tf_body") > 0, "body")
    return x.select("qid", "note_id", "term", place.alias("place")).where("place is not null")


def pointers(sections: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, note_id, target): where a section under 500 characters points on by its first link that resolves; names: (name, path)."""
    s = sections.where(F.length("section") < 500).select("qid", "note_id", F.posexplode(tx.wikilinks(F.col("section"))).alias("at", "link"))
    hit = s.join(names, F.lower(F.trim("link")) == F.col("name"))
    return hit.groupBy("qid", "note_id").agg(F.min(F.struct("at", "path")).alias("x")).select("qid", "note_id", F.col("x.path").alias("target"))


def asks_for_person(question: Column) -> Column:
    """Whether a question asks who has a person's role: any word of the role, singular or plural."""
    words = F.split(tx.relationship_role(question), r"[\s'-]+")
    return F.coalesce(F.exists(words, lambda w: w.isin(ROLES) | F.regexp_replace(w, "es$", "").isin(ROLES) | F.regexp_replace(w, "s$", "").isin(ROLES)), F.lit(False))


def relationship_check(questions: DataFrame, answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, honest): false where a question asks for a person and the first answer is of a type that is none. Notes under People/,
    of type person, of another type or without one are let through; so is a question without an answer."""
    asked = questions.where(asks_for_person(F.col("question"))).select("qid")
    kind = F.lower(F.regexp_extract("front", r"(?i)(?:^|\n)type:\s*['\"]?([a-z][a-z-]*)", 1))
    top = answers.where("rank = 1").select("qid", "note_id").join(corpus.select("note_id", "path", kind.alias("type")), "note_id")
    wrong = ~F.col("path").rlike("(?i)(^|/)People/") & F.col("type").isin(NO_PERSON)
    return asked.join(top, "qid", "left").select("qid", (~F.coalesce(wrong, F.lit(False))).alias("honest"))


def sibling_clarify(q: DataFrame, known: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, series, n, options): known items that would be pinned, without a date in the question, of whose first four all, two or
    more, differ in nothing but their date."""
    dated = q.where(tx.is_dateish(F.col("term"))).select("qid").distinct()
    pinned = fusion.known_pins(known).select("qid")
    k = known.where("nth <= 4").join(pinned, "qid", "left_semi").join(dated, "qid", "left_anti").join(corpus.select("note_id", tx.date_key(F.col("path")).alias("series")), "note_id")
    by = k.groupBy("qid").agg(F.count("*").alias("n"), F.collect_set("series").alias("keys"), F.sort_array(F.collect_list(F.struct("nth", "note_id"))).alias("o"))
    return by.where((F.col("n") >= 2) & (F.size("keys") == 1)).select("qid", F.get("keys", F.lit(0)).alias("series"), "n", F.transform("o", lambda x: x["note_id"]).alias("options"))


def confirmed(answers: DataFrame, near: DataFrame, chunks: DataFrame, corpus: DataFrame, first: int = 3) -> DataFrame:
    """(qid): questions whose first answer is among the first three of the semantic lane, by vectors of the note as it is now: its
    chunks' hash is the note's, or none is recorded."""
    top = answers.where("rank = 1").select("qid", "note_id").join(near.where(F.col("rank") <= first).select("qid", "note_id"), ["qid", "note_id"])
    if "note_hash" not in chunks.columns:
        return top.select("qid").distinct()
    now = corpus.select("note_id", tx.content_hash(F.col("raw")).alias("now"))
    fresh = chunks.select("note_id", "note_hash").join(top.select("note_id").distinct(), "note_id", "left_semi").join(now, "note_id").where(F.col("note_hash").isNull() | (F.col("note_hash") == F.col("now"))).select("note_id").distinct()
    return top.join(fresh, "note_id", "left_semi").select("qid").distinct()


def pair_pins(q: DataFrame, postings: DataFrame, terms: DataFrame, priors: DataFrame) -> DataFrame:
    """Pins for notes that hold all of the two or three longer words of a question with fewer than two rare ones, where one to six do:
    the two with most of them in their title, at slots 3 and 4."""
    words = q.where((F.col("df") > 0) & (F.length("term") >= 4) & (F.instr("term", " ") == 0) & ~tx.is_dateish(F.col("term")))
    few = words.groupBy("qid").agg(F.count("*").alias("k"), F.sum((F.col("df") <= 25).cast("int")).alias("rare")).where("k between 2 and 3 and rare < 2").select("qid", "k")
    t = terms.where("tf_title > 0").select("note_id", "term", F.lit(1).alias("t"))
    got = words.join(few.select("qid"), "qid", "left_semi").select("qid", "term").join(postings.select("note_id", "term"), "term").join(t, ["note_id", "term"], "left").groupBy("qid", "note_id").agg(F.count("*").alias("k"), F.count("t").alias("titles")).join(few, ["qid", "k"])
    got = got.withColumn("all", F.count("*").over(Window.partitionBy("qid"))).where("all <= 6").join(priors, "note_id")
    return got.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("titles"), F.desc("prior"), "note_id"))).where("nth <= 2").select("qid", "note_id", F.lit(9).alias("stage"), (F.col("nth") + 2).alias("slot"), F.lit(3).alias("unless"))


def category_pins(q: DataFrame, temporal: DataFrame, corpus: DataFrame, dates: DataFrame) -> DataFrame:
    """Pins for temporal questions that name a folder (plural or not) of at least two notes: the two freshest of the smallest such
    folder, at slots 3 and 4 unless they are among the first five. temporal: (qid)."""
    fold = lambda c: F.regexp_replace(c, "(?<=[a-z]{3})s$", "")
    words = q.join(temporal.select("qid"), "qid", "left_semi").select("qid", fold(F.col("term")).alias("w"))
    inside = corpus.select("note_id", F.explode(F.array_distinct(F.filter(F.split(F.lower(tx.folder(F.col("path"))), "[/ _-]+"), lambda s: F.length(s) >= 3))).alias("s")).select("note_id", fold(F.col("s")).alias("w")).distinct()
    size = inside.groupBy("w").agg(F.count("*").alias("n")).where("n >= 2")
    best = words.join(size, "w").groupBy("qid").agg(F.min(F.struct("n", "w")).alias("x")).select("qid", "x.w")
    fresh = best.join(inside, "w").join(dates, "note_id").withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("date"), "note_id"))).where("nth <= 2")
    return fresh.select("qid", "note_id", F.lit(10).alias("stage"), (F.col("nth") + 2).alias("slot"), F.lit(5).alias("unless"))


def entity_pins(entity_lane: DataFrame) -> DataFrame:
    """Pins for the best entity of each question: slot 5 unless among the first five."""
    return lanes.ranked(entity_lane, 1).select("qid", "note_id", F.lit(12).alias("stage"), F.lit(5).alias("slot"), F.lit(5).alias("unless"))


def chunks_of(body: str, small: int = 3000, most: int = 1400, least: int | None = 80, cap: int | None = 40) -> list[tuple[str, str]]:
    """(heading, text) chunks for embedding: a small body's paragraphs packed up to 1,400 characters; a larger one by its headings,
    parts of at most 80 characters dropped, long parts in windows, at most `cap`."""

    def windows(text: str) -> list[str]:
        out, own = [], ""
        for p in re.split(r"\n\s*\n", text):
            p = p.strip()
            if own and len(own) + 2 + len(p) > most:
                out.append(own)
                own = ""
            own = f"{own}\n\n{p}" if own and p else own or p
            while len(own) > most:
                out.append(own[:most])
                own = own[most:]
        return [w for w in [*out, own] if w.strip()]

    if len(body) < small:
        return [("", w) for w in windows(body)]
    out = []
    for part in re.split(r"(?m)^(?=#{1,4} )", body):
        if len(part.strip()) > (least or 0):
            head = re.match(r"#{1,4} +([^\n]+)", part)
            out += [(head[1].strip() if head else "", w) for w in windows(part)]
    return out[:cap]


def embedding_chunks(corpus: DataFrame, cap: int | None = 40, least: int | None = 80) -> DataFrame:
    """(note_id, path, nth, heading, passage): each note's chunks with the line that goes before them for an embedding.

    The definition takes the first 40 chunks of a large note and drops parts of up to 80 characters; None takes all."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: [{"heading": h, "text": t} for h, t in chunks_of(b, cap=cap, least=least)])

    ready()
    c = corpus.select("note_id", "path", "title", F.posexplode(F.pandas_udf(run, "array<struct<heading:string,text:string>>")(F.col("body"))).alias("nth", "x"))
    prefix = F.substring(F.trim(F.concat_ws(" ", "title", "x.heading")), 1, 120)
    return c.select("note_id", "path", "nth", "x.heading", F.concat(prefix, F.lit("\n"), F.col("x.text")).alias("passage"))


def suggested_questions(degrees: DataFrame, recent: DataFrame, entities: DataFrame, most: int = 4) -> DataFrame:
    """(question): up to four, from the entities with most links that were touched lately."""
    e = entities.groupBy("path").agg(F.min("name").alias("name")).join(recent.select("path").distinct(), "path", "left_semi").join(degrees, "path")
    return e.orderBy(F.desc("links"), "name", "path").limit(most).select(F.concat(F.lit("What do we know about "), "name", F.lit("?")).alias("question"))
