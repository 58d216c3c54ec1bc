"""Index tables of a corpus: terms by field, statistics, vocabulary.

A note is one row when its terms are counted, in the task that has it, so that building the index adds no shuffle of its own;
document frequencies are one map-side combined aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import RANKING
from marginalia.functions import text as tx
from marginalia.session import ready

LONG = 24  # letters of a word whose delete-one forms are written out


def fields(corpus: DataFrame) -> DataFrame:
    """(note_id, path, title array, head array, body array): the tokens of each field; body is the whole raw text."""
    title = F.concat(tx.tokens(F.col("title")), F.flatten(F.transform("aliases", tx.tokens)))
    head = F.flatten(F.transform(tx.headings(F.col("body")), tx.tokens))
    return corpus.select("note_id", "path", title.alias("title"), head.alias("head"), tx.tokens(F.col("raw")).alias("body"))


def terms(fields: DataFrame, cap: int = RANKING.position_cap) -> DataFrame:
    """(note_id, term, tf_title, tf_head, tf_body, first_pos, positions): a row per note and term over all fields, with the sorted
    places in the body, at most `cap` of them; tf_body above cap tells that there are more. fields holds a row a note: its
    terms are counted where the row lies, and no token travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = [part.column(c) for c in ("title", "head", "body")]
                sizes = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in lists]
                words = pa.chunked_array([c.flatten() for c in lists]).combine_chunks().dictionary_encode()
                if not len(words):
                    continue
                note = np.concatenate([np.repeat(np.arange(part.num_rows), n) for n in sizes])
                place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
                field = np.repeat(np.arange(3), [n.sum() for n in sizes])
                key = note * len(words.dictionary) + words.indices.to_numpy()
                order = np.argsort(key, kind="stable")  # within a term by field and place
                key, field, place = key[order], field[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                tf = [np.add.reduceat((field == k).astype(np.int64), first) for k in range(3)]
                body = first + tf[0] + tf[1]  # where a term's places in the body begin
                kept = np.minimum(tf[2], cap)
                ends = np.concatenate([[0], np.cumsum(kept)])
                at = np.repeat(body - ends[:-1], kept) + np.arange(ends[-1])
                head = place[np.minimum(body, len(place) - 1)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("note_id").take(pa.array(key[first] // len(words.dictionary))), words.dictionary.take(pa.array(key[first] % len(words.dictionary))), *map(pa.array, tf),
                    pa.array(head, mask=tf[2] == 0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[at], pa.int32())),
                ], names=["note_id", "term", "tf_title", "tf_head", "tf_body", "first_pos", "positions"])

    ready()
    kind = fields.schema["note_id"].dataType.simpleString()
    return fields.select("note_id", "title", "head", "body").mapInArrow(run, f"note_id {kind}, term string, tf_title long, tf_head long, tf_body long, first_pos int, positions array<int>")


def postings(fields: DataFrame) -> DataFrame:
    """(note_id, term, tf): the inverted index over the raw text."""
    return fields.select("note_id", F.explode("body").alias("term")).groupBy("note_id", "term").agg(F.count("*").alias("tf"))


def doc_freq(terms: DataFrame) -> DataFrame:
    """(term, df): in how many notes a term stands, in any field."""
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def lengths(fields: DataFrame) -> DataFrame:
    return fields.select("note_id", F.size("title").cast("long").alias("title_len"), F.size("head").cast("long").alias("head_len"), F.size("body").cast("long").alias("body_len"))


def stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avg_title, avg_head, avg_body); averages of 0 are 1."""
    avg = lambda c: F.coalesce(F.when(F.avg(c) > 0, F.avg(c)), F.lit(1.0))
    return lengths.agg(F.count("*").alias("n"), avg("title_len").alias("avg_title"), avg("head_len").alias("avg_head"), avg("body_len").alias("avg_body"))


def idf_clamped(n: Column, df: Column) -> Column:
    """log2(n / df) / 3 between 0.5 and 3; a term of no note counts as one of one."""
    return F.greatest(F.least(F.log2(n / F.greatest(df, F.lit(1))) / 3, F.lit(3.0)), F.lit(0.5))


def idf_bm25(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, term, n, at): each term of a question, how often and first where it stands."""
    q = questions.select("qid", F.posexplode(tx.tokens(F.col("question"))).alias("at", "term"))
    return q.groupBy("qid", "term").agg(F.count("*").alias("n"), F.min("at").alias("at"))


def _single(terms: DataFrame) -> DataFrame:
    """Of terms, the single words of at least four letters."""
    return terms.where((F.length("term") >= 4) & (F.instr("term", " ") == 0))


def vocabulary(doc_freq: DataFrame) -> DataFrame:
    """(term, df, trigrams, deletes) of single words of at least four letters; deletes of words up to 24 letters."""
    none = F.array().cast("array<string>")
    return _single(doc_freq).select("term", "df", tx.trigrams(F.col("term")).alias("trigrams"), F.when(F.length("term") <= 24, F.array_distinct(tx.deletes1(F.col("term")))).otherwise(none).alias("deletes"))


def words(corpus: DataFrame) -> DataFrame:
    """(term): the words of vocabulary() straight from the texts: no table of terms by note is built for them, and each task
    sends a word once. Repeated rows of a note add nothing."""
    return _single(fields(corpus).select(F.explode(F.array_distinct(F.concat("title", "head", "body"))).alias("term"))).distinct()


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(term, other), term < other: the distinct words (term) one edit apart, whatever their letters and however rare.

    A word of up to LONG letters goes to each of its delete-one forms k with the letter c taken out and its place i, of a run of
    equal letters the first; and to itself, at place 0. Which words at k are one edit apart follows from places and letters
    alone, and each pair comes from one k only: so no distance is computed and nothing is made distinct. Neither side is
    broadcast, as what unfolds here is many times the size that a plan takes it for. Longer words, whose forms would hold the
    square of their letters, go by hashes of the forms."""
    w = F.col("term")
    first = F.filter(F.sequence(F.lit(1), F.length(w)), lambda i: (i == 1) | (w.substr(i - 1, F.lit(1)) != w.substr(i, F.lit(1))))
    less = F.transform(first, lambda i: F.struct(F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))).alias("k"), i.alias("i"), w.substr(i, F.lit(1)).alias("c")))
    own = F.array(F.struct(w.alias("k"), F.lit(0).alias("i"), F.lit("").alias("c")))
    d = words.where(F.length("term").between(1, LONG)).select(F.inline(F.concat(own, less)))
    k, i, c, j, e = (F.col(x) for x in ("a.k", "a.i", "a.c", "b.i", "b.c"))
    run = lambda n: k.substr(i, n) == F.repeat(c, n)  # noqa: E731  # c may as well have been taken out n places later
    between = k.substr(j - 1, F.lit(1))
    # a letter more (i = 0), another letter at one place, or c and the letter it passed: that pair also meets with the other one taken out
    near = (i == 0) | (i == j) | run(j - i) | ((c == e) & (c < between) & run(j - 1 - i))
    pairs = d.alias("a").hint("merge").join(d.alias("b").hint("merge"), (k == F.col("b.k")) & ((i < j) | ((i == j) & (c < e))) & near)
    whole = lambda i, c: F.when(i == 0, k).otherwise(F.concat(k.substr(F.lit(1), i - 1), c, k.substr(i, F.length(k))))
    return _ordered(pairs.select(whole(i, c).alias("x"), whole(j, e).alias("y"))).unionByName(_long_pairs(words))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("term"), F.greatest("x", "y").alias("other"))


def _apart(x: Column, y: Column) -> Column:
    """Whether two different words are one edit apart: what is left between their common head and tail tells, in any length."""

    def one(a: str, b: str) -> bool:
        n, k = min(len(a), len(b)), 0
        while k < n and a[k] == b[k]:
            k += 1
        a, b = a[k:], b[k:]
        return abs(len(a) - len(b)) < 2 and (a[1:] == b[1:] or a[1:] == b or a == b[1:] or (a[:2] == b[1::-1] and a[2:] == b[2:]))

    ready()
    return F.pandas_udf(lambda p, q: pd.Series([one(a, b) for a, b in zip(p, q, strict=True)], dtype=bool), "boolean")(x, y)


def _long_pairs(words: DataFrame) -> DataFrame:
    """one_edit_pairs() with a word beyond LONG letters: those with a common hash among their delete-one forms are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 0x9E3779B97F4A7C15
        for batch in batches:
            for id, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                letters = np.frombuffer(term.encode("utf-32-le"), np.uint32).astype(np.uint64)
                powers = np.cumprod(np.append(np.uint64(1), np.full(len(letters) - 1, base, np.uint64)), dtype=np.uint64)
                sums = np.append(np.uint64(0), np.cumsum(letters * powers, dtype=np.uint64))
                # all modulo 2 ** 64: what comes after the letter taken out moves one power down
                forms = np.unique(np.append(sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(pow(base, -1, 1 << 64)), sums[-1])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(forms), id)), pa.array(forms)], names=["id", "h"])

    ready()
    long = words.where(F.length("term") >= LONG).select(F.xxhash64("term").alias("id"), "term")  # words of LONG letters meet those of one more
    d = long.mapInArrow(run, "id long, h long")
    met = d.alias("a").hint("merge").join(d.alias("b").hint("merge"), (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("p"), F.col("b.id").alias("q")).distinct()
    x, y = (long.select(F.col("id").alias(i), F.col("term").alias(t)) for i, t in (("p", "x"), ("q", "y")))
    both = met.join(x, "p").join(y, "q").where(F.greatest(F.length("x"), F.length("y")) > LONG)
    return _ordered(both.where(_apart(F.col("x"), F.col("y"))))


def _grams(c: str, sizes: tuple[int, ...]) -> Column:
    """The distinct runs of so many characters of a text."""
    text = F.col(c)

    def of(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1))), lambda i: text.substr(i, F.lit(k)))
        return F.when(F.length(text) >= k, each).otherwise(F.array().cast("array<string>"))

    runs = [of(k) for k in sizes]
    return F.array_distinct(F.concat(*runs))


def containing(strings: DataFrame, terms: DataFrame, text: str = "low") -> DataFrame:
    """(note_id, text, term): the short strings (note_id, text) that contain a term (term), whatever stands beside it.

    No string is compared with every term: a term is looked up under its rarest run of three characters (itself if it is
    shorter) among the strings' runs, and what is found there is compared. Null and empty terms are in nothing."""
    asked = terms.where(F.length("term") > 0).select("term").distinct()
    runs = strings.select("note_id", text, F.explode(_grams(text, (1, 2, 3))).alias("gram"))
    often = runs.groupBy("gram").agg(F.count("*").alias("n"))
    keys = asked.select("term", F.explode(F.when(F.length("term") < 3, F.array("term")).otherwise(_grams("term", (3,)))).alias("gram"))
    rarest = keys.join(often, "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return runs.join(rarest, "gram").where(F.contains(F.col(text), F.col("term"))).select("note_id", text, "term")


def entity_vocabulary(corpus: DataFrame, partitions: tuple[str, ...] = ("People/", "Partners/", "Work/People/", "Work/Partners/")) -> DataFrame:
    """(name, path): titles and aliases of the notes about entities, up to three folders deep, raw imports left out."""
    here = F.col("path").startswith(partitions[0])
    for p in partitions[1:]:
        here = here | F.col("path").startswith(p)
    some = corpus.where(here & (tx.depth(F.col("path")) <= 4) & ~F.lower("path").contains("/raw/"))
    return some.select(F.explode(F.concat(F.array("title"), "aliases")).alias("name"), "path").where(F.trim("name") != "").distinct()
