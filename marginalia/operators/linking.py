"""Link prediction: names of notes that a text mentions without a link, and clean-up plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as tx
from marginalia.operators import graph

# What no link may stand in, and which notes none may lead to.
_PROTECTED = r"(?s)^---.*?\n---|```.*?(?:```|$)|`(?:[^`\n]|\n(?!\n)){0,4000}`|!?\[\[[^\]]*\]\]|\]\([^)]*\)|https?://[^\s)]+|www\.[^\s)]+"
BAD_PLACES, BAD_NAMES = r"^(Templates|System|Inbox)/|(?i:/Raw/)|\.excalidraw", r"(?i)^_|^(SOURCES|GUIDE|SKILL|README|INDEX)\.md$"
FLOOR, ENOUGH, SURE = 0.065, 5, 0.5
#: In the text that is searched: a word, and what stands between two words that may be one name.
_TOKEN, _BREAK = r"[\p{L}\p{N}]+", r"[\r\n`*|\[\]]"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), F.lit(0))


def patterns(corpus: DataFrame, most_words: int | None = None) -> DataFrame:
    """(phrase, path, words): the names of notes that may be linked, title and aliases, each as words: single words of four letters
    and more that are no number, phrases of any length (most_words: up to so many). Notes in templates, system folders, the
    inbox or raw imports, structural files, and names that hold [, ], | or # are left out. Of several notes of one name the
    first by path stands, until links tell otherwise (commonness)."""
    ok = corpus.where(~F.col("path").rlike(BAD_PLACES) & ~F.substring_index("path", "/", -1).rlike(BAD_NAMES) & ~F.col("title").rlike(r"[\[\]|#]"))
    each = ok.select("path", F.explode(F.concat(F.array("title"), "aliases")).alias("name")).where(F.col("name").isNotNull() & ~F.col("name").rlike(r"[\[\]|#]"))
    p = each.select(F.array_join(_words(F.col("name")), " ").alias("phrase"), "path").withColumn("words", F.size(F.split("phrase", " ")))
    p = p.where((F.col("phrase") != "") & ((F.col("words") > 1) | ((F.length("phrase") >= 4) & ~F.col("phrase").rlike("^[0-9]+$"))))
    if most_words is not None:
        p = p.where(F.col("words") <= most_words)
    return p.groupBy("phrase", "words").agg(F.min("path").alias("path")).select("phrase", "path", "words")


def mentions(corpus: DataFrame, patterns: DataFrame, body: str = "body") -> DataFrame:
    """(path, phrase, target, at, words, shown): where free text holds a pattern as whole words, not beside a letter, number, -, _, / or
    \\ nor before a file ending, not over a line or markup; shown is the text there.

    A name is found by its first words: notes give each of their words with what follows it for as many words as the longest
    name with that first word has, and only words that begin a name go on."""
    starts = patterns.groupBy(F.substring_index("phrase", " ", 1).alias("first")).agg(F.array_sort(F.collect_set("words")).alias("sizes"))
    # what is protected counts as a break
    plain = corpus.select("path", F.regexp_replace(body, _PROTECTED, "\n").alias("text"))
    # only a note's distinct words travel, and what begins a name comes back to it: its text stays one row
    firsts = plain.select("path", F.explode(F.array_distinct(_words(F.col("text")))).alias("first")).join(starts, "first")
    known = firsts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("first", "sizes"))).alias("sizes"))
    met = plain.join(known, "path")
    # a word, and the signs up to the next one
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), "text"), F.lit(r"([^\p{L}\p{N}]*)([\p{L}\p{N}]+)"), F.lit(0))
    met = met.select("path", "sizes", "text", F.explode(F.array(pieces)).alias("pieces"))  # unfolded: worked out once, after the join
    word = F.transform("pieces", lambda p: F.regexp_extract(p, r"([\p{L}\p{N}]+)$", 1))
    between = F.transform("pieces", lambda p: F.regexp_replace(p, r"[\p{L}\p{N}]+$", ""))
    t = met.select("path", "sizes", F.explode(F.array(F.struct(word.alias("w"), F.concat(between, F.array(F.regexp_extract("text", r"([^\p{L}\p{N}]*)$", 1))).alias("b")))).alias("x")).select("path", "sizes", "x.*")
    at = F.transform("w", lambda x, i: F.struct(i.alias("i"), F.lower(x).alias("first")))
    w, b, sizes = F.col("w"), F.col("b"), F.col("sizes")

    def one(i: Column, words: Column) -> Column:
        """The run of so many words at a place; its end may lie beyond the text."""
        rest = F.slice(w, i + 2, words - 1)
        inner = F.slice(b, i + 2, words - 1)
        shown = F.concat(F.get(w, i), F.array_join(F.zip_with(inner, rest, lambda g, x: F.concat(g, x)), ""))
        before, after, follows = F.get(b, i), F.get(b, i + words), F.get(w, i + words)
        fits = ~before.rlike(r"[-_/\\\\]$") & ~after.rlike(r"^[-_/\\\\]") & ~((after == ".") & F.coalesce(follows.rlike("^[A-Za-z]"), F.lit(False))) & ~F.exists(inner, lambda g: g.rlike(_BREAK))
        phrase = F.lower(F.array_join(F.slice(w, i + 1, words), " "))
        return F.when((i + words <= F.size(w)) & fits, F.struct(phrase.alias("phrase"), (i + 1).alias("at"), words.alias("words"), shown.alias("shown")))

    runs = F.flatten(F.transform(F.filter(at, lambda x: F.map_contains_key(sizes, x["first"])), lambda x: F.transform(F.element_at(sizes, x["first"]), lambda k: one(x["i"], k))))
    run = t.select("path", F.explode(F.filter(runs, lambda x: x.isNotNull())).alias("x")).select("path", "x.*")
    return run.join(patterns.select("phrase", F.col("path").alias("target"), "words"), ["phrase", "words"]).select("path", "phrase", "target", "at", "words", "shown")


def phrase_statistics(corpus: DataFrame, mentions: DataFrame, each: int | None = 20) -> DataFrame:
    """(phrase, linked, mentioned, keyphraseness): how often a phrase is shown in a link that resolves, and how often names() stand
    free (at most `each` times a note), and the share of the former."""
    links = _shown_links(corpus)
    linked = links.groupBy("phrase").agg(F.count("*").alias("linked"))
    n = F.count("*") if each is None else F.least(F.count("*"), F.lit(each))
    once = mentions.groupBy("path", F.lower("shown").alias("phrase")).agg(n.alias("n")).groupBy("phrase").agg(F.sum("n").alias("mentioned"))
    x = linked.join(once, "phrase", "full").na.fill(0, ["linked", "mentioned"])
    return x.withColumn("keyphraseness", F.col("linked") / (F.col("linked") + F.col("mentioned")))


def _shown_links(corpus: DataFrame) -> DataFrame:
    """(path, phrase, target) of the links that resolve by title or alias, phrase being what is shown, in lower case."""
    names = corpus.select("path", F.lower("title").alias("name"), F.lit(0).alias("alias")).unionByName(corpus.select("path", F.explode(F.transform("aliases", lambda a: F.lower(a))).alias("name"), F.lit(1).alias("alias")))
    one = names.groupBy("name").agg(F.min(F.struct("alias", "path")).alias("x")).select("name", F.col("x.path").alias("target"))
    found = corpus.select("path", F.explode(F.regexp_extract_all("raw", F.lit(r"\[\[([^\]|#]+)(?:\|([^\]]+))?\]\]"), F.lit(0))).alias("l"))
    part = lambda i: F.lower(F.trim(F.regexp_extract("l", r"\[\[([^\]|#]+)(?:\|([^\]]+))?\]\]", i)))
    return found.select("path", part(1).alias("name"), F.when(part(2) != "", part(2)).otherwise(part(1)).alias("phrase")).where("phrase != ''").join(one, "name").select("path", "phrase", "target")


def commonness(corpus: DataFrame) -> DataFrame:
    """(phrase, target, share): the note a phrase links to most, of those it is a link to, where that is at least half the time."""
    n = _shown_links(corpus).groupBy("phrase", "target").agg(F.count("*").alias("n"))
    best = n.groupBy("phrase").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.struct((-F.length("target")).alias("l"), "target"))).alias("x"))
    return best.select("phrase", F.col("x.col2.target").alias("target"), (F.col("x.n") / F.col("all")).alias("share")).where(F.col("share") >= SURE)


def suggest(mentions: DataFrame, corpus: DataFrame | None = None, most: int | None = 20) -> DataFrame:
    """(path, target, phrase, at): links to make: from left to right the longest mention, none that overlaps another, one a target, at
    most `most` a note, none to the note itself.

    With `corpus` its links tell more: a phrase goes to the note it mostly links to; a word that was never linked needs a
    capital (or Arabic) here; phrases that stand five times or more and are linked in under 6.5 % are left out. A note's
    mentions are few and go through one pass in order."""
    m = mentions.withColumn("key", F.lower("shown"))
    if corpus is not None:
        stats = phrase_statistics(corpus, mentions).select(F.col("phrase").alias("key"), (F.col("linked") + F.col("mentioned")).alias("all"), F.when(F.col("linked") > 0, F.col("keyphraseness")).alias("k"))
        m = m.join(stats, "key", "left").join(commonness(corpus).select(F.col("phrase").alias("key"), F.col("target").alias("usual")), "key", "left")
        capital = F.col("shown").rlike("^[A-Z\u0600-\u06ff]")
        m = m.where(((F.col("words") > 1) | F.col("k").isNotNull() | capital) & (F.col("k").isNull() | (F.col("all") < ENOUGH) | (F.col("k") >= FLOOR)))
        m = m.withColumn("target", F.coalesce("usual", "target"))
    m = m.where("path != target").groupBy("path").agg(F.sort_array(F.collect_set(F.struct("at", (-F.col("words")).alias("less"), "target", "phrase"))).alias("m"))
    empty = F.array().cast("array<struct<at:int,less:int,target:string,phrase:string>>")

    def take(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        free = (F.size(acc) == 0) | (x["at"] >= last["at"] - last["less"])
        return F.when(F.when(F.size(acc) == 0, True).otherwise(free & ~F.exists(acc, lambda y: y["target"] == x["target"])), F.concat(acc, F.array(x))).otherwise(acc)

    kept = F.aggregate("m", empty, take)
    out = m.select("path", F.explode(kept if most is None else F.slice(kept, 1, most)).alias("x"))
    return out.select("path", "x.target", "x.phrase", "x.at")


def suggest_for(text: DataFrame, entities: DataFrame, most: int | None = 5) -> DataFrame:
    """(id, name, path): the entities (name, path) a new note's text (id, body) names without a link, the first `most`: what to tell
    its writer."""
    known = entities.select(F.array_join(_words(F.col("name")), " ").alias("phrase"), F.col("path")).where(F.length("phrase") >= 3).groupBy("phrase").agg(F.min("path").alias("path"))
    m = mentions(text.select(F.col("id").cast("string").alias("path"), "body"), known.withColumn("words", F.size(F.split("phrase", " "))))
    first = m.groupBy("path", "target").agg(F.min(F.struct("at", "shown")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("x.at", "target"))
    out = first.withColumn("nth", nth)
    return (out if most is None else out.where(F.col("nth") <= most)).select(F.col("path").alias("id"), F.col("x.shown").alias("name"), F.col("target").alias("path"))


def apply_links(corpus: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(path, body): bodies with the first free place of each suggested phrase made a link."""
    s = suggestions.groupBy("path").agg(F.sort_array(F.collect_list(F.struct((-F.length("phrase")).alias("l"), "phrase", tx.basename(F.col("target")).alias("name")))).alias("s"))
    # a free place: a whole word outside links; the look-ahead refuses places before a closing ]]
    swap = lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"(?is)^((?:(?!```).)*?)(?<![\p{L}\p{N}\[|])(\Q"), x["phrase"], F.lit(r"\E)(?![\p{L}\p{N}])(?![^\[]*\]\])")), F.concat(F.lit("$1[["), F.regexp_replace(x["name"], r"([\\$])", r"\\$1"), F.lit("|$2]]")))
    return corpus.join(s, "path").select("path", F.aggregate("s", F.col("body"), swap).alias("body"))


def cleanup_plan(corpus: DataFrame) -> DataFrame:
    """(path, keep, reason): notes whose whole content another note holds too; kept is the one outside imports and archives, then
    the shallowest, then the first path. Groups are by hash, their best is an aggregate: no group is gathered."""
    h = corpus.where(F.trim("body") != "").select("path", F.sha2(F.col("body"), 256).alias("h"), F.lower("path").rlike("(^|/)(inbox|raw|imports?|archive)/").cast("int").alias("off"), tx.depth(F.col("path")).alias("d"))
    best = h.groupBy("h").agg(F.min(F.struct("off", "d", "path")).alias("k"), F.count("*").alias("n")).where("n > 1")
    return h.join(best, "h").where(F.col("path") != F.col("k.path")).select("path", F.col("k.path").alias("keep"), F.lit("same content").alias("reason"))


def orphan_links(orphans: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(path, target, direction): links that would reach orphans: their own suggestions first, then those of others to them."""
    o = orphans.select("path")
    out = suggestions.join(o, "path", "left_semi").select("path", "target", F.lit("out").alias("direction"))
    into = suggestions.join(o.withColumnRenamed("path", "target"), "target", "left_semi").join(out.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target", F.lit("in").alias("direction"))
    return out.unionByName(into)


def related_sections(fused: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """(a, b, nth) of notes worth a list of related ones: those both measures name or that score over 0.02, two to four a note."""
    ok = fused.where("via = 'both' or score > 0.02").withColumn("k", F.count("*").over(Window.partitionBy("a")))
    return ok.where((F.col("k") >= least) & (F.col("nth") <= most)).select("a", "b", "nth")
