"""Variant spellings of names: a symmetric-delete index on tokens, then alignment of tokens with initials and short forms.

1. A name becomes tokens: letters without marks in lower case, joined words parted at capitals, titles and legal forms
   dropped. Null, blank and placeholder names mean nobody. Its core is the bag of its words.
2. Tokens that are one edit (a letter more, less, other, or two exchanged) apart share one of their delete-one forms, so
   an equi-join on these finds all such pairs without comparing the vocabulary with itself. A token may stand for a
   much more frequent neighbour, or for one that takes its place in most of the names it is in; a nickname for its given
   name; a short form (first letter equal, letters in order) for a common word. All of this is relative to the counts at
   hand, none to the size of the table.
3. Cores meet where the two rarest words of one are words of the other or what these may stand for: an equi-join on pairs
   of words. Their tokens are then aligned by an optimal assignment at least cost (equal 0, stands for 1). Of the cores a
   name aligns with, its own included, the one most names have is its reading.
4. A name with initials meets the cores that hold its rarest word and a word with its first initial, and is aligned with
   each: its words with equal ones, initials with words they begin, every word of the core with something, the first
   initial among them. It follows that core if only one entity fits, or the entity of the note it titles.
5. Names that title the same note mean the same entity: connected components over cores and notes.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.components import components
from marginalia.session import materialize, ready

#: Letters that have no decomposition, titles, legal forms and placeholders as people write them.
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "’": "'", "ʼ": "'"})
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "mx", "miss", "sir", "the"}
LEGAL = {"ltd", "limited", "inc", "incorporated", "llc", "llp", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "sas", "sarl", "bv", "nv", "plc", "kg", "srl", "spa", "oy", "ab", "as"}
PLACEHOLDERS = {"n/a", "na", "none", "null", "nil", "unknown", "tbd", "tba", "todo", "anonymous", "anon", "no name", "not known", "not available", "test", "xxx", "nobody", "someone"}
#: A token an edit away from one this much more frequent is taken for a slip; the share of names from which a word is common.
RATIO, COMMON = 0.34, 0.002
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])")
_DOTTED = re.compile(r"\b(?:\w\.){2,}|\b(?:\w\.)+\w\b(?!\w)")


def tokens(name: str | None) -> list[str]:
    """The tokens of a name in order; none for a name that means nobody."""
    if not name or name.strip().lower().strip(".-_ ") in PLACEHOLDERS:
        return []
    parted = _CAMEL.sub(" ", name.strip())
    text = unicodedata.normalize("NFKD", parted.lower().translate(_LETTERS))
    text = "".join(c for c in text if not unicodedata.combining(c)).replace("'", "")
    rest = len(re.findall(r"[^\W\d_]{2,}", text))
    text = _DOTTED.sub(lambda m: j if (j := m[0].replace(".", "")) in LEGAL and rest >= 2 else " ".join(j), text)
    found = [t for t in re.findall(r"[^\W_]+", text) if t not in TITLES]
    kept = [t for t in found if t not in LEGAL]
    return kept or found


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by one letter more, less or other, or by two neighbours exchanged."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def shortens(a: str, b: str) -> bool:
    """Whether a may be a short form of b: same first letter, its letters in order in b, at least two fewer."""
    if len(a) < 2 or len(a) + 2 > len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def _tokens_of(name: pd.Series) -> pd.Series:
    return name.map(tokens)


def _one_edit_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _shortens_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shortens(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def assign(cost: list[list[float]]) -> tuple[float, list[int]]:
    """(least total, column of each row) of a one-to-one assignment of all rows to columns, at least as many as rows.

    Shortest augmenting paths with potentials: one row after the other, in rows x rows x columns steps."""
    rows, cols = len(cost), len(cost[0]) if cost else 0
    u, v, owner = [0.0] * rows, [0.0] * (cols + 1), [-1] * (cols + 1)
    for r in range(rows):
        owner[cols], at = r, cols
        dist, back, done = [FAR * FAR] * cols, [cols] * cols, [False] * (cols + 1)
        while owner[at] >= 0:
            done[at], row, step, then = True, owner[at], FAR * FAR, -1
            for c in range(cols):
                if not done[c]:
                    d = cost[row][c] - u[row] - v[c]
                    if d < dist[c]:
                        dist[c], back[c] = d, at
                    if dist[c] < step:
                        step, then = dist[c], c
            for c in range(cols + 1):
                if done[c]:
                    u[owner[c]] += step
                    v[c] -= step
                elif c < cols:
                    dist[c] -= step
            at = then
        while at != cols:
            owner[at] = owner[back[at]]
            at = back[at]
    chosen = [0] * rows
    for c in range(cols):
        if owner[c] >= 0:
            chosen[owner[c]] = c
    return sum(cost[r][chosen[r]] for r in range(rows)), chosen


#: The cost of what may not be aligned, above any sum of costs that may.
FAR = 1e6


def aligned(parts: list[list[str]], words: list[str]) -> int | None:
    """The least number of words that change when the tokens (each with what it may stand for) align one to one with words; None if they can't."""
    if len(parts) != len(words):
        return None
    total, _ = assign([[0.0 if p[0] == w else 1.0 if w in p else FAR for w in words] for p in parts])
    return int(total) if total < FAR else None


def abbreviates(words: list[str], initials: list[str], full: list[str]) -> bool:
    """Whether words and initials align with the words of a full name: words with equal ones, initials with words that
    begin with them, all of full with something; an initial that is not the first may be left over, nothing else."""
    if not initials or not len(words) < len(full) <= len(words) + len(initials):
        return False
    spare = len(words) + len(initials) - len(full)
    cost = [[0.0 if w == x else FAR for x in full] + [FAR] * spare for w in words]
    cost += [[1.0 if x[0] == i else FAR for x in full] + [FAR if k == 0 else 0.0] * spare for k, i in enumerate(initials)]
    return assign(cost)[0] < FAR


def _aligned_of(parts: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([aligned([list(x) for x in p], list(w)) for p, w in zip(parts, words, strict=True)], dtype="Int32")


def _abbreviates_of(words: pd.Series, initials: pd.Series, full: pd.Series) -> pd.Series:
    return pd.Series([abbreviates(list(w), list(i), list(f)) for w, i, f in zip(words, initials, full, strict=True)], dtype=bool)


#: Wrapped when a query is built: workers import this module without a session.
_KINDS = {"_tokens": (_tokens_of, "array<string>"), "_one_edit": (_one_edit_of, "boolean"), "_shortens": (_shortens_of, "boolean"), "_aligned": (_aligned_of, "int"), "_abbreviates": (_abbreviates_of, "boolean")}


def _udf(name: str, *columns):
    ready()
    function, kind = _KINDS[name]
    return F.pandas_udf(function, kind)(*columns)


def token_readings(counts: DataFrame, nicknames: DataFrame, total: int, cores: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """(token, stands array<string>): what each token of counts (token, n) may stand for besides itself; cores: (core, words).

    A token may stand for one an edit away if it has at most `RATIO` of the other's count, from 4 letters on; or if it is
    no more frequent and in more than half of the cores it is in, the other in its place gives a core that names have.
    Common words, which short forms are held against, are tokens in at least `COMMON` of all names: as a name has a few
    tokens, there are at most some thousands of them however long the table."""
    nick = nicknames.select(F.explode(_udf("_tokens", "nickname")).alias("token"), F.get(_udf("_tokens", "given_name"), F.lit(0)).alias("u")).where("token is not null and u is not null").distinct()
    named = nick.select("token").unionByName(nick.select(F.col("u").alias("token"))).distinct()
    deletes = F.array_distinct(F.concat(F.array("token"), F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.col("token").substr(F.lit(1), i - 1), F.col("token").substr(i + 1, F.length("token"))))))
    index = counts.select("token", "n", F.explode(deletes).alias("d")).where("d != ''")
    other = index.select(F.col("token").alias("u"), F.col("n").alias("m"), "d")
    close = index.join(other, "d").where((F.col("u") != F.col("token")) & (F.col("n") <= F.col("m"))).select("token", "u", "n", "m").distinct().join(named, "token", "left_anti")
    close = materialize(close.where(_udf("_one_edit", "token", "u")), "close-tokens")
    held = cores.select("core", "words", F.explode(F.array_distinct("words")).alias("token"))
    swapped = F.array_join(F.array_sort(F.transform("words", lambda w: F.when(w == F.col("token"), F.col("u")).otherwise(w))), " ")
    tried = held.where(F.size("words") > 1).join(close.select("token", "u"), "token").select("token", "u", swapped.alias("core"))
    seen = tried.join(cores.select("core", F.lit(1).alias("has")), "core", "left").groupBy("token", "u").agg(F.sum(F.coalesce("has", F.lit(0))).alias("has"))
    within = held.groupBy("token").agg(F.count("*").alias("cores"))
    rated = close.join(seen, ["token", "u"], "left").join(within, "token", "left")
    long = F.least(F.length("token"), F.length("u")) >= 4
    near = rated.where((long & (F.col("n") <= RATIO * F.col("m"))) | (F.col("has") * 2 > F.col("cores"))).select("token", "u")
    common = F.broadcast(counts.where(F.col("n") >= COMMON * total).select(F.col("token").alias("u"), F.substring("token", 1, 1).alias("f"), F.col("n").alias("m")))
    brief = counts.where(F.length("token") <= 6).withColumn("f", F.substring("token", 1, 1)).join(common, "f").where((F.col("n") <= F.col("m")) & (F.length("token") + 2 <= F.length("u"))).where(_udf("_shortens", "token", "u")).select("token", "u").join(nick.select("token"), "token", "left_anti")
    stands = near.unionByName(brief).unionByName(nick)
    if learned is not None:
        stands = stands.unionByName(learned)
    ranked = stands.distinct().join(counts.select(F.col("token").alias("u"), F.col("n").alias("m")), "u", "left")
    return ranked.groupBy("token").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.coalesce("m", F.lit(0))).alias("m"), "u"))), lambda x: x["u"]).alias("stands"))


def core_readings(cores: DataFrame, stands: DataFrame, counts: DataFrame) -> DataFrame:
    """(core, other, changed): the pairs of cores whose words align one to one, by least cost, with `changed` words that stand for others.

    cores: (core, words, initial), initial of one-word cores only. A core is found under its two rarest words, by equi-join."""
    each = cores.select("core", "words", "initial", F.posexplode("words").alias("at", "token")).join(stands, "token", "left").join(counts, "token", "left")
    may = F.concat(F.array("token"), F.coalesce("stands", F.array().cast("array<string>")))
    full = each.groupBy("core").agg(F.first("words").alias("words"), F.first("initial").alias("initial"), F.sort_array(F.collect_list(F.struct("at", may.alias("may")))).alias("parts"), F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("rare"))
    full = full.withColumn("parts", F.transform("parts", lambda x: x["may"]))
    first = F.concat_ws("|", F.size("words").cast("string"), F.coalesce("initial", F.lit("")))
    two = lambda a, b: F.concat_ws("|", first, F.least(a, b), F.greatest(a, b))
    targets = full.select(F.col("core").alias("other"), F.col("words").alias("other_words"), F.when(F.size("words") == 1, F.concat_ws("|", first, F.get("rare", F.lit(0))["token"])).otherwise(two(F.get("rare", F.lit(0))["token"], F.get("rare", F.lit(1))["token"])).alias("key"))
    changing = full.where(F.exists("parts", lambda p: F.size(p) > 1))
    solo = changing.where(F.size("words") == 1).select("core", "parts", F.explode(F.transform(F.get("parts", F.lit(0)), lambda w: F.concat_ws("|", first, w))).alias("key"))
    pair = changing.where(F.size("words") > 1).select("core", "parts", first.alias("first"), F.posexplode("parts").alias("i", "a")).withColumn("b", F.explode(F.slice("parts", F.col("i") + 2, F.size("parts"))))
    pair = pair.select("core", "parts", "first", F.explode("a").alias("a"), "b").select("core", "parts", "first", "a", F.explode("b").alias("b")).select("core", "parts", F.concat_ws("|", "first", F.least("a", "b"), F.greatest("a", "b")).alias("key"))
    met = solo.unionByName(pair).dropDuplicates(["core", "key"]).join(targets, "key").where("core != other").dropDuplicates(["core", "other"])
    return met.select("core", "other", _udf("_aligned", "parts", "other_words").alias("changed")).where("changed is not null")


def learned_nicknames(rows: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """(token, u): words that replace a more frequent word in names that title the same note, for at least `least` notes (a single note may be wrong)."""
    titled = rows.where("path is not null").select("path", F.array_distinct(F.filter("tokens", lambda t: F.length(t) > 1)).alias("w")).where(F.size("w") >= 2).distinct()
    # of each word the names of a note hold, how often the others hold it: a linear stand-in for comparing all names of a note
    word = titled.select("path", "w", F.explode("w").alias("t")).join(counts.select(F.col("token").alias("t"), "n"), "t")
    whole = word.groupBy("path", "w").agg(F.min("n").alias("least"), F.sum("n").alias("sum"))
    top = whole.groupBy("path").agg(F.max_by("w", F.struct("least", "sum", "w")).alias("v"))
    a, b = F.array_except("w", "v"), F.array_except("v", "w")
    met = titled.join(top, "path").select("path", a.alias("a"), b.alias("b"), (F.size("w") == F.size("v")).alias("even"))
    one = met.where((F.size("a") == 1) & (F.size("b") == 1) & F.col("even")).select("path", F.get("a", F.lit(0)).alias("token"), F.get("b", F.lit(0)).alias("u"))
    seen = one.groupBy("token", "u").agg(F.count_distinct("path").alias("paths")).where(F.col("paths") >= least)
    n = seen.join(counts, "token").join(counts.select(F.col("token").alias("u"), F.col("n").alias("m")), "u")
    return n.where("m > n").select("token", "u")


def entities(names: DataFrame, nicknames: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name_id, entity) of every name that means somebody; entity is equal for the variants of one person or organisation.

    names: (name_id, name_text, path, origin); aliases: (path, aliases) of notes; nicknames: (given_name, nickname).
    Rows that repeat a name_id count once. A name whose initials fit several entities, in no title, is its own."""
    about = F.when(F.col("origin").isin("title", "alias"), F.col("path"))
    base = names.where("name_id is not null and name_text is not null").select("name_id", F.struct("name_text", about.alias("path")).alias("x")).groupBy("name_id").agg(F.min("x").alias("x")).select("name_id", "x.name_text", "x.path")
    if aliases is not None:
        more = aliases.where("path is not null").select(F.lit(None).cast(names.schema["name_id"].dataType).alias("name_id"), F.explode("aliases").alias("name_text"), "path").distinct()
        base = base.unionByName(more.where("name_text is not null"))
    rows = materialize(base.withColumn("tokens", _udf("_tokens", "name_text")).where(F.size("tokens") > 0).withColumn("form", F.array_join("tokens", " ")), "names")
    each = rows.where("name_id is not null")
    counts = materialize(each.select("name_id", F.explode("tokens").alias("token")).where(F.length("token") > 1).distinct().groupBy("token").agg(F.count("*").alias("n")), "tokens")
    words = F.array_sort(F.filter("tokens", lambda t: F.length(t) > 1))
    first = F.get(F.filter("tokens", lambda t: F.length(t) == 1), F.lit(0))
    # a lone word keeps its first initial, as "J. Foo" and "K. Foo" are two
    forms = rows.groupBy("form").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens")).select("form", "n", words.alias("words"), F.when(F.size(words) < 2, first).alias("initial"))
    forms = materialize(forms.withColumn("core", F.concat(F.array_join("words", " "), F.coalesce(F.concat(F.lit("|"), "initial"), F.lit("")))), "forms")
    stands = materialize(token_readings(counts, nicknames, each.count(), forms.select("core", "words").distinct(), learned_nicknames(rows, counts)), "token-readings")
    cores = forms.groupBy("core").agg(F.first("words").alias("words"), F.first("initial").alias("initial"), F.sum("n").alias("support"))
    alike = materialize(core_readings(cores.where(F.size("words") > 0), stands, counts), "readings")
    support = cores.select(F.col("core").alias("reading"), "support")
    read = forms.select("form", "n", "core", F.col("core").alias("reading"), F.lit(0).alias("changed")).unionByName(forms.select("form", "n", "core").join(alike, "core").select("form", "n", "core", F.col("other").alias("reading"), "changed"))
    # a reading others have as it stands beats the name's own; among those the most frequent, then the fewest changes
    rated = read.join(support, "reading")
    own = F.col("reading") == F.col("core")
    best = F.row_number().over(Window.partitionBy("form").orderBy(F.desc(F.when(own, F.col("support") - F.col("n")).otherwise(F.col("support")) > 0), F.desc(F.when(own, F.col("support")).otherwise(F.col("support") * 2)), "changed", "reading"))
    rated = materialize(rated.withColumn("best", best).select("form", "core", "reading", "best"), "cores")
    read_as = rated.where("best = 1").select("form", F.col("reading").alias("core"))
    base = F.split(F.get(F.split("core", r"\|"), F.lit(0)), " ")
    named = rows.join(read_as, "form").select("name_id", "path", "core", base.alias("words"), F.filter("tokens", lambda t: F.length(t) == 1).alias("initials"))
    named = materialize(named, "cored")
    full = named.where((F.size("words") > 1) & ~F.contains("core", F.lit("|"))).select(F.col("core").alias("fits"), F.col("words").alias("full")).distinct()
    keyed = full.select("fits", "full", F.posexplode("full").alias("i", "w")).select("fits", "full", "w", F.explode(F.array_distinct(F.transform(F.filter("full", lambda x, j: j != F.col("i")), lambda x: F.substring(x, 1, 1)))).alias("letter"))
    asked = named.where((F.size("initials") > 0) & (F.col("core") != "")).select("core", "words", "initials").distinct()
    rarest = asked.select("core", "words", "initials", F.explode("words").alias("w")).join(counts.select(F.col("token").alias("w"), "n"), "w", "left")
    asked = rarest.groupBy("core", "words", "initials").agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w")).withColumn("letter", F.get("initials", F.lit(0)))
    fits = materialize(asked.join(keyed, ["w", "letter"]).where("core != fits").where(_udf("_abbreviates", "words", "initials", "full")).select("core", "initials", "fits").distinct(), "fits")
    open_ = fits.select("core", "initials").distinct()
    firm = named.join(open_, ["core", "initials"], "left_anti")
    links = firm.where("path is not null").select(F.concat(F.lit("c:"), "core").alias("a"), F.concat(F.lit("p:"), "path").alias("b")).distinct()
    # every reading that is some name's own core means the same as the one that was chosen
    also = rated.select("form", F.concat(F.lit("c:"), "reading").alias("a")).join(read_as.select("form", F.concat(F.lit("c:"), "core").alias("b")), "form").where("a != b").select("a", "b").distinct()
    links = links.unionByName(also)
    groups = materialize(components(links), "name-groups")
    of_core = groups.where(F.col("key").startswith("c:")).select(F.expr("substring(key, 3)").alias("core"), F.col("group").alias("g"))
    of_path = groups.where(F.col("key").startswith("p:")).select(F.expr("substring(key, 3)").alias("path"), F.col("group").alias("pg"))
    entity = F.coalesce("g", F.concat(F.lit("c:"), F.col("core")))
    certain = firm.join(of_core, "core", "left").select("name_id", entity.alias("entity"))
    told = fits.join(of_core.select(F.col("core").alias("fits"), "g"), "fits", "left").select("core", "initials", F.coalesce("g", F.concat(F.lit("c:"), F.col("fits"))).alias("e"))
    only = told.groupBy("core", "initials").agg(F.count_distinct("e").alias("several"), F.min("e").alias("e"))
    loose = named.join(open_, ["core", "initials"], "left_semi").join(only, ["core", "initials"], "left").join(of_path, "path", "left")
    loose = loose.select("name_id", F.coalesce("pg", F.when(F.col("several") == 1, F.col("e")), F.concat(F.lit("n:"), F.col("name_id").cast("string"))).alias("entity"))
    return certain.unionByName(loose).where("name_id is not null")


def variant_pairs(members: DataFrame, expand: int = 2000, names: DataFrame | None = None) -> DataFrame:
    """(name_a, name_b), name_a < name_b: the pairs of names of one entity.

    Of an entity with more than `expand` names, the least name_ids of its spellings are paired with each other and each other
    name is linked to the least of its own spelling: with `names` (name_id, name_text) no link between spellings is missing.
    Without `names` all spellings count as one. The members are written first: five branches read them, and each would hold
    the plan that made them, with its broadcasts, in the driver."""
    members = materialize(members.select("name_id", "entity"), "members")
    size = members.groupBy("entity").agg(F.count("*").alias("size"))
    few = members.join(size.where((F.col("size") > 1) & (F.col("size") <= expand)).select("entity"), "entity", "left_semi")
    both = lambda x: x.select("entity", F.col("name_id").alias("name_a")).join(x.select("entity", F.col("name_id").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
    many = members.join(size.where(F.col("size") > expand).select("entity"), "entity", "left_semi")
    if names is None:
        many = many.withColumn("spelling", F.lit(""))
    else:
        many = many.join(names.where("name_id is not null").groupBy("name_id").agg(F.min("name_text").alias("spelling")), "name_id")
    least = many.groupBy("entity", "spelling").agg(F.min("name_id").alias("least"))
    star = many.join(least, ["entity", "spelling"]).where("least < name_id").select(F.col("least").alias("name_a"), F.col("name_id").alias("name_b"))
    return both(few).unionByName(both(least.select("entity", F.col("least").alias("name_id")))).unionByName(star)
