"""Texts cut off by field limits: hidden limits by length under several encodings, then how the text ends.

One Arrow pass measures each text: its length as the field may have counted it (characters, UTF-8 bytes, UTF-16 units,
with HTML or JSON escapes, with either kind of line break), and how it ends. Lengths of texts with an open end are then
counted by source and encoding; a length that many of them share, far above its neighbours, is a hidden limit of that
source. What an ending alone does not tell is asked of the corpus, all of it: how lines that begin alike end, which
words end list items, and whether the length is at a limit.

Shuffled are only counts: by (source, encoding, length) and by the first word of a line or last word of an item.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialize, ready

#: Put after a cut; what stands before it decides.
_MARK = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…|truncated|cut|more|continued)\s*\]|\(\s*(?:truncated|cut|more)\s*\)|<\s*truncated\s*>)\s*$", re.I)
_DOTS = re.compile(r"\s*(?:…|\.{3,})$")
_END = re.compile(r"[.!?؟。！？۔]")
#: The signs after the last letter or digit of a line, and what may stand in round brackets before them.
_TAIL = re.compile(r"[^\w]*$")
_BRACKET = re.compile(r"\s*\([^()\n]{1,40}\)\s*$")
_INNER = re.compile(r"[.!?؟。！？۔][\"'»”)*_]*\s+\S")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+(?:\[[ xX]\]\s*)?")
_SPEAKER = re.compile(r"\s*(?:>\s*)?\*\*[^*\n]{1,60}:?\*\*:?\s*")
_LINKS = re.compile(r"\s*(?:\[\[[^\]\n]+\]\]\s*)+$")
_TAGS = re.compile(r"\s*(?:#\w[\w/-]*\s*)+$")
_URL = re.compile(r"\s*<?\w+://\S+\s*$")
_WORD = re.compile(r"\w+")
ENCODINGS = ("chars", "utf8", "utf16", "html", "html_utf8", "json", "json_ascii", "lf", "lf_utf8", "crlf", "crlf_utf8")
BYTES = ("utf8", "html_utf8", "lf_utf8", "crlf_utf8")
SCHEMA = "ending string, marked boolean, first string, last string, lengths array<int>, keys array<string>"


def lengths(t: str) -> list[int]:
    """The length of a text under each of ENCODINGS."""
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    escaped, lf = html.escape(t), t.replace("\r\n", "\n")
    crlf = lf.replace("\n", "\r\n")
    return [len(t), size(t), len(t.encode("utf-16-le", "surrogatepass")) // 2, len(escaped), size(escaped), len(json.dumps(t, ensure_ascii=False)) - 2, len(json.dumps(t)) - 2, len(lf), size(lf), len(crlf), size(crlf)]


def _ended(line: str) -> bool:
    """Whether a line ends like a sentence: a full stop or the like among its last signs, before any note in brackets."""
    return bool(_END.search(_TAIL.search(line)[0]) or _END.search(_TAIL.search(_BRACKET.sub("", line))[0]))


def _first(line: str) -> str:
    m = _WORD.search(line)
    return m[0].lower() if m else ""


def ending(t: str) -> tuple[str, bool, str, str, list[str]]:
    """(ending, marked, first word of the last line, last word, keys about the other lines) of a text.

    ending: `whole`; `cut` for an open sentence, code block, link or table row; `line` for a line of one open fragment,
    `item` for a list item, `dots` for dots after a word, `other` for addresses, tags, signatures and headings: these
    ask the corpus. Keys: "s+word" and "s-word" for lines that begin with word and end, or do not end, like a sentence,
    "i word" for the last word of a list item. An open last line has no key: it is what the others are asked about."""
    core = t.rstrip()
    marked = False
    if m := _MARK.search(core):
        core, marked = core[: m.start()].rstrip(), True
    while core.endswith("�"):
        core, marked = core[:-1], True
    lines = core.splitlines()
    keys, fence = [], ""
    for i, line in enumerate(lines):
        three = line[:3]
        if fence:
            if three == fence:
                fence = ""
        elif three in ("```", "~~~"):
            fence = three
        elif i < len(lines) - 1 and line and not line.isspace():
            if m := _ITEM.match(line):
                if w := _WORD.findall(line):
                    keys.append("i " + w[-1].lower())
            elif line[0] not in "#|—":
                text = line[m.end() :] if (m := _SPEAKER.match(line)) else line
                if w := _first(text):
                    keys.append(("s+" if _ended(text) else "s-") + w)
    if not lines:
        return "whole", marked, "", "", keys
    line = lines[-1]
    words = _WORD.findall(line)
    last = words[-1].lower() if words and words[-1][0].islower() and not core[-1].isdigit() else ""
    if fence:
        return "cut", marked, "", "", keys
    if line[:3] in ("```", "~~~"):
        return "whole", marked, "", "", keys
    if line.rfind("[[") > line.rfind("]]"):
        return "cut", marked, "", "", keys
    if line.lstrip().startswith("|"):
        return ("whole" if line.endswith("|") else "cut"), marked, "", "", keys
    item = _ITEM.match(line)
    text = line[item.end() :] if item else line[m.end() :] if (m := _SPEAKER.match(line)) else line
    first = _first(text)
    dots = _DOTS.search(text)
    if dots and not marked:
        before = text[: dots.start()]
        if not before or _ended(before):
            return "whole", marked, first, last, keys
        return "dots", marked, first, last, keys
    if _ended(text):
        if first and not item and line[0] not in "#|—":
            keys.append("s+" + first)
        return "whole", marked, first, last, keys
    if _LINKS.match(text) or _TAGS.match(text) or _URL.match(text) or line.startswith("—") or re.match(r"#{1,6} ", line):
        return ("cut" if marked else "other"), marked, first, last, keys
    if marked or _INNER.search(text):
        return "cut", marked, first, last, keys
    if not words:
        return "whole", marked, first, last, keys
    if item:
        return "item", marked, first, last, keys
    return "line", marked, first, last, keys


def normal_source(source: Column) -> Column:
    """One spelling of a source: lower case, runs of white space, _ and - as one -; null and blank stay null."""
    s = F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "-")
    return F.when(s != "", s)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, ending, marked, first, last, lengths, keys) of each row, written once; blank texts are whole, rows without a key or text are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, s, t in zip(b["key"], b["source"], b["text"], strict=True):
                e, marked, first, last, keys = ending(t)
                rows.append((k, s, e, marked, first, last, lengths(t) if e != "whole" else None, keys))
            yield pd.DataFrame(rows, columns=["key", "source", "ending", "marked", "first", "last", "lengths", "keys"])

    ready()
    kind = docs.schema[key].dataType.simpleString()
    some = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), normal_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    return materialize(some.mapInPandas(run, f"key {kind}, source string, {SCHEMA}"), "endings")


def hidden_limits(measured: DataFrame, least: int = 8, factor: float = 5.0, around: int = 20, keep: float = 0.4) -> DataFrame:
    """(source, encoding, limit, n): lengths that at least `least` open-ended texts of a source share under an encoding,
    and `factor` times as many as their neighbours within `around` have on average. Null sources are one group. least is
    the number below which a pile is no evidence, keep the share of a pile's texts that lie in no larger pile."""
    counted = measured.where("ending != 'whole'").select("source", F.posexplode("lengths").alias("e", "length")).groupBy("source", "e", "length").agg(F.count("*").alias("n"))
    near = counted.where(F.col("n") >= least).select("source", "e", F.col("length").alias("limit"), F.col("n").alias("at"))
    # neighbours by equi-join on blocks of lengths, so that no source is compared with itself as a whole
    block = lambda c: F.floor(c / F.lit(around))
    blocks = near.withColumn("b", F.explode(F.array(*[block(F.col("limit")) + i for i in (-1, 0, 1)])))
    other = counted.select(F.col("source").alias("s2"), F.col("e").alias("e2"), "length", "n", block(F.col("length")).alias("b2"))
    met = blocks.join(other, F.col("source").eqNullSafe(F.col("s2")) & (F.col("e") == F.col("e2")) & (F.col("b") == F.col("b2")))
    dist = F.abs(F.col("length") - F.col("limit"))
    rated = met.groupBy("source", "e", "limit", "at").agg(F.sum(F.when((dist > 3) & (dist <= around), F.col("n")).otherwise(0)).alias("beside"))
    found = rated.where(F.col("at") >= factor * F.greatest(F.lit(1.0), F.col("beside") / (2.0 * (around - 3))))
    # the same texts also pile up a little under encodings that only resemble the field's: each text goes to the largest
    # of its piles, and a pile that keeps too few of its texts is none; another limit of the same source has other texts
    texts = measured.where("ending != 'whole'").select("key", F.col("source").alias("s4"), F.posexplode("lengths").alias("e4", "length"))
    piled = texts.join(found, F.col("s4").eqNullSafe(F.col("source")) & (F.col("e4") == F.col("e")) & (F.col("length") == F.col("limit")))
    own = piled.groupBy("key").agg(F.max_by(F.struct("source", "e", "limit", "at"), F.struct("at", -F.col("e"), -F.col("limit"))).alias("x")).select("x.*")
    found = own.groupBy("source", "e", "limit", "at").agg(F.count("*").alias("kept")).where(F.col("kept") >= keep * F.col("at"))
    return found.select("source", F.element_at(F.array(*map(F.lit, ENCODINGS)), F.col("e") + 1).alias("encoding"), "limit", F.col("at").alias("n"))


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", measured: DataFrame | None = None) -> DataFrame:
    """(key, source, cut, reason, encoding, limit) of each row with a text: whether it was cut inside a word, sentence
    or code block, why that is held, and the hidden limit it lies at, if any.

    Null and blank texts are not cut (null texts have no row). A text under several ids counts under each. A text
    without a source is held against the limits of all sources. Repeated rows give one row."""
    m = measure(docs, key, text, source) if measured is None else measured
    m = m.dropDuplicates(["key"])
    ask = m.where("ending != 'whole'")
    keys = m.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    kind, word = F.substring("k", 1, 2), F.expr("substring(k, 3)")
    begins = keys.where(kind.isin("s+", "s-")).groupBy(word.alias("first")).agg(F.sum(F.when(kind == "s+", F.col("n")).otherwise(0)).alias("ends"), F.sum("n").alias("lines"))
    finals = keys.where((kind == "i ") & (F.col("n") >= 2)).select(word.alias("last"), F.lit(True).alias("known"))
    limits = hidden_limits(m)
    names = {c: i for i, c in enumerate(ENCODINGS)}
    slack = F.create_map(*[x for c in ENCODINGS for x in (F.lit(c), F.lit(3 if c in BYTES else 0))])
    place = F.create_map(*[x for c, i in names.items() for x in (F.lit(c), F.lit(i))])
    at = limits.select(F.col("source").alias("ls"), "encoding", "limit", F.explode(F.sequence(F.lit(0), slack[F.col("encoding")])).alias("short")).select("ls", "encoding", "limit", place[F.col("encoding")].alias("e"), (F.col("limit") - F.col("short")).alias("length"))
    # the limits of all sources serve rows without one
    at = at.unionByName(at.where("ls is not null").withColumn("ls", F.lit(None).cast("string"))).dropDuplicates(["ls", "e", "length"])
    lies = ask.select("key", F.col("source").alias("s"), F.posexplode("lengths").alias("e", "length"))
    lies = lies.join(at.select("ls", F.col("e").alias("le"), F.col("length").alias("ll"), "encoding", "limit"), F.col("s").eqNullSafe(F.col("ls")) & (F.col("e") == F.col("le")) & (F.col("length") == F.col("ll")))
    lies = materialize(lies.groupBy("key").agg(F.min_by(F.struct("encoding", "limit"), F.struct("e", "limit")).alias("at_limit")), "at-limits")
    told = ask.drop("keys", "lengths").join(lies, "key", "left")
    limited = F.col("at_limit").isNotNull()
    # open last lines by their first word, at a limit and elsewhere; a line's own count is taken off again below
    lasts = told.where("ending = 'line'").groupBy("first").agg(F.sum(limited.cast("long")).alias("stops"), F.sum((~limited).cast("long")).alias("free"))
    told = told.join(begins, "first", "left").join(lasts, "first", "left").join(finals, "last", "left").na.fill(0, ["ends", "lines", "stops", "free"])
    elsewhere = F.col("lines") - F.col("ends") + F.col("free")
    prose = (F.col("ends") > 0) & (F.col("ends") >= elsewhere - F.when(limited, 0).otherwise(1))
    known_kind = elsewhere > F.col("stops")
    stump = (F.col("last") != "") & F.col("known").isNull()
    # a hidden limit is the first evidence, how the text ends the second
    open_line = (F.col("ending") == "line") & (prose | ~known_kind)
    reason = (
        F.when(limited & (F.col("ending").isin("cut", "item", "dots", "other") | open_line), F.concat(F.lit("at a limit, open "), F.when(F.col("ending") == "cut", "end").when(F.col("ending") == "other", "address, tag or heading").otherwise(F.col("ending"))))
        .when(F.col("ending") == "cut", F.when(F.col("marked"), "mark after an open end").otherwise("open sentence, code, link or row"))
        .when((F.col("ending") == "line") & prose, "open line that begins like a sentence")
        .when((F.col("ending") == "item") & stump, "list item that ends in no item's last word")
    )
    told = told.select(F.col("key"), "source", reason.alias("reason"), F.col("at_limit.encoding").alias("encoding"), F.col("at_limit.limit").alias("limit"))
    whole = m.where("ending = 'whole'").select("key", "source", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("int").alias("limit"))
    return told.unionByName(whole).select(F.col("key").alias(key), "source", F.col("reason").isNotNull().alias("cut"), "reason", "encoding", "limit")


def truncation_rates(rows: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, n_at_limit, share) from truncated(): n_at_limit of the cut ones lie at a hidden limit; a null source is a row of its own."""
    at_limit = F.sum((F.col("cut") & F.col("limit").isNotNull()).cast("long")).alias("n_at_limit")
    return rows.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut"), at_limit, F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))


def truncation_reasons(rows: DataFrame) -> DataFrame:
    """(reason, encoding, n) from truncated(): on what evidence, and under which encoding's limit, rows count as cut."""
    return rows.where("cut").groupBy("reason", "encoding").agg(F.count("*").alias("n"))
