"""Time windows: periods in questions, dated events in bodies, recent activity with bulk edits told apart."""

from __future__ import annotations

import datetime as dt
import re
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as tx
from marginalia.session import ready

# How periods are spoken of, in English and Arabic, with the numbers that may stand in them.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "a": 1, "couple": 2, "few": 3}
LAST_N = r"\b(?:last|past|previous|recent)\s+([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten|a|couple(?:\s+of)?|few)\s+(day|days|week|weeks|month|months)\b"
LAST_N_AR = r"(?:آخر|اخر|خلال|في\s*آخر)\s*([0-9]+)\s*(يوم|أيام|ايام|أسبوع|اسبوع|أسابيع|اسابيع|شهر|أشهر|اشهر|شهور)"
YESTERDAY = r"\byesterday\b|(?<![ء-ي])(?:أمس|امس)(?![ء-ي])|البارحة|مبارح|امبارح"
TODAY = r"\btoday\b|(?<![ء-ي])اليوم(?![ء-ي])|النهاردة"
TWO_WEEKS = r"\b(?:last|past|this|previous)\s+(?:fortnight|two weeks)\b|\btwo weeks\b|أسبوعين|اسبوعين"
WEEK = r"\b(?:last|past|this|previous)\s+week\b|(?:الأسبوع|الاسبوع)\s*(?:الماضي|الفائت|المنصرم|الحالي|ده)|آخر\s*(?:أسبوع|اسبوع)"
MONTH = r"\b(?:last|past|this|previous)\s+month\b|الشهر\s*(?:الماضي|الفائت|المنصرم|الحالي|ده)|آخر\s*شهر"
LATELY = r"\b(?:lately|recently|of late|these days|nowadays)\b|مؤخرا|هذه\s*الأيام|هالأيام|في\s*الآونة|الآونة\s*الأخيرة"
# Phrases of upkeep, which make a date no event.
MAINTENANCE = r"\b(?:merged\s+from|renamed\s+from|vault\s+(?:health|audit|dedupe|cleanup)|health\s+check|adopted\s+during|removed\s+in\s+the)\b"
# Words of a question about a period that are no topic, and spelled counts.
NO_TOPIC = (
    "what did does was were have has had the and for over last past previous recent recently lately day days week weeks month months two yesterday today this that "
    "happen happened across get give our with how when since ago you work working worked done are "
    "real really movement moved move moving active actively right now current currently still actually genuine genuinely going progress update updates new latest been about made make any some thing things stuff there"
).split()
COUNTS = "one three four five six seven eight nine ten eleven twelve fourteen fifteen twenty thirty sixty ninety hundred couple few several".split()
#: Days a window may reach back; what a question asks beyond it is no longer a calendar date.
FURTHEST = 700_000


def period(question: Column, today: Column) -> Column:
    """struct(from, to, label) of the window a question names, null without one. Both ends are inclusive, and a window ends at
    midnight of a day: "yesterday" therefore also holds notes dated today, as the definition has it. "last month" is 31 days,
    "last 2 months" 60. Numbers may be spelled; Arabic words count only where they stand alone."""
    q = F.lower(tx.fold_digits(question))
    number, unit = F.regexp_replace(F.regexp_extract(q, LAST_N, 1), r"\s+of$", ""), F.substring(F.regexp_extract(q, LAST_N, 2), 1, 1)
    spelled = F.create_map(*[F.lit(x) for x in chain(*NUMBERS.items())])
    n = F.when(number.rlike("^[0-9]+$"), F.coalesce(number.try_cast("bigint"), F.lit(FURTHEST))).otherwise(spelled[number].cast("bigint"))
    n_ar = F.coalesce(F.regexp_extract(q, LAST_N_AR, 1).try_cast("bigint"), F.lit(FURTHEST))
    unit_ar = F.regexp_extract(q, LAST_N_AR, 2)
    kind = F.when(unit_ar.rlike("^(أسبوع|اسبوع|أسابيع|اسابيع)$"), "w").when(unit_ar.rlike("^(شهر|أشهر|اشهر|شهور)$"), "m").otherwise("d")
    each = lambda u: F.when(u == "w", 7).when(u == "m", 30).otherwise(1)
    name = lambda u: F.when(u == "w", "week").when(u == "m", "month").otherwise("day")
    back = lambda days: F.least(days, F.lit(FURTHEST)).cast("int")

    def win(a: Column, b: int, label: Column | str) -> Column:
        return F.struct(F.date_add(today, a).alias("from"), F.date_add(today, b).alias("to"), (F.lit(label) if isinstance(label, str) else label).alias("label"))

    return (
        F.when(q.rlike(LAST_N), win(-back(F.least(n, F.lit(FURTHEST)) * each(unit)), 1, F.concat_ws(" ", F.lit("last"), n.cast("string"), F.concat(name(unit), F.when(n == 1, "").otherwise("s")))))
        .when(q.rlike(LAST_N_AR), win(-back(F.least(n_ar, F.lit(FURTHEST)) * each(kind)), 1, F.concat_ws(" ", F.lit("last"), n_ar.cast("string"), F.concat(name(kind), F.lit("s")))))
        .when(q.rlike(YESTERDAY), win(F.lit(-1), 0, "yesterday"))
        .when(q.rlike(TODAY), win(F.lit(0), 1, "today"))
        .when(q.rlike(TWO_WEEKS), win(F.lit(-14), 1, "last two weeks"))
        .when(q.rlike(WEEK), win(F.lit(-7), 1, "last week"))
        .when(q.rlike(MONTH), win(F.lit(-31), 1, "last month"))
        .when(q.rlike(LATELY), win(F.lit(-14), 1, "recently"))
    )


def topic_words(question: Column) -> Column:
    """A question's tokens without words of asking about a period and without the period's size."""
    bare = lambda w: F.trim(F.regexp_replace(w, r"[0-9\s]+", ""))
    return F.array_distinct(F.filter(tx.tokens(question), lambda w: ~w.isin(*NO_TOPIC) & ~w.isin(*COUNTS) & (bare(w) != "") & ~bare(w).isin(*NO_TOPIC)))


_FRONT = re.compile(r"\ufeff?---.*?\r?\n---\r?\n?", re.S)
_FENCE = re.compile(r"\s*(```|~~~)")
_HIDDEN = re.compile(r"`[^`\n]+`|\[\[[^\]\n]{0,300}\]\]|\]\([^)\n]{0,1000}\)|(?:https?://|www\.)[^\s)\]>]+", re.I)
_SHAPES = (
    (re.compile(r"([0-9]{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?\s+(20[0-9]{2})"), (3, 2, 1)),
    (re.compile(r"([A-Za-z]{3,9})\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+(20[0-9]{2})"), (3, 1, 2)),
    (re.compile(r"(20[0-9]{2})-([0-9]{2})-([0-9]{2})"), (1, 2, 3)),
)
_UPKEEP = re.compile(MAINTENANCE, re.I)
_MONTH_NO = {m: tx.MONTHS.index(m[:3]) + 1 for m in tx.MONTHS}


def prose_only(text: str) -> str:
    """A text of the same length in which fenced blocks, inline code, link targets and addresses are blank."""
    out, open_ = [], ""
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if m and (not open_ or m[1] == open_):
            open_ = "" if open_ else m[1]
            line = " " * len(line)
        elif open_:
            line = " " * len(line)
        elif any(c.isdigit() for c in line):
            line = _HIDDEN.sub(lambda h: " " * len(h[0]), line)
        out.append(line)
    return "\n".join(out)


def _stands_alone(text: str, start: int, end: int, iso: bool) -> bool:
    """Whether a date is no part of a name, path or number; a range of days ("5-7 Jul 2026") is none."""
    before = text[start - 1 : start]
    if before == "-":
        if iso or not text[start - 2 : start - 1].isdigit():
            return False
    elif before and before in "/\\._:@" or before.isascii() and before.isalnum():
        return False
    return not re.match(r"\.[A-Za-z0-9]|[-:T][0-9]", text[end : end + 2])


def events_in(text: str, start: dt.date | None = None, end: dt.date | None = None, scan: int | None = None, cap: int | None = None) -> list[tuple[dt.date, str]]:
    """(date, snippet) of the dated events in a file's prose, newest first, each date once where it first counts."""
    body = _FRONT.sub("", text, count=1) if _FRONT.match(text) else text
    body = body[:scan]
    plain, found = prose_only(body), {}
    for shape, (y, m, d) in _SHAPES:
        for hit in shape.finditer(plain):
            month = int(hit[m]) if hit[m].isdigit() else _MONTH_NO.get(hit[m].lower())
            try:
                date = dt.date(int(hit[y]), month or 0, int(hit[d]))
            except ValueError:
                continue
            a, b = hit.span()
            if date in found or (start and date < start) or (end and date > end) or not _stands_alone(body, a, b, shape is _SHAPES[2][0]):
                continue
            if _UPKEEP.search(body[max(0, a - 140) : b + 50]):
                continue
            near = " ".join(re.sub("[\\ufeff]", "", re.sub("[\\x00-\\x1f\\x7f]", " ", body[max(0, a - 70) : b + 70])).split())
            found[date] = near if len(near) <= 160 else near[:159] + "…"
    return sorted(found.items(), reverse=True)[:cap]


def body_events(notes: DataFrame, key: str = "path", text: str = "raw", scan: int | None = None, cap: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(key, date, snippet, nth): dates with a year in the prose of files (5 Jul 2026, July 5, 2026, 2026-07-05), each once a
    note, the newest first. Front matter, code, links and addresses are left out, as are dates that are part of a name, path
    or number, and those whose own surroundings tell of upkeep. The definition reads 20,000 characters (scan) and gives five
    dates (cap); None, as here, means all. Null texts give no rows."""
    a, b = (None if x is None else dt.date.fromisoformat(x) for x in (start, end))

    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{"date": d, "snippet": s} for d, s in events_in(x, a, b, scan, cap)])

    ready()
    some = notes.where(F.col(text).rlike("20[0-9]{2}")).select(F.col(key).alias("key"), F.col(text).alias("t"))
    each = some.select("key", F.posexplode(F.pandas_udf(run, "array<struct<date:date,snippet:string>>")("t")).alias("at", "x"))
    return each.select(F.col("key").alias(key), "x.date", "x.snippet", (F.col("at") + 1).alias("nth"))


def dated(corpus: DataFrame) -> DataFrame:
    """(note_id, path, date, source): each note's content date, by name, front matter or folder, else the day it was last written."""
    d = corpus.withColumn("d", tx.note_date(F.col("path"), F.col("front")))
    return d.select("note_id", "path", F.coalesce("d.date", F.to_date("mtime")).alias("date"), F.coalesce("d.source", F.lit("mtime")).alias("source"))


def bulk_days(dated: DataFrame, least: int = 8) -> DataFrame:
    """(date, n): front-matter days that eight notes or more share: edited in bulk, so that they tell nothing of the day."""
    return dated.where("source = 'front'").groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def topic_hits(corpus: DataFrame, topic: list[str], chars: int | None = 500) -> DataFrame:
    """(note_id) of notes with one of the words in their path or the first `chars` characters of their file (None: all of it)."""
    words = F.array(*[F.lit(t) for t in topic]) if topic else F.array().cast("array<string>")
    text = F.col("raw") if chars is None else F.substring("raw", 1, chars)
    return corpus.where(F.arrays_overlap(tx.tokens(F.concat_ws(" ", "path", text)), words)).select("note_id")


def recent(corpus: DataFrame, start: str, end: str, topic: list[str] | None = None, limit: int | None = 40, now: str | None = None, scans: int | None = None, chars: int | None = 500, bulk: int = 8) -> DataFrame:
    """(note_id, path, date, tier, kind): what happened from start to end, newest first: tier 0 artifacts (dated by name or
    folder) and events (dated in their text, no later than now), tier 1 notes dated by front matter, tier 2 those whose
    front-matter day `bulk` notes of the window share.

    A note without such a date, as one that was only written to, is never inside a window. Notes outside it come in only by
    an event and only with a topic; a bulk note rises by one. Archived notes, System/ and Raw/ are left out. The definition
    looks for events in the 400 newest such notes (scans); None means all. Ties: artifacts first, then path."""
    path = F.col("path")
    live = corpus.where(~tx.is_archived(path) & ~path.startswith("System/") & ~path.rlike("(^|/)Raw/")).withColumn("d", tx.note_date(path, F.col("front")))
    live = live.select("note_id", "path", "raw", "d.date", "d.source")
    inside = F.coalesce(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    x = live.withColumn("inside", inside).withColumn("front", F.col("inside") & (F.col("source") == "front"))
    days = x.where("front").groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") >= bulk).select("date", F.lit(True).alias("shared"))
    x = x.join(days, "date", "left").withColumn("shared", F.col("front") & F.coalesce("shared", F.lit(False)))
    if topic:
        x = x.join(topic_hits(x, topic, chars), "note_id", "left_semi")
    else:
        x = x.where("inside")
    asked = x.where("shared or not inside")
    if scans is not None:
        asked = asked.orderBy(F.desc("date"), "path").limit(scans)
    events = body_events(asked, "note_id", start=start, end=now or end).where("nth = 1").select("note_id", F.col("date").alias("event"))
    x = x.drop("raw").join(events, "note_id", "left").where("inside or event is not null")
    eventful = F.col("event").isNotNull()
    kind = F.when(~F.col("inside") | (F.col("shared") & eventful), "event").when(F.col("source") != "front", "artifact").when(F.col("shared"), "bulk").otherwise("front")
    day = F.when(~F.col("inside"), F.col("event")).when(F.col("shared") & eventful, F.greatest("date", "event")).otherwise(F.col("date"))
    x = x.select("note_id", "path", day.alias("date"), kind.alias("kind")).withColumn("tier", F.when(F.col("kind").isin("artifact", "event"), 0).when(F.col("kind") == "front", 1).otherwise(2))
    out = x.select("note_id", "path", "date", "tier", "kind")
    return out if limit is None else out.orderBy("tier", F.desc("date"), F.col("kind") != "artifact", "path").limit(limit)


def activity(actions: DataFrame, notes: DataFrame, limit: int | None = 30) -> DataFrame:
    """(at_ms, path, what): logged writes and changes of files that no log explains: a file's time counts unless it lies within a
    second after the last logged write of its path."""
    wrote = actions.where(F.lower(F.trim("action_kind")).isin("write", "append", "move", "archive", "remember") & F.col("path").isNotNull())
    last = wrote.groupBy("path").agg(F.max("at_ms").alias("last"))
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(mtime as timestamp_ntz))")  # UTC whatever the session's zone
    outside = notes.where("mtime is not null").select("path", ms.alias("at_ms")).join(last, "path", "left").where(F.col("last").isNull() | (F.col("at_ms") > F.col("last") + 1000)).select("at_ms", "path", F.lit("changed outside").alias("what"))
    all_ = actions.where("at_ms is not null").select("at_ms", "path", F.lower(F.trim("action_kind")).alias("what")).unionByName(outside)
    newest = all_.orderBy(F.desc("at_ms"), "path", "what")
    return newest if limit is None else newest.limit(limit)
