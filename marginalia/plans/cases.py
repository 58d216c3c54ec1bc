"""Registered queries over literal cases: rules that the tables hardly exercise, each with its result spelled out as SQL values."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.api import Vault
from marginalia.functions import text as tx
from marginalia.operators import audit, delivery, fusion, index as ix, lanes, linking, structure, temporal
from marginalia.plans.catalog import query
from marginalia.sources import vault as src


def _lit(v: object) -> str:
    if v is None:
        return "null"
    return str(v) if isinstance(v, (int, float, bool)) else "'" + str(v).replace("'", "''") + "'"


def values(columns: str, rows: list[tuple], casts: str = "*") -> str:
    return f"select {casts} from (values {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) t({columns})"


# Texts with the days of events inside 2026-07-04 to 2026-07-19; the last are what must not count.
EVENTS = [
    ("We filled in the questionnaire on 7 Jul 2026 ([[Long name 3 Jul 2026]]), review is pending.", "2026-07-07"),
    ("The interview was held on July 9, 2026 in town.", "2026-07-09"),
    ("The anchor moved to 2026-07-15 at noon", "2026-07-15"),
    ("LAST Jul 12 2026 answers", "2026-07-12"),
    ("## 17 July 2026\nx\n## 16 July 2026\ny\n## 15 July 2026\nz", "2026-07-17|2026-07-16|2026-07-15"),
    ("It went out on 8 Jul 2026.", "2026-07-08"),
    ("8 Jul 2026: it went out", "2026-07-08"),
    ("تم الإرسال 7 Jul 2026 صباحا", "2026-07-07"),
    ("The fair ran 5-7 Jul 2026 in the hall", "2026-07-07"),
    ("Health check run 7 Jul 2026. " + "Other lines follow here. " * 12 + "We signed the lease on 7 Jul 2026", "2026-07-07"),
    ("Migrated from paper; signed 8 Jul 2026", "2026-07-08"),
    ("North merged into South; the deal closed 10 Jul 2026", "2026-07-10"),
    ("Form sent 7 Jul 2026. The old layout was superseded later.", "2026-07-07"),
    ("~~~\n6 Jul 2026\n```\n~~~\nand 9 Jul 2026 after it", "2026-07-09"),
    ("﻿---\r\nupdated: 2026-07-05\r\n---\r\n# t\r\nmoved 7 Jul 2026", "2026-07-07"),
    ("seen 7 Jul 2026, again 7 Jul 2026 and [[x 07 Jul 2026]]", "2026-07-07"),
    ("see [[Session 7 July 2026]] there", None),
    ("query `since:2026-07-14` there", None),
    ('```\n"date":"2026-07-10"\n```', None),
    ("[report](https://x.example/2026-07-10/r) there", None),
    ("www.x.example/2026-07-10 there", None),
    ("Table 2026-07-10.md is done", None),
    ("00000186-CLIP-2026-07-10-12-52-58.mp4", None),
    ("ticket ABC-2026-07-10 filed", None),
    ("REF-7 Jul 2026 filed", None),
    ("at 2026-07-10T14:00 sharp", None),
    ("---\nupdated: 2026-07-15\n---\n# X\nno day here", None),
    ("- Jul 9: [[Some summary]]", None),
    ("Date: 12/07/2026", None),
    ('## files (merged from "Long list of questions", 7 Jul 2026)', None),
    ("Renamed from `Untitled.md` (a default name) on 7 Jul 2026", None),
    ("the draft was removed in the 7 Jul 2026 vault dedupe", None),
    ("Adopted during the 7 Jul 2026 vault health check", None),
    ("moved 13 Jun 2026", None),
    ("due 30 Jul 2026", None),
    ("bad 2026-13-40, 31 Jun 2026", None),
]


@query(values("id, dates", [(i, d or "") for i, (_, d) in enumerate(EVENTS)], "id::int id, dates"))
def event_cases(spark, sf):
    """Dated events in prose, newest first; no date where it is part of a name, hidden, or upkeep."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EVENTS)], "id int, raw string")
    ev = temporal.body_events(df, "id", start="2026-07-04", end="2026-07-19").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "date"))), lambda x: x["date"].cast("string")), "|").alias("dates"))
    return df.select("id").join(ev, "id", "left").na.fill("", ["dates"])


#: Questions on 2026-07-15 with the first and last day of their window.
PERIODS = [
    ("what did I do the last 3 days", "2026-07-12", "2026-07-16"), ("the last three days", "2026-07-12", "2026-07-16"), ("past couple of weeks", "2026-07-01", "2026-07-16"), ("a few: previous few months", "2026-04-16", "2026-07-16"),
    ("last 2 months", "2026-05-16", "2026-07-16"), ("notes of last month", "2026-06-14", "2026-07-16"), ("this month", "2026-06-14", "2026-07-16"), ("yesterday", "2026-07-14", "2026-07-15"), ("today please", "2026-07-15", "2026-07-16"),
    ("the past week", "2026-07-08", "2026-07-16"), ("past fortnight", "2026-07-01", "2026-07-16"), ("two weeks", "2026-07-01", "2026-07-16"), ("lately", "2026-07-01", "2026-07-16"), ("these days", "2026-07-01", "2026-07-16"),
    ("آخر 3 أيام", "2026-07-12", "2026-07-16"), ("خلال ٢ أسابيع", "2026-07-01", "2026-07-16"), ("آخر 2 شهور", "2026-05-16", "2026-07-16"), ("ماذا فعلنا امس", "2026-07-14", "2026-07-15"), ("اليوم", "2026-07-15", "2026-07-16"),
    ("أسبوعين", "2026-07-01", "2026-07-16"), ("الأسبوع الماضي", "2026-07-08", "2026-07-16"), ("الشهر الماضي", "2026-06-14", "2026-07-16"), ("مؤخرا", "2026-07-01", "2026-07-16"),
    ("التقارير اليومية", None, None), ("الخامس من الشهور", None, None), ("the budget", None, None), ("yesterdays paper", None, None), ("last forty days", None, None),
]


@query(values("q, d_from, d_to", PERIODS, "q, d_from::date d_from, d_to::date d_to"))
def period_cases(spark, sf):
    df = spark.createDataFrame([(q,) for q, *_ in PERIODS], "q string").withColumn("p", temporal.period(F.col("q"), F.lit("2026-07-15").cast("date")))
    return df.select("q", F.col("p.from").alias("d_from"), F.col("p.to").alias("d_to"))


TOPICS = [("what opportunities moved in the last 3 days", "opportunities"), ("what did I do over the past 7 days", ""), ("anything new on acme and the lease lately", "acme|lease"), ("what happened in the last three weeks", "")]


@query(values("q, topic", TOPICS))
def topic_cases(spark, sf):
    df = spark.createDataFrame([(q,) for q, _ in TOPICS], "q string")
    return df.select("q", F.array_join(F.array_sort(temporal.topic_words(F.col("q"))), "|").alias("topic"))


def _notes(spark, rows: list[tuple]):
    """A corpus of (path, front matter or null, body)."""
    df = spark.createDataFrame([(i + 1, p, f, b) for i, (p, f, b) in enumerate(rows)], "note_id long, path string, frontmatter string, body string")
    df = df.withColumn("aliases", tx.aliases(F.coalesce("frontmatter", F.lit("")))).withColumn("mtime", F.lit("2026-07-10 00:00:00").cast("timestamp"))
    return src.corpus(df)


RECENT = [
    ("Logs/Session 12 July 2026.md", None, "Worked on acme."),
    ("Logs/Session 5 January 2020.md", None, "Old work on acme."),
    ("Knowledge/Acme Deal 1 May 2026.md", None, "The acme proposal was filled 10 Jul 2026."),
    ("Knowledge/Acme Legacy 2 May 2026.md", None, "acme scoping 1 Feb 2026 and 3 Mar 2026; due 1 Aug 2026."),
    ("Knowledge/Acme Own.md", "updated: 2026-07-09", "acme text"),
    *((f"Knowledge/Acme Bulk {c}.md", "updated: 2026-07-11", "acme text") for c in "abcdefg"),
    ("Knowledge/Acme Bulk h.md", "updated: 2026-07-11", "acme text, signed 13 Jul 2026"),
    ("Knowledge/Acme Written.md", None, "acme text; no day but the file's"),
    ("Knowledge/Other Deal 1 May 2026.md", None, "Filled 10 Jul 2026."),
    ("Work/Raw/Acme 12 July 2026.md", None, "acme"),
    ("System/Acme 12 July 2026.md", None, "acme"),
    ("Work/Archive/Acme 12 July 2026.md", None, "acme"),
]


@query(values("path, date, tier, kind", [
    ("Logs/Session 12 July 2026.md", "2026-07-12", 0, "artifact"), ("Knowledge/Acme Deal 1 May 2026.md", "2026-07-10", 0, "event"), ("Knowledge/Acme Bulk h.md", "2026-07-13", 0, "event"),
    ("Knowledge/Acme Own.md", "2026-07-09", 1, "front"), *((f"Knowledge/Acme Bulk {c}.md", "2026-07-11", 2, "bulk") for c in "abcdefg"),
], "path, date::date as date, tier::int tier, kind"))
def recent_cases(spark, sf):
    """What moved on a topic: rescue and promotion by events, bulk days, no deadlines, no file times."""
    return temporal.recent(_notes(spark, RECENT), "2026-07-04", "2026-07-16", ["acme"], None, now="2026-07-15").drop("note_id")


@query(values("path, tier", [("Logs/Session 12 July 2026.md", 0), ("Knowledge/Acme Own.md", 1), *((f"Knowledge/Acme Bulk {c}.md", 2) for c in "abcdefg"), ("Knowledge/Acme Bulk h.md", 0)], "path, tier::int tier"))
def recent_without_topic(spark, sf):
    """Without a topic no note outside the window comes in."""
    return temporal.recent(_notes(spark, RECENT), "2026-07-04", "2026-07-16", None, None, now="2026-07-15").select("path", "tier")


COPIES = [
    ("A/Note-DESKTOP-AB12.md", "A/Note.md"), ("A/Plan-for-Bob's Mac.md", "A/Plan-for.md"), ("A/Note.sync-conflict-20260701-101010-XYZ.md", "A/Note.md"), ("A/Note (Bob's conflicted copy 2026-07-01).md", "A/Note.md"),
    ("Q1-Reports/Sheet-MacBook Air.md", "Q1-Reports/Sheet.md"), ("A/PC-Build.md", None), ("A/Report - Final Draft.md", None), ("A/Lone-LAPTOP-9.md", None), ("A/Note.md", None), ("A/Plan.md", None), ("A/Plan-for.md", None), ("Q1-Reports/Sheet.md", None), ("Q1.md", None), ("A/PC.md", None),
]


@query(values("path, detail", [c for c in COPIES if c[1]]))
def conflict_copy_cases(spark, sf):
    return audit.conflict_copies(_notes(spark, [(p, None, p) for p, _ in COPIES])).select("path", "detail")


HUBS = [
    ("Initiatives/Brand MOC.md", "type: moc", "[[Side Roadmap]]"), ("Initiatives/Initiatives MOC.md", "type: MOC", "x"), ("Initiatives/Voice/Voice Home.md", "type: moc", "x"), ("Initiatives/Voice/Roadmap.md", None, "x"), ("Initiatives/New Venture.md", None, "x"),
    ("Logs/Log Index.md", None, "x"), ("Logs/Day.md", None, "x"), ("Knowledge/Indexing Notes.md", None, "x"), ("Knowledge/The index of things.md", None, "x"), ("Home.md", None, "x"), ("Work/Alpha/Alpha MOC.md", None, "x"), ("Work/Beta/Beta MOC.md", None, "x"), ("Work/Side Roadmap.md", None, "[[Alpha MOC]]"),
    ("Dry/one.md", None, "x"), ("Dry/two.md", None, "x"), ("Dry/three.md", None, "x"),
]


@query(values("path", [(p,) for p in ("Initiatives/Brand MOC.md", "Initiatives/Initiatives MOC.md", "Initiatives/Voice/Voice Home.md", "Logs/Log Index.md", "Home.md", "Work/Alpha/Alpha MOC.md", "Work/Beta/Beta MOC.md")]))
def hub_cases(spark, sf):
    return audit.hubs(_notes(spark, HUBS)).select(F.col("hub").alias("path"))


@query(values("path, hub", [
    ("Initiatives/New Venture.md", "Initiatives/Initiatives MOC.md"), ("Initiatives/Brand MOC.md", "Initiatives/Initiatives MOC.md"), ("Initiatives/Initiatives MOC.md", "Initiatives/Brand MOC.md"), ("Initiatives/Voice/Roadmap.md", "Initiatives/Voice/Voice Home.md"),
    ("Initiatives/Voice/Voice Home.md", "Initiatives/Initiatives MOC.md"), ("Logs/Day.md", "Logs/Log Index.md"),
]))
def governing_hub_cases(spark, sf):
    """The nearest folder's own map before its other maps."""
    c = _notes(spark, HUBS)
    return structure.governing_hub(c, audit.hubs(c))


@query(values("kind, path, detail", [("area-moc-gap", "Work/Alpha/Alpha MOC.md", "Work"), ("hub-gap", "Dry/one.md", "Dry 3"), ("moc-gap", "Initiatives/New Venture.md", "no hub of the folder links it")]))
def gap_cases(spark, sf):
    """Areas without a map, folders without a hub, notes that a hub of their folder does not link; the venture is linked from elsewhere."""
    v = Vault(_notes(spark, [*HUBS, ("Work/Note.md", None, "[[New Venture]]"), ("Initiatives/Voice/Roadmap 2.md", None, "[[Roadmap]]"), ("Initiatives/Voice/Index.md", None, "[[Roadmap]] [[Roadmap 2]]")]), keep=False)
    found = audit.area_gaps(v.corpus, v.edges).unionByName(audit.hub_gaps(v.corpus, v.edges)).unionByName(audit.moc_gaps(v.corpus, v.edges))
    return found.select("kind", "path", "detail")


ROLES = [
    ("who is my manager", True), ("who is my direct manager", True), ("who are my bosses", True), ("who're my managers", True), ("who's our lawyer", True), ("who are our parents", True), ("who is our client", False), ("who is my partner", False),
    ("who is our vendor", False), ("who is Robert", False), ("what is the ratio", False),
]


@query(values("q, asks", ROLES))
def person_question_cases(spark, sf):
    return spark.createDataFrame([(q,) for q, _ in ROLES], "q string").select("q", delivery.asks_for_person(F.col("q")).alias("asks"))


@query(values("qid, honest", [(1, False), (2, True), (3, True)], "qid::bigint qid, honest"))
def person_answer_cases(spark, sf):
    c = _notes(spark, [("Partners/North.md", "type: partner", "account manager"), ("People/Sam.md", "type: partner", "manager"), ("Contacts/Jane.md", "type: contact", "manager")])
    q = spark.createDataFrame([(1, "who is my manager"), (2, "who is my manager"), (3, "who is our boss"), (4, "what is the ratio")], "qid long, question string")
    return delivery.relationship_check(q, spark.createDataFrame([(i, i, 1) for i in (1, 2, 3, 4)], "qid long, note_id long, rank int"), c)


VOCABULARY = [("espresso", 40), ("ratio", 30), ("knowledge", 60), ("xantham", 3), ("goals", 9), ("gaos", 1), ("docs", 12), ("document", 40), ("documentation", 50), ("tram", 5), ("trap", 7), ("milk", 4), ("meetings", 2), ("meeting", 50), ("city", 1), ("cities", 9), ("bake", 8), ("mar", 90), ("mars", 1), ("مشروع", 1), ("المشروع", 7)]
TYPOS = [("expresso", "espresso"), ("zzzqqwx", None), ("gaols", "goals"), ("docum", "document"), ("trax", None), ("milx", "milk"), ("knowlegde", "knowledge"), ("rato", "ratio")]


@query(values("term, correction", TYPOS))
def correction_cases(spark, sf):
    """Words of no note and what they are read as: a word of four letters only where a single candidate is left."""
    q = spark.createDataFrame([(1, t, 0) for t, _ in TYPOS], "qid long, term string, df long")
    v = ix.vocabulary(spark.createDataFrame(VOCABULARY, "term string, df long"))
    got = lanes.corrections(q, v, spark.createDataFrame([(200,)], "n long")).select("term", "correction")
    return q.select("term").join(got, "term", "left")


@query(values("term, variant", [("meetings", "meeting"), ("city", "cities"), ("baking", "bake"), ("مشروع", "المشروع")]))
def inflection_cases(spark, sf):
    words = spark.createDataFrame([("meetings",), ("city",), ("baking",), ("mars",), ("مشروع",), ("tea",)], "term string")
    return lanes.morph_variants(spark.createDataFrame(VOCABULARY, "term string, df long"), words)


@query(values("term, note_id, edits", [("micro", 1, 1), ("calendla", 2, 1), ("projekt", 3, 2), ("mikrosoft", 1, 1)], "term, note_id::bigint note_id, edits::int edits"))
def entity_cases(spark, sf):
    """Names met by a cut word, a slip, or their sound."""
    q = spark.createDataFrame([(i, t, 0) for i, t in enumerate(("micro", "calendla", "zz", "xylophone", "projekt", "mikrosoft"))], "qid long, term string, df long")
    e = spark.createDataFrame([(1, "Microsoft"), (2, "Calendula"), (3, "Priject")], "note_id long, name string")
    got = lanes.entity_fuzzy(q, e, spark.createDataFrame([(200,)], "n long"))
    return got.join(q.select("qid", "term"), "qid").select("term", "note_id", (-F.col("score")).cast("int").alias("edits"))


KNOWN = [("Plans/Colour ABC identification 7 Apr 2026.md", None, "x"), ("Plans/Colour ABC identification 9 Apr 2026.md", None, "x"), ("System/Colour ABC identification 9 Apr 2026.md", None, "x"), ("Plans/Colour wheel.md", None, "colour"), ("Notes/April.md", None, "april 2026")]


@query(values("qid, path, nth", [(1, KNOWN[1][0], 1), (1, KNOWN[0][0], 2), (2, KNOWN[1][0], 1), (2, KNOWN[0][0], 2)], "qid::bigint qid, path, nth::bigint nth"))
def known_item_cases(spark, sf):
    """Dated siblings: the one whose day and month the question names comes first, else the one of the more frequent day, whose
    other words weigh more; System/ has none."""
    v = Vault(_notes(spark, KNOWN), keep=False)
    q = spark.createDataFrame([(1, "colour abc identification 9 apr"), (2, "colour abc identification"), (3, "april")], "qid long, question string")
    t = lanes.with_idf(ix.question_terms(q), v.doc_freq, v.stats)
    return fusion.known_item(t, v.terms, v.lengths, v.doc_freq, v.stats, v.corpus).join(v.corpus.select("note_id", "path"), "note_id").select("qid", "path", F.col("nth").cast("long").alias("nth"))


SIDES = [(1, "tea vs coffee?", "tea|coffee"), (2, "what is the difference between green tea and oolong", "green tea|oolong"), (3, "Berlin compared to the Hague", "Berlin|Hague"), (4, "tea", None), (5, "the vs a", None)]


@query(values("qid, sides", [(i, s) for i, _, s in SIDES if s], "qid::bigint qid, sides"))
def comparison_cases(spark, sf):
    s = fusion.compare_sides(spark.createDataFrame([(i, q) for i, q, _ in SIDES], "qid long, question string"))
    return s.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("side", "question"))), lambda x: x["question"]), "|").alias("sides"))


VAULT = [
    ("Knowledge/Espresso Ratios.md", "type: knowledge", "# Espresso\n\nGrind the arabica beans for a balanced extraction, one part coffee to two parts water."),
    ("Knowledge/Milk Steaming.md", "type: knowledge", "# Milk\n\nSteam whole milk to sixty degrees for a silky texture."),
    ("People/Ana Diaz.md", "type: person\naliases: [Anita Diaz]", "Ana roasts arabica beans and trains new baristas."),
    ("Partners/North Roasters.md", "type: partner", "Our account manager there visits in spring."),
    ("Logs/Session 5 June 2026.md", "type: log", "Talked about invoices and the lease of the second shop."),
    ("Plans/Lease terms review board 3 Mar 2026.md", None, "Terms of the lease, draft."),
    ("Plans/Lease terms review board 9 Apr 2026.md", None, "Terms of the lease, final."),
    ("Index.md", None, "[[Espresso Ratios]] [[Milk Steaming]] [[Ana Diaz]] [[North Roasters]]"),
]
ASKED = [
    (1, "espresso ratios", True, "Knowledge/Espresso Ratios.md"), (2, "zzqx wvvk qqqq", False, None), (3, "silky texture degrees", True, "Knowledge/Milk Steaming.md"), (4, "espreso ratois", True, "Knowledge/Espresso Ratios.md"),
    (5, "espresso ratios vs milk steaming", True, "Knowledge/Espresso Ratios.md"), (6, "who is our account manager", False, None), (7, "anita diaz", True, "People/Ana Diaz.md"), (8, "lease terms review board", True, "Plans/Lease terms review board 3 Mar 2026.md"),
    (9, "lease terms review board 9 apr", True, "Plans/Lease terms review board 9 Apr 2026.md"), (10, "", False, None),
]


def _recalled(spark):
    v = Vault(_notes(spark, VAULT))
    return v.recall(spark.createDataFrame([(i, q) for i, q, *_ in ASKED], "qid long, question string"), as_of="2026-07-15")


@query(values("qid, path", [(i, p) for i, _, _, p in ASKED if p], "qid::bigint qid, path"))
def recall_case_answers(spark, sf):
    """The whole engine on a literal vault: known items, slips, comparisons, aliases, dated siblings; nothing for what it refuses."""
    return _recalled(spark)[0].where("rank = 1").select("qid", "path")


@query(values("qid, found, choices", [(i, f, 2 if i == 8 else 0) for i, _, f, _ in ASKED], "qid::bigint qid, found, choices::int choices"))
def recall_case_outcomes(spark, sf):
    """What is refused, and where the asker is to choose between dated versions."""
    return _recalled(spark)[1].select("qid", "found", F.size("clarify").alias("choices"))


LINKED = [
    ("People/Ana Diaz.md", "aliases: [Anita]", "x"), ("Knowledge/Milk Steaming.md", None, "Ask Ana Diaz or Anita about milk steaming. `Ana Diaz` is in code, a [[Roast]] is linked."), ("Knowledge/Beans.md", None, "Nobody knows beans; the State of the Union Address 2021 in Brief was read, so the roast and Roast.md and pre-Roast."),
    ("Knowledge/Tea.md", None, "Ana Diazo is another. See milk steaming and Milk Steaming. Ana\nDiaz. Anita came."), ("Work/The State of the Union Address 2021 in Brief.md", "aliases: [State of the Union Address 2021 in Brief]", "Beans, not roast"),
    ("Knowledge/Roast.md", None, "x"), ("Templates/Beans Plan.md", None, "x"), ("Knowledge/Old Roast.md", "aliases: [Roast]", "x"),
]


@query(values("path, target", [
    ("Knowledge/Milk Steaming.md", "People/Ana Diaz.md"), ("Knowledge/Tea.md", "Knowledge/Milk Steaming.md"), ("Knowledge/Tea.md", "People/Ana Diaz.md"), ("Knowledge/Beans.md", "Work/The State of the Union Address 2021 in Brief.md"),
    ("Knowledge/Beans.md", "Knowledge/Roast.md"), ("Work/The State of the Union Address 2021 in Brief.md", "Knowledge/Beans.md"), ("Work/The State of the Union Address 2021 in Brief.md", "Knowledge/Roast.md"),
]))
def suggestion_cases(spark, sf):
    """Names in notes that could be links: one for each target, none to what is linked already, none inside longer words."""
    c = _notes(spark, LINKED)
    return linking.suggest(linking.mentions(c, linking.patterns(c)), c).select("path", "target")


FRAMED = [
    ("latest on the lease?", "the lease?", True, False), ("can you pull up beans for me", "beans", False, False), ("what was the deal with tea again?", "tea", False, False), ("where did we leave the lease this week", "the lease this week", True, False),
    ("build me a plan based on what we know about tea", "tea", False, True), ("show me", "show me", False, False), ("build plan", "build plan", False, False), ("catch me up on beans", "beans", True, False), ("وش سالفة المشروع", "المشروع", False, False),
]


@query(values("q, bare, recent, build", FRAMED))
def frame_cases(spark, sf):
    """Questions without their phrases of asking, and what these ask for."""
    q = F.col("q")
    return spark.createDataFrame([(x,) for x, *_ in FRAMED], "q string").select("q", tx.strip_frames(q).alias("bare"), tx.is_temporal(q).alias("recent"), tx.is_build(q).alias("build"))
