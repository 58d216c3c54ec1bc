"""The audit: rules over notes and edges, each a filter, an anti join or an aggregate; all give (kind, path, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import graph

# Fixed values of the default configuration.
REQUIRED = ("type", "tags", "status", "updated")
TYPES = ("profile", "knowledge", "initiative", "project", "person", "memory", "log", "milestone", "moc", "reference", "system", "content study")
STATUSES = ("active", "idea", "parked", "done", "archived", "complete")
PARTITIONS = ("Profile", "Knowledge", "Initiatives", "People", "Memory", "Logs", "Milestones", "Personal", "Private", "Inbox", "Reference", "Templates", "System", "Work", "Social Media")
PLACEHOLDERS = "name names link links text note notes example examples title tag tags foo bar baz thing item items key value id page slug label field type x y z".split()
INTEGRITY = ("broken-wikilink", "missing-frontmatter", "invalid-frontmatter", "duplicate-alias", "sync-conflict-copy")


def in_verbatim(path: Column) -> Column:
    return F.lower(path).rlike("(^|/)raw/") | F.lower(path).rlike("(^|/)recovered sessions/")


def is_exempt(path: Column) -> Column:
    base, low = F.lower(F.substring_index(path, "/", -1)), F.lower(path)
    return in_verbatim(path) | path.startswith("System/") | (F.substring_index(path, "/", -1) == "SKILL.md") | low.rlike("(^|/)transcripts?/") | base.rlike("(^|[^a-z0-9_])transcripts?([^a-z0-9_]|$)")


def is_hub(path: Column, front: Column) -> Column:
    base = F.lower(tx.basename(path))
    return F.coalesce(F.lower(tx.front_value(F.substring(front, 1, 400), "type")) == "moc", F.lit(False)) | base.isin("home", "overview", "index") | base.endswith(" index") | base.endswith(" moc")


def _finding(df: DataFrame, kind: str, path: Column | str, detail: Column | str) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), (F.col(path) if isinstance(path, str) else path).alias("path"), detail.alias("detail") if isinstance(detail, Column) else F.lit(detail).alias("detail"))


def broken_links(edges: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    bad = edges.where("unresolved and source = 'wikilink'").where(~in_verbatim(F.col("src")) & ~F.col("src").startswith("System/"))
    name = F.lower(F.trim(tx.basename(F.col("dst"))))
    bad = bad.where(~F.col("dst").rlike(r'[<>*?"{}]') & ~((F.trim(tx.basename(F.col("dst"))) == name) & name.isin(PLACEHOLDERS)))
    if attachments is not None:
        bad = bad.join(attachments.select("name"), F.lower(F.substring_index("dst", "/", -1)) == F.col("name"), "left_anti")
    return _finding(bad, "broken-wikilink", "src", F.col("dst"))


def vocabulary(corpus: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(value, n): front-matter values that at least three notes use."""
    return corpus.select(tx.front_value(F.col("front"), key).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def conformance(corpus: DataFrame) -> DataFrame:
    """Missing front matter, required fields missing or empty, types and statuses neither configured nor in use by three notes."""
    some = corpus.where(~is_exempt(F.col("path"))).withColumn("top", tx.top_folder(F.col("path")))
    bare = some.where("front is null").where(F.col("top").isin(*PARTITIONS) & ~F.col("top").isin("Inbox", "Reference"))
    has = some.where("front is not null")
    need = has.select("path", "front", F.explode(F.array(*map(F.lit, REQUIRED))).alias("field"))
    line = F.concat(F.lit(r"(?im)^"), F.col("field"), F.lit(r":[ \t]*([^\r\n]*(?:\r?\n[ \t]+-[^\r\n]*)*)"))
    value = F.call_function("regexp_extract", F.col("front"), line, F.lit(1))
    missing = F.regexp_count("front", F.concat(F.lit(r"(?im)^"), F.col("field"), F.lit(":"))) == 0
    empty = F.regexp_replace(value, r"[\[\]\s\"']", "") == ""
    fields = need.select("path", F.when(missing, F.concat(F.lit("missing "), "field")).when(empty, F.concat(F.lit("empty "), "field")).alias("detail")).where("detail is not null")
    out = _finding(bare, "missing-frontmatter", "path", F.col("top")).unionByName(_finding(fields, "invalid-frontmatter", "path", F.col("detail")))
    for kind, key, known in (("unknown-type", "type", TYPES), ("invalid-status", "status", STATUSES)):
        v = has.select("path", tx.front_value(F.col("front"), key).alias("value")).where(F.col("value").isNotNull() & ~F.col("value").isin(*known))
        out = out.unionByName(_finding(v.join(vocabulary(corpus, key), "value", "left_anti"), kind, "path", F.col("value")))
    return out


def orphans(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.where("not unresolved")
    linked = e.select(F.col("src").alias("path")).unionByName(e.select(F.col("dst").alias("path"))).distinct()
    leaf = is_hub(F.col("path"), F.col("front")) | F.col("path").rlike("^(Templates|Inbox)/") | in_verbatim(F.col("path")) | F.col("path").rlike("(^|/)Reference/Skills/")
    return _finding(corpus.where(~leaf).join(linked, "path", "left_anti"), "orphan-note", "path", F.lit(None).cast("string"))


def hubs(corpus: DataFrame) -> DataFrame:
    """(hub, dir) of the notes that are maps of content."""
    return corpus.where(is_hub(F.col("path"), F.col("front"))).select(F.col("path").alias("hub"), tx.folder(F.col("path")).alias("dir"))


def is_area_map(hub: Column, folder: Column) -> Column:
    """Whether a hub is named after a folder, but for a general word at its end and a plural s on either side."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    core = F.regexp_replace(F.trim(F.regexp_replace(flat(tx.basename(hub)), r"\s+(moc|home|index|hub)$", "")), "s$", "")
    return (core != "") & (core == F.regexp_replace(flat(folder), "s$", ""))


def _skipped(path: Column) -> Column:
    return path.rlike("^(System|Templates|Inbox)/") | in_verbatim(path) | path.rlike("(^|/)Reference/Skills/")


def moc_gaps(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes beside hubs of which none links them, and notes that link a hub which does not link back; orphans are left out."""
    h = hubs(corpus)
    e = edges.where("not unresolved").select("src", "dst").distinct()
    alone = orphans(corpus, edges).select("path")
    notes = corpus.where(~_skipped(F.col("path"))).select("path", tx.folder(F.col("path")).alias("dir")).join(h.select(F.col("hub").alias("path")), "path", "left_anti").join(alone, "path", "left_anti")
    from_hub = e.join(h.select(F.col("hub").alias("src"), F.col("dir").alias("hub_dir")), "src")
    here = notes.join(h.select("dir").distinct(), "dir", "left_semi").join(from_hub.select(F.col("dst").alias("path"), F.col("hub_dir").alias("dir")), ["path", "dir"], "left_anti")
    away = notes.where(~F.col("path").startswith("Memory/")).join(h.select("dir").distinct(), "dir", "left_anti").join(from_hub.select(F.col("dst").alias("path")), "path", "left_anti")
    away = away.join(e.join(h.select(F.col("hub").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"), "dst"), "path").groupBy("path").agg(F.min("dst").alias("hub"))
    return _finding(here, "moc-gap", "path", "no hub of the folder links it").unionByName(_finding(away, "moc-gap", "path", F.col("hub")))


def hub_gaps(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    """Folders of three notes or more without a hub, none of whose notes a hub links."""
    h = hubs(corpus)
    from_hub = edges.where("not unresolved").join(h.select(F.col("hub").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct().withColumn("wired", F.lit(1))
    notes = corpus.where(~_skipped(F.col("path"))).select("path", tx.folder(F.col("path")).alias("dir")).where("dir != ''").join(h.select(F.col("hub").alias("path")), "path", "left_anti")
    by = notes.join(from_hub, "path", "left").groupBy("dir").agg(F.count("*").alias("n"), F.count("wired").alias("wired"), F.min("path").alias("path")).where("n >= 3 and wired = 0")
    return _finding(by.join(h.select("dir"), "dir", "left_anti"), "hub-gap", "path", F.concat_ws(" ", "dir", F.col("n").cast("string")))


def area_gaps(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    """Partitions with two hubs or more one folder down and no map of their own that names them, is general, or links half of them."""
    h = hubs(corpus).withColumn("top", tx.top_folder(F.col("hub"))).where(~F.col("top").isin("", "Templates", "Inbox", "System"))
    sub, root = h.where(F.size(F.split("dir", "/")) == 2), h.where(F.col("dir") == F.col("top"))
    many = sub.groupBy("top").agg(F.count("*").alias("k"), F.min("hub").alias("path")).where("k >= 2")
    e = edges.where("not unresolved").select("src", "dst").distinct()
    links = root.join(e, F.col("hub") == F.col("src")).join(sub.select(F.col("hub").alias("dst")), "dst", "left_semi").groupBy("hub").agg(F.count("*").alias("links"))
    named = is_area_map(F.col("hub"), F.col("top")) | F.lower(tx.basename(F.col("hub"))).isin("home", "overview", "index", "moc")
    area = root.join(links, "hub", "left").na.fill(0, ["links"]).join(many.select("top", "k"), "top").where(named | (F.col("links") >= F.ceil(F.col("k") / 2)))
    return _finding(many.join(area.select("top"), "top", "left_anti"), "area-moc-gap", "path", F.col("top"))


def dated_drift(corpus: DataFrame) -> DataFrame:
    """Memory and log notes that were updated two days or more after their date."""
    d = lambda k: F.try_to_date(F.regexp_extract(tx.front_value(F.col("front"), k), "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    days = F.datediff(d("updated"), d("date"))
    return _finding(corpus.where(F.lower(tx.front_value(F.col("front"), "type")).isin("memory", "log")).withColumn("days", days).where("days >= 2"), "dated-note-drift", "path", F.col("days").cast("string"))


def duplicate_aliases(corpus: DataFrame) -> DataFrame:
    """Names that two notes or more claim, but for structural names, conflict copies, and names all in raw imports or meetings."""
    structural = ("home", "overview", "index", "readme", "skill", "log index", "moc")
    c = graph.collisions(corpus).where(~F.col("name").isin(*structural)).select("name", F.explode("paths").alias("path"))
    copy = F.col("path").rlike(r"(^|/)Quarantine\b") | F.lower(F.substring_index("path", "/", -1)).rlike("-[^/]*(macbook|imac|desktop|laptop|['’]s )")
    raw, met = F.lower("path").rlike("(^|/)raw/"), F.lower("path").rlike("(^|/)meetings/")
    by = c.where(~copy).groupBy("name").agg(F.count("*").alias("n"), F.sum(raw.cast("int")).alias("r"), F.sum(met.cast("int")).alias("m"), F.min(F.struct(tx.depth(F.col("path")), "path"))["path"].alias("path"))
    return _finding(by.where("n >= 2 and r < n and m < n"), "duplicate-alias", "path", F.concat_ws(" ", "name", F.col("n").cast("string")))


def conflict_copies(corpus: DataFrame) -> DataFrame:
    """Copies that a sync left beside a note, by three shapes of their names; the original must exist.

    A device's name may hold hyphens itself: the shortest end of the basename that is shaped like one counts."""
    p = F.col("path")
    # The shapes of file names that sync tools make.
    thing = F.regexp_extract(p, r"^(.*)\.sync-conflict-[0-9]{8}-[0-9]{6}-[^./]+\.md$", 1)
    told = F.regexp_extract(p, r"^(.*) \([^()]*?(?:conflicted copy|sync-conflict)[^)]*\)\.md$", 1)
    device = r"(?i)^(?:(?:desktop|laptop|macbook)[- ]\S|.*['’]s(?:\s|$))"
    parts = F.split(F.regexp_replace(F.substring_index(p, "/", -1), r"(?i)\.md$", ""), "-")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - i), "-").alias("stem"), F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "-").alias("end")))
    stem = F.get(F.filter(ends, lambda x: x["end"].rlike(device)), F.lit(0))["stem"]
    base = F.when(thing != "", thing).when(told != "", told).when((F.size(parts) > 1) & stem.isNotNull(), F.concat(F.regexp_replace(p, "[^/]*$", ""), stem))
    c = corpus.select("path", F.concat(base, F.lit(".md")).alias("original")).where("original is not null and original != path")
    return _finding(c.join(corpus.select(F.col("path").alias("original")), "original", "left_semi"), "sync-conflict-copy", "path", F.col("original"))


def audit(corpus: DataFrame, edges: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """All findings (kind, path, detail)."""
    out = broken_links(edges, attachments)
    for part in (conformance(corpus), orphans(corpus, edges), moc_gaps(corpus, edges), hub_gaps(corpus, edges), area_gaps(corpus, edges), dated_drift(corpus), duplicate_aliases(corpus), conflict_copies(corpus)):
        out = out.unionByName(part)
    return out


def skipped_checks(has_schema: bool, has_attachments: bool) -> list[tuple[str, str]]:
    """The checks that a run can't make, and why, to be shown with its findings."""
    out = [] if has_schema else [("conformance", "the vault brings no configuration; the default was held against it")]
    return out if has_attachments else [*out, ("broken-wikilink", "links to attachments can't be told from broken ones")]


def finding_key(kind: Column, path: Column, detail: Column) -> Column:
    return F.concat_ws("|", kind, path, F.when(kind.isin("broken-wikilink", "duplicate-alias", "sync-conflict-copy", "invalid-frontmatter"), detail))


def without_dismissed(findings: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Findings whose key is not among the dismissed (key)."""
    return findings.withColumn("key", finding_key(F.col("kind"), F.col("path"), F.col("detail"))).join(dismissed.select("key"), "key", "left_anti")


def by_kind(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("n"))


def health(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """One row (score): 100 less the weighted findings a note, between 40 and 100; integrity counts whole, the rest a tenth."""
    w = findings.agg(F.coalesce(F.sum(F.when(F.col("kind").isin(*INTEGRITY), F.lit(1.0)).otherwise(0.1)), F.lit(0.0)).alias("w"))
    n = notes.agg(F.count("*").alias("n"))
    return w.join(n).select(F.least(F.greatest(F.round(100 - 100 * F.col("w") / F.greatest("n", F.lit(1))), F.lit(40.0)), F.lit(100.0)).cast("int").alias("score"))


# Groups of findings as they are shown, with their weight.
CARDS = (
    ("links", "warn", ("broken-wikilink",)), ("format", "notice", ("missing-frontmatter", "invalid-frontmatter", "unknown-type", "invalid-status")), ("copies", "warn", ("sync-conflict-copy", "duplicate-alias")),
    ("wiring", "notice", ("orphan-note", "moc-gap", "hub-gap", "area-moc-gap")), ("dates", "notice", ("dated-note-drift",)),
)


def health_cards(findings: DataFrame) -> DataFrame:
    """(card, weight, n): findings by group, warnings first, then notices, then groups without any (weight ok)."""
    cards = findings.sparkSession.createDataFrame([(c, w, k, i) for i, (c, w, kinds) in enumerate(CARDS) for k in kinds], "card string, weight string, kind string, at int")
    n = findings.groupBy("kind").agg(F.count("*").alias("n"))
    by = cards.join(n, "kind", "left").na.fill(0, ["n"]).groupBy("card", "weight", "at").agg(F.sum("n").alias("n"))
    weight = F.when(F.col("n") == 0, "ok").otherwise(F.col("weight"))
    return by.select("card", weight.alias("weight"), "n", "at").orderBy(F.array_position(F.array(*map(F.lit, ("warn", "notice", "ok"))), F.col("weight")), "at").drop("at")
