"""Structure of a vault: counts by folder at every level, governing hubs, outlines, sections, folder documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as tx


def partition_counts(corpus: DataFrame) -> DataFrame:
    """(partition, n) by top folder."""
    return corpus.groupBy(tx.top_folder(F.col("path")).alias("partition")).agg(F.count("*").alias("n"))


def _ancestors(path: Column, most: int) -> Column:
    """The folders above a path, the outermost first, until a folder that is a year, month or number."""
    parts = F.slice(F.split(path, "/"), 1, F.least(F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)), F.lit(most)))
    stop = F.array_position(F.transform(parts, lambda s: tx.is_date_segment(s).cast("int")), 1).cast("int")
    kept = F.when(stop > 0, F.slice(parts, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(parts)
    return F.transform(kept, lambda s, i: F.array_join(F.slice(kept, 1, i + 1), "/"))


def folder_rollup(corpus: DataFrame, most: int = 6) -> DataFrame:
    """(folder, depth, n): notes below every folder up to six levels: a roll-up over path prefixes in one aggregate."""
    each = corpus.select(F.explode(_ancestors(F.col("path"), most)).alias("folder"))
    return each.groupBy("folder").agg(F.count("*").alias("n")).select("folder", tx.depth(F.col("folder")).alias("depth"), "n")


def vault_map(corpus: DataFrame, hubs: DataFrame, top: int = 20) -> DataFrame:
    """(folder, depth, n, hubs): the folders worth showing: two notes or a hub, the top 20 by hubs and size, with all above them."""
    roll = folder_rollup(corpus).join(hubs.groupBy(F.col("dir").alias("folder")).agg(F.count("*").alias("hubs")), "folder", "left").na.fill(0, ["hubs"]).where("n >= 2 or hubs > 0")
    best = roll.orderBy(F.desc("hubs"), F.desc("n"), "folder").limit(top).select("folder")
    above = best.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda i: F.array_join(F.slice(F.split("folder", "/"), 1, i), "/"))).alias("folder")).distinct()
    return roll.join(above, "folder", "left_semi")


def governing_hub(corpus: DataFrame, hubs: DataFrame) -> DataFrame:
    """(path, hub): the hub directly in the nearest folder at or above a note, that folder's own map before others, then the
    first path; Raw/ and System/ are left out. An equi-join on ancestors and a min."""
    from marginalia.operators.audit import is_area_map

    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    a = corpus.where((F.instr("path", "/") > 0) & ~F.col("path").startswith("System/")).select("path", F.posexplode(dirs).alias("d", "dir"))
    h = hubs.where(~F.col("hub").contains("/Raw/")).select("hub", "dir", (~is_area_map(F.col("hub"), F.substring_index("dir", "/", -1))).alias("other"))
    return a.join(h, "dir").where("path != hub").groupBy("path").agg(F.min(F.struct((-F.col("d")).alias("d"), "other", "hub")).alias("x")).select("path", "x.hub")


def partition_of(corpus: DataFrame, partitions: DataFrame) -> DataFrame:
    """(path, partition): the longest configured prefix (partition) of each path."""
    dirs = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    hit = corpus.select("path", F.explode(dirs).alias("partition")).join(partitions.select("partition"), "partition")
    return hit.groupBy("path").agg(F.max_by("partition", F.length("partition")).alias("partition"))


def outline(corpus: DataFrame, most: int | None = 120, body: str = "body") -> DataFrame:
    """(path, nth, line, level, heading, offset): headings outside fences with the offset of their line in characters; `most` a
    note, None for all."""
    lines = corpus.select("path", F.split(body, "\n").alias("l"))
    mark = lambda s: F.when(s.rlike(r"^\s*```"), 1).when(s.rlike(r"^\s*~~~"), 2).otherwise(0)
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("at"), F.array().cast("array<struct<line:int,level:int,heading:string,offset:int>>").alias("out"), F.lit(0).alias("no"))

    def step(acc: Column, s: Column) -> Column:
        level = F.length(F.regexp_extract(s, r"^(#{1,6})[ \t]+\S", 1))
        hit = (acc["open"] == 0) & (level > 0)
        opened = F.when(acc["open"] > 0, F.when(mark(s) == acc["open"], 0).otherwise(acc["open"])).otherwise(mark(s))
        out = F.when(hit, F.concat(acc["out"], F.array(F.struct((acc["no"] + 1).alias("line"), level.alias("level"), F.regexp_replace(F.regexp_replace(s, r"^#+[ \t]+", ""), r"\s+$", "").alias("heading"), acc["at"].alias("offset"))))).otherwise(acc["out"])
        return F.struct(opened.alias("open"), (acc["at"] + F.length(s) + 1).alias("at"), out.alias("out"), (acc["no"] + 1).alias("no"))

    heads = lines.select("path", F.aggregate("l", zero, step)["out"].alias("h"))
    return heads.select("path", F.posexplode("h" if most is None else F.slice("h", 1, most)).alias("nth", "h")).select("path", (F.col("nth") + 1).alias("nth"), "h.*")


def extract_section(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, heading, section): of each note the section a reader asks for, from its heading to the next one of its level or above.
    wanted: (path, want); a heading that is equal counts before one that holds the words, the first before later ones."""
    heads = outline(corpus.join(wanted.select("path").distinct(), "path", "left_semi"), None, "raw")
    w = wanted.select("path", F.lower(F.trim("want")).alias("want")).distinct()
    low = F.lower("heading")
    hit = heads.join(w, "path").where(F.contains(low, F.col("want"))).withColumn("nth_fit", F.struct((low != F.col("want")).alias("inexact"), "nth"))
    best = hit.groupBy("path", "want").agg(F.min_by(F.struct("nth", "level", "heading", "offset"), "nth_fit").alias("x")).select("path", "want", "x.*")
    later = heads.select("path", F.col("nth").alias("n2"), F.col("level").alias("l2"), F.col("offset").alias("end"))
    ends = best.join(later, "path").where((F.col("n2") > F.col("nth")) & (F.col("l2") <= F.col("level"))).groupBy("path", "want").agg(F.min("end").alias("end"))
    x = best.join(ends, ["path", "want"], "left").join(corpus.select("path", "raw"), "path")
    cut = F.substring("raw", F.col("offset") + 1, F.coalesce("end", F.length("raw")) - F.col("offset"))
    return x.select("path", "heading", F.regexp_replace(cut, r"^\s+|\s+$", "").alias("section"))


def note_view(corpus: DataFrame, offset: int | None = None, limit: int | None = None, whole: bool = False, large: int = 12_000, opening: int = 4_000) -> DataFrame:
    """(path, chars, start, end, more, text): notes as a reader is given them: a range, the whole, or of a large one its opening;
    `more` counts the characters after it. outline() is the map that goes with an opening."""
    n = F.length("raw")
    if offset is not None or limit is not None:
        start = F.least(F.lit(max(0, offset or 0)), n)
        size = F.lit(max(1, large if limit is None else limit))
    else:
        start, size = F.lit(0), n if whole else F.when(n <= large, n).otherwise(F.lit(opening))
    end = F.least(start + size, n)
    return corpus.select("path", n.alias("chars"), start.alias("start"), end.alias("end"), (n - end).alias("more"), F.substring("raw", start + 1, end - start).alias("text"))


def folder_document(corpus: DataFrame, prefix: str, chars: int | None = 60_000) -> DataFrame:
    """(path, before, text): a folder's notes in order of path until the budget of characters is spent; None gives all.

    Lengths are added up by file name first letters and within them, over paths and lengths alone; only the notes that
    fit the budget are read for their text."""
    some = corpus.where(F.col("path").startswith(prefix.rstrip("/") + "/"))
    if chars is None:
        return some.select("path", F.lit(None).cast("long").alias("before"), F.col("raw").alias("text"))
    size = some.select("path", F.length("raw").cast("long").alias("n"), F.substring("path", 1, len(prefix.rstrip("/")) + 3).alias("block"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block: two letters after the prefix
    base = size.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).where(F.col("base") < chars)
    within = Window.partitionBy("block").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    fit = size.join(base, "block").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).where(F.col("before") < chars).select("path", "before")
    return some.select("path", "raw").join(fit, "path").select("path", "before", F.substring("raw", F.lit(1), (F.lit(chars) - F.col("before")).cast("int")).alias("text"))


def skills(corpus: DataFrame) -> DataFrame:
    """(skill, path, description) of .../skills/<name>/SKILL.md."""
    at = F.regexp_extract("path", r"(?i)(?:^|/)skills/([^/]+)/SKILL\.md$", 1)
    return corpus.withColumn("folder", at).where("folder != ''").select(F.coalesce(tx.front_value(F.col("front"), "name"), F.col("folder")).alias("skill"), "path", tx.front_value(F.col("front"), "description").alias("description"))


def newest(corpus: DataFrame, prefix: str = "", limit: int = 50) -> DataFrame:
    """(path, mtime): the newest notes under a prefix."""
    return corpus.where(F.col("path").startswith(prefix)).orderBy(F.desc_nulls_last("mtime"), "path").limit(limit).select("path", "mtime")


def glossary(corpus: DataFrame, entities: DataFrame, limit: int = 400) -> DataFrame:
    """(path, names): the entity notes in order of path with all their names."""
    return entities.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names")).orderBy("path").limit(limit)


def title_lookup(corpus: DataFrame, degree: DataFrame, typed: str, top: int = 8) -> DataFrame:
    """(path, tier, links): type-ahead: equal, prefix, start of a word, inside; then by links and title."""
    q, t = typed.strip().lower(), F.lower("title")
    tier = F.when(t == q, 0).when(t.startswith(q), 1).when(F.instr(F.translate(t, "-_", "  "), " " + q) > 0, 2).when(F.contains(t, F.lit(q)), 3)
    return corpus.withColumn("tier", tier).where("tier is not null").join(degree.select("path", "links"), "path", "left").na.fill(0, ["links"]).orderBy("tier", F.desc("links"), "title", "path").limit(top).select("path", "tier", "links")


def degrees(edges: DataFrame) -> DataFrame:
    """(path, links): resolved edges in and out of each note, without loops."""
    e = edges.where("not unresolved and src != dst and not startswith(src, 'System/') and not startswith(dst, 'System/')")
    return e.select(F.col("src").alias("path")).unionByName(e.select(F.col("dst").alias("path"))).groupBy("path").agg(F.count("*").alias("links"))


def overview(corpus: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (notes, edges, unresolved, chunks)."""
    n = corpus.agg(F.count("*").alias("notes"))
    e = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum(F.col("unresolved").cast("long")), F.lit(0)).alias("unresolved"))
    return n.join(e).join(chunks.agg(F.count("*").alias("chunks")))


def route(requests: DataFrame) -> DataFrame:
    """(id, path): where a new note goes: records by source and month, logs by day, others to the folder of their type, unknown types
    to Inbox. requests: (id, type, title, source, date)."""
    t, src = tx.sanitize_segment(F.trim("title")), F.coalesce(F.nullif(tx.sanitize_segment(F.trim("source")), F.lit("")), F.lit("Unknown"))
    fmt = lambda f: F.date_format("date", f)
    homes = {"profile": "Profile", "knowledge": "Knowledge", "initiative": "Initiatives", "project": "Work/Projects", "person": "People", "milestone": "Milestones", "reference": "Reference", "content study": "Social Media/Content Studied"}
    home = F.lit("Inbox")
    for kind, at in reversed(homes.items()):
        home = F.when(F.col("type") == kind, at).otherwise(home)
    memory = F.concat(F.lit("Memory/"), src, fmt("'/'yyyy'/'MM MMM'/'"), src, F.lit(" "), t, fmt("' 'dd MMM yyyy'.md'"))
    log = F.concat(F.lit("Logs/"), F.when(F.trim(F.coalesce("source", F.lit(""))) != "", F.concat(src, fmt("'/'yyyy'/'MM MMM'/'"))).otherwise(""), fmt("'Session 'd MMMM yyyy'.md'"))
    return requests.select("id", F.when(F.col("type") == "memory", memory).when(F.col("type") == "log", log).otherwise(F.concat(home, F.lit("/"), t, F.lit(".md"))).alias("path"))


def map_hubs(degree: DataFrame, top: int = 12, least: int = 10) -> DataFrame:
    """(path, links): the notes marked as hubs on a map of the graph: at least ten links, the most first, then by path."""
    return degree.where(F.col("links") >= least).orderBy(F.desc("links"), "path").limit(top).select("path", "links")


def layout_bounds(points: DataFrame, low: float = 0.02, high: float = 0.98, pad: float = 60.0) -> DataFrame:
    """One row (min_x, min_y, max_x, max_y): the 2nd to 98th percentile of a layout's points (x, y) with a margin, by place in
    sorted order; null without points."""
    from marginalia.operators.evaluate import places

    x = [places(points, c, {"low": F.floor(F.col("n") * low), "high": F.least(F.col("n") - 1, F.floor(F.col("n") * high))}) for c in ("x", "y")]
    side = lambda d, c: d.agg(F.min(F.when(F.col("point") == "low", F.col("value"))).alias(f"min_{c}"), F.max(F.when(F.col("point") == "high", F.col("value"))).alias(f"max_{c}"))
    both = side(x[0], "x").join(side(x[1], "y"))
    return both.select(*((F.col(f"min_{c}") - pad).alias(f"min_{c}") for c in "xy"), *((F.col(f"max_{c}") + pad).alias(f"max_{c}") for c in "xy"))


def validate_schema(schema: dict) -> dict:
    """A vault's configuration with partition paths in plain form; ValueError tells what is missing or unsafe."""

    def plain(p: dict, kind: str) -> dict:
        at = str(p.get("path") or "").replace("\\", "/")
        if not at:
            raise ValueError(f"{kind} without a path")
        parts = [s for s in at.split("/") if s not in ("", ".")]
        if at.startswith("/") or at[1:2] == ":" or ".." in parts:
            raise ValueError(f"unsafe path of a {kind}: {at}")
        if not parts:
            raise ValueError(f"{kind} whose path is empty")
        return {**p, "path": "/".join(parts)}

    if not isinstance(schema, dict):
        raise ValueError("a configuration is a mapping")
    parts = schema.get("partitions") or {}
    for what, value in (("schemaVersion", schema.get("schemaVersion")), ("partitions.core", parts.get("core")), ("noteTypes", schema.get("noteTypes"))):
        if not value:
            raise ValueError(f"missing {what}")
    if not isinstance((schema.get("frontmatter") or {}).get("required"), list):
        raise ValueError("missing frontmatter.required")
    if not isinstance(parts.get("modules", []), list):
        raise ValueError("partitions.modules is no list")
    for p in parts["core"]:
        if not p.get("job"):
            raise ValueError(f"partition without a job: {p.get('path')}")
    return {**schema, "partitions": {**parts, "core": [plain(p, "partition") for p in parts["core"]], "modules": [plain(p, "module") for p in parts.get("modules", [])]}}


def partition_paths(schema: dict) -> list[str]:
    """All partitions of a configuration, the core's first."""
    return [p["path"] for k in ("core", "modules") for p in schema["partitions"].get(k, [])]


def filing_rules(schema: dict, allowed: list[str] | None = None) -> str:
    """A configuration's rules of where notes go, as text; partitions outside `allowed` are not mentioned."""
    ok = lambda p: allowed is None or any(p == a or p.startswith(a.rstrip("/") + "/") for a in allowed)
    lines = ["# Filing rules", "", "## Partitions"]
    for p in [*schema["partitions"]["core"], *schema["partitions"].get("modules", [])]:
        if ok(p["path"]):
            lines.append(f"- {p['path']}/: {p.get('job', '')}" + (f" Only for: {', '.join(p['gateTopics'])}." if p.get("gated") and p.get("gateTopics") else ""))
    lines += ["", "## Types", *(f"- {t}" for t in schema["noteTypes"]), "", "## Front matter", f"Required: {', '.join(schema['frontmatter']['required'])}"]
    routes = [r for r in schema.get("routing", []) if ok(str(r.get("to", r.get("path", ""))).split("{")[0].rstrip("/") or "")]
    if routes:
        lines += ["", "## Routes", *(f"- {r.get('type', r.get('when', ''))}: {r.get('to', r.get('path', ''))}" for r in routes)]
    if schema.get("standingRules"):
        lines += ["", "## Standing rules", *(f"- {r}" for r in schema["standingRules"])]
    return "\n".join(lines) + "\n"
