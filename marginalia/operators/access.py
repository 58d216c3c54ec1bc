"""Row-level access: which agent may see which path, applied before any statistic is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as tx


def matches(path: Column, prefixes: Column) -> Column:
    """Whether a path is one of the prefixes or lies below one, at a folder's boundary, in any case."""
    low = F.lower(path)
    bare = lambda p: F.regexp_replace(F.lower(p), "/+$", "")
    return F.exists(prefixes, lambda p: (bare(p) != "") & ((low == bare(p)) | low.startswith(F.concat(bare(p), F.lit("/")))))


def reserved(path: Column) -> Column:
    return path.startswith("System/") | path.rlike(r"(^|/)\.\.(/|$)") | path.startswith("/")


def can_read(path: Column, read: Column, deny: Column) -> Column:
    """No reserved path, none under deny; an empty or null read list means all. Paths are brought to their plain form first;
    one that is absolute or climbs out of the vault can't be read."""
    none = F.array().cast("array<string>")
    path = tx.normalize_rel(path)
    read, deny = F.coalesce(read, none), F.coalesce(deny, none)
    return path.isNotNull() & ~reserved(path) & ~matches(path, deny) & ((F.size(read) == 0) | matches(path, read))


def can_write(path: Column, read: Column, deny: Column, write: Column) -> Column:
    return can_read(path, read, deny) & matches(path, F.coalesce(write, F.array().cast("array<string>")))


def live(agents: DataFrame, now: Column) -> DataFrame:
    """Agents that have not expired."""
    return agents.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def scoped(rows: DataFrame, agent: DataFrame, path: str = "path") -> DataFrame:
    """The rows an agent (one row: read_scopes, deny_read) may see. To be put before index and statistics, as these depend on it."""
    a = F.broadcast(agent.select(F.col("read_scopes").alias("__read"), F.col("deny_read").alias("__deny")).limit(1))
    return rows.join(a).where(can_read(F.col(path), F.col("__read"), F.col("__deny"))).drop("__read", "__deny")


def readable_counts(notes: DataFrame, agents: DataFrame, most: int = 6) -> DataFrame:
    """(agent_id, n): how many notes each agent may read. Notes are counted once by folder prefix; an agent's scopes then meet these
    counts by equi-joins, so that no agent is compared with every note."""
    notes = notes.withColumn("path", tx.normalize_rel(F.col("path")))
    low = F.lower("path")
    dirs = F.transform(F.sequence(F.lit(1), F.size(F.split(low, "/"))), lambda i: F.array_join(F.slice(F.split(low, "/"), 1, i), "/"))
    open_ = notes.where(F.col("path").isNotNull() & ~reserved(F.col("path")))
    counts = open_.select(F.explode(dirs).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    total = open_.agg(F.count("*").alias("total"))
    bare = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.regexp_replace(F.lower(p), "/+$", "")), lambda p: p != ""))
    a = agents.where("agent_id is not null").select("agent_id", bare(F.col("read_scopes")).alias("r"), bare(F.col("deny_read")).alias("d"))
    below = lambda x, y: x.startswith(F.concat(y, F.lit("/")))
    outer = lambda c: F.filter(c, lambda p: ~F.exists(c, lambda y: below(p, y)))
    a = a.select("agent_id", (F.size("r") == 0).alias("all"), outer(F.col("r")).alias("r"), outer(F.col("d")).alias("d"))
    # what is read less what is denied inside it; what a denied folder covers is no longer read
    read = F.filter("r", lambda p: ~F.exists("d", lambda y: (p == y) | below(p, y)))
    denied = F.filter("d", lambda p: F.col("all") | F.exists("r", lambda y: below(p, y)))
    signs = F.concat(F.transform(read, lambda p: F.struct(p.alias("p"), F.lit(1).alias("s"))), F.transform(denied, lambda p: F.struct(p.alias("p"), F.lit(-1).alias("s"))))
    part = a.select("agent_id", F.explode(signs).alias("x")).select("agent_id", "x.*").join(counts, "p").groupBy("agent_id").agg(F.sum(F.col("s") * F.col("n")).alias("n"))
    return a.select("agent_id", "all").join(part, "agent_id", "left").join(F.broadcast(total)).select("agent_id", (F.when(F.col("all"), F.col("total")).otherwise(0) + F.coalesce("n", F.lit(0))).alias("n"))


def redact(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings whose path may be seen, with details that name other paths replaced."""
    ok = allowed.select("path").distinct()
    seen = findings.join(ok, "path", "left_semi").join(ok.select(F.col("path").alias("detail"), F.lit(True).alias("__ok")), "detail", "left")
    hidden = F.col("detail").contains("/") & F.col("__ok").isNull()
    return seen.select("kind", "path", F.when(hidden, "(outside your scope)").otherwise(F.col("detail")).alias("detail"))
