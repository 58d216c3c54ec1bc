"""Versions of notes as an append-only table: capture of outside changes, diffs, restore, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import text as tx
from marginalia.functions import udfs

#: versions: path string, oid string, ts timestamp, source string, message string, text string (null where the note was deleted)


def head(versions: DataFrame, at: str | None = None) -> DataFrame:
    """(path, oid, ts, text): the last version of each note, as of a time if given; deleted notes have none."""
    v = versions if at is None else versions.where(F.col("ts") <= F.lit(at).cast("timestamp"))
    last = v.groupBy("path").agg(F.max_by(F.struct("oid", "ts", "text"), F.struct("ts", "oid")).alias("x"))
    return last.select("path", "x.*").where("text is not null")


def list_versions(versions: DataFrame, path: str, limit: int = 500) -> DataFrame:
    return versions.where(F.col("path") == path).orderBy(F.desc("ts"), F.desc("oid")).limit(limit).drop("text")


def changes(head: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change, before, after): a full outer join of the last versions and the files (path, text) by path and hash."""
    a = head.select("path", F.col("text").alias("before"), tx.content_hash(F.col("text")).alias("h1"))
    b = disk.select("path", F.col("text").alias("after"), tx.content_hash(F.col("text")).alias("h2"))
    x = a.join(b, "path", "full").where(~F.col("h1").eqNullSafe(F.col("h2")))
    return x.select("path", F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "deleted").otherwise("edited").alias("change"), "before", "after")


def capture(versions: DataFrame, disk: DataFrame, ts: str, source: str = "external") -> DataFrame:
    """New version rows for all that changed outside, with counts of lines added and deleted in their message."""
    c = changes(head(versions), disk).withColumn("d", udfs.diff(F.col("before"), F.col("after")))
    add, cut = F.size(F.filter("d", lambda x: x["op"] == "+")), F.size(F.filter("d", lambda x: x["op"] == "-"))
    return c.select("path", tx.content_hash(F.concat_ws("\n", "path", F.lit(ts), F.coalesce("after", F.lit("")))).alias("oid"), F.lit(ts).cast("timestamp").alias("ts"), F.lit(source).alias("source"), F.concat(F.col("change"), F.lit(" +"), add.cast("string"), F.lit(" -"), cut.cast("string")).alias("message"), F.col("after").alias("text"))


def snapshot(versions: DataFrame, written: DataFrame) -> DataFrame:
    """Version rows (as versions) of written notes whose content differs from their last version."""
    last = head(versions).select("path", tx.content_hash(F.col("text")).alias("hash"))
    return written.withColumn("hash", tx.content_hash(F.col("text"))).join(last, ["path", "hash"], "left_anti").drop("hash")


def diff_lines(before_after: DataFrame) -> DataFrame:
    """(path, nth, op, text) of (path, before, after)."""
    return before_after.select("path", F.posexplode(udfs.diff(F.col("before"), F.col("after"))).alias("nth", "x")).select("path", "nth", "x.op", "x.text")


def diff_stat(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(F.sum((F.col("op") == "+").cast("long")).alias("added"), F.sum((F.col("op") == "-").cast("long")).alias("deleted"))


def restore(versions: DataFrame, path: str, oid: str, ts: str) -> DataFrame:
    """The row that puts an old version of a note back on top."""
    old = versions.where((F.col("path") == path) & (F.col("oid") == oid)).limit(1)
    return old.select("path", tx.content_hash(F.concat_ws("\n", "path", F.lit(ts), "oid")).alias("oid"), F.lit(ts).cast("timestamp").alias("ts"), F.lit("restore").alias("source"), F.concat(F.lit("restored "), "oid").alias("message"), "text")


def prune(versions: DataFrame, keep: int = 20_000_000) -> DataFrame:
    """The newest `keep` versions of the whole store, at least 50. Counts by day tell the day the cut falls in; only that
    day's versions are put in order. Ties: the higher oid, then path, stays. Versions without a time go first."""
    keep = max(keep, 50)
    v = versions.withColumn("__day", F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date")))
    newer = Window.partitionBy(F.lit(0)).orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = v.groupBy("__day").agg(F.count("*").alias("n")).withColumn("__newer", F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("__newer") < keep)
    whole = days.where(F.col("__newer") + F.col("n") <= keep).select("__day")
    part = v.join(days.where(F.col("__newer") + F.col("n") > keep).select("__day", "__newer"), "__day")
    nth = F.row_number().over(Window.partitionBy("__day").orderBy(F.desc_nulls_last("ts"), F.desc("oid"), F.desc("path")))
    return v.join(whole, "__day", "left_semi").drop("__day").unionByName(part.withColumn("__nth", nth).where(F.col("__nth") + F.col("__newer") <= keep).drop("__day", "__newer", "__nth"))


def purge(versions: DataFrame, paths: DataFrame) -> DataFrame:
    """All versions but those of the given paths."""
    return versions.join(paths.select("path"), "path", "left_anti")


def upsert(notes: DataFrame, writes: DataFrame, today: str) -> DataFrame:
    """(path, text, base_hash, agent) writes against (path, text, created_by, updated_by, updated) notes: the notes after them.

    A write to a note that exists needs that note's hash as base_hash, else it is refused; of several writes to a path the one with the
    least text and agent stands. created_by stays, updated_by and updated are stamped."""
    w = writes.groupBy("path").agg(F.min(F.struct("text", "base_hash", "agent")).alias("w")).select("path", "w.*")
    x = notes.join(w.withColumnRenamed("text", "new").withColumnRenamed("agent", "by"), "path", "full")
    ok = F.col("new").isNotNull() & (F.col("text").isNull() | (F.col("base_hash") == tx.content_hash(F.col("text"))))
    pick = lambda a, b: F.when(ok, a).otherwise(b)
    return x.select("path", pick(F.col("new"), F.col("text")).alias("text"), F.when(F.col("text").isNull(), F.col("by")).otherwise(F.col("created_by")).alias("created_by"), pick(F.col("by"), F.col("updated_by")).alias("updated_by"), pick(F.lit(today).cast("date"), F.col("updated")).alias("updated"))


def refused(notes: DataFrame, writes: DataFrame) -> DataFrame:
    """(path, agent, reason): the writes that upsert() does not take: those whose base_hash is not the note's as it is, and of several
    to one path all but the one that stands."""
    first = writes.groupBy("path").agg(F.min(F.struct("text", "base_hash", "agent")).alias("w"))
    x = writes.join(first, "path").join(notes.select("path", tx.content_hash(F.col("text")).alias("now")), "path", "left")
    stale = F.col("now").isNotNull() & ~F.col("base_hash").eqNullSafe(F.col("now"))
    later = ~F.struct("text", "base_hash", "agent").eqNullSafe(F.col("w"))
    return x.where(stale | later).select("path", "agent", F.when(stale, "the note has changed since it was read").otherwise("another write to the note came first").alias("reason"))


def append_notes(notes: DataFrame, additions: DataFrame, today: str) -> DataFrame:
    """Notes after texts (path, text, agent) were put at their ends, in order of agent and text; notes that don't exist are left out."""
    more = additions.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("agent", "text"))).alias("a"))
    x = notes.join(more, "path", "left")
    put = F.concat(F.regexp_replace("text", r"\s+$", ""), F.array_join(F.transform("a", lambda y: F.concat(F.lit("\n\n"), y["text"])), ""), F.lit("\n"))
    had = F.col("a").isNotNull()
    return x.select("path", F.when(had, put).otherwise(F.col("text")).alias("text"), "created_by", F.when(had, F.element_at("a", -1)["agent"]).otherwise(F.col("updated_by")).alias("updated_by"), F.when(had, F.lit(today).cast("date")).otherwise(F.col("updated")).alias("updated"))


def move_notes(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Notes after moves (old, new): a path that is taken refuses the move, as do two moves to one path. graph.repoint() rewrites links."""
    sole = moves.groupBy("new").agg(F.count("*").alias("k"), F.min("old").alias("old")).where("k = 1").join(notes.select(F.col("path").alias("new")), "new", "left_anti").select("old", "new")
    return notes.join(sole.withColumnRenamed("old", "path"), "path", "left").withColumn("path", F.coalesce("new", "path")).drop("new")


def archive_notes(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """Notes after some were moved under Archive/, where they are not there already."""
    gone = paths.select(F.col("path").alias("old")).distinct().where(~tx.is_archived(F.col("old")))
    return move_notes(notes, gone.select("old", F.concat(F.lit("Archive/"), "old").alias("new")))
