"""Incremental upkeep with Structured Streaming: new note versions, the action log, and sessions as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions import text as tx

NOTE = "note_id long, path string, frontmatter string, body string, mtime timestamp, synced_at timestamp"
STORED = f"{NOTE}, hash string, bucket int"


def note_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Notes as files of a folder arrive."""
    return spark.readStream.schema(NOTE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def action_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(actions: DataFrame, late: str = "3 days") -> DataFrame:
    """Actions each once: an entry delivered again within the watermark is dropped."""
    return actions.where("at_ms is not null").withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late).dropDuplicatesWithinWatermark(["entry_id"])


def activity_windows(actions: DataFrame, width: str = "1 hour", late: str = "3 days") -> DataFrame:
    """(agent_id, start, kind, n) per window of event time; an extension."""
    a = once(actions, late)
    return a.groupBy("agent_id", F.window("at", width).alias("w"), F.lower(F.trim("action_kind")).alias("kind")).agg(F.count("*").alias("n")).select("agent_id", F.col("w.start").alias("start"), "kind", "n")


def live_sessions(actions: DataFrame, gap: str = "30 minutes", late: str = "3 days") -> DataFrame:
    """(agent_id, start, end, n) by Spark's session windows; an extension for streams. The batch operator is the gap tree."""
    a = once(actions, late).where("agent_id is not null")
    return a.groupBy("agent_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.max("at").alias("end")).select("agent_id", F.col("w.start").alias("start"), "end", "n")


def _files(spark: SparkSession, path: str):
    """(file system, Path) of a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers n of the finished folders v=n below a path, in order."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")]
    return sorted(int(d.getName()[2:]) for d in done if fs.exists(d.suffix("/_SUCCESS")))


def _state(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """All stored rows that a reader needs: the last base and the changes after it."""
    bases = [n for n in _numbers(spark, f"{target}/base") if before is None or n < before]
    base = bases[-1] if bases else -1
    paths = ([f"{target}/base/v={base}"] if bases else []) + [f"{target}/changes/v={n}" for n in _numbers(spark, f"{target}/changes") if n > base and (before is None or n < before)]
    every = None
    for p in paths:  # read alone, so that each is pruned by its buckets
        part = spark.read.schema(STORED).parquet(p)
        every = part if every is None else every.unionByName(part)
    return every


def _last(rows: DataFrame) -> DataFrame:
    """Of each note the row that was synced last, whenever it came; rows without that time count as the oldest."""
    rest = [c for c in rows.columns if c != "note_id"]
    when = F.struct(F.coalesce("synced_at", F.lit("0001-01-01").cast("timestamp")), "hash")
    return rows.groupBy("note_id").agg(F.max_by(F.struct(*rest), when).alias("x")).select("note_id", "x.*")


def keep_notes(notes: DataFrame, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Maintains a table of the last version of each note by the time it was synced, so that an older row that comes late changes
    nothing. A batch writes only the notes it brings newer, in buckets by a hash of their id, and reads only these buckets of
    what is stored. The same batch again writes the same. compact() puts the changes together."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.where("note_id is not null").withColumn("hash", tx.content_hash(tx.raw_text(F.col("frontmatter"), F.col("body")))).withColumn("bucket", F.pmod(F.xxhash64("note_id"), F.lit(buckets)).cast("int"))
        new = _last(new.select("note_id", "path", "frontmatter", "body", "mtime", "synced_at", "hash", "bucket"))
        old = _state(spark, target, before=batch_id)
        if old is not None:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
            had = _last(old.where(F.col("bucket").isin(touched)).select("note_id", "synced_at", "hash")).select("note_id", F.col("synced_at").alias("was"))
            new = new.join(had, "note_id", "left").where(F.col("was").isNull() | (F.col("synced_at") > F.col("was"))).drop("was")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/changes/v={batch_id}")

    return notes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The table keep_notes() maintains, as of its last batch."""
    return _last(_state(spark, target)).drop("bucket")


def compact(spark: SparkSession, target: str) -> None:
    """Writes the notes as they are as a new base and then deletes what it replaces; to be run while no batch is."""
    changes, bases = _numbers(spark, f"{target}/changes"), _numbers(spark, f"{target}/base")
    if not changes or (bases and bases[-1] >= changes[-1]):
        return
    _last(_state(spark, target)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/base/v={changes[-1]}")
    for path in [f"{target}/changes/v={n}" for n in changes] + [f"{target}/base/v={n}" for n in bases]:
        fs, p = _files(spark, path)
        fs.delete(p, True)


def keep_edges(notes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Maintains the link graph of a stream of notes: keep_notes() into target/notes, then links are taken again only from notes a
    batch changed, and resolved against all; each batch writes target/edges/v=n, of which the last is the graph."""
    from marginalia.operators import graph
    from marginalia.sources import vault as src

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = _last(batch.where("note_id is not null").withColumn("hash", tx.content_hash(tx.raw_text(F.col("frontmatter"), F.col("body")))).select("note_id", "path", "frontmatter", "body", "mtime", "synced_at", "hash"))
        was = [n for n in _numbers(spark, f"{target}/notes") if n < batch_id]
        stored = f"{NOTE}, hash string"
        old = spark.read.schema(stored).parquet(f"{target}/notes/v={was[-1]}") if was else None
        notes_now = now if old is None else _last(old.unionByName(now))
        notes_now.write.mode("overwrite").parquet(f"{target}/notes/v={batch_id}")
        kept = spark.read.schema(stored).parquet(f"{target}/notes/v={batch_id}").withColumn("aliases", tx.aliases(F.coalesce("frontmatter", F.lit(""))))
        corpus = src.corpus(kept)
        edges = graph.build(corpus) if old is None else graph.rebuild(spark.read.schema("src string, dst string, rel string, source string, unresolved boolean").parquet(f"{target}/edges/v={was[-1]}"), old.select("path", "hash"), corpus)
        edges.write.mode("overwrite").parquet(f"{target}/edges/v={batch_id}")
        for n in was[:-1]:
            for kind in ("notes", "edges"):
                fs, p = _files(spark, f"{target}/{kind}/v={n}")
                fs.delete(p, True)

    return notes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
