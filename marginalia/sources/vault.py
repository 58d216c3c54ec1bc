"""Readers of a note vault: Markdown folders, the parquet tables, JSON side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as tx

#: Folders a vault keeps for itself or its editors.
SKIPPED = (".git", ".obsidian", ".trash", "node_modules", ".cache")
MAX_BYTES = 5_000_000


def read_folder(spark: SparkSession, root: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, text, mtime, size, archived, unreadable) of all .md files under a folder; files beyond max_bytes (None: none) have no text.

    The size is a filter on file metadata that the reader takes: of larger files only the metadata is read. Folders in SKIPPED are left out."""
    from marginalia.functions.udfs import nfc

    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(base)
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:(//)?", "")
    start = base if base.startswith("/") else base.split(":", 1)[-1].replace("//", "", 1)
    meta = [F.expr("substring(p, length(r) + 2)").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]
    listed = lambda some: some.withColumn("p", path).withColumn("r", F.lit(start))
    small = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    out = listed(small).select(meta[0], nfc(F.decode("content", "UTF-8")).alias("text"), *meta[1:], F.lit(False).alias("unreadable"))
    if max_bytes is not None:
        out = out.unionByName(listed(files.where(F.col("length") > max_bytes).drop("content")).select(meta[0], F.lit(None).cast("string").alias("text"), *meta[1:], F.lit(True).alias("unreadable")))
    kept = out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    return kept.select("path", "text", "mtime", "size", tx.is_archived(F.col("path")).alias("archived"), "unreadable")


def parse_notes(files: DataFrame) -> DataFrame:
    """(path, frontmatter, body, no_frontmatter, ...) from (path, text, ...)."""
    return files.withColumn("frontmatter", tx.front_matter(F.col("text"))).withColumn("body", tx.file_body(F.col("text"))).withColumn("no_frontmatter", F.col("frontmatter").isNull()).drop("text")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """The notes table, each note once. Rows that repeat a note_id are whole repeats; any of them stands."""
    return spark.read.parquet(f"{sf}/notes.parquet").where("note_id is not null").dropDuplicates(["note_id"])


def corpus(notes: DataFrame) -> DataFrame:
    """(note_id, path, title, front, aliases, body, raw, mtime) with texts that are never null."""
    return notes.select("note_id", "path", tx.basename(F.col("path")).alias("title"), F.col("frontmatter").alias("front"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("body", F.lit("")).alias("body"), tx.raw_text(F.col("frontmatter"), F.col("body")).alias("raw"), "mtime")


def questions(corpus: DataFrame) -> DataFrame:
    """(qid, question): the stated query set, a question from every note whose id is divisible by 50: its title and
    the first 120 characters of its words."""
    words = F.substring(F.regexp_replace("body", r"[^\p{L}\p{N}\p{M} ]+", " "), 1, 120)
    return corpus.where("note_id % 50 = 0").select(F.col("note_id").alias("qid"), F.concat_ws(" ", "title", words).alias("question"))


def freshness(files: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """One row (n, newest, token): a snapshot's id from its paths, times and sizes. Hashes are added up, so that
    no list of files goes to one task; repeated rows count once."""
    row = F.xxhash64("path", F.col("mtime").cast("long"), "size")
    files = files.select("path", "mtime", "size").where(~F.col("path").isin(*without)) if without else files.select("path", "mtime", "size")
    return files.distinct().agg(F.count("*").alias("n"), F.max("mtime").alias("newest"), F.sum(row.cast("decimal(20,0)")).cast("string").alias("token"))


def attachments(spark: SparkSession, root: str) -> DataFrame:
    """The names of files that are no notes, with and without extension, in lower case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.lower(F.substring_index("path", "/", -1)).alias("name")).where(~F.col("name").endswith(".md"))
    return files.unionByName(files.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("name"))).distinct()


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A JSON side file (configuration, agents, dismissed findings), one document over many lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


ACTION = "at_ms long, agent_id string, agent string, action_kind string, path string, detail string"


def read_actions(spark: SparkSession, path: str, limit: int | None = 30) -> DataFrame:
    """The newest actions of an append-only JSON-lines log, torn lines left out; limit None gives all."""
    log = spark.read.schema(ACTION).option("mode", "DROPMALFORMED").json(path).where("at_ms is not null")
    newest = log.orderBy(F.desc("at_ms"), "agent_id", "path")
    return newest if limit is None else newest.limit(limit)


def read_vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Chunk vectors with a check of their width: a vector of another length stops the read."""
    chunks = spark.read.parquet(path)
    ok = F.assert_true(F.col("vec").isNull() | (F.size("vec") == width), F.lit("a vector has another length"))
    return chunks.where(ok.isNull())
