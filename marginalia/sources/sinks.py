"""Writers: tables, logs, Markdown, and upkeep of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as tx


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites a table; the committer makes the change visible at once."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path, partitionBy=partition_by)


def append_actions(actions: DataFrame, path: str, most: int = 500) -> None:
    """Appends to the action log as JSON lines by day, details cut at 500 characters."""
    day = F.to_date(F.timestamp_millis("at_ms"))
    actions.withColumn("detail", F.substring("detail", 1, most)).withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def rotate_actions(actions: DataFrame, keep: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(live, rotated): the newest entries and the older ones, parted at the time of the last one kept."""
    edge = actions.where("at_ms is not null").orderBy(F.desc("at_ms")).limit(keep).agg(F.min("at_ms").alias("edge"))
    x = actions.join(F.broadcast(edge))
    return x.where("at_ms >= edge").drop("edge"), x.where("at_ms < edge or at_ms is null").drop("edge")


def write_changed(df: DataFrame, path: str, key: str, old: DataFrame | None) -> bool:
    """Writes a derived table only if a row differs from the old one by content; tells whether it wrote."""
    if old is not None:
        h = lambda d: d.select(F.xxhash64(*sorted(d.columns)).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("x")).first()
        if h(df) == h(old.select(df.columns)):
            return False
    write_table(df, path)
    return True


def markdown(notes: DataFrame) -> DataFrame:
    """(path, text): notes (path, front, body) as files."""
    return notes.select("path", tx.raw_text(F.col("front"), F.col("body")).alias("text"))


def front_yaml(fields: list[tuple[str, str]]) -> Column:
    """A YAML text of columns (key, column) in order; strings are quoted where YAML would read them otherwise, nulls are left out."""
    parts = []
    for key, column in fields:
        c = F.col(column).cast("string")
        risky = c.rlike(r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]|[:#]\s|\s$|:$|^$") | F.lower(c).isin("true", "false", "null", "yes", "no", "~") | c.rlike(r"^[-+]?[0-9.]+$")
        quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{key}: "), F.when(risky, quoted).otherwise(c))))
    return F.concat_ws("\n", *parts)


def export(notes: DataFrame, path: str, without: str = "System/") -> None:
    """Every note but the server's own as JSON lines."""
    notes.where(~F.col("path").startswith(without)).write.mode("overwrite").option("compression", "gzip").json(path)


def delete_notes(table: DataFrame, path: str, gone: DataFrame, key: str = "path") -> int:
    """Rewrites a table without the rows of given keys, into a new folder beside it that then takes its place; tells how many went.
    A key that is not there changes nothing."""
    spark = table.sparkSession
    found = table.join(gone.select(key).distinct(), key, "left_semi").count()
    if found:
        write_table(table.join(gone.select(key).distinct(), key, "left_anti"), f"{path}.next")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p, q = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.next")
        fs = p.getFileSystem(conf)
        fs.delete(p, True)
        fs.rename(q, p)
    return found


def write_vectors(chunks: DataFrame, path: str, build: str) -> None:
    """Writes chunk vectors under their build first and then the record that names the build; a reader that goes by the record never
    sees half a build."""
    write_table(chunks, f"{path}/build={build}")
    width = chunks.where("vec is not null").agg(F.max(F.size("vec")).alias("width"), F.count("*").alias("n"))
    write_table(width.withColumn("build", F.lit(build)), f"{path}/current")


def read_built_vectors(spark, path: str) -> DataFrame:
    """The vectors of the build that the record names."""
    return spark.read.parquet(f"{path}/build={spark.read.parquet(f'{path}/current').first().build}")


def write_map(map_rows: DataFrame, path: str) -> None:
    """Writes a vault's map (folder, depth, n, hubs) as one Markdown file; it has as many lines as the map has folders, some dozens."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), F.element_at(F.split("folder", "/"), -1), F.lit("/ ("), F.col("n").cast("string"), F.lit(")"), F.when(F.col("hubs") > 0, F.concat(F.lit(" · hubs: "), F.col("hubs").cast("string"))).otherwise(""))
    map_rows.coalesce(1).sortWithinPartitions("folder").select(line.alias("value")).write.mode("overwrite").text(path)
