"""Session plumbing: the shared folder, lineage cuts by a written table, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset (tests, a laptop) a local temporary folder is set, but only under a local master:
    a cluster without the setting is an error, as a machine-local folder there would lose data."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = _written.setdefault("local", [tempfile.mkdtemp(prefix="marginalia-")])[0]
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here, every reader prunes
    columns and pushes filters, and lost executors cost nothing that was already written.

    What is written goes with discard(), or with the end of the driver's program; tables to keep only with the latter."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/marginalia/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    _written.setdefault(spark.sparkContext.applicationId + (" kept" if keep else ""), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*work: Callable[[], T]) -> list[T]:
    """Runs independent jobs at the same time, so that the one's tail overlaps with the other's start; results in order."""
    with ThreadPoolExecutor(max(1, len(work))) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


def discard(spark: SparkSession, kept: bool = False) -> None:
    """Deletes what materialize() wrote in this application, tables to keep only if asked to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []) + (_written.pop(f"{spark.sparkContext.applicationId} kept", []) if kept else []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def token(spark: SparkSession, path: str) -> str:
    """Size and time of the files under a path, from metadata only: another token, another state."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    found = fs.globStatus(p)
    files = [f for s in found or [] for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    return " ".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in every Python worker, whatever path the driver found it by; once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="marginalia-ship-"), "marginalia_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"marginalia/{p.relative_to(root)}")
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def ready() -> None:
    """ship() for the session in use. Called before a Python function is made, as it takes the files known by then."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def _sweep() -> None:
    import shutil

    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            discard(spark, kept=True)
    except Exception:  # the JVM may have ended first; the cluster's folder is then cleaned by its owner
        pass
    for path in _written.get("local", []):
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_sweep)
