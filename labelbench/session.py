"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job of the library assumes: ANSI semantics, UTC, AQE with skew handling.
SESSION_DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(master: str | None = None, app_name: str = "labelbench",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("LABELBENCH_DRIVER_MEMORY", "8g")))
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, so that a process started in any folder can run its Python tasks.

    ``get_session`` does it; call it for a session of your own unless the workers have the package installed."""
    sc = spark.sparkContext
    if any(f.endswith("labelbench.zip") for f in sc._python_includes):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="labelbench-ship-")
    shutil.copytree(here, f"{folder}/src/labelbench", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{folder}/labelbench", "zip", f"{folder}/src"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without one (tests, a laptop) gets a private folder; on a
    cluster a machine-local folder would be wrong, so a missing setting is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            d = tempfile.mkdtemp(prefix="labelbench-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared checkpoint folder (e.g. for written result tables)."""
    base = checkpoint_dir(spark)
    bits = ["labelbench", *parts]
    if unique:
        bits.append(uuid.uuid4().hex[:12])
    sep = "/" if "://" in base or base.startswith("/") else os.sep
    return base.rstrip("/") + sep + sep.join(bits)


def land(df, name: str, partition_by: str | None = None, group_rows: int | None = None):
    """Write a table that several jobs will read to the shared folder and read it back:
    its lineage runs once and is cut (a lost executor re-reads files, it does not recompute).

    With ``partition_by`` rows of one value of that column share a folder, and a reader that
    filters on it opens no other.  ``group_rows`` bounds the rows of a Parquet row group: a writer looks at their
    size only from a hundred rows on, and a reader unpacks up to a whole group at once, so rows of megabytes need
    small ones, and the denser packing of zstd.  The files stay until the caller drops them (``landed``)."""
    spark = df.sparkSession
    path = shared_path(spark, name, unique=True)
    writer = df.write.mode("overwrite")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", str(group_rows)).option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    note_landed(path)
    return spark.read.schema(df.schema).parquet(path) if partition_by else spark.read.parquet(path)


_SCOPES: list[list[str]] = []


def note_landed(path: str) -> None:
    """Count a folder among what the enclosing blocks have landed."""
    for paths in _SCOPES:
        paths.append(path)


@contextmanager
def recording():
    """The paths of what is landed inside the block, in a list that grows meanwhile."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not paths]


def drop_landed(spark: SparkSession, paths: list[str]) -> None:
    """Remove landed folders whose consumers are done."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path = hadoop(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def landed(spark: SparkSession):
    """Remove what is landed inside the block when it ends: consume results before that."""
    with recording() as paths:
        try:
            yield
        finally:
            drop_landed(spark, paths)
