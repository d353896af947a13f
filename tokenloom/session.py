"""Session set-up, shared staging tables and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Set by a user whose files have too few splits for the cores, as in a local session.
SPREAD = "spark.tokenloom.spread"

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: int | str = 8, app: str = "tokenloom") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config(SPREAD, str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster an unset folder is an error, as a machine-local path would not be
    visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_roots[app] = tempfile.mkdtemp(prefix="tokenloom-")
    return _local_roots[app]


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the staging root, never used before."""
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/tokenloom/{app}/{label}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark itself gives it, so that tasks open the same place."""
    system, where = _hadoop(spark, path)
    return system.makeQualified(where).toString()


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def folder_entries(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of what a folder holds; empty if there is no such folder."""
    system, where = _hadoop(spark, path)
    if not system.exists(where):
        return []
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(where))


def is_folder(spark: SparkSession, path: str) -> bool:
    system, where = _hadoop(spark, path)
    return system.getFileStatus(where).isDirectory()


def remove_folder(spark: SparkSession, path: str) -> None:
    system, where = _hadoop(spark, path)
    system.delete(where, True)


def clean_staging(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, once its results are written."""
    remove_folder(spark, f"{staging_root(spark)}/tokenloom/{spark.sparkContext.applicationId}")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, for reading and writing inside tasks."""
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri.split("://", 1)[1]
    if uri.startswith("file:"):
        path = uri.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + path[2:].partition("/")[2] if path.startswith("//") else path
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    raise ValueError(f"{uri} has no scheme; qualify it on the driver first")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and fixes row values.

    Unlike a cached table the files outlive any executor, and the reader gets
    column pruning and real file sizes for join planning.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as the setting ``SPREAD`` says; without it, as they were read."""
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts else df


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches near 4 MB whatever the rows' lengths; the setting stays on in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def wide_partitions(spark: SparkSession) -> int:
    """Partitions for CPU-heavy rounds over a stored table: at least one per core."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    base = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tokenloom-pkg-"), "tokenloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(base):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tokenloom", os.path.relpath(full, base)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
