"""Headerless CSV run logs: ``step, split, loss, lr, gnorm, tok_s``.

A run is a folder; every session has a numbered folder, and in it every append
one that orders it behind the earlier ones. Validation lines leave the last two
fields blank, which read back as null. Logs may also be plain: one file
``<run>/log.csv`` per run, its lines in order.
"""

from __future__ import annotations

import posixpath
import time
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import file_system, qualified, ship_package

SCHEMA = "step int, split string, loss double, lr double, gnorm double, tok_s long"
_FIELDS = ("step", "split", "loss", "lr", "gnorm", "tok_s")


def _log_fields() -> list:
    return [
        "step", "split", F.round("loss", 5).alias("loss"), "lr", F.round("gnorm", 4).alias("gnorm"),
        F.col("tok_s").cast("long").alias("tok_s"),
    ]


def append_log(lines: DataFrame, path: str, order: str = "line", append: int | None = None) -> None:
    """Append lines of ``session, run, <order>`` plus the log fields.

    ``append`` orders the appends of a session (default: the time now). Ranges of
    (session, run, order) keep lines in order over the files, and a long run
    may fill several files.
    """
    keys = ["session", "run", order]
    (
        lines.select(*keys, *_log_fields()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(order)
        .withColumn("append", F.lit(time.time_ns() if append is None else append).cast("long"))
        .write.mode("append").partitionBy("session", "append", "run").csv(path, emptyValue="", nullValue="")
    )


def _written_order(*before: str) -> list:
    """Part files of one append are numbered in order, splits of a file by their offset, and ids increase in a split."""
    return [
        *before, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    ]


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """All lines with their ``run`` and ``line``, which orders lines as written."""
    raw = spark.read.schema(SCHEMA + ", session int, append long, run string").csv(path)
    return raw.select(*_FIELDS, "run", F.struct(*_written_order("session", "append")).alias("line"))


def write_plain_logs(lines: DataFrame, path: str, order: tuple[str, ...] = ("session", "line")) -> DataFrame:
    """One file ``<run>/log.csv`` per run, its lines by ``order``; gives the runs written.

    A run's file is streamed by one task, as a training run writes it. A run's name
    is its folder's, so it holds no slash.
    """
    spark = lines.sparkSession
    ship_package(spark)
    root = qualified(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done = []
        for run, own in groupby(rows, key=lambda r: r[0]):
            if "/" in run:
                raise ValueError(f"run {run!r} is no folder name")
            system, base = file_system(posixpath.join(root, run))
            system.create_dir(base, recursive=True)
            temp = posixpath.join(base, f"_log.{TaskContext.get().taskAttemptId()}")
            with system.open_output_stream(temp) as out:
                for _, *fields in own:
                    out.write((",".join("" if f is None else str(f) for f in fields) + "\n").encode())
            system.move(temp, posixpath.join(base, "log.csv"))
            done.append(run)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["run"])

    keyed = lines.select("run", *order, *_log_fields()).repartition("run").sortWithinPartitions("run", *order)
    return keyed.drop(*order).mapInArrow(write, "run string")


def read_plain_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all ``<run>/log.csv`` files (or folders of that name) below ``path``, as ``read_logs``."""
    raw = spark.read.schema(SCHEMA).csv(f"{path.rstrip('/')}/*/log.csv")
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/log\.csv", 1)
    run = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))  # metadata paths are encoded
    return raw.select(*_FIELDS, run.alias("run"), F.struct(*_written_order()).alias("line"))
