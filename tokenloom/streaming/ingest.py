"""Resumable ingest of corpus files with Structured Streaming.

The checkpoint remembers which files were read, so a restarted job continues
where it stopped. There is no event time: totals are unbounded counters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.session import folder_entries, is_folder, remove_folder

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: str = DOCUMENTS,
                   files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, new files as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def read_table(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    """A stored table as a stream, be it one file or a folder of files."""
    if is_folder(spark, path):
        return read_documents(spark, path, schema=schema)
    folder, _, name = path.rpartition("/")
    return read_documents(spark, folder, name, schema)


def append_batches(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], table: str,
                   checkpoint: str) -> StreamingQuery:
    """Apply a stateless step to each micro-batch and append the result to ``table``.

    Each batch owns one folder and replaces it, so a batch run twice after a
    failure is there once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def running_source_totals(stream: DataFrame, table: str, checkpoint: str, amount: str = "n_tok") -> StreamingQuery:
    """Keep documents and tokens per source as streaming state; ``table`` has the latest.

    State is one counter row per source; each trigger writes the small table anew
    and drops the versions before the last.
    """
    totals = stream.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(amount).cast("long").alias("tokens"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/version={batch_id}")
        for version in _versions(batch.sparkSession, table):
            if version < batch_id - 1:
                remove_folder(batch.sparkSession, f"{table}/version={version}")

    return (
        totals.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Versions whose writing has ended."""
    names = [n for n, _, _ in folder_entries(spark, table) if n.startswith("version=")]
    return [int(n.split("=")[1]) for n in names
            if any(f == "_SUCCESS" for f, _, _ in folder_entries(spark, f"{table}/{n}"))]


def latest_version(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of a table written per trigger; no other one is read."""
    return spark.read.parquet(f"{table}/version={max(_versions(spark, table))}")
