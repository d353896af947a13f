"""Progress manifest: one appended record per run, the latest one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "saved_at timestamp, mix string, written long, shard_idx int, val_done boolean, tokens_by_source map<string,long>"


def progress(stats: DataFrame, mixed: DataFrame, mix: str, split: str = "train") -> DataFrame:
    """The record after a run: tokens written, next shard, tokens read per source."""
    own = F.col("split") == split
    state = stats.agg(
        F.coalesce(F.sum(F.when(own, F.col("tokens"))), F.lit(0)).cast("long").alias("written"),
        F.coalesce(F.max(F.when(own, F.col("shard_idx"))) + 1, F.lit(0)).cast("int").alias("shard_idx"),
        F.coalesce(F.max((F.col("split") == "val").cast("int")), F.lit(0)).cast("boolean").alias("val_done"),
    )
    # One row per source of the mix.
    per_source = mixed.groupBy("source").agg(F.sum("n_tok").cast("long").alias("t")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "t")))))
    return state.select(
        F.current_timestamp().alias("saved_at"), F.lit(mix).alias("mix"), "written", "shard_idx", "val_done",
        per_source.scalar().alias("tokens_by_source"))


def append(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("append").json(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each mix."""
    log = spark.read.schema(SCHEMA).json(path)
    return log.groupBy("mix").agg(
        F.max_by(F.struct(*[c for c in log.columns if c != "mix"]), "saved_at").alias("r")).select("mix", "r.*")
