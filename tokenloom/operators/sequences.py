"""Fixed-length training sequences and batches out of shards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.ordering import running_totals


def shard_batches(shards: DataFrame, batch_seqs: int, seq_len: int) -> DataFrame:
    """Whole batches per shard: ``split, shard_idx, n_batches, first_batch``.

    ``shards`` has ``split, shard_idx, tokens``. A batch reads one token more
    than it advances; what is left over at the end of a shard is dropped.
    """
    step = batch_seqs * seq_len
    per = shards.select(
        "split", "shard_idx",
        F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / step).cast("long").alias("n_batches"),
    )
    return running_totals(per, ["shard_idx"], {"n_batches": "first_batch"}, group_by=["split"], label="batches")


def shard_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("split", "shard_idx").agg(F.sum("n_tok").cast("long").alias("tokens"))


def stream_batches(batches: DataFrame) -> dict[str, int]:
    """Batches in one epoch per split (a handful of rows)."""
    rows = batches.groupBy("split").agg(F.sum("n_batches").alias("n")).collect()
    return {r["split"]: int(r["n"]) for r in rows}


def shift_windows(chunks: DataFrame, batches: DataFrame, batch_seqs: int, seq_len: int) -> DataFrame:
    """One row per sequence: ``split, shard_idx, batch_id, in_shard, row, ids``.

    Sequence ``q`` of a shard covers tokens ``qT … qT+T`` inclusive, so it
    shares one token with the next. A group holds at most T+1 tokens.
    """
    t = seq_len
    pos, n = F.col("shard_pos"), F.col("n_tok")
    lo = F.greatest(F.floor((pos - 1) / t), F.lit(0)).cast("long")
    hi = F.floor((pos + n - 1) / t).cast("long")
    parts = chunks.withColumn("seq", F.explode(F.sequence(lo, hi)))
    first = F.greatest("shard_pos", F.col("seq") * t)
    last = F.least(pos + n, F.col("seq") * t + t + 1)
    parts = parts.select(
        "split", "shard_idx", "seq",
        F.struct(
            first.alias("at"),
            F.slice("ids", (first - pos + 1).cast("int"), (last - first).cast("int")).alias("ids"),
        ).alias("part"),
    )
    seqs = parts.groupBy("split", "shard_idx", "seq").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("ids")
    )
    in_shard = F.floor(F.col("seq") / batch_seqs).cast("long")
    return seqs.join(batches, ["split", "shard_idx"]).where(in_shard < F.col("n_batches")).select(
        "split", "shard_idx",
        (F.col("first_batch") + in_shard).alias("batch_id"),
        in_shard.alias("in_shard"),
        (F.col("seq") % batch_seqs).cast("int").alias("row"),
        "ids",
    )


def inputs(ids: Column, seq_len: int) -> Column:
    return F.slice(ids, 1, seq_len)


def targets(ids: Column, seq_len: int) -> Column:
    return F.slice(ids, 2, seq_len)


def resume_from(spark: SparkSession, windows: Windows, batches_per_epoch: int, cursor: int,
                reads: int | None = None) -> DataFrame:
    """What an endless stream reads after a restart: ``read, epoch`` and the rows of the batch.

    ``cursor`` may lie in any epoch; by default the reads go on to the end of that epoch.
    """
    if reads is None:
        reads = batches_per_epoch - cursor % batches_per_epoch
    at = cursor_batches(spark, reads, batches_per_epoch, cursor)
    return at.join(batches_between(windows, cursor, reads, batches_per_epoch), "batch_id")


#: Windows as a table, or as what reads the batches first … end-1 of a source.
Windows = DataFrame | Callable[[int, int], DataFrame]


def batches_between(windows: Windows, first: int, reads: int, batches_per_epoch: int) -> DataFrame:
    """The windows whose batches some of the reads ``first … first+reads-1`` want."""
    low = first % batches_per_epoch
    if reads >= batches_per_epoch:
        ranges = [(0, batches_per_epoch)]
    elif low + reads <= batches_per_epoch:
        ranges = [(low, low + reads)]
    else:  # over the end of the epoch
        ranges = [(low, batches_per_epoch), (0, low + reads - batches_per_epoch)]
    if isinstance(windows, DataFrame):
        own = [windows.where((F.col("batch_id") >= a) & (F.col("batch_id") < e)) for a, e in ranges]
    else:
        own = [windows(a, e) for a, e in ranges]
    return reduce(DataFrame.unionByName, own)


def batch_rows(batches: DataFrame, batch_seqs: int) -> DataFrame:
    """``split, shard_idx, batch_id, in_shard, row`` of every sequence, from the batch counts alone."""
    each = batches.where(F.col("n_batches") > 0).select(
        "split", "shard_idx", "first_batch",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_batches") - 1)).alias("in_shard"))
    return each.select("split", "shard_idx", (F.col("first_batch") + F.col("in_shard")).alias("batch_id"), "in_shard",
                       F.explode(F.sequence(F.lit(0), F.lit(batch_seqs - 1))).alias("row"))


def cursor_of(batches: DataFrame, state: dict, batch_seqs: int, seq_len: int, split: str = "train") -> int:
    """Global batch number the loader state ``{shard_idx, pos, epoch}`` points at."""
    own = batches.where(F.col("split") == split)
    size = own.agg(F.count(F.lit(1)).alias("shards"), F.sum("n_batches").alias("n")).first()
    if not size["shards"]:
        raise FileNotFoundError(f"no shards in split {split!r}")
    idx = int(state["shard_idx"]) % size["shards"]
    row = own.where(F.col("shard_idx") == idx).first()
    return (int(state.get("epoch", 0)) * size["n"] + row["first_batch"]
            + int(state["pos"]) // (batch_seqs * seq_len))


def cursor_batches(spark: SparkSession, n: int, batches_per_epoch: int, start: int = 0) -> DataFrame:
    """Reads ``start … start+n-1`` of an endless stream: ``read, epoch, batch_id``."""
    if batches_per_epoch <= 0:
        raise ValueError("the stream holds no whole batch")
    at = F.col("read")
    return spark.range(start, start + n).select(
        F.col("id").alias("read"),
    ).select(
        "read", F.floor(at / batches_per_epoch).cast("int").alias("epoch"),
        (at % batches_per_epoch).alias("batch_id"),
    )


def val_batch_count(max_tokens: float, batch_seqs: int, seq_len: int) -> int:
    return max(1, int(max_tokens // (batch_seqs * seq_len)))


def val_batches(spark: SparkSession, windows: Windows, batches_per_epoch: int, max_tokens: float, batch_seqs: int,
                seq_len: int) -> DataFrame:
    """The fixed validation batches, out of the windows of that split; too few and they repeat."""
    n = val_batch_count(max_tokens, batch_seqs, seq_len)
    reads = cursor_batches(spark, n, batches_per_epoch)
    return reads.join(batches_between(windows, 0, n, batches_per_epoch), "batch_id")


def torch_rows(windows: DataFrame, batch_seqs: int, micro: int, world: int) -> DataFrame:
    """Rank and micro-batch of every row: contiguous per rank, then per pass."""
    if batch_seqs % (micro * world):
        raise ValueError("batch_seqs must be a multiple of micro * world")
    per_rank = batch_seqs // world
    rank = F.floor(F.col("row") / per_rank).cast("int")
    return windows.withColumn("rank", rank).withColumn(
        "accum", F.floor((F.col("row") % per_rank) / micro).cast("int"))


def jax_rows(windows: DataFrame, batch_seqs: int, micro: int, devices: int) -> DataFrame:
    """Pass and device of every row: passes first, each split over the devices."""
    if batch_seqs % (micro * devices):
        raise ValueError("batch_seqs must be a multiple of micro * devices")
    per_pass = micro * devices
    return windows.withColumn("accum", F.floor(F.col("row") / per_pass).cast("int")).withColumn(
        "device", F.floor((F.col("row") % per_pass) / micro).cast("int"))
