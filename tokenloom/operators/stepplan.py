"""The plan of a training run: which step reads which batch at which rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.schedule import decay_steps, in_decay, preference_factor, rewarm, warm_stable_decay
from tokenloom.operators.ordering import epoch_permutations


def total_steps(total_tokens: float, batch_seqs: int, seq_len: int) -> int:
    return int(total_tokens // (batch_seqs * seq_len))


def step_plan(
    spark: SparkSession,
    steps: int,
    per_epoch: dict[str, int],
    lr: float = 2e-3,
    warmup: int = 1000,
    decay_frac: float = 0.2,
    min_frac: float = 0.0,
    rewarm_from: int | None = None,
    max_steps: int | None = None,
    anneal: bool = True,
) -> DataFrame:
    """``step, stream, cursor, epoch, batch_id, lr`` for every step of the run.

    The last steps read the anneal stream if there is one; each stream keeps
    its own cursor and wraps at the end of its shards. ``max_steps`` is the
    cut of a shortened run.
    """
    step = F.col("step")
    use_anneal = anneal and per_epoch.get("anneal", 0) > 0
    begin = steps - decay_steps(steps, decay_frac)
    tail = in_decay(step, steps, decay_frac) & F.lit(use_anneal)
    size = F.when(tail, F.lit(per_epoch.get("anneal", 1) or 1)).otherwise(F.lit(per_epoch["train"]))
    factor = warm_stable_decay(step, steps, warmup, decay_frac, min_frac)
    if rewarm_from is not None:
        factor = factor * rewarm(step, rewarm_from, warmup)
    plan = spark.range(steps).select(F.col("id").alias("step"))
    if max_steps is not None:
        plan = plan.where(step < max_steps)
    return plan.select(
        "step",
        F.when(tail, F.lit("anneal")).otherwise(F.lit("train")).alias("stream"),
        F.when(tail, step - begin).otherwise(step).alias("cursor"),
        size.alias("_size"),
        (F.lit(lr) * factor).alias("lr"),
    ).select(
        "step", "stream", "cursor",
        F.floor(F.col("cursor") / F.col("_size")).cast("int").alias("epoch"),
        (F.col("cursor") % F.col("_size")).cast("long").alias("batch_id"),
        "lr",
    )


def locate(plan: DataFrame, batches: DataFrame, batch_seqs: int, seq_len: int) -> DataFrame:
    """Shard and loader state after each step: ``shard_idx, in_shard, pos``."""
    per_batch = batches.where(F.col("n_batches") > 0).select(
        F.col("split").alias("stream"), "shard_idx",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_batches") - 1)).alias("in_shard"),
        "first_batch",
    ).select("stream", "shard_idx", "in_shard", (F.col("first_batch") + F.col("in_shard")).alias("batch_id"))
    return plan.join(per_batch, ["stream", "batch_id"]).withColumn(
        "pos", (F.col("in_shard") + 1) * batch_seqs * seq_len)


def sft_size(rows: int, batch: int, epochs: float) -> tuple[int, int]:
    """(steps per epoch, total steps); too few rows for one batch give no step."""
    per = rows // batch
    return per, (max(1, int(per * epochs)) if per else 0)


def sft_plan(rows: DataFrame, n_rows: int, batch: int, micro: int, epochs: float, lr: float = 3e-4,
             row_id: str = "row_id") -> DataFrame:
    """``step, epoch, slot, micro, row_id, lr``: a fresh permutation per epoch, last part dropped."""
    per, total = sft_size(n_rows, batch, epochs)
    if not total:
        return epoch_permutations(rows.limit(0), [row_id], 1, 1).select(
            F.lit(0).cast("long").alias("step"), F.col("epoch"), F.lit(0).alias("slot"),
            F.lit(0).alias("micro"), row_id, F.lit(0.0).alias("lr"))
    places = epoch_permutations(rows, [row_id], -(-total // per), per)
    step = F.col("step")
    return (
        places.where(F.col("place") < per * batch)
        .withColumn("step", F.col("epoch") * per + F.floor(F.col("place") / batch))
        .where(step < total)
        .select(
            step.cast("long").alias("step"), "epoch",
            (F.col("place") % batch).cast("int").alias("slot"),
            F.floor((F.col("place") % batch) / micro).cast("int").alias("micro"),
            row_id,
            (F.lit(lr) * warm_stable_decay(step, total, max(1, total // 50), 0.5)).alias("lr"),
        )
    )


def preference_plan(pairs: DataFrame, n_pairs: int, batch: int, micro: int, lr: float = 1e-6,
                    place: str = "place") -> DataFrame:
    """Adds ``step, micro, lr`` to pairs in order; an incomplete last batch is dropped."""
    total = n_pairs // batch
    step = F.floor(F.col(place) / batch).cast("long")
    return pairs.withColumn("step", step).where(F.col("step") < total).withColumn(
        "micro", F.floor((F.col(place) % batch) / micro).cast("int")
    ).withColumn("lr", F.lit(lr) * preference_factor(F.col("step"), max(1, total)))
