"""Training-run logs: curves, last values, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_lines(log: DataFrame, order: str = "line") -> DataFrame:
    """One line per run, split and step: the last written.

    A resumed run appends steps it has logged before. ``max_by`` keeps one
    value per task and key before the shuffle.
    """
    keys = ["run", "split", "step"]
    values = [c for c in log.columns if c not in (*keys, order)]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_v"))
    return best.select(*keys, "_v.*")


def loss_curve(log: DataFrame, split: str) -> DataFrame:
    """Loss by step of one split, a curve per run, in step order."""
    return log.where(F.col("split") == split).select("run", "step", "loss").orderBy("run", "step")


def compare_runs(log: DataFrame) -> DataFrame:
    """Per run the last and best validation loss and the last training loss."""
    val, train = F.col("split") == "val", F.col("split") == "train"

    def last(column: str, cond: Column) -> Column:
        return F.max_by(F.when(cond, F.col(column)), F.when(cond, F.col("step")))

    return log.groupBy("run").agg(
        F.max("step").alias("last_step"),
        F.sum(val.cast("int")).cast("long").alias("val_points"),
        last("loss", val).alias("final_val_loss"),
        F.min(F.when(val, F.col("loss"))).alias("best_val_loss"),
        last("loss", train).alias("final_train_loss"),
    )


def throughput(steps: DataFrame, tokens_per_step: int, flops_per_token: Column, peak: Column,
               devices: int = 1, seconds: str = "seconds") -> DataFrame:
    """Adds tokens per second and model FLOP utilisation (null for an unknown device)."""
    dt = F.col(seconds)
    return steps.withColumn("tok_s", F.floor(F.lit(tokens_per_step) / dt).cast("long")).withColumn(
        "mfu", flops_per_token * F.lit(tokens_per_step) / dt / (peak * F.lit(1e12) * devices))
