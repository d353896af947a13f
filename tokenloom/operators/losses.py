"""Loss figures from logged per-token values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_loss(tokens: DataFrame, group_by: Sequence[str], lse: Column, target: Column, mask: Column,
               z_coef: float = 0.0) -> DataFrame:
    """Masked cross-entropy, z term and their weighted sum per group.

    ``lse`` is the log-sum-exp of the logits and ``target`` the logit of the
    right token. A group without counted tokens has loss 0.
    """
    m = mask.cast("double")
    denom = F.greatest(F.sum(m), F.lit(1.0))
    sums = tokens.groupBy(*group_by).agg(
        (F.sum((lse - target) * m) / denom).alias("ce"),
        (F.sum(lse * lse * m) / denom).alias("z"),
        F.sum(m).cast("long").alias("counted"),
    )
    return sums.select(*group_by, "counted", "ce", "z", (F.col("ce") + F.lit(z_coef) * F.col("z")).alias("loss"))


def validation_loss(batch_losses: DataFrame, group_by: Sequence[str] = (), ce: str = "ce") -> DataFrame:
    """Unweighted mean of batch losses and its perplexity."""
    return batch_losses.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("batches"), F.avg(ce).alias("val_loss"), F.exp(F.avg(ce)).alias("perplexity"))
