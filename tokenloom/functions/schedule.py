"""Learning-rate factors as column expressions over a step number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay_steps(total_steps: int, decay_frac: float) -> int:
    return max(1, int(total_steps * decay_frac))


def warm_stable_decay(step: Column, total_steps: int, warmup: int, decay_frac: float,
                      min_frac: float = 0.0) -> Column:
    """Linear warm-up, plateau, then one minus square root of the progress."""
    d = decay_steps(total_steps, decay_frac)
    begin = total_steps - d
    progress = F.least(F.lit(1.0), (step - begin) / F.lit(float(d)))
    tail = F.lit(min_frac) + F.lit(1.0 - min_frac) * (F.lit(1.0) - F.sqrt(progress))
    warm = (step + 1) / F.lit(float(max(1, warmup)))
    return F.when(step < warmup, warm).when(step < begin, F.lit(1.0)).otherwise(tail)


def rewarm(step: Column, since: int, warmup: int) -> Column:
    """Short second warm-up after the optimiser state was reset at ``since``."""
    return F.least(F.lit(1.0), (step - since + 1) / F.lit(float(max(1, warmup // 4))))


def in_decay(step: Column, total_steps: int, decay_frac: float) -> Column:
    return step >= total_steps - decay_steps(total_steps, decay_frac)


def preference_factor(step: Column, total: int) -> Column:
    """Warm-up over a tenth of the run times a linear fall to zero."""
    warm = F.least(F.lit(1.0), (step + 1) / F.lit(float(max(1, total // 10))))
    return warm * (F.lit(1.0) - step / F.lit(float(total)))
