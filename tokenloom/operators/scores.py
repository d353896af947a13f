"""Benchmark scores: choosing the metric, the leaderboard, what is left to score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Benchmark tasks with the metric each is judged by, in table
# order, and the public baseline models.
TASKS = {
    "hellaswag": "acc_norm",
    "arc_easy": "acc_norm",
    "arc_challenge": "acc_norm",
    "piqa": "acc_norm",
    "winogrande": "acc",
    "openbookqa": "acc_norm",
    "sciq": "acc_norm",
    "lambada_openai": "acc",
    "mmlu_continuation": "acc_norm",
}
BASELINES = {
    "gpt2-124M": "openai-community/gpt2",
    "gpt2-355M": "openai-community/gpt2-medium",
    "pythia-410M": "EleutherAI/pythia-410m",
    "smollm2-360M": "HuggingFaceTB/SmolLM2-360M",
}


def model_list(pairs: DataFrame, baselines: Mapping[str, str] | None = BASELINES, pair: str = "pair") -> DataFrame:
    """``label, path`` from ``label=path`` texts; baselines win on an equal label.

    Among equal labels of the user the last one given counts (by ``ord``).
    """
    parts = F.split(F.col(pair), "=", 2)
    own = pairs.select(parts[0].alias("label"), parts[1].alias("path"), F.lit(0).alias("_p"), F.col("ord").cast("long").alias("ord"))
    if baselines:
        extra = pairs.sparkSession.createDataFrame(
            [(k, v, 1, i) for i, (k, v) in enumerate(baselines.items())], own.schema)
        own = own.unionByName(extra)
    return own.groupBy("label").agg(F.max_by("path", F.struct("_p", "ord")).alias("path"))


def left_to_score(models: DataFrame, scored: DataFrame, force: bool = False) -> DataFrame:
    """Models without a score file, or all of them."""
    return models if force else models.join(scored.select("label").distinct(), "label", "left_anti")


def select_scores(raw: DataFrame, tasks: Mapping[str, str] | None = None) -> DataFrame:
    """``label, task, score`` from raw ``label, task, metric, value`` rows.

    The metric of the task, else accuracy; a task with neither has no row.
    """
    wanted = dict(TASKS if tasks is None else tasks)
    metric = F.coalesce(*[F.when(F.col("task") == t, F.lit(m)) for t, m in wanted.items()], F.lit("acc"))
    kept = raw.where(F.col("task").isin(*wanted))
    picked = kept.groupBy("label", "task").agg(
        F.coalesce(
            F.max(F.when(F.col("metric") == metric, F.col("value"))),
            F.max(F.when(F.col("metric") == "acc", F.col("value"))),
        ).alias("score"))
    return picked.where(F.col("score").isNotNull()).withColumn("score", F.round("score", 4))


def score_matrix(scores: DataFrame, tasks: Sequence[str] | None = None) -> DataFrame:
    """One row per label, a column per task (null if missing), the mean of the present ones."""
    names = list(TASKS if tasks is None else tasks)
    wide = scores.groupBy("label").agg(
        *[F.max(F.when(F.col("task") == t, F.col("score"))).alias(t) for t in names])
    values = F.array_compact(F.array(*[F.col(t) for t in names]))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))
    return wide.withColumn("mean_score", mean)


def one_decimal(x: Column) -> Column:
    """Text of a non-negative double with one decimal, rounded by its exact binary value; null stays null.

    The comparison with the midpoint is exact: the two products by powers of
    two do not round, and their differences from it are representable.
    """
    low = F.floor(x * 10).cast("double")
    mid = low * 2 + 1
    side = (x * 16 - mid) + x * 4
    up = (side > 0) | ((side == 0) & (low % 2 == 1))
    text = F.format_string("%.1f", (low + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / 10)
    return F.when(x.isNotNull(), text)


def leaderboard(matrix: DataFrame, tasks: Sequence[str] | None = None) -> DataFrame:
    """Adds ``line``, the Markdown row, and sorts by mean (best first), then label."""
    names = list(TASKS if tasks is None else tasks)
    cells = [F.coalesce(one_decimal(F.col(t) * 100), F.lit("–")) for t in names]
    line = F.concat(
        F.lit("| "), F.concat_ws(" | ", "label", *cells),
        F.lit(" | **"), one_decimal(F.col("mean_score") * 100), F.lit("** |"),
    )
    return matrix.withColumn("line", line).orderBy(F.desc("mean_score"), "label")


# First and last heading of the table.
LABEL_HEAD, MEAN_HEAD = "Modèle", "Moyenne"


def table_head(tasks: Sequence[str] | None = None) -> list[str]:
    """Heading and rule of the Markdown table."""
    names = list(TASKS if tasks is None else tasks)
    return ["| " + " | ".join([LABEL_HEAD, *names, MEAN_HEAD]) + " |", "|---|" + "---|" * (len(names) + 1)]
