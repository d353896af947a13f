"""Score files, a JSON record per model label, and the Markdown table.

A label that is scored again keeps only its newest record.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.scores import leaderboard, score_matrix, table_head

SCHEMA = "path string, `limit` int, scores map<string,double>, scored_at long, label string"


def score_rows(scores: DataFrame, models: DataFrame, limit: int | None = None) -> DataFrame:
    """``label, path, limit, scores`` with one score map per model (an entry per task)."""
    maps = scores.groupBy("label").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", F.round("score", 4))))).alias("scores"))
    return models.join(maps, "label", "left").select(
        "label", "path", F.lit(limit).cast("int").alias("limit"),
        F.coalesce("scores", F.create_map().cast("map<string,double>")).alias("scores"))


def write_scores(rows: DataFrame, path: str, folders: bool = False, scored_at: int | None = None) -> None:
    """Add score records, which replace earlier ones of their labels.

    ``scored_at`` orders the records of a label (default: the time now).
    ``folders`` gives every label a folder of its own, whose old record is
    overwritten; that suits tens of models rather than millions.
    """
    dated = rows.withColumn("scored_at", F.lit(time.time_ns() if scored_at is None else scored_at).cast("long"))
    if folders:
        dated.repartition("label").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("label").json(path)
    else:
        dated.write.mode("append").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``label, task, score`` of the newest record of every label."""
    files = spark.read.schema(SCHEMA).json(path)
    when = F.coalesce("scored_at", F.lit(0).cast("long"))
    newest = files.groupBy("label").agg(F.max_by("scores", when).alias("scores"))
    return newest.select("label", F.explode("scores").alias("task", "score"))


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """``label, task, score`` of files ``<label>.json``, one record each, labelled by file name."""
    files = spark.read.schema("path string, `limit` int, scores map<string,double>").option(
        "multiLine", True).option("pathGlobFilter", "*.json").json(path)
    label = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    label = F.url_decode(F.replace(label, F.lit("+"), F.lit("%2B")))  # metadata names are encoded
    return files.select(label.alias("label"), F.explode("scores").alias("task", "score"))


def scored_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path).select("label").distinct()


def markdown(scores: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """The leaderboard as text lines in order, head first."""
    spark = scores.sparkSession
    head = spark.createDataFrame(list(enumerate(table_head(tasks))), "ord int, value string")
    body = leaderboard(score_matrix(scores, tasks), tasks)
    lines = head.select(F.lit(0).alias("part"), "ord", F.lit(0.0).alias("down"), F.lit("").alias("label"), "value")
    rows = body.select(
        F.lit(1).alias("part"), F.lit(0).alias("ord"), (-F.col("mean_score")).alias("down"), "label",
        F.col("line").alias("value"))
    return lines.unionByName(rows).orderBy("part", "ord", "down", "label").select("value")


def write_markdown(scores: DataFrame, tasks: Sequence[str], path: str) -> None:
    """Part files in range order; read together they are the table."""
    markdown(scores, tasks).write.mode("overwrite").text(path)
