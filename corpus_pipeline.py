"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows its predecessor kept, and what it decides takes
effect: rejected documents go, deleted lines are gone from the texts. All stages
but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import best_fit, line_dedup, ngram_join, positional_index, quality
from tokenloom.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are deleted; a document without any other line goes.

    A character count beside the text follows it.
    """
    done = line_dedup.delete_copies(docs)
    if "n_chars" not in done.columns:
        return done
    kind = done.schema["n_chars"].dataType
    return done.withColumn("n_chars", F.char_length("text").cast(kind))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return positional_index.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return best_fit.pack_best_fit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", drop_bad_quality),
    ("line_dedup", delete_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Hashed sketches, tokenisation and packing have no SQL form; tests compare with plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each reads what the one before has stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
