"""The registered queries and their SQL counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import folder_entries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_held: dict[tuple[str, str, str], tuple[list, object]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def artifact(fn: Callable) -> Callable:
    """Build a pipeline artifact (staged table, vocabulary) once per session and input.

    As in a real run, where the vocabulary and the token table are files that
    many later jobs read. Built anew once the folder's files have changed.
    """
    @functools.wraps(fn)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        files = folder_entries(spark, sf_dir)
        if key not in _held or _held[key][0] != files:
            _held[key] = (files, fn(spark, sf_dir))
        return _held[key][1]

    def keep(spark: SparkSession, sf_dir: str, value: object) -> None:
        _held[(spark.sparkContext.applicationId, sf_dir, fn.__name__)] = (folder_entries(spark, sf_dir), value)

    get.fresh, get.keep = fn, keep
    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(ids: Column) -> Column:
    """md5 over the ids, each followed by a comma."""
    return F.md5(F.concat(F.array_join(ids.cast("array<string>"), ","), F.lit(",")))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
