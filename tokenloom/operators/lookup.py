"""Lookup of names in a table of keys by prefix or substring: the first match in table order counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(name: Column, lengths: Column, prefix: bool) -> Column:
    """The prefixes (or all substrings) of a name that are as long as some key."""
    fit = F.filter(lengths, lambda n: n <= F.char_length(name))
    if prefix:
        return F.transform(fit, lambda n: F.substr(name, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(fit, lambda n: F.transform(
        F.sequence(F.lit(1), F.char_length(name) - n + 1), lambda at: F.substr(name, at, n)))))


def first_match(rows: DataFrame, name: str, entries: DataFrame, key: str = "key", order: str = "ord",
                prefix: bool = False) -> DataFrame:
    """``rows`` with the other columns of their first matching entry, null where none matches.

    A name matches a key that it contains, or begins with. Instead of comparing each name with
    each key, each different name is cut into its parts of the keys' lengths, and parts meet
    keys in an equi-join; so both tables may be of any size. Equal orders go by key.
    """
    values = [c for c in entries.columns if c not in (key, order)]
    lengths = entries.agg(F.collect_set(F.char_length(key)).alias("l")).scalar()
    names = rows.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    parts = names.withColumn("_lengths", lengths).select("_name", F.explode(_parts(F.col("_name"), F.col("_lengths"), prefix)).alias("_part"))
    best = parts.join(entries, parts["_part"] == entries[key]).groupBy("_name").agg(
        F.min_by(F.struct(*values), F.struct(order, key)).alias("_best"))
    return rows.join(best, rows[name] == best["_name"], "left").select(rows["*"], *[F.col(f"_best.{v}").alias(v) for v in values])
