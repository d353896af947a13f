"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import ship_package

#: Arrow batches of texts stay near this size whatever the texts' lengths.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """Ship the package to the executors and bound Arrow batches by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_key(text: str = "text") -> Column:
    """Tells rows of one id with different texts apart (null counts as empty)."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null gives an empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def equal_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of all keys."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on
