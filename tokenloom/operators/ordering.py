"""Global order at scale: running totals, ranks and seeded shuffles.

An unpartitioned (or hot-key) window sorts everything in one task. Here rows
are cut into ranges of the order key, sorted and totalled in place inside each
range, and lifted by the totals of the earlier ranges. Only groups that cross a
range border need lifting, so the joined-back table has at most one row per range.
The rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tokenloom.session import ship_package, stage

_SLICE = "_slice"
_COUNT = "_rows"


def _in_place(group: list[str], sums: list[str], rank: bool) -> Callable:
    """Exclusive running totals per group over the sorted rows of one range.

    Totals of the open group are carried from batch to batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        key, carried = None, np.zeros(len(sums) + rank, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(g)) for g in group]
            fresh = np.zeros(n, dtype=bool)
            for c in columns:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                fresh[1:] |= codes[1:] != codes[:-1]
            fresh[0] = key is None or [c[0].as_py() for c in columns] != key
            begins = np.flatnonzero(fresh)
            turn = np.cumsum(fresh) - 1  # -1: the group that the batch before left open
            out = []
            amounts = [batch.column(batch.schema.get_field_index(s)).cast(pa.int64()).fill_null(0).to_numpy() for s in sums]
            for i, amount in enumerate([*amounts, *([np.ones(n, dtype=np.int64)] * rank)]):
                upto = np.cumsum(amount)
                before = upto - amount
                start = np.r_[before[begins], -carried[i]]  # the last entry serves turn -1
                out.append(pa.array(before - start[turn]))
                carried[i] = upto[-1] - start[turn[-1]]
            key = [c[-1].as_py() for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, piece, dtype=np.int32)), *out],
                names=[*batch.schema.names, _SLICE, *(f"out{i}" for i in range(len(out)))])
    return run


def running_totals(
    df: DataFrame,
    order_by: Sequence[str],
    sums: Mapping[str, str] | None = None,
    group_by: Sequence[str] = (),
    rank: str | None = None,
    label: str = "totals",
) -> DataFrame:
    """Add, per row, the sums over all *earlier* rows of its group.

    ``sums`` maps an integer column to the name of its exclusive running total;
    ``rank`` names a 0-based position. ``order_by`` must be unique in a group.
    Groups may be of any size and number: a group is spread over as many
    ranges as its rows fill.
    """
    sums = dict(sums or {})
    if not sums and rank is None:
        raise ValueError("nothing to total")
    group, order = list(group_by), list(order_by)
    outs = [*sums.values(), *([rank] if rank is not None else [])]
    ship_package(df.sparkSession)
    ranges = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    schema = StructType([*df.schema.fields, StructField(_SLICE, IntegerType()), *(StructField(o, LongType()) for o in outs)])
    # Written before use: the range of a row is then a stored value, so both
    # readers below agree on it even after lost executors.
    staged = stage(ranges.mapInArrow(_in_place(group, list(sums), rank is not None), schema), label)

    totals = staged.groupBy(_SLICE, *group).agg(
        *[F.sum(c).cast("long").alias(f"_t_{out}") for c, out in sums.items()],
        F.count(F.lit(1)).alias(_COUNT),
    )
    sources = {out: f"_t_{out}" for out in sums.values()}
    if rank is not None:
        sources[rank] = _COUNT
    # Per group one row per range it touches, so at most as many as ranges.
    earlier = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    lift = (
        totals.select(
            _SLICE, *group,
            F.count(F.lit(1)).over(earlier).alias("_seen"),
            *[F.sum(src).over(earlier).alias(f"_l_{out}") for out, src in sources.items()],
        )
        .where(F.col("_seen") > 0)
        .drop("_seen")
    )
    # Range cuts put a continued group first in its range: one lift row per
    # range, hence never more rows than shuffle partitions.
    joined = staged.join(F.broadcast(lift), [_SLICE, *group], "left")
    keep = [c for c in df.columns]
    return joined.select(
        *keep,
        *[(F.col(out) + F.coalesce(F.col(f"_l_{out}"), F.lit(0))).alias(out) for out in sources],
    )


def seeded_key(seed: int | str | Column, *ids: str) -> Column:
    """Shuffle key of a row: md5 over the seed and the row's id columns."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", head.cast("string"), *[F.col(c).cast("string") for c in ids]))


def seeded_order(df: DataFrame, seed: int, ids: Sequence[str], out: str = "place") -> DataFrame:
    """Position of every row in the seeded shuffle of the table.

    Only key and ids pass through the ordering; wide columns join back after.
    """
    keyed = df.select(*ids).withColumn("_key", seeded_key(seed, *ids))
    placed = running_totals(keyed, ["_key", *ids], rank=out, label="shuffle")
    narrow = placed.select(*ids, out)
    if set(df.columns) == set(ids):
        return narrow
    return df.join(narrow, list(ids))


def seeded_sample(df: DataFrame, seed: int, ids: Sequence[str], n: int, out: str = "place") -> DataFrame:
    """The first ``n`` rows of the seeded shuffle, with their positions.

    Keys are uniform, so the n smallest lie below a bound that follows from the
    row count; only rows below it are put in order. Should too few lie there,
    all rows are ordered instead.
    """
    keyed = stage(df.select(*ids).withColumn("_key", seeded_key(seed, *ids)), "keys")
    total = keyed.count()
    share = (n + 8 * n ** 0.5 + 16) / max(total, 1)
    near = keyed.where(F.col("_key") < f"{int(share * 16 ** 12):012x}") if share < 1 else keyed
    if share < 1 and near.count() < n:
        near = keyed
    placed = running_totals(near, ["_key", *ids], rank=out, label="sample")
    return df.join(placed.where(F.col(out) < n).select(*ids, out), list(ids))


def epoch_permutations(df: DataFrame, ids: Sequence[str], epochs: int, steps_per_epoch: int,
                       out: str = "place") -> DataFrame:
    """One fresh permutation of all rows per epoch, seeded by its first step."""
    per_epoch = df.select(*ids).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keyed = per_epoch.withColumn("_key", seeded_key(F.col("epoch") * F.lit(steps_per_epoch), *ids))
    return running_totals(
        keyed, ["_key", *ids], group_by=["epoch"], rank=out, label="epochs"
    ).drop("_key")


def buffered_shuffle(df: DataFrame, order_by: Sequence[str], seed: int, buffer: int, out: str = "place") -> DataFrame:
    """``order_by`` (unique) and each row's position after a shuffle with a buffer, as a reader with bounded memory does it.

    The buffer is filled with the first rows. Then each further row is a step: it takes the place
    of the row in a drawn slot, which leaves; at the end the rest leaves in a drawn order. The slot
    drawn at a step is a function of seed and step alone, so a row leaves at the *next* step
    that draws its slot: a ``lead`` over the draws of a slot, without a loop. A slot sees about
    rows / buffer rows.
    """
    order = list(order_by)
    read = running_totals(df.select(*order), order, rank="_read", label="buffered")
    step = F.col("_read") - buffer
    drawn = F.conv(F.substring(seeded_key(seed, "_step"), 1, 12), 16, 10).cast("long") % buffer
    held = read.withColumn("_step", F.greatest(step, F.lit(-1))).withColumn(
        "_slot", F.when(F.col("_step") < 0, F.col("_read")).otherwise(drawn))
    moved = stage(held.withColumn(out, F.lead("_step").over(Window.partitionBy("_slot").orderBy("_step"))), "leaving")
    left = moved.where(F.col(out).isNull()).select(*order, "_slot").withColumn("_key", seeded_key(f"{seed}:end", "_slot"))
    steps = moved.where("_step >= 0").count()
    rest = running_totals(left, ["_key", "_slot"], rank="_rank", label="buffer-end").select(
        *order, (F.col("_rank") + steps).alias(out))
    return moved.where(F.col(out).isNotNull()).select(*order, out).unionByName(rest)
