"""Hard negatives by a vertical scan of vectors (BOND): dimension by dimension, with shrinking candidates.

Vectors are stored as blocks of columns: one row of the block table holds a dimension
after the other for some thousand vectors, with each dimension's least and largest
value. An anchor reads the dimensions in descending size of its own components. What
the dimensions still unread can add lies between bounds made of those extremes, so
after every few dimensions the bitmap of candidates loses the vectors that can't come
into the result any more; what is left at the end has its exact score.

Two scans: the first finds each anchor's ``positives`` best others of its label. Their
scores give windows, and the second finds the ``negatives`` best vectors of another label
in each window (least_percent * positive <= 100 * negative <= 100 * positive). Groups of
anchors meet all blocks in the cells of a grid, so neither passes the driver, and a task
holds one block and one group at a time. Within a group, what earlier blocks of the
task have reached is a bound for the next. Blocks give a handful of rows per anchor,
and one ordering per anchor merges them; labels don't deal the rows, so one label may
have any share of them.

Components are integers; scores are inner products in 64-bit integers.

Cases: rows with a null label, a null vector or a null component take no part; vectors
of unlike lengths count as filled up with zeros. Equal scores go by ascending id, a null
id first. Equal rows count once; rows with an equal id and other contents are rows of
their own, but never positives of each other. Empty tables give no rows; columns
other than id, vector and label aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokenloom.llm.common import ready
from tokenloom.session import stage, wide_partitions

POSITIVES = NEGATIVES = 5
LEAST_PERCENT = 80
BLOCK_VALUES = 1 << 18
GROUP = 128
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Meetings of a group and a block that make up the work of one task (some minutes).
MEETINGS = 4096
_LOW = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component in doubles; null where a component is null or not finite."""
    def whole(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    values = vector.cast("array<double>")
    return F.when(F.forall(values, whole), F.transform(values, lambda x: F.floor(x * scale)))


def _matrix(lists: list[list[int]]) -> np.ndarray:
    """One row per vector, as long as the longest."""
    out = np.zeros((len(lists), max(map(len, lists), default=0)), dtype=np.int64)
    for row, values in zip(out, lists, strict=True):
        row[: len(values)] = values
    return out


def column_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (id, label, vec) as blocks of columns, the vectors of a block in id order."""
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def block(held: list[tuple]) -> pa.RecordBatch:
        held = sorted(held, key=lambda r: (False, 0, r[1], r[2]) if r[0] is None else (True, *r))
        table = _matrix([r[2] for r in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([table.shape[1]], pa.int32()), pa.array([[r[0] for r in held]], pa.list_(id_type)),
             pa.array([[r[1] for r in held]]), pa.array([np.ascontiguousarray(table.T).tobytes()], pa.binary())],
            names=["dims", "ids", "labels", "columns"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        values = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                values += len(row[2]) + 1
                if values >= BLOCK_VALUES:
                    yield block(held)
                    held, values = [], 0
        if held:
            yield block(held)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "label", "vec").mapInArrow(pack, f"dims int, ids array<{kind}>, labels array<string>, columns binary")


class Block:
    """Columns of a block, ready for scans."""

    def __init__(self, row: dict):
        dims = row["dims"]
        self.ids = row["ids"]
        table = np.frombuffer(row["columns"], dtype=np.int64).reshape(dims, -1) if dims else np.zeros((0, len(self.ids)), np.int64)
        self.least, self.most = (table.min(axis=1), table.max(axis=1)) if dims else (np.zeros(0, np.int64),) * 2
        self.reach = max(-int(self.least.min(initial=0)), int(self.most.max(initial=0)))
        self.columns, self.floats = table, None
        self.codes: dict[str, int] = {}
        self.labels = np.array([self.codes.setdefault(x, len(self.codes)) for x in row["labels"]], dtype=np.int64)
        self.places: dict[object, list[int]] = {}
        for at, i in enumerate(self.ids):
            self.places.setdefault(i, []).append(at)

    def table(self, vector: np.ndarray) -> np.ndarray:
        """The columns in doubles where these hold all sums exactly, else in integers."""
        if self.reach * int(np.abs(vector).max(initial=0)) * max(len(vector), 1) >= 1 << 53:
            return self.columns
        if self.floats is None:
            self.floats = self.columns.astype(np.float64)
        return self.floats

    def scan(self, vector: np.ndarray, candidates: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates that ``prune`` leaves.

        prune(lower, upper) gets bounds of the scores and tells which candidates stay.
        """
        vector = vector[: len(self.columns)]
        order = np.argsort(-np.abs(vector), kind="stable")
        order = order[vector[order] != 0]
        ends = np.stack([vector[order] * self.least[order], vector[order] * self.most[order]])
        low, high = (np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(axis=0), ends.max(axis=0)))
        table = self.table(vector)
        scores = np.zeros(len(candidates), dtype=table.dtype)
        for at in range(0, len(order), STEP):
            dims = order[at:at + STEP]
            part = table[dims] if len(candidates) == table.shape[1] else table[np.ix_(dims, candidates)]
            scores = scores + vector[dims].astype(table.dtype) @ part
            after = min(at + STEP, len(order))
            stays = prune(scores + low[after], scores + high[after])
            if not stays.all():
                candidates, scores = candidates[stays], scores[stays]
            if not len(candidates):
                break
        return candidates, scores.astype(np.int64)


def _kth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else _LOW


def _best(places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which of the candidates, in id order, are the k best."""
    return np.lexsort((places, -scores))[:k]


def best_positives(block: Block, anchor: dict, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best others of the anchor's label in the block, of those that reach ``least``."""
    mask = block.labels == block.codes.get(anchor["label"], -1)
    mask[block.places.get(anchor["id"], [])] = False

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= max(least, _kth(lower, k))

    places, scores = block.scan(anchor["vec"], np.flatnonzero(mask), prune)
    chosen = _best(places, scores, k)
    return places[chosen], scores[chosen]


def best_negatives(block: Block, anchor: dict, windows: list[tuple[int, int]], k: int,
                   least: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high), the k best rows of another label in it, of those that reach ``least``."""
    mask = block.labels != block.codes.get(anchor["label"], -1)
    lows = [max(low, reached) for (low, _), reached in zip(windows, least, strict=True)]

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(lower), dtype=bool)
        for (low, high), bound in zip(windows, lows, strict=True):
            # Rows that lie in the window for sure push its bound up.
            sure = lower[(lower >= low) & (upper <= high)]
            stays |= (upper >= max(bound, _kth(sure, k))) & (lower <= high)
        return stays

    places, scores = block.scan(anchor["vec"], np.flatnonzero(mask), prune)
    out = []
    for (_, high), bound in zip(windows, lows, strict=True):
        inside = np.flatnonzero((scores >= bound) & (scores <= high))
        chosen = inside[_best(places[inside], scores[inside], k)]
        out.append((places[chosen], scores[chosen]))
    return out


@dataclass
class Reached:
    """The k best scores that the blocks of a task have given, per anchor and window of one group."""

    group: object = None
    scores: dict | None = None

    def of(self, key: tuple, k: int) -> int:
        held = self.scores.get(key, ())
        return held[k - 1] if len(held) >= k else _LOW

    def add(self, key: tuple, scores: np.ndarray, k: int) -> None:
        if len(scores):
            self.scores[key] = sorted([*self.scores.get(key, ()), *scores.tolist()], reverse=True)[:k]


def _meet(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every group of anchors beside every block, once.

    Both are dealt into rows and columns of a grid of cells, as many as the work needs;
    in a cell each group, one after the other, meets the cell's blocks.
    """
    group = F.floor(F.col("anchor") / GROUP).alias("group")
    groups = stage(anchors.groupBy(group).agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors")), "anchor-groups")
    n_blocks, n_groups = blocks.count(), groups.count()
    tasks = max(wide_partitions(blocks.sparkSession), math.ceil(n_blocks * n_groups / MEETINGS))
    down = max(1, min(n_blocks, tasks))
    across = max(1, min(n_groups, math.ceil(tasks / down)))

    def dealt(df: DataFrame, own: str, own_cells: int, key: str, other: str, other_cells: int) -> DataFrame:
        celled = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_cells)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_cells - 1))))
        return celled.repartition(down * across, "down", "across")

    return dealt(groups, "across", across, "group", "down", down).join(
        dealt(blocks, "down", down, "block", "across", across), ["down", "across"]).select(
        "group", "anchors", "dims", "ids", "labels", "columns")


def _scan_pairs(pairs: DataFrame, k: int, second: bool, kind: str) -> DataFrame:
    """(anchor, window, id, score): the k best of each block, at most, per anchor and window."""
    id_type = to_arrow_type(pairs.schema["ids"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = Reached()
        for batch in batches:
            for row in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                block = Block(row)
                if reached.group != row["group"]:
                    reached = Reached(row["group"], {})
                out: list[tuple] = []
                for a in row["anchors"]:
                    a["vec"] = np.array(a["vec"], dtype=np.int64)
                    wins = a["windows"] if second else [None]
                    least = [reached.of((a["anchor"], w), k) for w in range(len(wins))]
                    if second:
                        found = best_negatives(block, a, [(w["low"], w["high"]) for w in wins], k, least)
                    else:
                        found = [best_positives(block, a, k, least[0])]
                    for w, (places, scores) in enumerate(found):
                        reached.add((a["anchor"], w), scores, k)
                        out += [(a["anchor"], w, block.ids[p], s) for p, s in zip(places.tolist(), scores.tolist(), strict=True)]
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2], id_type), pa.array(columns[3])],
                        names=["anchor", "window", "id", "score"])

    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc("id"))
    found = pairs.mapInArrow(run, f"anchor long, window int, id {kind}, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector`` holds integers (see :func:`quantised`); ``is_anchor`` is a condition on ``rows``.
    """
    ready(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    whole = F.col(label).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull())
    held = stage(rows.where(whole).select(
        F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<long>").alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks")).distinct(), "vectors")
    blocks = stage(column_blocks(held).withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
    # Numbered in runs per task, so groups of consecutive numbers are full ones.
    anchors = stage(held.where("asks").select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "vec"), "anchors")

    near = _scan_pairs(_meet(blocks, anchors), positives, False, kind)
    near = stage(near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Equal scores have one window: its negatives serve all positives that have it.
    low = F.expr(f"({least_percent} * positive_score + 99) div 100")
    window = F.struct(low.alias("low"), F.col("positive_score").alias("high"))
    windows = near.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set(window)).alias("windows"))
    asking = stage(anchors.join(windows, "anchor"), "windows")
    far = _scan_pairs(_meet(blocks, asking), negatives, True, kind)

    wins = asking.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("windows").alias("window", "w"))
    pairs = near.join(wins, "anchor").where(F.col("w.high") == F.col("positive_score"))
    return pairs.join(far.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
                      ["anchor", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
