"""Byte-level BPE vocabulary training as rounds over the distinct pieces.

The corpus is read once, to count distinct pieces. Each round then counts the
adjacent token pairs, weighted by piece count, and merges. A round applies a
whole batch of merges, yet gives exactly the merges of the one-at-a-time rule:
with pairs sorted by (count, pair), take the longest prefix in which no token
is the left of one pair and the right of another. Such pairs never overlap in a
piece, so merging one leaves the counts of the others as they are; and a pair
with a new token occurs at most as often as some pair outside the prefix did.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tokenloom.functions.encode import PieceEncoder
from tokenloom.functions.text import FIRST_MERGE, SPECIAL_TOKENS, byte_ids, pieces
from tokenloom.operators.filters import check_vocabulary
from tokenloom.session import stage, wide_partitions

MERGES_SCHEMA = "rank int, left int, right int, new_id int"
# Pairs looked at per round; a batch is a prefix of them, so a small number
# costs only rounds, never correctness.
CANDIDATES = 1024
# Pairs whose counts are kept on the driver.
WATCHED = 16_384


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(0).flatten().value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["piece", "n"])


def piece_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct pre-tokens of the corpus with their counts.

    Each Arrow batch is counted where it is, so no piece is ever a row of its own.
    """
    found = texts.select(pieces(F.col(text)).alias("pieces")).mapInArrow(_count_pieces, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def _layout(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids, the row of each id, and the row counts of a batch of words."""
    lists, n = batch.column("ids"), batch.column("n").to_numpy(zero_copy_only=False)
    word = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), word, n


def _apply(merger: PieceEncoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, word, n = _layout(batch)
            ids, word = merger.merge(ids, word)
            size = np.bincount(word, minlength=len(n))
            offsets = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            # A piece that became one token has no pair left.
            yield pa.RecordBatch.from_arrays([lists, batch.column("n")], ["ids", "n"]).filter(pa.array(size > 1))
    return run


def _count_pairs(merger: PieceEncoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, word, n = _layout(batch)
            ids, word = merger.merge(ids, word)
            same = np.flatnonzero(word[:-1] == word[1:])
            if not len(same):
                continue
            group, pair = pd.factorize((ids[same] << 20) | ids[same + 1])
            total = np.zeros(len(pair), dtype=np.int64)
            np.add.at(total, group, n[word[same]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair >> 20, pa.int32()), pa.array(pair & 0xFFFFF, pa.int32()),
                 pa.array(total, pa.int64())], ["left", "right", "n"])
    return run


def pair_counts(words: DataFrame, pending: list[tuple[int, int]] = (), first_id: int = FIRST_MERGE) -> DataFrame:
    """Adjacent id pairs of ``words(ids, n)`` after ``pending`` merges, with their counts.

    Each Arrow batch is summed where it is; only partial sums are shuffled.
    """
    partial = words.mapInArrow(_count_pairs(PieceEncoder(list(pending), first_id)), "left int, right int, n long")
    return partial.groupBy("left", "right").agg(F.sum("n").alias("n"))


def _batch(candidates: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    lefts: set[int] = set()
    rights: set[int] = set()
    out: list[tuple[int, int]] = []
    for a, b in candidates[:room]:
        clash = a == b or a in rights or b in lefts
        if clash and out:
            break
        out.append((a, b))
        lefts.add(a)
        rights.add(b)
        if clash:
            break
    return out


def _pair_changes(before: PieceEncoder, step: PieceEncoder, watched: np.ndarray, first_new: int):
    """What a batch of merges does to the pair counts, from the words it changes alone.

    Old pairs are reported if they are watched; pairs with a new token always.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, word, n = _layout(batch)
            ids, word = before.merge(ids, word)
            busy = step.words_to_merge(ids, word)
            ids, word = ids[busy], word[busy]
            if not len(ids):
                continue
            keys, amounts = [], []
            for sign, (i, w) in ((-1, (ids, word)), (1, step.merge(ids, word))):
                same = np.flatnonzero(w[:-1] == w[1:])
                keys.append((i[same] << 20) | i[same + 1])
                amounts.append(sign * n[w[same]])
            group, pair = pd.factorize(np.concatenate(keys))
            total = np.zeros(len(pair), dtype=np.int64)
            np.add.at(total, group, np.concatenate(amounts))
            new = ((pair >> 20) >= first_new) | ((pair & 0xFFFFF) >= first_new)
            report = (total != 0) & (new | np.isin(pair, watched))
            pair, total = pair[report], total[report]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair >> 20, pa.int32()), pa.array(pair & 0xFFFFF, pa.int32()),
                 pa.array(total, pa.int64())], ["left", "right", "n"])
    return run


def train_bpe(
    spark: SparkSession,
    counts: DataFrame,
    vocab_size: int,
    min_frequency: int = 2,
    rounds_per_stage: int = 32,
) -> DataFrame:
    """Merges of a byte-level vocabulary from ``counts(piece, n)``.

    Special tokens come first, then the 256 bytes, then the merges by rank.
    Ties go to the smaller left, then the smaller right id.

    All pairs are counted once; the WATCHED most frequent are then kept up to date
    by what each batch of merges changes. A merge never makes an old pair more
    frequent, and pairs with a new token are counted in full as they arise. So
    the watched pairs hold the most frequent one until it falls below the least
    count they were taken with; then all pairs are counted again.
    """
    check_vocabulary(vocab_size)
    room = vocab_size - FIRST_MERGE
    merges: list[tuple[int, int]] = []
    words = counts.select(byte_ids(F.col("piece")).alias("ids"), F.col("n").cast("long").alias("n"))
    words = words.where(F.size("ids") > 1)
    held, staged, rounds = None, 0, 0
    watched: dict[int, int] = {}
    floor, only_ties = None, False  # pairs that are not watched occur less often than the floor
    while len(merges) < room:
        if rounds % rounds_per_stage == 0:
            if merges:
                step = PieceEncoder(merges[staged:], FIRST_MERGE + staged)
                words = held.mapInArrow(_apply(step), "ids array<int>, n long")
            # Each round is work for every core, however small the table.
            fresh = stage(words.repartition(wide_partitions(spark)), "bpe-words").persist(StorageLevel.MEMORY_AND_DISK)
            if held is not None:
                held.unpersist()
            held, staged = fresh, len(merges)
        rounds += 1
        top = _most_frequent(watched)
        if floor is None or (floor > min_frequency and (not top or watched[top[0]] < floor)):
            rows = (
                pair_counts(held, merges[staged:], FIRST_MERGE + staged).where(F.col("n") >= min_frequency)
                .orderBy(F.desc("n"), "left", "right").limit(WATCHED).collect()
            )
            watched = {(r["left"] << 20) | r["right"]: r["n"] for r in rows}
            floor = min_frequency
            if len(rows) == WATCHED:
                floor = rows[-1]["n"] + 1  # the least count may have more pairs
            top = _most_frequent(watched)
            only_ties = bool(rows) and rows[0]["n"] < floor
        ready = [k for k in top if watched[k] >= floor or only_ties]
        if not ready:
            break
        batch = _batch([(k >> 20, k & 0xFFFFF) for k in ready], room - len(merges))
        first = FIRST_MERGE + len(merges)
        changes = held.mapInArrow(
            _pair_changes(PieceEncoder(merges[staged:], FIRST_MERGE + staged), PieceEncoder(batch, first),
                          np.fromiter(watched, np.int64, len(watched)), first),
            "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
        merges += batch
        if only_ties:  # as many pairs may be as frequent and not watched: count again
            floor = None
            continue
        for r in changes.where((F.col("n") < 0) | (F.col("n") >= floor)).collect():
            key = (r["left"] << 20) | r["right"]
            left = watched.get(key, 0) + r["n"]
            if left >= floor:
                watched[key] = left
            else:
                watched.pop(key, None)
    if held is not None:
        held.unpersist()
    return spark.createDataFrame(
        [(i, a, b, FIRST_MERGE + i) for i, (a, b) in enumerate(merges)], MERGES_SCHEMA)


def _most_frequent(watched: dict[int, int]) -> list[int]:
    """Keys of the CANDIDATES most frequent pairs, ties by left, then right id."""
    if not watched:
        return []
    keys = np.fromiter(watched, np.int64, len(watched))
    counts = np.fromiter(watched.values(), np.int64, len(watched))
    return keys[np.lexsort((keys, -counts))[:CANDIDATES]].tolist()


def write_vocabulary(merges: DataFrame, path: str) -> None:
    """The merges as one JSON-lines file, by rank: all that encoding needs."""
    merges.coalesce(1).sortWithinPartitions("rank").write.json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The merges of a stored vocabulary; ranks must be whole."""
    merges = spark.read.schema(MERGES_SCHEMA).json(path)
    size = merges.agg(F.count(F.lit(1)), F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    if size[0] and (size[1], size[2], size[3]) != (0, size[0] - 1, size[0]):
        raise ValueError(f"the ranks in {path!r} have gaps")
    return merges


def merge_list(merges: DataFrame) -> list[tuple[int, int]]:
    """The (left, right) ids by rank; at most 65,536 rows by the vocabulary limit."""
    rows = merges.orderBy("rank").limit(check_vocabulary(merges.count()) + 1).collect()
    return [(r["left"], r["right"]) for r in rows]


def token_bytes(merge_pairs: list[tuple[int, int]]) -> list[bytes | None]:
    """Bytes of every token id; special tokens stand for no bytes."""
    out: list[bytes | None] = [None] * len(SPECIAL_TOKENS) + [bytes([b]) for b in range(256)]
    for left, right in merge_pairs:
        out.append(out[left] + out[right])
    return out


def vocabulary(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """The whole vocabulary: ``id, token_bytes, special``."""
    tokens = token_bytes(merge_list(merges))
    rows = [
        (i, bytearray(SPECIAL_TOKENS[i].encode() if t is None else t), t is None) for i, t in enumerate(tokens)
    ]
    return spark.createDataFrame(rows, "id int, token_bytes binary, special boolean")
