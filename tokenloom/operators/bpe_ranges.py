"""BPE vocabularies over more pieces than a driver holds: a range of pair counts at a time.

A merge never makes a pair more frequent, and a pair with a new token stands where the
older pair at its border stood. So where two neighbouring tokens are a pair that occurs less often than
some floor, no merge that occurs that often will ever reach across. A round picks a floor and
cuts the pieces at all rarer pairs. What is left are short segments, most of them the same in
many pieces: tasks count the different ones, and they alone go to the driver. There the rule is
followed one merge at a time until the most frequent pair lies below the floor; all counts above
the floor are exact, so these are the merges of the whole corpus. Then all pieces are merged so far, and
the next round has a lower floor.

The floor is as low as lets the segments fit ``most`` tokens, and at least the most frequent pair is
above it. Pieces that all fit are merged to the end in one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.encode import PieceEncoder
from tokenloom.functions.text import FIRST_MERGE, byte_ids
from tokenloom.operators.bpe import MERGES_SCHEMA, _apply, _layout
from tokenloom.operators.bpe_draft import _BASE, _GAP, _SKIP, PER_TASK, PairCounts, Pieces, _char, _ids
from tokenloom.operators.filters import check_vocabulary
from tokenloom.session import stage

#: Tokens of all different segments that the driver holds at once, and pairs whose counts it is told.
MOST, PAIRS = 3_000_000, 1 << 20
#: Tokens that a task works on at once, and words it lays out at once.
AT_ONCE, ROWS = 1 << 18, 5_000


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a task, ``AT_ONCE`` tokens or a batch at a time: ids, how often each word occurs, the places where a pair begins, the pairs."""
    parts, words, held = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            ids, word, n = _layout(batch.slice(at, ROWS))
            parts.append((ids.astype(np.int32), (word + words).astype(np.int32), n))
            words, held = words + len(n), held + len(ids)
            if held >= AT_ONCE:
                yield _pairs_of(parts)
                parts, words, held = [], 0, 0
    if held:
        yield _pairs_of(parts)


def _pairs_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, word, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    at = np.flatnonzero(word[:-1] == word[1:])
    return ids, n[word], at, (ids[at].astype(np.int64) << 20) | ids[at + 1]


def _sums(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, how often each is there, and the sums of their amounts."""
    order = np.argsort(keys, kind="stable")
    keys, amounts = keys[order], amounts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)]), np.add.reduceat(amounts, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, n, at, pairs in _portions(batches):
        if len(at):
            keys, places, total = _sums(pairs, n[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places, pa.int64()), pa.array(total, pa.int64())],
                                             ["pair", "places", "n"])


def _texts(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One string per segment with a character for each token."""
    points = (ids + _BASE + np.where(ids >= _GAP, _SKIP, 0)).astype("<u4")
    data = points.tobytes().decode("utf-32-le").encode()
    ends = np.cumsum(np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))[np.cumsum(sizes) - 1]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data))


def _cut(kept: np.ndarray):
    """The different segments of a task's words between pairs that aren't kept (sorted keys), with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, at, pairs in _portions(batches):
            spot = np.minimum(np.searchsorted(kept, pairs), len(kept) - 1)
            at = at[kept[spot] == pairs]
            if not len(at):
                continue
            opens = np.r_[True, np.diff(at) != 1]
            begins = at[opens]
            sizes = np.diff(np.r_[np.flatnonzero(opens), len(at)]) + 1
            ends = np.cumsum(sizes)
            flat = ids[np.arange(ends[-1]) - np.repeat(ends - sizes - begins, sizes)]
            found = pa.table({"segment": _texts(flat, sizes), "n": pa.array(n[begins], pa.int64())})
            found = found.group_by("segment").aggregate([("n", "sum")])
            yield from pa.table({"segment": found["segment"].cast(pa.string()), "n": found["n_sum"]}).to_batches(100_000)
    return run


def _follow(segments: list[str], counts: list[int], floor: int, first: int, most: int) -> list[tuple[int, int]]:
    """The merges of the one-at-a-time rule over the segments down to the floor, at most so many."""
    pieces, exact = Pieces(segments, counts), {}
    for pair, places in pieces.where.items():
        total = sum(counts[at] for at in places)
        if total >= floor:
            exact[pair] = total
    exact = PairCounts(exact, floor)
    merges: list[tuple[int, int]] = []
    while len(merges) < most and (pair := exact.top()) is not None:
        exact.apply(pair, pieces.merge(pair, _char(first + len(merges))))
        merges.append(_ids(pair))
    return merges


def _floor(pairs: pa.Table, room: float, least: int, complete: bool) -> int:
    """The least count such that the pairs from there on have at most ``room`` places; the most frequent pair always is."""
    n, places = pairs["n"].to_numpy(), pairs["places"].to_numpy()
    fit = int(np.searchsorted(np.cumsum(places), room, side="right"))
    if fit == len(n) and complete:
        return least
    # Pairs as frequent as the first that doesn't fit stay below the floor.
    return min(int(n[0]), int(n[min(fit, len(n) - 1)]) + 1)


def train_by_ranges(spark: SparkSession, counts: DataFrame, vocab_size: int, min_frequency: int = 2,
                    most: int = MOST, told: int = PAIRS) -> DataFrame:
    """Merges of a byte-level vocabulary from ``counts(piece, n)``: the rows of :func:`tokenloom.operators.bpe.train_bpe`."""
    check_vocabulary(vocab_size)
    room = vocab_size - FIRST_MERGE
    words = counts.select(byte_ids(F.col("piece")).alias("ids"), F.col("n").cast("long").alias("n")).where(F.size("ids") > 1)
    words = stage(words, "bpe-pieces")
    parts = max(spark.sparkContext.defaultParallelism, -(-words.count() // PER_TASK))
    words = stage(words.repartition(parts), "bpe-words")
    merges: list[tuple[int, int]] = []
    share = 1.0  # places of the pairs above the floor for each token the driver has room for
    while len(merges) < room:
        found = words.mapInArrow(_count, "pair long, places long, n long").groupBy("pair").agg(
            F.sum("n").alias("n"), F.sum("places").alias("places")).where(F.col("n") >= min_frequency)
        pairs = found.orderBy(F.desc("n"), "pair").limit(told).toArrow()
        if not len(pairs):
            break
        while True:
            floor = _floor(pairs, share * most, min_frequency, len(pairs) < told)
            kept = np.sort(pairs["pair"].to_numpy()[pairs["n"].to_numpy() >= floor])
            segments = stage(words.mapInArrow(_cut(kept), "segment string, n long").groupBy("segment").agg(
                F.sum("n").alias("n")), "bpe-segments")
            tokens = segments.agg(F.sum(F.char_length("segment"))).first()[0]
            if tokens <= most or floor >= pairs["n"][0].as_py():
                break
            share = min(share, sum(pairs["places"].to_numpy().tolist()) / max(most, 1)) * max(0.1, 0.7 * most / tokens)
        first = FIRST_MERGE + len(merges)
        if tokens <= most and (len(pairs) < told or floor > pairs["n"][-1].as_py()):
            held = segments.toArrow()
            new = _follow(held["segment"].to_pylist(), held["n"].to_pylist(), floor, first, room - len(merges))
        else:  # pairs of the same count make more segments than fit, or are not all known: the first can be merged without them
            key = pairs["pair"][0].as_py()
            new = [(key >> 20, key & 0xFFFFF)]
        share *= min(1.5, max(1.0, 0.7 * most / tokens))
        merges += new
        if len(merges) < room:
            words = stage(words.mapInArrow(_apply(PieceEncoder(new, first)), "ids array<int>, n long"), "bpe-words")
    return spark.createDataFrame([(i, a, b, FIRST_MERGE + i) for i, (a, b) in enumerate(merges)], MERGES_SCHEMA)
