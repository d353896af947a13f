"""Best-fit packing by hierarchical residual merging.

1. Every scan task tokenises its rows, cuts long documents, and best-fits the
   pieces it has by falling length. A full piece is a sequence of its own.
2. A bin that is nearly full is final. Of the others a task passes on all that
   later rounds can use. At most one bin is half full or less (two such bins
   would have been joined), and only such a bin can go into another one. So a round
   over ``FAN_IN`` tasks' bins fills up at most FAN_IN others, whichever they are,
   and an emptier bin takes whatever a fuller one does: with the FAN_IN emptiest
   bins of each task for each round to come, every bin that could be spared
   still can be (tested against passing on all of them).
3. Rounds of best fit then treat underfull bins as items: groups of
   ``FAN_IN`` tasks' bins are joined in parallel, group by group, level by level,
   until one group is left. A group holds at most FAN_IN * passed_at(1) bins, so no
   task grows with the input. A bin that isn't passed on is final as it stands:
   no piece is lost.
4. The moves of the levels are narrow rows (bin, place in the bin above), joined
   back to the pieces of unfinished bins only.

Cases: a null text is an empty text and gives the end token alone. Rows with
equal ids are packed each on its own. Empty tables give no rows. A text of any
length is tokenised whole; its pieces never need another row.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokenloom.llm.common import byte_texts, ready
from tokenloom.session import stage

WIDTH = 1024
END = 2
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: A bin with at most so many free places is final at once.
SLACK = 8
#: Tasks whose bins are joined in a level, and the most levels there are: FAN_IN ** LEVELS tasks.
FAN_IN = 64
LEVELS = 5
_LEVEL, _TASK = 1 << 58, 1 << 28


@functools.cache
def encoder(vocabulary: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to byte-level BPE ids (unsigned 32-bit); made once per worker process.

    The special string of the vocabulary inside a text is its one id, as the named tokenizer has it.
    """
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens={SPECIAL: SPECIAL_ID})
    return lambda text: bpe.encode_to_numpy(text, allowed_special="all")


def cut(length: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all are ``width`` long but the first, if the document is longer."""
    if length <= width:
        return [(0, length)]
    head = length % width
    starts = ([0] if head else []) + list(range(head, length, width))
    return [(s, (head if s == 0 and head else width)) for s in starts]


def best_fit(sizes: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the bins' fills: items by falling size, each into the fullest bin it fits."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    offsets = np.zeros(len(sizes), dtype=np.int64)
    fills: list[int] = []
    free_sizes: list[int] = []          # the different free room there is, ascending
    by_room: dict[int, list[int]] = {}  # bins with that much room
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect.bisect_left(free_sizes, size)
        if at == len(free_sizes):
            chosen, room = len(fills), width
            fills.append(0)
        else:
            room = free_sizes[at]
            chosen = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], free_sizes[at]
        bins[i], offsets[i] = chosen, fills[chosen]
        fills[chosen] += size
        left = room - size
        if left:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(free_sizes, left)
            by_room[left].append(chosen)
    return bins, offsets, fills


def passed_at(level: int) -> int:
    """How many bins go on to a level: FAN_IN for it and for each level after it, and the half-empty one."""
    return FAN_IN * max(LEVELS + 1 - level, 1) + 1


def _passed_on(fills: list[int], width: int, most: int) -> np.ndarray:
    """Which bins go on to the next level: the ``most`` emptiest."""
    fills = np.array(fills, dtype=np.int64)
    open_bins = np.flatnonzero(fills < width - SLACK)
    emptiest = open_bins[np.argsort(fills[open_bins], kind="stable")[:most]]
    out = np.zeros(len(fills), dtype=bool)
    out[emptiest] = True
    return out


def pack_pieces(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, packed within its scan task; ``open`` bins may be joined later."""
    ready(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(narrow.schema["doc_id"].dataType)
    most = passed_at(1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Narrow rows of one scan task; its texts are gone once they are tokenised.
        encode = encoder(vocabulary)
        ids: list = []
        rows: list[tuple[int, int, int, int]] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch), strict=True):
                tokens = np.append(encode(text.decode()), END).astype("<u4")
                for k, (start, length) in enumerate(cut(len(tokens), width)):
                    ids.append(doc)
                    rows.append((k, start, length, zlib.crc32(tokens[start:start + length])))
        if not rows:
            return
        table = np.array(rows, dtype=np.int64)
        bins, offsets, fills = best_fit(table[:, 2], width)
        task = TaskContext.get().partitionId() * _TASK
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, type=id_type), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, c]) for c in (1, 2, 3)),
             pa.array(bins + task), pa.array(offsets), pa.array(_passed_on(fills, width, most)[bins])],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "open"],
        )

    return narrow.mapInArrow(
        pack, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean")


def _join_level(bins: DataFrame, level: int, width: int) -> DataFrame:
    """Best fit of the bins of each group; one row per bin: where it goes and whether that stays open."""
    most = passed_at(level + 1)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin", ignore_index=True)
        into, shift, fills = best_fit(group["fill"].to_numpy(), width)
        goes_on = _passed_on(fills, width, most)
        base = level * _LEVEL + int(group["team"].iloc[0]) * _TASK
        return pd.DataFrame({
            "bin": group["bin"], "into": into + base, "shift": shift,
            "fill": np.array(fills)[into], "team": group["team"], "open": goes_on[into],
        })
    return bins.groupBy("team").applyInPandas(join, "bin long, into long, shift long, fill long, team long, open boolean")


def pack_best_fit(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece, in as few sequences as found."""
    pieces = stage(pack_pieces(docs, vocabulary, width, id_col, text_col), "pieces")
    open_bins = (
        pieces.where("open").groupBy("bin").agg(F.sum("length").alias("fill"))
        .withColumn("team", F.floor(F.col("bin") / _TASK).cast("long"))
    )
    teams = open_bins.agg(F.max("team")).first()[0]
    moves = None
    level = 0
    while teams:  # more than one team left
        level += 1
        open_bins = open_bins.withColumn("team", F.floor(F.col("team") / FAN_IN).cast("long"))
        placed = stage(_join_level(open_bins, level, width), "joined")
        step = placed.select("bin", "into", "shift")
        if moves is None:
            moves = step
        else:
            above = step.select(F.col("bin").alias("into"), F.col("into").alias("above"), F.col("shift").alias("more"))
            moves = moves.join(above, "into", "left").select(
                "bin", F.coalesce("above", "into").alias("into"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        open_bins = placed.where("open").select(F.col("into").alias("bin"), "fill", "team").distinct()
        teams //= FAN_IN
    if moves is None:
        final = pieces.select("*", F.col("bin").alias("sequence_id"))
    else:
        final = pieces.join(moves, "bin", "left").select(
            *[c for c in pieces.columns if c != "offset"],
            F.coalesce("into", "bin").alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    return final.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
