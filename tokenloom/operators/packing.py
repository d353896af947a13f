"""Next-fit packing of conversations into fixed-width rows, exactly and in parallel.

Next-fit looks sequential, but all that passes from one conversation to the
next is how full the open row is, a number from 0 to the width. A block of
conversations is therefore a table *fill before → (fill after, rows closed)*.
Blocks are tabulated in parallel, the tables chained, and each block then
places its conversations knowing the fill and row number it starts with.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import PAD
from tokenloom.session import stage

BLOCK = 65_536
FANOUT = 512
_TABLE = "block long, after array<int>, closed array<long>"
_ENTRY = "block long, fill int, base long"


def _hops(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where following ``step`` ends for each item, and in how many hops, by pointer doubling.

    ``step[j]`` is larger than ``j``; ``len(step)`` or more means there is no next.
    """
    n = len(step)
    to = np.where(step < n, step, np.arange(n))
    hops = (step < n).astype(np.int64)
    while True:
        further = to[to]
        if (further == to).all():
            return to, hops
        hops += hops[to]
        to = further


def _chain_from(step: np.ndarray, first: int) -> np.ndarray:
    """All items on the way from ``first``: each round doubles how many are known."""
    n = len(step)
    if first >= n:
        return np.zeros(0, dtype=np.int64)
    jump = np.append(np.minimum(step, n), n)
    seen = np.array([first])
    while seen[-1] < n:
        seen = np.append(seen, jump[seen])
        jump = jump[jump]
    return seen[seen < n]


def _row_ends(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cumulated sizes, and for a row opened by item ``j`` the item that opens the next."""
    cum = np.cumsum(sizes)
    return cum, np.searchsorted(cum, width + cum - sizes, side="right")


def _tabulate(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values("place")["size"].to_numpy(np.int64)
        cum, nxt = _row_ends(sizes, width)
        n = len(sizes)
        last, hops = _hops(nxt)
        closed, after = np.append(hops, 0), np.append(cum[-1] - cum[last] + sizes[last], 0)
        fill = np.arange(width + 1)
        first = np.searchsorted(cum, width - fill, side="right")
        stays = first == n
        out = np.where(stays, fill + cum[-1], after[first])
        rows = np.where(stays, 0, closed[first] + 1)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "after": [out.astype(np.int32)], "closed": [rows]})
    return run


def _chain(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    after = closed = None
    for a, c in zip(pdf["after"], pdf["closed"]):
        a, c = np.asarray(a), np.asarray(c)
        if after is None:
            after, closed = a, c
        else:
            after, closed = a[after], closed + c[after]
    return after, closed


def _super_table(pdf: pd.DataFrame) -> pd.DataFrame:
    after, closed = _chain(pdf.sort_values("block"))
    return pd.DataFrame({"block": [pdf["super"].iloc[0]], "after": [after], "closed": [closed]})


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    fill, base = int(pdf["fill"].iloc[0]), int(pdf["base"].iloc[0])
    out = []
    for block, after, closed in zip(pdf["block"], pdf["after"], pdf["closed"]):
        out.append((block, fill, base))
        base += int(closed[fill])
        fill = int(after[fill])
    return pd.DataFrame(out, columns=["block", "fill", "base"])


def _entries(tables: DataFrame, n_blocks: int) -> DataFrame:
    """Fill and row number each block starts with, chaining at most FANOUT tables at a time."""
    if n_blocks <= FANOUT:
        started = tables.select("*", F.lit(0).alias("fill"), F.lit(0).cast("long").alias("base"))
        return started.groupBy().applyInPandas(_walk, _ENTRY)
    above = tables.withColumn("super", F.floor(F.col("block") / FANOUT).cast("long"))
    upper = stage(above.groupBy("super").applyInPandas(_super_table, _TABLE), "pack-tables")
    starts = _entries(upper, -(-n_blocks // FANOUT)).withColumnRenamed("block", "super")
    return above.join(starts, "super").groupBy("super").applyInPandas(_walk, _ENTRY)


def _place(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        sizes = pdf["size"].to_numpy(np.int64)
        cum, nxt = _row_ends(sizes, width)
        fill, base, n = int(pdf["fill"].iloc[0]), int(pdf["base"].iloc[0]), len(sizes)
        opens = _chain_from(nxt, int(np.searchsorted(cum, width - fill, side="right")))
        starts = np.zeros(n, np.int64)
        starts[opens] = 1
        row = np.cumsum(starts)
        at = np.r_[-fill, (cum - sizes)[opens]].astype(np.int64)
        return pd.DataFrame({
            "place": pdf["place"], "row_id": base + row, "at": (cum - sizes - at[row]).astype(np.int32)})
    return run


def next_fit(sizes: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """``place, row_id, at`` for items ``place, size`` with 0-based, gapless places.

    A new row starts when the next item does not fit; no size exceeds the width.
    Places and sizes are stored once, as they are read three times.
    """
    blocked = stage(sizes.select(
        F.col("place").cast("long").alias("place"), F.col("size").cast("int").alias("size"),
        F.floor(F.col("place") / block).cast("long").alias("block"),
    ), "pack-sizes")
    top = blocked.agg(F.max("block")).first()[0]
    tables = blocked.groupBy("block").applyInPandas(_tabulate(width), _TABLE)
    entries = _entries(tables, (top or 0) + 1)
    return (
        blocked.join(entries, "block").groupBy("block")
        .applyInPandas(_place(width), "place long, row_id long, at int")
    )


def pack(conversations: DataFrame, seq_len: int, pad: int = PAD, block: int = BLOCK,
         places: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """Packed rows ``row_id, items, used, ids, mask`` of ``seq_len + 1`` tokens.

    ``conversations`` has ``ids`` and ``mask``, already truncated to the width,
    and ``place`` (the shuffled order). The order may instead come as a narrow
    table ``places`` (``key, place, size``); then the wide rows are read only once.
    """
    width = seq_len + 1
    cut = [F.slice("ids", 1, width).alias("ids"), F.slice("mask", 1, width).alias("mask")]
    if places is None:
        held = conversations.select("place", *cut)
        spots = next_fit(held.select("place", F.size("ids").alias("size")), width, block)
        placed = held.join(spots, "place")
    else:
        spots = next_fit(places.select("place", F.least("size", F.lit(width)).alias("size")), width, block)
        placed = conversations.select(key, *cut).join(places.select(key, "place").join(spots, "place"), key)
    parts = placed.select("row_id", F.struct("at", "place", "ids", "mask").alias("part"))
    rows = parts.groupBy("row_id").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(
        "row_id",
        F.size("parts").alias("items"),
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.flatten(F.transform("parts", lambda p: p["mask"])).alias("mask"),
    )
    used = F.size("ids")
    return rows.select(
        "row_id", "items", used.alias("used"),
        F.concat("ids", F.array_repeat(F.lit(pad), width - used)).alias("ids"),
        F.concat("mask", F.array_repeat(F.lit(0), width - used)).alias("mask"),
    )
