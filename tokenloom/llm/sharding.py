"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair has its own uniform draw u from a hash; the key goes to the
shard with the largest -weight / ln(u). A key's shard follows from the key,
the shards and their weights alone. A new shard takes only the keys it
wins, about its share of the weight, and no key moves between old shards.

Places within a shard come from ordered ranges with running counts
(``running_totals``), so a shard of any size is numbered by many tasks.

Cases: a null key is a key like any other. Rows with equal keys go to one shard and
get places of their own, ordered by the text's checksum and size. A null text
has size 1 and checksum 0. Empty tables give no rows; no other column is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.ordering import running_totals
from tokenloom.session import stage

_HEX = 12  # hexadecimal digits of a draw: 48 bits, exact in a double


def _draw(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) for a key and a shard."""
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")))
    return (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") + 0.5) / float(1 << 4 * _HEX)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards; a shard of weight 0 gets none."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    text = F.coalesce(key.cast("string"), F.lit("\0"))
    # max over (score, -shard): the smaller shard wins a tie.
    bids = [
        F.struct((F.lit(-float(w)) / F.log(_draw(text, s))).alias("score"), F.lit(-s).alias("shard"))
        for s, w in enumerate(weights) if w > 0
    ]
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    return (-best["shard"]).cast("int")


def shard_records(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the shard once ``grown_weights`` hold."""
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = stage(narrow.select(
        "*", rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        (rendezvous_shard(F.col("doc_id"), grown_weights) if grown_weights else F.lit(None).cast("int")).alias("grown_shard"),
    ), "sharded")
    order = ["doc_id", "text_crc32", "size"]
    return running_totals(placed, order, group_by=["shard"], rank="slot", label="slots")
