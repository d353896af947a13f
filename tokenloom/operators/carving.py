"""Cutting the mixed token stream into a validation part and equal shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.ordering import running_totals

SHARD_KEY = ("split", "shard_idx")
USES_PER_ROW = 64


def stream_need(total_tokens: int, shard_tokens: int, val_tokens: int = 0) -> int:
    """Tokens the mix must supply: validation plus whole shards up to the total."""
    return val_tokens + -(-total_tokens // shard_tokens) * shard_tokens


def carve(
    mixed: DataFrame,
    shard_tokens: int,
    val_tokens: int = 0,
    split: str = "train",
    total_tokens: int | None = None,
) -> DataFrame:
    """Split every document use at shard borders.

    ``mixed`` has ``start`` and ``n_tok``. The first ``val_tokens`` positions
    form the one validation shard, then shards of exactly ``shard_tokens``
    follow; the last, incomplete shard is never written. With ``total_tokens``
    shards stop once that many are written.

    Adds ``split, shard_idx, shard_pos`` (position in the shard), ``skip``
    (tokens of the document before the piece) and sets ``n_tok`` to the piece.
    """
    end = F.col("start") + F.col("n_tok")
    if total_tokens is None:
        # One number: the length of the stream, cut down to whole shards.
        reach = mixed.agg(F.max(end)).scalar()
        limit = F.lit(val_tokens) + F.floor(
            F.greatest(reach - val_tokens, F.lit(0)) / shard_tokens).cast("long") * shard_tokens
    else:
        limit = F.lit(stream_need(total_tokens, shard_tokens, val_tokens))

    def cell(pos: Column) -> Column:
        return F.when(pos < val_tokens, F.lit(-1)).otherwise(
            F.floor((pos - val_tokens) / shard_tokens)).cast("long")

    bounded = mixed.withColumn("_end", F.least(end, limit)).where(F.col("start") < F.col("_end"))
    cells = bounded.withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("_end") - 1))))
    is_val = F.col("_cell") < 0
    begin = F.when(is_val, F.lit(0)).otherwise(val_tokens + F.col("_cell") * shard_tokens)
    stop = F.when(is_val, F.lit(val_tokens)).otherwise(val_tokens + (F.col("_cell") + 1) * shard_tokens)
    first, last = F.greatest("start", begin), F.least("_end", stop)
    others = [c for c in mixed.columns if c not in ("n_tok",)]
    return cells.select(
        *others,
        F.when(is_val, F.lit("val")).otherwise(F.lit(split)).alias("split"),
        F.when(is_val, F.lit(0)).otherwise(F.col("_cell")).cast("int").alias("shard_idx"),
        (first - begin).cast("long").alias("shard_pos"),
        (first - F.col("start")).cast("int").alias("skip"),
        (last - first).cast("int").alias("n_tok"),
    )


def shard_chunks(tokens: DataFrame, carved: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Token ids of every piece: ``split, shard_idx, shard_pos, n_tok, ids``.

    ``tokens`` holds one ``ids`` array per document; arrays never grow beyond
    a document, however large the shard. The uses of a document are gathered per
    USES_PER_ROW epochs, so a small source that is read over and over joins
    as rows of bounded size.
    """
    key = list(ids)
    use = F.struct(*SHARD_KEY, "shard_pos", "skip", F.col("n_tok").alias("n"))
    uses = carved.groupBy(*key, F.floor(F.col("epoch") / USES_PER_ROW).alias("_turn")).agg(F.collect_list(use).alias("_uses"))
    joined = tokens.select(*key, "ids").join(uses, key).select("ids", F.explode("_uses").alias("_use"))
    return joined.select(
        *[F.col(f"_use.{c}") for c in SHARD_KEY], F.col("_use.shard_pos"), F.col("_use.n").alias("n_tok"),
        F.slice("ids", F.col("_use.skip") + 1, F.col("_use.n")).alias("ids"),
    )


def shard_name(split: Column, idx: Column) -> Column:
    return F.format_string("%s_%05d.bin", split, idx)


def shard_stats(carved: DataFrame) -> DataFrame:
    """Per shard: file name, tokens, pieces and the tokens written up to it.

    Validation tokens do not count as written.
    """
    per = carved.groupBy(*SHARD_KEY).agg(
        F.sum("n_tok").cast("long").alias("tokens"), F.count(F.lit(1)).alias("chunks"))
    totals = running_totals(per, ["shard_idx"], {"tokens": "before"}, group_by=["split"], label="shards")
    return totals.select(
        *SHARD_KEY, shard_name(F.col("split"), F.col("shard_idx")).alias("name"), "tokens", "chunks",
        F.when(F.col("split") == "val", F.lit(0)).otherwise(F.col("before") + F.col("tokens"))
        .cast("long").alias("written"),
    )


def running_shares(carved: DataFrame, sources: Sequence[str]) -> DataFrame:
    """What each source makes up of the tokens written so far, at every shard: ``split, shard_idx, source, tokens, upto, share``.

    ``sources`` are the entries of the mix. One without a piece in a shard still has its running
    share there, so shards are filled up to a row per source before the running totals.
    """
    per = carved.groupBy(*SHARD_KEY, "source").agg(F.sum("n_tok").cast("long").alias("tokens"))
    grid = carved.select(*SHARD_KEY).distinct().withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources])))
    full = grid.join(per, [*SHARD_KEY, "source"], "left").fillna(0, ["tokens"])
    totals = running_totals(full, ["shard_idx"], {"tokens": "_before"}, group_by=["split", "source"], label="shares")
    upto = totals.withColumn("upto", F.col("_before") + F.col("tokens")).drop("_before")
    whole = upto.groupBy(*SHARD_KEY).agg(F.sum("upto").alias("_all"))
    return upto.join(whole, list(SHARD_KEY)).select(
        *SHARD_KEY, "source", "tokens", "upto", (F.col("upto") / F.greatest("_all", F.lit(1))).alias("share"))


def unwritten(chunks: DataFrame, written: DataFrame) -> DataFrame:
    """Chunks of shards the manifest does not list yet.

    The plan is a function of its inputs, so a resumed job continues without
    losing the tokens that sat in a buffer.
    """
    return chunks.join(written.select(*SHARD_KEY).distinct(), list(SHARD_KEY), "left_anti")
