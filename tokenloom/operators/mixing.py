"""Weighted interleaving of sources, by token or byte deficit.

The rule "take next from the source furthest behind its share" merges sorted
lists: within a source the ratio *taken so far / share* only grows, so the
global order is the order of that ratio, ties by position in the mix. Both
mixes below are therefore two sets of running totals and one range sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.ordering import running_totals
from tokenloom.sources.mixes import Mix

DOCS_PER_BATCH = 128


class EmptySource(ValueError):
    """A source of the mix has no passing document."""


def _lookup(mix: Mix, values: dict, key: str = "source") -> Column:
    """Value per source as a CASE over the few names of the mix."""
    out = None
    for s in mix.sources:
        out = F.when(F.col(key) == s.name, F.lit(values[s.name])) if out is None else out.when(
            F.col(key) == s.name, F.lit(values[s.name]))
    return out


def source_totals(ranked: DataFrame, mix: Mix, amount: str) -> dict[str, tuple[int, int, int]]:
    """(documents, amount, largest amount) per source; one row per mix entry reaches the driver."""
    rows = ranked.where(F.col("source").isin(*[s.name for s in mix.sources])).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).cast("long").alias("t"), F.max(amount).alias("top")).collect()
    found = {r["source"]: (r["n"], r["t"], r["top"]) for r in rows}
    missing = [s.name for s in mix.sources if not found.get(s.name, (0, 0))[1]]
    if missing:
        raise EmptySource(f"no passing documents in {missing}")
    return found


def token_deficit_mix(
    docs: DataFrame,
    mix: Mix,
    need: int | None = None,
    per_batch: int = DOCS_PER_BATCH,
    ids: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Order passing documents as the token-deficit interleave does.

    ``docs`` has ``source``, the id columns and ``n_tok`` (end-of-text
    included). Batches of ``per_batch`` documents come from the source with the
    smallest tokens / share; a source that runs out starts again inside the
    same batch. Batches are taken until ``need`` tokens are there (by default
    as many as the passing documents hold).

    Returns one row per document use: ``source, epoch, ids…, n_tok, batch_no,
    start``, where ``start`` is its position in the mixed token stream.
    """
    ids = list(ids)
    ranked = running_totals(
        docs.select("source", *ids, F.col("n_tok").cast("long").alias("n_tok")),
        ids, {"n_tok": "before"}, group_by=["source"], rank="place", label="mix-docs",
    )
    totals = source_totals(ranked, mix, "n_tok")
    share = mix.shares
    if need is None:
        need = sum(t for _, t, _ in totals.values())
    # A batch that starts below need * share tokens of its source may be used, and
    # its documents start at most a batch's largest size further on. A document
    # is copied for the epochs in which it starts below that, and not at all
    # if even its first use does not.
    limit = {s: int(need * share[s]) + 1 + per_batch * top for s, (_, _, top) in totals.items()}
    size = _lookup(mix, {s: t for s, (_, t, _) in totals.items()})
    last = F.floor((_lookup(mix, limit) - 1 - F.col("before")) / size).cast("int")
    # A source may fit 32 bits while its epochs together don't.
    epoch = F.col("epoch").cast("long")
    place = epoch * _lookup(mix, {s: n for s, (n, _, _) in totals.items()}) + F.col("place")
    before = epoch * size + F.col("before")
    uses = (
        ranked.where(F.col("before") < _lookup(mix, limit))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
        .select(
            "source", "epoch", *ids, "n_tok",
            F.floor(place / per_batch).cast("long").alias("batch_no"),
            before.cast("long").alias("before"),
        )
    )
    batches = (
        uses.groupBy("source", "batch_no")
        .agg(F.min("before").alias("batch_before"), F.sum("n_tok").alias("batch_tok"))
        .withColumn("ratio", F.col("batch_before") / _lookup(mix, share))
        .withColumn("ord", _lookup(mix, mix.order))
        .where(F.col("ratio") < need)
    )
    ordered = running_totals(
        batches, ["ratio", "ord", "batch_no"], {"batch_tok": "batch_start"}, label="mix-batches"
    ).where(F.col("batch_start") < need)
    return uses.join(
        ordered.select("source", "batch_no", "batch_before", "batch_start"), ["source", "batch_no"]
    ).select(
        "source", "epoch", *ids, "n_tok", "batch_no",
        (F.col("batch_start") + F.col("before") - F.col("batch_before")).alias("start"),
    )


def byte_budget_mix(docs: DataFrame, mix: Mix, budget: int | None = None,
                    ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Order documents by byte deficit, one at a time, until ``budget`` bytes are taken.

    ``docs`` has ``source``, the id columns and ``n_bytes``. No filter and no
    restart: needing more than a source has is an error. The default budget is
    the largest that no source runs out of. The last document overshoots.

    Returns ``source, ids…, n_bytes, start`` of the taken documents.
    """
    ids = list(ids)
    ranked = running_totals(
        docs.select("source", *ids, F.col("n_bytes").cast("long").alias("n_bytes")),
        ids, {"n_bytes": "before"}, group_by=["source"], label="bytes-docs",
    )
    totals = source_totals(ranked, mix, "n_bytes")
    share = mix.shares
    reach = min(totals[s][1] / share[s] for s in share)
    if budget is None:
        budget = int(reach)
    elif budget > reach:
        raise EmptySource(f"a source ends before {budget} bytes are mixed")
    keyed = (
        ranked.withColumn("ratio", F.col("before") / _lookup(mix, share))
        .withColumn("ord", _lookup(mix, mix.order))
        .where(F.col("ratio") < budget)
    )
    ordered = running_totals(keyed, ["ratio", "ord", "before", *ids], {"n_bytes": "start"}, label="bytes-mix")
    return ordered.where(F.col("start") < budget).select("source", *ids, "n_bytes", "start")


def taken_rows(rows: DataFrame, mixed: DataFrame, order_id: str) -> DataFrame:
    """The rows of ``rows(source, order_id, …)`` that a mix without restart took.

    A mix takes a prefix of every source, so the last id per source (one row
    each) says it all: a pushed-down filter, no join that moves the texts.
    """
    last = {r["source"]: r["last"] for r in
            mixed.groupBy("source").agg(F.max(order_id).alias("last")).collect()}
    hit = F.lit(False)
    for name, bound in last.items():
        hit = hit | ((F.col("source") == name) & (F.col(order_id) <= bound))
    return rows.where(hit)


def mix_shares(mixed: DataFrame, amount: str = "n_tok") -> DataFrame:
    """Tokens per source and their share of all tokens (never dividing by zero)."""
    per = mixed.groupBy("source").agg(
        F.sum(amount).cast("long").alias("tokens"), F.count(F.lit(1)).alias("docs")
    )
    # One row per source of the mix from here on.
    total = per.groupBy().agg(F.greatest(F.sum("tokens"), F.lit(1)).alias("all"))
    return per.select("source", "docs", "tokens", (F.col("tokens") / total.scalar()).alias("share"))


def source_repeats(mixed: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """How often the mix reads each source: epochs begun, document uses, tokens."""
    return mixed.groupBy("source").agg(
        (F.max("epoch") + 1).cast("int").alias("epochs"),
        F.count(F.lit(1)).alias("uses"),
        F.sum("n_tok").cast("long").alias("tokens"),
    )


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
