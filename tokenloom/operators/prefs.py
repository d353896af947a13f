"""Preference pairs: building, collating, and the metrics of a preference run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import PAD
from tokenloom.operators.chat import (
    ASSISTANT, CONVERSATION, assemble, conversation_sizes, encode_messages, encode_turns, turn_offsets,
)
from tokenloom.operators.filters import short_pairs
from tokenloom.operators.ordering import running_totals
from tokenloom.session import stage


def reply_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, other_id, reply_turn, other_turn`` of conversations with a reply.

    Chosen is a conversation up to its first reply; rejected is the same prompt
    with the first reply of the next such conversation (the last takes the first's).
    """
    first = turns.where(F.col("role") == ASSISTANT).groupBy("conv_id").agg(F.min("turn").alias("reply_turn"))
    ranked = running_totals(first, ["conv_id"], rank="nr", label="replies")
    count = ranked.agg(F.count(F.lit(1))).scalar()
    other = ranked.select(F.col("conv_id").alias("other_id"), F.col("reply_turn").alias("other_turn"),
                          F.col("nr").alias("_nr"))
    return ranked.withColumn("_nr", (F.col("nr") + 1) % count).join(other, "_nr").drop("_nr", "nr")


def pair_lengths(pairs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds ``prompt_tok, chosen_len, rejected_len`` from encoded turns with offsets."""
    reply = offsets.select(
        F.col("conv_id"), F.col("turn").alias("reply_turn"),
        F.col("offset").alias("prompt_tok"), F.col("n_tok").alias("_own"))
    other = offsets.select(
        F.col("conv_id").alias("other_id"), F.col("turn").alias("other_turn"), F.col("n_tok").alias("_other"))
    return (
        pairs.join(reply, ["conv_id", "reply_turn"]).join(other, ["other_id", "other_turn"])
        .withColumn("chosen_len", F.col("prompt_tok") + F.col("_own"))
        .withColumn("rejected_len", F.col("prompt_tok") + F.col("_other"))
        .drop("_own", "_other")
    )


def pair_tokens(pairs: DataFrame, offsets: DataFrame, max_len: int = 1024) -> DataFrame:
    """Both token rows of each kept pair: ``conv_id, side, ids, mask``; side 0 is chosen.

    Kept pairs end within ``max_len`` tokens, so turns past it, however many a
    conversation has, are left out before the join.
    """
    turn = offsets.where(F.col("offset") < max_len).select("conv_id", "turn", "ids", "mask")
    prompt = pairs.select("conv_id", "reply_turn").join(turn, "conv_id").where(F.col("turn") < F.col("reply_turn"))
    both = prompt.select("conv_id", "turn", "ids", "mask", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    own = pairs.select("conv_id", F.col("reply_turn").alias("turn")).join(turn, ["conv_id", "turn"]).select(
        "conv_id", "turn", "ids", "mask", F.lit(0).alias("side"))
    reply = offsets.where(F.col("n_tok") <= max_len).select(
        F.col("conv_id").alias("other_id"), F.col("turn").alias("other_turn"), "ids", "mask")
    other = pairs.select("conv_id", "reply_turn", "other_id", "other_turn").join(
        reply, ["other_id", "other_turn"]
    ).select("conv_id", F.col("reply_turn").alias("turn"), "ids", "mask", F.lit(1).alias("side"))
    parts = both.select(*own.columns).unionByName(own).unionByName(other)
    return parts.groupBy("conv_id", "side").agg(
        F.array_sort(F.collect_list(F.struct("turn", "ids", "mask"))).alias("parts")
    ).select(
        "conv_id", "side",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.flatten(F.transform("parts", lambda p: p["mask"])).alias("mask"),
    )


def pair_turns(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns of both sides of each pair (side 0 is chosen), for :func:`encode_pair_turns`; no list of turns is built."""
    pairs = pairs.dropna(subset=["conv_id", "other_id"])
    said = turns.select("conv_id", "turn", "role", "text")
    prompt = pairs.select("conv_id", "reply_turn").join(said, "conv_id").where(F.col("turn") < F.col("reply_turn"))
    both = prompt.select("conv_id", "turn", "role", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    own = pairs.select("conv_id", F.col("reply_turn").alias("turn")).join(said, ["conv_id", "turn"]).select(
        "conv_id", "turn", "role", "text", F.lit(0).alias("side"))
    reply = said.select(F.col("conv_id").alias("other_id"), F.col("turn").alias("other_turn"), "role", "text")
    other = pairs.join(reply, ["other_id", "other_turn"]).select(
        "conv_id", F.col("reply_turn").alias("turn"), "role", "text", F.lit(1).alias("side"))
    return both.select(*own.columns).unionByName(own).unionByName(other)


def encode_message_pairs(rows: DataFrame, merges: list[tuple[int, int]], pair_id: str = "pair_id",
                         max_len: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Pairs given as message lists ``chosen`` and ``rejected``, encoded and filtered.

    Returns the kept pairs ``conv_id, chosen_len, rejected_len`` and their
    token rows ``conv_id, side, ids, mask``, ready for a plan and :func:`collate`.
    """
    sides = rows.select(
        F.col(pair_id).alias("conv_id"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("chosen").alias("said")),
            F.struct(F.lit(1).alias("side"), F.col("rejected").alias("said")))).alias("_s"),
    ).select("conv_id", "_s.side", F.posexplode("_s.said").alias("turn", "_m"))
    return encode_pair_turns(
        sides.select("conv_id", "side", F.col("turn").cast("long").alias("turn"), "_m.role", F.col("_m.content").alias("text")),
        merges, max_len)


def pair_lists(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """``conv_id, chosen, rejected``: the pairs of :func:`reply_pairs` as message lists, from ``conv_id, messages``."""
    own = pairs.join(lists, "conv_id")
    prompt = F.filter("messages", lambda m: m["turn"] < F.col("reply_turn"))
    reply = lists.select(F.col("conv_id").alias("other_id"), F.explode("messages").alias("_m")).select(
        "other_id", F.col("_m.turn").alias("other_turn"), F.col("_m").alias("_reply"))
    return own.join(reply, ["other_id", "other_turn"]).select(
        "conv_id", F.filter("messages", lambda m: m["turn"] <= F.col("reply_turn")).alias("chosen"),
        F.concat(prompt, F.array("_reply")).alias("rejected"))


def encode_pair_lists(rows: DataFrame, merges: list[tuple[int, int]], max_len: int = 1024, chosen: str = "chosen",
                      rejected: str = "rejected") -> DataFrame:
    """The rows with both message lists encoded in place (``struct<ids,mask>``), without the pairs with a side above ``max_len``.

    Any other columns stay; no key is needed, and equal or null ids don't matter.
    """
    encode = encode_messages(merges)
    coded = rows.withColumns({chosen: encode(F.col(chosen)), rejected: encode(F.col(rejected))})
    return coded.where((F.size(f"{chosen}.ids") <= max_len) & (F.size(f"{rejected}.ids") <= max_len))


#: A side of a pair is a conversation of its own.
SIDE = ("conv_id", "side")


def encode_pair_turns(turns: DataFrame, merges: list[tuple[int, int]], max_len: int = 1024) -> tuple[DataFrame, DataFrame]:
    """As :func:`encode_message_pairs`, from the turns ``conv_id, side, turn, role, text`` of both sides.

    Ids of any type and value; pairs with a null id take no part. A side without turns has length 0.
    """
    coded = stage(encode_turns(turns.where(F.col("conv_id").isNotNull()), merges, SIDE), "pair-turns")
    offsets = turn_offsets(coded, SIDE)

    def length(of: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == of, F.col("n_tok"))), F.lit(0))

    kept = short_pairs(
        conversation_sizes(offsets, SIDE).groupBy("conv_id").agg(length(0).alias("chosen_len"), length(1).alias("rejected_len")),
        "chosen_len", "rejected_len", max_len)
    tokens = assemble(offsets, max_len, SIDE)
    return kept, tokens.join(kept.select("conv_id"), "conv_id", "left_semi")


def collate(planned: DataFrame, tokens: DataFrame, pad: int = PAD) -> DataFrame:
    """Pad the rows of each micro-batch to its longest: chosen rows first, then rejected.

    ``planned`` has ``conv_id, place, step, micro``; adds ``slot`` (row in the
    micro-batch) and ``width``.
    """
    rows = planned.select("conv_id", "place", "step", "micro").join(tokens, "conv_id")
    group = Window.partitionBy("step", "micro")
    width = F.max(F.size("ids")).over(group)
    slot = F.row_number().over(group.orderBy("side", "place")) - 1
    sized = rows.withColumn("width", width).withColumn("slot", slot)
    missing = F.col("width") - F.size("ids")
    return sized.select(
        "step", "micro", "slot", "conv_id", "side", "width",
        F.concat("ids", F.array_repeat(F.lit(pad), missing)).alias("ids"),
        F.concat("mask", F.array_repeat(F.lit(0), missing)).alias("mask"),
    )


def sequence_logprobs(tokens: DataFrame, seq: str, pos: str, logprob: Column, mask: Column) -> DataFrame:
    """Summed log-probability of the masked tokens; position 0 has no prediction."""
    return tokens.where(F.col(pos) >= 1).groupBy(seq).agg(F.sum(logprob * mask).alias("logprob"))


def conversation_logprobs(turns: DataFrame, logprob: Column, keys: Sequence[str] = CONVERSATION) -> DataFrame:
    """Summed log-probability of the masked tokens of whole conversations: ``keys, logprob``.

    ``turns`` has ``offset, n_tok, mask`` per turn and ``logprob`` gives an array beside the
    mask: what the model said at a token about the *next* one. So the mask is shifted by one, and
    the last token of a turn meets the first mask of the next. That one comes by a join on the
    place where a turn ends: no window over a conversation, however long it is.
    """
    heads = turns.select(*keys, F.col("offset").alias("_end"), F.element_at("mask", 1).alias("_next"))
    joined = turns.withColumn("_end", F.col("offset") + F.col("n_tok")).join(heads, [*keys, "_end"], "left")
    shifted = F.concat(F.slice("mask", F.lit(2), F.greatest(F.size("mask") - 1, F.lit(0))),
                       F.array(F.coalesce("_next", F.lit(0))))
    each = F.aggregate(F.zip_with(logprob, shifted, lambda p, m: p * m), F.lit(0.0), lambda a, x: a + x)
    return joined.groupBy(*keys).agg(F.sum(each).alias("logprob"))


def minus_log_sigmoid(z: Column) -> Column:
    """Stable for large arguments of either sign."""
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def preference_metrics(planned: DataFrame, beta: float = 0.1) -> DataFrame:
    """Per step the loss, accuracy and margin, as the mean of micro-batch means.

    ``planned`` has ``step, micro`` and the summed log-probabilities
    ``policy_chosen, policy_rejected, ref_chosen, ref_rejected``. A tie counts as wrong.
    """
    z = F.lit(beta) * ((F.col("policy_chosen") - F.col("ref_chosen"))
                       - (F.col("policy_rejected") - F.col("ref_rejected")))
    per_micro = planned.withColumn("z", z).groupBy("step", "micro").agg(
        F.avg(minus_log_sigmoid(F.col("z"))).alias("loss"),
        F.avg((F.col("z") > 0).cast("double")).alias("acc"),
        F.avg("z").alias("margin"),
        F.count(F.lit(1)).alias("pairs"),
    )
    return per_micro.groupBy("step").agg(
        F.sum("pairs").alias("pairs"), F.avg("loss").alias("loss"),
        F.avg("acc").alias("acc"), F.avg("margin").alias("margin"))
