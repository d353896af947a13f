"""Queries over conversations: rendering, encoding, packing, preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import chat, ordering, packing, prefs, stepplan
from tokenloom.operators.filters import short_pairs
from tokenloom.plans.corpus import merges
from tokenloom.plans.registry import artifact, digest, query, rounded, table
from tokenloom.plans.sqltext import CHAT_LEN, MAX_PAIR, ids_text, sql
from tokenloom.session import spread, stage

#: How many conversations and pairs the two sampling queries take.
CHAT_SAMPLE, PAIR_SAMPLE = 60, 40
BATCH, MICRO, EPOCHS = 8, 4, 2.5
PREF_BATCH, PREF_MICRO, BETA = 8, 2, 0.1


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def sample_conversations(said: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Turns of ``n`` seeded conversations, for a run that takes no more."""
    taken = ordering.seeded_sample(said.select("conv_id").distinct(), seed, ["conv_id"], n).select("conv_id")
    return said.join(taken, "conv_id", "left_semi")


@artifact
def encoded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids, masks and offsets of every turn."""
    coded = stage(chat.encode_turns(spread(turns(spark, sf_dir)), merges(spark, sf_dir)), "coded")
    return stage(chat.turn_offsets(coded), "turns")


@artifact
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(pack_rows(spark, sf_dir), "packed")


def pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = stage(chat.assemble(encoded_turns(spark, sf_dir), CHAT_LEN + 1).withColumn("size", F.size("ids")), "chats")
    places = stage(ordering.seeded_order(chats.select("conv_id", "size"), 1, ["conv_id"]), "places")
    return packing.pack(chats, CHAT_LEN, places=places)


@query("chat_render", sql(
    "select conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as rendered from conversations "
    "union all select conv_id, max(turn) + 1, '<|im_start|>assistant' || chr(10) from conversations group by conv_id"))
def chat_render(spark, sf_dir):
    """The chat text of every turn, then the prompt for the next; in turn order they are the whole text."""
    said = turns(spark, sf_dir).select("conv_id", "turn", chat.render_turn(F.col("role"), F.col("text")).alias("rendered"))
    prompt = turns(spark, sf_dir).groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select(
        "conv_id", "turn", F.lit("<|im_start|>assistant\n").alias("rendered"))
    return said.unionByName(prompt)


@query("chat_render_whole", sql(
    "select conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn)) as text_md5, "
    "md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) || "
    "'<|im_start|>assistant' || chr(10)) as prompt_md5 from conversations group by conv_id"))
def chat_render_whole(spark, sf_dir):
    """The chat text of whole conversations, without and with the prompt for a reply."""
    return chat.text_digests(turns(spark, sf_dir))


@query("chat_sample", sql(
    "select conv_id, turn from conversations join (select conv_id, row_number() over (order by md5('0:' || conv_id), conv_id) as r "
    f"from (select distinct conv_id from conversations)) using (conv_id) where r <= {CHAT_SAMPLE}"))
def chat_sample(spark, sf_dir):
    """Turns of a seeded sample of conversations, what a short fine-tuning run takes."""
    return sample_conversations(turns(spark, sf_dir), CHAT_SAMPLE).select("conv_id", "turn")


@query("chat_encode", sql(
    "select conv_id, turn, (length(syms) // 7)::INT as n_tok, "
    f"md5({ids_text('syms')}) as ids_md5, md5(mask) as mask_md5 from turn_tokens", "turn_tokens"))
def chat_encode(spark, sf_dir):
    coded = chat.encode_turns(spread(turns(spark, sf_dir)), merges(spark, sf_dir))
    return coded.select("conv_id", "turn", F.size("ids").alias("n_tok"), digest(F.col("ids")).alias("ids_md5"),
                        digest(F.col("mask")).alias("mask_md5"))


@query("chat_encode_nested", sql(
    f"select conv_id, (length(syms) // 7)::INT as n_tok, md5({ids_text('syms')}) as ids_md5, md5(mask) as mask_md5 from chat_all",
    "chat_all"))
def chat_encode_nested(spark, sf_dir):
    """Conversations given as message lists, encoded in place."""
    encode = chat.encode_messages(merges(spark, sf_dir))
    lists = stage(chat.message_lists(turns(spark, sf_dir)), "message-lists")
    coded = spread(lists).select("conv_id", encode(F.col("messages")).alias("c"))
    return coded.select("conv_id", F.size("c.ids").alias("n_tok"), digest(F.col("c.ids")).alias("ids_md5"),
                        digest(F.col("c.mask")).alias("mask_md5"))


@query("sequence_logprobs_tokens", sql(
    "select conv_id, coalesce(sum(-((id * 31 + 7) % 101) * next_mask), 0)::DOUBLE as logprob from "
    "(select conv_id, id, lead(m) over (partition by conv_id order by t) as next_mask from "
    "(select conv_id, generate_subscripts(ids, 1) as t, unnest(ids)::BIGINT as id, unnest(mask)::BIGINT as m from "
    "(select conv_id, regexp_extract_all(syms, '<([0-9]+)>', 1) as ids, regexp_extract_all(mask, '[01]') as mask from chat_all))) "
    "group by conv_id", "chat_all"))
def sequence_logprobs_tokens(spark, sf_dir):
    """Log-probabilities stand-in per token, from its id; the shifted mask crosses turn borders."""
    said = F.transform("ids", lambda i: (-((i.cast("long") * 31 + 7) % 101)).cast("double"))
    return prefs.conversation_logprobs(encoded_turns(spark, sf_dir), said)


@query("chat_prompt", sql(
    "select conv_id, (length(c.syms || p) // 7)::INT as n_tok, "
    f"md5({ids_text('c.syms || p')}) as ids_md5, md5(c.mask || repeat('0,', length(p)::INT // 7)) as mask_md5 "
    "from chats c, (select '<00001>' || a.syms || n.syms as p from turn_words a, turn_words n "
    "where a.piece = 'assistant' and n.piece = chr(10))", "chats", "turn_words"))
def chat_prompt(spark, sf_dir):
    """Each conversation, up to the width, followed by the prompt for the next reply."""
    whole = chat.with_prompt(chat.assemble(encoded_turns(spark, sf_dir), CHAT_LEN + 1), merges(spark, sf_dir))
    return whole.select("conv_id", F.size("ids").alias("n_tok"), digest(F.col("ids")).alias("ids_md5"),
                        digest(F.col("mask")).alias("mask_md5"))


@query("chat_sizes", sql(
    "select conv_id, (length(syms) // 7)::BIGINT as n_tok, (length(mask) - length(replace(mask, '1', '')))::BIGINT as supervised "
    "from chat_all", "chat_all"))
def chat_sizes(spark, sf_dir):
    return chat.conversation_sizes(encoded_turns(spark, sf_dir))


@query("chat_truncate", sql(
    f"select conv_id, (length(syms) // 7)::INT as n_tok, md5({ids_text('syms')}) as ids_md5, md5(mask) as mask_md5 from chats",
    "chats"))
def chat_truncate(spark, sf_dir):
    whole = chat.assemble(encoded_turns(spark, sf_dir), CHAT_LEN + 1)
    return whole.select("conv_id", F.size("ids").alias("n_tok"), digest(F.col("ids")).alias("ids_md5"),
                        digest(F.col("mask")).alias("mask_md5"))


_PAD = CHAT_LEN + 1


@query("chat_pack", sql(
    f"select row_id, items, used, md5({ids_text(f'''syms || repeat('<00003>', {_PAD} - used)''')}) as ids_md5, "
    f"md5(mask || repeat('0,', {_PAD} - used)) as mask_md5 from packed", "packed"))
def chat_pack(spark, sf_dir):
    """Next-fit rows of the reshuffled conversations, padded to one width."""
    return pack_rows(spark, sf_dir).select(
        "row_id", "items", "used", digest(F.col("ids")).alias("ids_md5"), digest(F.col("mask")).alias("mask_md5"))


@query("packing_report", sql(
    "select count(*)::BIGINT as rows, sum(length(mask) - length(replace(mask, '1', '')))::BIGINT as supervised, "
    f"round(sum(used) / (count(*) * {_PAD})::DOUBLE, 6) as filled from packed", "packed"))
def packing_report(spark, sf_dir):
    return chat.packing_report(packed(spark, sf_dir)).withColumn("filled", rounded(F.col("filled")))


@query("sft_plan", sql(
    f"select s.step, s.epoch::INT as epoch, slot::INT as slot, (slot // {MICRO})::INT as micro, row_id, round(case when step < warm "
    "then (step + 1) / warm::DOUBLE when step < total - d then 1.0::DOUBLE else "
    "1.0::DOUBLE - sqrt(least(1.0::DOUBLE, (step - (total - d)) / d::DOUBLE)) end, 9) as lr_factor from "
    f"(select epoch * per + place // {BATCH} as step, epoch, place % {BATCH} as slot, place, row_id, per, total, "
    "greatest(1, total // 50) as warm, greatest(1, floor(total * 0.5::DOUBLE)::BIGINT) as d from "
    "(select epoch, row_id, per, total, row_number() over (partition by epoch order by "
    "md5((epoch * per)::VARCHAR || ':' || row_id), row_id) - 1 as place from packed, "
    f"(select per, total, unnest(generate_series(0, ceil(total / per)::BIGINT - 1)) as epoch from "
    f"(select per, greatest(1, floor(per * {EPOCHS}::DOUBLE)::BIGINT) as total from "
    f"(select count(*) // {BATCH} as per from packed))))) s where place < per * {BATCH} and step < total", "packed"))
def sft_plan(spark, sf_dir):
    """Two and a half epochs, each over its own permutation of the packed rows."""
    rows = packed(spark, sf_dir).select("row_id")
    return stepplan.sft_plan(rows, rows.count(), BATCH, MICRO, EPOCHS, lr=1.0).withColumnRenamed("lr", "lr_factor").withColumn(
        "lr_factor", rounded(F.col("lr_factor"), 9))


def pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefs.pair_lengths(prefs.reply_pairs(turns(spark, sf_dir)), encoded_turns(spark, sf_dir))


@artifact
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preference pair with its lengths; stored, as ordering and sampling read it more than once."""
    return stage(pair_lengths(spark, sf_dir), "all-pairs")


@artifact
def planned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in seeded order, filtered by length, with their step and micro-batch."""
    kept = stage(short_pairs(all_pairs(spark, sf_dir), "chosen_len", "rejected_len", MAX_PAIR), "pairs")
    ordered = ordering.seeded_order(kept, 0, ["conv_id"])
    return stage(stepplan.preference_plan(ordered, kept.count(), PREF_BATCH, PREF_MICRO, lr=1.0), "planned")


@query("pair_filter", sql(
    f"select conv_id, other_id, chosen_len, rejected_len from pairs where chosen_len <= {MAX_PAIR} and rejected_len <= {MAX_PAIR}",
    "pairs"))
def pair_filter(spark, sf_dir):
    return short_pairs(pair_lengths(spark, sf_dir), "chosen_len", "rejected_len", MAX_PAIR).select(
        "conv_id", "other_id", "chosen_len", "rejected_len")


@query("pair_sample", sql(
    "select conv_id, other_id, chosen_len, rejected_len from (select *, row_number() over (order by md5('0:' || conv_id), conv_id) "
    f"as r from pairs) where r <= {PAIR_SAMPLE} and chosen_len <= {MAX_PAIR} and rejected_len <= {MAX_PAIR}", "pairs"))
def pair_sample(spark, sf_dir):
    """A seeded sample of all pairs, of which the short ones stay."""
    taken = ordering.seeded_sample(all_pairs(spark, sf_dir), 0, ["conv_id"], PAIR_SAMPLE)
    return short_pairs(taken, "chosen_len", "rejected_len", MAX_PAIR).select(
        "conv_id", "other_id", "chosen_len", "rejected_len")


@query("pair_messages", sql("select conv_id, chosen_len, rejected_len from kept_pairs", "kept_pairs"))
def pair_messages(spark, sf_dir):
    """The same pairs, handed over as the turns of both sides and encoded from these."""
    said = turns(spark, sf_dir)
    sides = stage(prefs.pair_turns(prefs.reply_pairs(said), said), "pair-sides")
    return prefs.encode_pair_turns(spread(sides), merges(spark, sf_dir), MAX_PAIR)[0].select(
        "conv_id", "chosen_len", "rejected_len")


@query("pair_lists", sql(
    "select p.conv_id, chosen_len, rejected_len, md5({c}) as chosen_md5, md5({r}) as rejected_md5 from "
    "(select p.conv_id, p.chosen_len, p.rejected_len, any_value(o.syms) as other, "
    "coalesce(string_agg(t.syms, '' order by t.turn) filter (where t.turn < p.reply_turn), '') as prompt, "
    "any_value(t.syms) filter (where t.turn = p.reply_turn) as own from kept_pairs p join turn_offsets o on o.conv_id = p.other_id "
    "and o.turn = p.other_turn join turn_offsets t on t.conv_id = p.conv_id and t.turn <= p.reply_turn group by all) p".format(
        c=ids_text("prompt || own"), r=ids_text("prompt || other")), "kept_pairs", "turn_offsets"))
def pair_lists(spark, sf_dir):
    """The same pairs as rows with two message lists, encoded in place and filtered by length."""
    said = turns(spark, sf_dir)
    lists = stage(chat.message_lists(said), "message-lists")
    rows = stage(prefs.pair_lists(prefs.reply_pairs(said), lists), "pair-lists")
    kept = prefs.encode_pair_lists(spread(rows), merges(spark, sf_dir), MAX_PAIR)
    return kept.select("conv_id", F.size("chosen.ids").cast("long").alias("chosen_len"), F.size("rejected.ids").cast("long").alias("rejected_len"),
                       digest(F.col("chosen.ids")).alias("chosen_md5"), digest(F.col("rejected.ids")).alias("rejected_md5"))


@query("pref_plan", sql(
    "select conv_id, place, step, micro, round(least(1.0::DOUBLE, (step + 1) / greatest(1, total // 10)::DOUBLE) * "
    "(1.0::DOUBLE - step / greatest(1, total)::DOUBLE), 9) as lr_factor from planned_pairs, "
    f"(select count(*) // {PREF_BATCH} as total from kept_pairs)", "planned_pairs", "kept_pairs"))
def pref_plan(spark, sf_dir):
    return planned_pairs(spark, sf_dir).select(
        "conv_id", "place", "step", "micro", rounded(F.col("lr"), 9).alias("lr_factor"))


@query("pref_collate", sql(
    "with sides as (select p.step, p.micro, p.place, p.conv_id, 0 as side, string_agg(t.syms, '' order by t.turn) as syms, "
    "string_agg(t.mask, '' order by t.turn) as mask from planned_pairs p join turn_offsets t on t.conv_id = p.conv_id "
    "and t.turn <= p.reply_turn group by all union all "
    "select p.step, p.micro, p.place, p.conv_id, 1, coalesce(string_agg(t.syms, '' order by t.turn), '') || any_value(o.syms), "
    "coalesce(string_agg(t.mask, '' order by t.turn), '') || any_value(o.mask) from planned_pairs p join turn_offsets o "
    "on o.conv_id = p.other_id and o.turn = p.other_turn left join turn_offsets t on t.conv_id = p.conv_id and "
    "t.turn < p.reply_turn group by p.step, p.micro, p.place, p.conv_id), "
    "sized as (select *, max(length(syms) // 7) over (partition by step, micro)::INT as width, "
    "(row_number() over (partition by step, micro order by side, place) - 1)::INT as slot from sides) "
    f"select step, micro, slot, conv_id, side, width, md5({ids_text('''syms || repeat('<00003>', width - length(syms)::INT // 7)''')}) "
    "as ids_md5, md5(mask || repeat('0,', width - length(syms)::INT // 7)) as mask_md5 from sized",
    "planned_pairs", "turn_offsets").replace("\nwith sides as", ",\nsides as", 1))
def pref_collate(spark, sf_dir):
    plan = planned_pairs(spark, sf_dir)
    tokens = prefs.pair_tokens(plan, encoded_turns(spark, sf_dir), MAX_PAIR)
    return prefs.collate(plan, tokens).select(
        "step", "micro", "slot", "conv_id", "side", "width", digest(F.col("ids")).alias("ids_md5"),
        digest(F.col("mask")).alias("mask_md5"))


@query("pref_metrics", sql(
    f"with z as (select step, micro, {BETA}::DOUBLE * ((-chosen_len / 10.0::DOUBLE + chosen_len / 11.0::DOUBLE) - "
    "(-rejected_len / 10.0::DOUBLE + rejected_len / 11.0::DOUBLE)) as z from planned_pairs), "
    "m as (select step, micro, count(*) as pairs, avg(greatest(-z, 0.0::DOUBLE) + ln(1.0::DOUBLE + exp(-abs(z)))) as loss, "
    "avg(case when z > 0 then 1.0::DOUBLE else 0.0::DOUBLE end) as acc, avg(z) as margin from z group by step, micro) "
    "select step, sum(pairs)::BIGINT as pairs, round(avg(loss), 6) as loss, round(avg(acc), 6) as acc, "
    "round(avg(margin), 6) as margin from m group by step", "planned_pairs").replace("\nwith z as", ",\nz as", 1))
def pref_metrics(spark, sf_dir):
    """Log-probabilities stand-in: minus a tenth (policy) or an eleventh (reference) of the length."""
    logged = planned_pairs(spark, sf_dir).select(
        "step", "micro",
        (-F.col("chosen_len") / 10.0).alias("policy_chosen"), (-F.col("rejected_len") / 10.0).alias("policy_rejected"),
        (-F.col("chosen_len") / 11.0).alias("ref_chosen"), (-F.col("rejected_len") / 11.0).alias("ref_rejected"))
    found = prefs.preference_metrics(logged, BETA)
    return found.select("step", "pairs", *[rounded(F.col(c)).alias(c) for c in ("loss", "acc", "margin")])
