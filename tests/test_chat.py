import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.encode import PieceEncoder
from tokenloom.functions.text import BYTE_BASE, IM_END, IM_START, PAD
from tokenloom.operators import chat, packing, prefs
from tokenloom.plans import QUERIES, chats as chat_plans

MERGES = [(101, 102), (260, 103)]


def _ids(text):
    import regex
    from tokenloom.functions.text import SPLIT_PATTERN
    parts = [m.group(0).encode() for m in regex.finditer(SPLIT_PATTERN, text)]
    return [int(i) for p in PieceEncoder(MERGES).encode_many(parts) for i in p]


def _encode(messages, prompt=False):
    ids, mask = [], []
    for role, text in messages:
        head, body, nl = [IM_START] + _ids(role + "\n"), _ids(text) + [IM_END], _ids("\n")
        ids += head + body + nl
        mask += [0] * len(head) + [int(role == "assistant")] * len(body) + [0] * len(nl)
    if prompt:
        ids += [IM_START] + _ids("assistant\n")
        mask += [0] * (1 + len(_ids("assistant\n")))
    return ids, mask


CHATS = {
    1: [("system", "abc"), ("user", "hello abc"), ("assistant", "abcabc <|im_end|> é")],
    2: [("user", ""), ("assistant", "")],
    3: [("user", "x" * 30), ("assistant", "y" * 30), ("user", "z")],
}


def _turns(spark, chats=CHATS):
    rows = [(c, t, role, text) for c, ms in chats.items() for t, (role, text) in enumerate(ms)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_encode_and_assemble(spark, many_ranges):
    offsets = chat.turn_offsets(chat.encode_turns(_turns(spark), MERGES))
    whole = {r["conv_id"]: (r["ids"], r["mask"]) for r in chat.assemble(offsets, 1000).collect()}
    assert whole == {c: _encode(ms) for c, ms in CHATS.items()}
    cut = {r["conv_id"]: (r["ids"], r["mask"]) for r in chat.assemble(offsets, 20).collect()}
    assert cut == {c: (_encode(ms)[0][:20], _encode(ms)[1][:20]) for c, ms in CHATS.items()}
    sizes = {r["conv_id"]: (r["n_tok"], r["supervised"]) for r in chat.conversation_sizes(offsets).collect()}
    assert sizes == {c: (len(_encode(ms)[0]), sum(_encode(ms)[1])) for c, ms in CHATS.items()}


def test_one_conversation_over_many_tasks(spark, many_ranges):
    chats = {9: [("user" if i % 2 else "assistant", "abc " * (i % 5)) for i in range(300)], 10: CHATS[1]}
    offsets = chat.turn_offsets(chat.encode_turns(_turns(spark, chats), MERGES))
    got = {r["conv_id"]: r["ids"] for r in chat.assemble(offsets, 10**6).collect()}
    assert got == {c: _encode(ms)[0] for c, ms in chats.items()}


def test_prompt_and_template(spark):
    row = spark.range(1).select(chat.generation_prompt(MERGES).alias("p")).first()
    assert row["p"] == _encode([], True)[0]
    lists = chat.messages(_turns(spark), 10)
    text = {r["conv_id"]: (r["t"], r["p"]) for r in lists.select(
        "conv_id", chat.render_messages(F.col("messages")).alias("t"),
        chat.render_messages(F.col("messages"), True).alias("p")).collect()}
    want = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in CHATS[1])
    assert text[1] == (want, want + "<|im_start|>assistant\n")
    back = chat.turns_of(lists, "conv_id", "messages").orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in _turns(spark).orderBy("conv_id", "turn").collect()]
    with pytest.raises(ValueError):
        chat.messages(_turns(spark), 2)


def _next_fit(sizes, width):
    out, row, fill = [], 0, 0
    for n in sizes:
        if fill + n > width:
            row, fill = row + 1, 0
        out.append((row, fill))
        fill += n
    return out


@pytest.mark.parametrize("block,fanout", [(packing.BLOCK, packing.FANOUT), (7, 512), (3, 4), (1, 2)])
def test_next_fit_equals_the_loop(spark, monkeypatch, block, fanout):
    monkeypatch.setattr(packing, "FANOUT", fanout)
    rng = random.Random(block)
    sizes = [rng.choice([1, 2, 3, 9, 20, 21]) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(sizes)), "place long, size int")
    got = {r["place"]: (r["row_id"], r["at"]) for r in packing.next_fit(df, 21, block).collect()}
    assert [got[i] for i in range(100)] == _next_fit(sizes, 21)


def test_pack_golden(spark):
    lengths = [5, 3, 4, 8, 12, 1]
    rows = [(i, [100 * i + j for j in range(n)], [j % 2 for j in range(n)]) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "place long, ids array<int>, mask array<int>")
    got = packing.pack(df, 7).orderBy("row_id").collect()
    assert [(r["items"], r["used"]) for r in got] == [(2, 8), (1, 4), (1, 8), (1, 8), (1, 1)]
    assert got[1]["ids"] == [200, 201, 202, 203] + [PAD] * 4 and got[1]["mask"] == [0, 1, 0, 1, 0, 0, 0, 0]
    report = chat.packing_report(packing.pack(df, 7)).first()
    assert report["rows"] == 5 and report["filled"] == 29 / 40 and report["supervised"] == 2 + 1 + 2 + 4 + 4 + 0


def test_message_pairs(spark):
    def rows(messages):
        return [{"role": r, "content": t} for r, t in messages]

    sides = {5: (CHATS[1], CHATS[2]), 6: (CHATS[3], CHATS[1]), 7: (CHATS[2], CHATS[3])}
    schema = "pair_id long, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(p, rows(c), rows(r)) for p, (c, r) in sides.items()], schema)
    limit = max(len(_encode(CHATS[c])[0]) for c in (1, 2))
    assert limit < len(_encode(CHATS[3])[0])
    kept, tokens = prefs.encode_message_pairs(df, MERGES, max_len=limit)
    assert [(r["conv_id"], r["chosen_len"], r["rejected_len"]) for r in kept.collect()] == [
        (5, len(_encode(CHATS[1])[0]), len(_encode(CHATS[2])[0]))]
    got = {(r["conv_id"], r["side"]): (r["ids"], r["mask"]) for r in tokens.collect()}
    assert got == {(5, 0): _encode(CHATS[1]), (5, 1): _encode(CHATS[2])}


def test_pairs_of_any_id(spark):
    """Negative and very large ids keep their pairs apart; a null id takes no part, a side without turns has no tokens."""
    said = [{"role": "user", "content": "abc"}, {"role": "assistant", "content": "abcabc"}]
    ids = [-1, 0, 1, 2 ** 53 + 1, 2 ** 53, 2 ** 62, -2 ** 63, 2 ** 63 - 1, None]
    schema = "pair_id long, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(i, said, said[:1]) for i in ids] + [(7, said, [])], schema)
    kept, tokens = prefs.encode_message_pairs(df, MERGES)
    whole, first = (_encode([(m["role"], m["content"]) for m in ms]) for ms in (said, said[:1]))
    want = {i: (len(whole[0]), len(first[0])) for i in ids if i is not None} | {7: (len(whole[0]), 0)}
    assert {r["conv_id"]: (r["chosen_len"], r["rejected_len"]) for r in kept.collect()} == want
    got = {(r["conv_id"], r["side"]): (r["ids"], r["mask"]) for r in tokens.collect()}
    assert got == {(i, s): (whole, first)[s] for i in want for s in (0, 1) if (i, s) != (7, 1)}
    # In place, no key is needed at all.
    inside = prefs.encode_pair_lists(df.withColumn("note", F.lit("n")), MERGES, len(whole[0]))
    assert inside.columns == ["pair_id", "chosen", "rejected", "note"] and inside.count() == 10
    assert all(tuple(r["chosen"]) == whole for r in inside.collect())
    assert prefs.encode_pair_lists(df, MERGES, len(whole[0]) - 1).count() == 0


def test_messages_are_encoded_in_place(spark):
    chats = {**CHATS, 20: [], 21: [("assistant", "")], 22: [("user", "abc " * (i % 7)) for i in range(500)]}
    rows = [(c, [{"role": r, "content": t} for r, t in ms]) for c, ms in chats.items()]
    rows += [(30, None), (31, [{"role": None, "content": "abc"}, {"role": "assistant", "content": None}])]
    df = spark.createDataFrame(rows, "conv_id long, messages array<struct<role:string,content:string>>").repartition(3)
    encode = chat.encode_messages(MERGES)
    got = {r["conv_id"]: (r["c"]["ids"], r["c"]["mask"]) for r in df.select("conv_id", encode(F.col("messages")).alias("c")).collect()}
    assert {c: got[c] for c in chats} == {c: _encode(ms) for c, ms in chats.items()}
    assert got[30] == ([], [])
    flat = chat.encode_turns(chat.turns_of(df.where("conv_id = 31"), "conv_id", "messages"), MERGES).orderBy("turn").collect()
    assert got[31] == (sum((r["ids"] for r in flat), []), sum((r["mask"] for r in flat), []))


def test_shifted_mask_crosses_turns(spark, many_ranges):
    """Position 0 predicts the next token; a changed bit at a border changes the sum."""
    rng = random.Random(3)
    turns, whole = [], {}
    for conv in range(6):
        for turn in range(rng.randint(1, 40)):
            n = rng.randint(1, 5)
            ids, mask = [rng.randrange(50) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]
            turns.append((conv, turn, ids, mask))
            whole.setdefault(conv, ([], []))[0].extend(ids)
            whole[conv][1].extend(mask)

    def sums(rows):
        df = spark.createDataFrame(rows, "conv_id long, turn long, ids array<int>, mask array<int>")
        said = F.transform("ids", lambda i: -i.cast("double"))
        return {r["conv_id"]: r["logprob"] for r in prefs.conversation_logprobs(chat.turn_offsets(df), said).collect()}

    got = sums(turns)
    assert got == {c: float(-sum(i * m for i, m in zip(ids, mask[1:]))) for c, (ids, mask) in whole.items()}
    at = next(k for k, t in enumerate(turns) if t[1] == 1)
    conv, turn, ids, mask = turns[at]
    turns[at] = (conv, turn, ids, [1 - mask[0], *mask[1:]])
    changed = sums(turns)
    last = turns[at - 1][2][-1]
    assert changed[conv] - got[conv] == (last if mask[0] else -last) and last


def test_chat_queries_take_a_conversation_of_any_length(spark, tmp_path):
    """One conversation, and the rows without conv_id, of more than 10,000 turns; the hot one's first reply is late."""
    hot = [("user", f"abc {i}") for i in range(10_005)] + [("assistant", "abc"), ("user", "x")]
    rows = [(c, t, r, s) for c, ms in {**CHATS, 4: hot}.items() for t, (r, s) in enumerate(ms)]
    rows += [(5, 7, "user", "gap"), (5, 9, "assistant", "late"), (5, 11, "user", None)]
    lost = [(None, t, "user", f"n{t}") for t in range(10_002)]
    table = spark.createDataFrame(rows + lost + [(6, 0, "user", None)], "conv_id long, turn long, role string, text string")
    table.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))

    said = {}
    for c, _, r, s in rows + lost:
        said[c] = said.get(c, "") + (f"<|im_start|>{r}\n{s}<|im_end|>\n" if s is not None else "")
    prompt = "<|im_start|>assistant\n"
    want = {c: tuple(hashlib.md5(x.encode()).hexdigest() for x in (s, s + prompt)) for c, s in said.items()}
    want[6] = (None, None)
    got = QUERIES["chat_render_whole"](spark, str(tmp_path)).collect()
    assert {r["conv_id"]: (r["text_md5"], r["prompt_md5"]) for r in got} == want and len(got) == len(want)

    chat_plans.merges.keep(spark, str(tmp_path), MERGES)
    replies = {c: next(i for i, m in enumerate(ms) if m[0] == "assistant") for c, ms in {**CHATS, 4: hot}.items()}
    ms = {**CHATS, 4: hot, 5: [("user", "gap"), ("assistant", "late")]}
    replies[5] = 1
    pairs, ring = {}, sorted(replies)
    for i, c in enumerate(ring):
        o = ring[(i + 1) % len(ring)]
        own, other = ms[c][:replies[c] + 1], ms[c][:replies[c]] + [ms[o][replies[o]]]
        pairs[c] = (len(_encode(own)[0]), len(_encode(other)[0]))
    assert max(pairs[4]) > chat_plans.MAX_PAIR
    got = QUERIES["pair_messages"](spark, str(tmp_path)).collect()
    assert {r["conv_id"]: (r["chosen_len"], r["rejected_len"]) for r in got} == {
        c: n for c, n in pairs.items() if max(n) <= chat_plans.MAX_PAIR}
