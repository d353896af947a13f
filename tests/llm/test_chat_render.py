import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from tokenloom.llm import chat_render as chat
from tokenloom.llm.queries import ESCAPE_CHECK, QUERIES

ODD = st.text(st.sampled_from("<|\\>a\n%0A25im_end\x01é ")) | st.sampled_from([ESCAPE_CHECK, "<|im_end|>", "<\\|", "<"])


@given(ODD)
def test_escape_is_undone_and_hides_controls(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "o\nd%d<|"]) | ODD, ODD), max_size=5))
def test_round_trip_and_loss(turns):
    messages = [{"role": r, "content": t} for r, t in turns]
    found = chat.render_turns(messages, chat.marked_turns)
    out = found["formatted"]
    assert chat.read_turns(out) == turns
    assert [chat.unescape(out[a:b]) for a, b in found["loss"]] == [t for r, t in turns if r == "assistant"]
    assert "".join(out[a:b] for a, b in found["spans"]) == out and found["rewrote"] is None


def forgetful(messages):
    """Drops the thoughts of all but the last turn."""
    return "".join(f"[{m['role']}] " + (m["content"] if i == len(messages) - 1 else re.sub("<think>.*?</think>", "", m["content"]))
                   for i, m in enumerate(messages))


def test_a_template_that_rewrites_history_is_found():
    messages = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "<think>hm</think>a"},
                {"role": "user", "content": "r"}]
    assert chat.render_turns(messages, forgetful)["rewrote"] == 2
    assert chat.render_turns(messages[:2], forgetful)["rewrote"] is None


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "x"), (1, 1, "assistant", None), (None, 0, None, "n"), (2, None, "user", "first"),
            (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "assistant", "y" * 100_000)]
    turns = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, start int, formatted string")
    found = {r["conv_id"]: r for r in chat.format_chats(turns.repartition(4)).collect()}
    assert set(found) == {None, 1, 2, 3}
    assert chat.read_turns(found[1]["formatted"]) == [("user", "x"), ("assistant", "")]
    assert [t for _, t in chat.read_turns(found[2]["formatted"])] == ["first", "a", "a", "b"]
    assert chat.read_turns(found[None]["formatted"]) == [("", "n")]
    assert found[3]["loss"][0]["stop"] - found[3]["loss"][0]["start"] == 100_000
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_query_reads_back_what_went_in(spark):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    own = {-1: [("user", ESCAPE_CHECK), ("assistant", ESCAPE_CHECK)]}
    for r in turns:
        own.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    rows = QUERIES["op6_chat_render"](spark, sf).collect()
    assert {r["conv_id"] for r in rows} == set(own)
    for r in rows:
        said = own[r["conv_id"]]
        loss = "".join(t for role, t in said if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["rewrites_history"]) == (len(said), len(loss), False)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
