"""Chat formatting with templates taken as black boxes.

A template is any function from a list of messages to one string. What it does to a
turn is found by rendering successive prefixes of the conversation and
comparing consecutive outputs: the part that a turn adds is its span. An output
that doesn't go on from the one before shows that the template rewrites history. The
place of a text inside its span is found by rendering it once more with another
text in its stead: what both outputs share before and after is the template's.

Cases: a null text or role is an empty string. Turns are ordered by turn (null
first), then role, then text; repeated rows are turns of their own. Null ids are one
conversation. An empty table gives no rows; other columns aren't read. A task holds
one conversation at a time, whole, as a template may look at all of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokenloom.llm.common import ready

Template = Callable[[list[dict[str, str]]], str]

_PROBES = ("\x01", "\x02", "\x03")
_ROWS = 256


def shared_head(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    if a.startswith(b):
        return len(b)
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # a[:low] == b[:low] always holds
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _shared_tail(a: str, b: str) -> int:
    return shared_head(a[::-1], b[::-1])


def text_place(render: Template, messages: list[dict[str, str]], out: str) -> tuple[int, int]:
    """Where the last message's text stands in ``out``, the rendering of ``messages``."""
    last = messages[-1]
    probe = next((p for p in _PROBES if p not in (last["content"][:1], last["content"][-1:])), _PROBES[0])
    other = render([*messages[:-1], {**last, "content": probe}])
    start = shared_head(out, other)
    return start, max(start, len(out) - _shared_tail(out[start:], other[start:]))


def render_turns(messages: list[dict[str, str]], render: Template,
                 loss_roles: tuple[str, ...] = ("assistant",)) -> dict:
    """The rendering, each turn's span, the loss spans, and the first turn that rewrote history (or None)."""
    before, spans, loss, rewrote = render([]), [], [], None
    for k, message in enumerate(messages):
        out = render(messages[: k + 1])
        start = shared_head(before, out)
        if start < len(before):
            if rewrote is None:
                rewrote = k
            # What stood behind the change is no longer where it was.
            spans = [(min(a, start), min(b, start)) for a, b in spans]
            loss = [(a, b) for a, b in loss if b <= start]
        spans.append((start, len(out)))
        if message["role"] in loss_roles:
            loss.append(text_place(render, messages[: k + 1], out))
        before = out
    return {"formatted": before, "spans": spans, "loss": loss, "rewrote": rewrote}


# The template of the query.

START, STOP = "<|im_start|>", "<|im_end|>"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(STOP) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """No "<|" is left: each gets one more backslash inside. Undone by ``unescape``."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def marked_turns(messages: list[dict[str, str]]) -> str:
    """A mark, the role, the text and a closing mark per turn; controls inside texts are escaped."""
    return "".join(
        f"{START}{escape(m['role']).replace('%', '%25').replace(chr(10), '%0A')}\n{escape(m['content'])}{STOP}\n"
        for m in messages
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of ``marked_turns``."""
    return [(unescape(role.replace("%0A", "\n").replace("%25", "%")), unescape(text))
            for role, text in _TURN.findall(formatted)]


def format_chats(turns: DataFrame, render: Template = marked_turns,
                 loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, spans, loss, rewrote: one row per conversation (conv_id, turn, role, text)."""
    ready(turns.sparkSession)
    clean = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    by_conversation = (
        clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    kind = clean.schema["conv_id"].dataType
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("formatted", pa.string()), ("spans", span),
                        ("loss", span), ("rewrote", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def pack(done: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(done, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        for conv, own in groupby(rows(batches), key=lambda r: r[0]):
            found = render_turns([{"role": r, "content": t} for _, r, t in own], render, loss_roles)
            as_rows = {k: [{"start": a, "stop": b} for a, b in found[k]] for k in ("spans", "loss")}
            done.append({"conv_id": conv, **found, **as_rows})
            if len(done) >= _ROWS:
                yield pack(done)
                done = []
        yield pack(done)

    return by_conversation.mapInArrow(
        run, f"conv_id {kind.simpleString()}, formatted string, spans array<struct<start:long,stop:long>>, "
             "loss array<struct<start:long,stop:long>>, rewrote int")
