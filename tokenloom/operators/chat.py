"""Chat turns to token ids with a loss mask on what the assistant says."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from tokenloom.functions.encode import PieceEncoder, encoder
from tokenloom.functions.text import IM_END, IM_START, pieces
from tokenloom.operators.ordering import running_totals

ASSISTANT = "assistant"


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


#: Columns that make up a conversation; pairs add the side.
CONVERSATION = ("conv_id",)


def encode_turns(turns: DataFrame, merges: list[tuple[int, int]], keys: Sequence[str] = CONVERSATION) -> DataFrame:
    """Per turn: ``conv_id, turn, ids, mask`` (or the columns ``keys`` in place of ``conv_id``).

    The header, the content and the line end are encoded apart, so no merge
    crosses them. The mask is 1 on the content and end mark of assistant turns.
    Content is plain text: special tokens written in it stay bytes.
    """
    encode = encoder(merges)
    newline = PieceEncoder(merges).encode_many([b"\n"])[0]
    coded = turns.select(
        *keys, "turn", "role",
        encode(F.concat("role", F.lit("\n"))).alias("_role"),
        encode(F.col("text")).alias("_text"),
    )
    train = F.when(F.col("role") == ASSISTANT, F.lit(1)).otherwise(F.lit(0))
    return coded.select(
        *keys, "turn", "role",
        F.concat(_ints([IM_START]), "_role", "_text", _ints([IM_END]), _ints(newline)).alias("ids"),
        F.concat(
            F.array_repeat(F.lit(0), F.size("_role") + 1),
            F.array_repeat(train, F.size("_text") + 1),
            F.array_repeat(F.lit(0), len(newline)),
        ).alias("mask"),
    )


def encode_messages(merges: list[tuple[int, int]]) -> Callable[[Column], Column]:
    """Column function: ``array<struct<role,content>>`` → ``struct<ids,mask>``, the tokens of :func:`encode_turns` in list order.

    Message lists are encoded where they are: the split into pieces runs in the JVM, and one
    Arrow pass over the nested arrays puts the ids in place by offsets. Nothing is exploded or
    regrouped, so rows need no key. A null or empty list gives no ids.
    """
    coder = PieceEncoder(merges)
    newline = coder.encode_many([b"\n"])[0]

    @F.arrow_udf("struct<ids:array<int>,mask:array<int>>")
    def encode_lists(lists: pa.Array) -> pa.Array:
        count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        head, body, own = lists.flatten().flatten()
        head, body = coder.encode_batch(head), coder.encode_batch(body)
        h, b = (x.value_lengths().to_numpy().astype(np.int64) for x in (head, body))
        ends = np.cumsum(h + b + 2 + len(newline))
        begin = ends - (h + b + 2 + len(newline))
        ids = np.empty(ends[-1] if len(ends) else 0, dtype=np.int32)
        mask = np.zeros(len(ids), dtype=np.int32)
        ids[begin] = IM_START
        for part, n, at in ((head, h, begin + 1), (body, b, begin + 1 + h)):
            spots = np.arange(n.sum()) + np.repeat(at - np.cumsum(n) + n, n)
            ids[spots] = part.flatten().to_numpy()
        mask[spots] = np.repeat(own.to_numpy(), b)  # the bodies' places
        ids[begin + 1 + h + b], mask[begin + 1 + h + b] = IM_END, own.to_numpy()
        ids[(begin + 2 + h + b)[:, None] + np.arange(len(newline))] = newline
        offsets = pa.array(np.r_[0, ends][np.r_[0, np.cumsum(count)]], pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, mask)], ["ids", "mask"])

    def encode(messages: Column) -> Column:
        return encode_lists(F.transform(messages, lambda m: F.struct(
            pieces(F.coalesce(F.concat(m["role"], F.lit("\n")), F.lit(""))).alias("head"),
            pieces(F.coalesce(m["content"], F.lit(""))).alias("body"),
            F.when(m["role"] == ASSISTANT, F.lit(1)).otherwise(F.lit(0)).alias("own"))))

    return encode


def message_lists(turns: DataFrame) -> DataFrame:
    """``conv_id, messages`` with ``turn, role, content`` in turn order: the nested form of a turn table, a row per conversation."""
    return turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))


def generation_prompt(merges: list[tuple[int, int]]) -> Column:
    """Ids that open an assistant turn; their mask is 0."""
    coder = PieceEncoder(merges)
    name, newline = coder.encode_many([ASSISTANT.encode(), b"\n"])
    return _ints([IM_START, *name, *newline])


def with_prompt(assembled: DataFrame, merges: list[tuple[int, int]]) -> DataFrame:
    """Append the generation prompt to the ids of each conversation; its mask is 0."""
    prompt = generation_prompt(merges)
    return assembled.withColumn("mask", F.concat("mask", F.array_repeat(F.lit(0), F.size(prompt)))).withColumn(
        "ids", F.concat("ids", prompt))


def turn_offsets(encoded: DataFrame, keys: Sequence[str] = CONVERSATION) -> DataFrame:
    """Adds ``n_tok`` and ``offset``, the token position of a turn in its conversation.

    Works for a conversation of any length: its turns are spread over tasks.
    ``encoded`` should be a stored table; only sizes go through the ordering.
    """
    sizes = encoded.select(*keys, "turn", F.size("ids").cast("long").alias("n_tok"))
    placed = running_totals(sizes, ["turn"], {"n_tok": "offset"}, group_by=keys, label="turns")
    return encoded.join(placed, [*keys, "turn"])


def conversation_sizes(offsets: DataFrame, keys: Sequence[str] = CONVERSATION) -> DataFrame:
    """Token and supervised-token totals per conversation."""
    return offsets.groupBy(*keys).agg(
        F.sum("n_tok").cast("long").alias("n_tok"),
        F.sum(F.aggregate("mask", F.lit(0), lambda a, m: a + m)).cast("long").alias("supervised"),
    )


def assemble(offsets: DataFrame, width: int, keys: Sequence[str] = CONVERSATION) -> DataFrame:
    """``conv_id, ids, mask`` of each conversation, truncated to ``width`` tokens.

    Turns past the width are left out before grouping, which bounds each group.
    """
    left = (F.lit(width) - F.col("offset")).cast("int")
    parts = offsets.where(F.col("offset") < width).select(
        *keys,
        F.struct("offset", F.slice("ids", F.lit(1), left).alias("ids"),
                 F.slice("mask", F.lit(1), left).alias("mask")).alias("part"),
    )
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts")).select(
        *keys,
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.flatten(F.transform("parts", lambda p: p["mask"])).alias("mask"),
    )


def render_turn(role: Column, content: Column) -> Column:
    """One turn in the chat text template."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


def render_messages(messages: Column, prompt: bool = False) -> Column:
    """A whole message list in the chat text template."""
    text = F.concat_ws("", F.transform(messages, lambda m: render_turn(m["role"], m["content"])))
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if prompt else text


def _digest_runs(prompt: bytes, schema: pa.Schema):
    """MD5 over the texts of each run of equal ``conv_id``; the open run goes on from batch to batch."""
    def rows(done: list) -> pa.RecordBatch:
        sums = [(None, None) if not any_text else (text.hexdigest(), _with(text, prompt)) for _, text, any_text in done]
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], schema.field(0).type), pa.array([a for a, _ in sums], pa.string()),
             pa.array([b for _, b in sums], pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # conv_id, digest so far, whether there was any text
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, said, done = batch.column(0), batch.column(1), []
            codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
            begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            ends = np.r_[begins[1:], len(codes)]
            for key, a, b in zip(conv.take(pa.array(begins)).to_pylist(), begins.tolist(), ends.tolist()):
                if held is None or held[0] != key:
                    if held is not None:
                        done.append(held)
                    held = [key, hashlib.md5(usedforsecurity=False), False]
                for text in said.slice(a, b - a):
                    if text.is_valid:
                        held[1].update(text.as_buffer())
                        held[2] = True
            if done:
                yield rows(done)
        if held is not None:
            yield rows([held])
    return run


def _with(text, more: bytes) -> str:
    whole = text.copy()
    whole.update(more)
    return whole.hexdigest()


def text_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, text_md5, prompt_md5`` of the chat text of each conversation, without and with the prompt for a reply.

    Conversations of any length: their turns come sorted (Spark spills the sort)
    and are digested row by row, so no task holds a whole text. A turn without
    role or text adds nothing, as in :func:`render_messages`; with no turn left
    both are null.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    out = StructType([turns.schema["conv_id"], StructField("text_md5", StringType()), StructField("prompt_md5", StringType())])
    said = rows.select("conv_id", render_turn(F.col("role"), F.col("text")).cast("binary").alias("said"))
    return said.mapInArrow(_digest_runs(b"<|im_start|>assistant\n", to_arrow_schema(out)), out)


def messages(turns: DataFrame, max_turns: int) -> DataFrame:
    """Message lists from a turn table, for datasets of short conversations.

    A conversation of more than ``max_turns`` turns is an error rather than an
    oversized group: use :func:`text_digests` or :func:`turn_offsets` for those.
    """
    if turns.groupBy("conv_id").count().where(F.col("count") > max_turns).limit(1).count():
        raise ValueError(f"a conversation has more than {max_turns} turns")
    return turns.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages"))


def turns_of(rows: DataFrame, id_col: str, messages_col: str) -> DataFrame:
    """A turn table ``conv_id, turn, role, text`` from rows with a message list."""
    return rows.select(F.col(id_col).alias("conv_id"), F.posexplode(messages_col).alias("turn", "_m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "_m.role", F.col("_m.content").alias("text"))


def packing_report(packed: DataFrame) -> DataFrame:
    """Rows, supervised tokens and share of real (not padding) tokens of a packed set."""
    return packed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.aggregate("mask", F.lit(0), lambda a, m: a + m)).cast("long").alias("supervised"),
        (F.sum("used") / F.sum(F.size("ids"))).alias("filled"),
    )
