"""Secret scans: all rules in one pass over the bytes.

All rules run as one minimal automaton (``automaton``). Its pass gives for each
byte the rules that may be in the middle of a match. A match of a rule lies
inside one unbroken stretch of such bytes; a stretch that is long enough and in which
the rule accepts is walked through with the rule's own small automaton to find
its leftmost, longest, non-overlapping matches. A match counts if its tail (what
the rule accepts byte by byte at its end) is long enough; one that is too short is
dropped but still uses up its bytes.

Cases: a null text is an empty text and has no spans. Texts of any length are
scanned whole. Equal rows give equal results, an empty table gives no rows, and no
column but id and text is read. Spans are code points, end exclusive.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.automaton import (
    Automaton, Node, byte_set, compile_rules, either, literal, many, maybe, scan, some, span, then,
)
from tokenloom.llm.common import byte_texts, ready

GROUP_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    shape: Node
    tail: int    # accepted bytes a match needs at its end
    least: int   # bytes a match has at least


def _rules() -> tuple[Rule, ...]:
    quote, spaces = maybe(byte_set("\"'")), many(byte_set(" "))
    value = byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    word, url_safe = span("AZ", "az", "09"), span("AZ", "az", "09", "_", "-")
    keys = either(*[literal(k, any_case=True) for k in ("password", "passwd", "secret", "token")],
                  then(literal("api", True), maybe(byte_set("_")), literal("key", True)))
    return (
        Rule("assign", then(keys, quote, spaces, byte_set(":="), spaces, quote, some(value)), 6, 12),
        Rule("access", then(literal("AKIA"), some(span("AZ", "09"))), 16, 20),
        Rule("hex", some(span("09", "af")), 24, 24),
        # Added by this operator.
        Rule("forge", then(literal("gh"), byte_set("pousr"), byte_set("_"), some(word)), 36, 40),
        Rule("chat", then(literal("xox"), byte_set("abprs"), byte_set("-"), some(span("AZ", "az", "09", "-"))), 10, 15),
        Rule("webtoken", then(literal("eyJ"), some(url_safe), byte_set("."), literal("eyJ"), some(url_safe),
                              byte_set("."), some(url_safe)), 10, 20),
        Rule("key", then(literal("-----BEGIN "), many(span("AZ", " ")), literal("PRIVATE KEY-----")), 1, 27),
    )


RULES = _rules()
BASE = ("assign", "access", "hex")


@functools.cache
def combined() -> Automaton:
    """All rules, each free to begin anywhere; compiled once per worker."""
    return compile_rules([r.shape for r in RULES])


@functools.cache
def _alone(k: int) -> tuple[list[int], list[int], list[int], list[int], int]:
    """One rule that begins at the first byte, as plain lists: moves, accepts, active, classes, width."""
    auto = compile_rules([RULES[k].shape], anywhere=False)
    return auto.moves.tolist(), auto.accepts.tolist(), auto.active.tolist(), auto.class_of.tolist(), auto.classes


def _walk(k: int, data: bytes, begin: int, end: int) -> list[tuple[int, int]]:
    """Matches of rule ``k`` between two places of ``data``."""
    table, accepts, active, classes, width = _alone(k)
    rule, out, at = RULES[k], [], begin
    while at < end:
        state, stop, tail = 0, -1, 0
        for i in range(at, end):
            state = table[state * width + classes[data[i]]]
            if not active[state]:
                break
            if accepts[state]:
                stop, tail = i + 1, tail + 1
        if stop < 0:
            at += 1
        else:
            if tail >= rule.tail:
                out.append((at, stop))
            at = stop
    return out


def find_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(begin, rule number, end) of all matches in bytes, by begin, then rule."""
    auto = combined()
    states = scan(auto, np.frombuffer(data, dtype=np.uint8))
    accepts, active = auto.accepts.astype(np.uint16)[states], auto.active.astype(np.uint16)[states]
    found: list[tuple[int, int, int]] = []
    for k, rule in enumerate(RULES):
        accepted = np.flatnonzero((accepts >> k) & 1)
        if not len(accepted):
            continue
        edge = np.diff(np.concatenate([[0], (active >> k) & 1, [0]]).astype(np.int8))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - begins >= rule.least
        begins, ends = begins[long], ends[long]
        hits = np.searchsorted(accepted, ends) > np.searchsorted(accepted, begins)
        for b, e in zip(begins[hits].tolist(), ends[hits].tolist(), strict=True):
            found.extend((x, k, y) for x, y in _walk(k, data, b, e))
    return sorted(found)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < GROUP_BYTES:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def text_spans(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(begin, rule number, end) of each text's matches, in code points."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for first, last in _groups(texts):
        # No rule matches a zero byte, so nothing reaches from one text into the next.
        data = b"\0".join(texts[first:last])
        borders = np.cumsum([0, *(len(t) + 1 for t in texts[first:last])])
        spans = find_spans(data)
        owners = np.searchsorted(borders, [b for b, _, _ in spans], side="right") - 1
        for owner, (b, k, e) in zip(owners.tolist(), spans, strict=True):
            text, shift = texts[first + owner], int(borders[owner])
            begin = len(text[: b - shift].decode())
            out[first + owner].append((begin, k, begin + (e - b)))  # matches are ASCII
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [r.kind for r in RULES]
    base = [kinds.index(k) for k in BASE]
    for batch in batches:
        found = text_spans(byte_texts(batch))
        lines = [[f"{kinds[k]}:{b}:{e}" for b, k, e in spans] for spans in found]
        own = [",".join(s for s, (_, k, _) in zip(line, spans, strict=True) if k in base)
               for line, spans in zip(lines, found, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)]
            + [pa.array([sum(k == want for _, k, _ in spans) for spans in found], pa.int64()) for want in base]
            + [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own], pa.string()),
               pa.array([",".join(line) for line in lines], pa.string())],
            names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, a digest of their spans, and all spans as kind:start:end."""
    ready(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        _report, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
