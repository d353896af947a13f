"""Quality rules: how much of a text lies inside repeated n-grams and lines.

One running sum per group of texts gives rolling hashes of every n-gram length
(``wordhash``). For each length the characters of all words inside an n-gram
that occurs twice or more in its text are counted, first occurrence included.
A text fails a rule when the share of such characters is above the limit.

Cases: a null text is an empty text (no words; fails the base rule). Texts of
any length are handled, a long one in a group of its own. Equal rows give equal
results, an empty table gives no rows, and no column but id and text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import byte_texts, ready
from tokenloom.llm.wordhash import Hashed, hashed_groups, mix, ngram_hashes, running_words

#: Largest share of characters in repeated n-grams, by length. About twice what is
#: usual for web text: a boilerplate line that a good text holds twice is for line
#: dedup to take out, not a reason to lose the text.
NGRAM_LIMITS = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
#: Largest shares of repeated lines among lines, and of their characters.
LINE_LIMIT, LINE_CHARS_LIMIT = 0.50, 0.30
#: The fixed base rule.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (*(f"dup_{n}gram" for n in NGRAM_LIMITS), "dup_lines", "dup_line_chars")


def _repeated_words(group: Hashed, sums: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which words lie inside an n-gram found twice or more in their text."""
    covered = np.zeros(len(owner), dtype=bool)
    hashes = ngram_hashes(sums, n)
    if not len(hashes):
        return covered
    whole = np.flatnonzero(owner[: len(hashes)] == owner[n - 1:])
    keys = hashes[whole] ^ mix(owner[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = whole[order[twice]]
    if len(starts):
        steps = np.bincount(starts, minlength=len(owner) + 1) - np.bincount(starts + n, minlength=len(owner) + 1)
        covered = np.cumsum(steps)[: len(owner)] > 0
    return covered


def _line_counts(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, later copies of a line among them, and characters of both."""
    seen: set[bytes] = set()
    lines = copies = chars = copied = 0
    for line in text.split(b"\n"):
        if not line.split(None, 1):
            continue
        size = len(line.decode("utf-8", "replace"))
        lines += 1
        chars += size
        if line in seen:
            copies += 1
            copied += size
        else:
            seen.add(line)
    return lines, copies, chars, copied


def measure_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All counts and shares, one value per text."""
    out = {c: np.zeros(len(texts), dtype=np.int64) for c in COUNTS}
    out |= {c: np.zeros(len(texts)) for c in SHARES}
    for group in hashed_groups(texts, lower=False):
        count = len(group.offsets) - 1
        here = slice(group.first, group.first + count)
        owner, sums = group.owner, running_words(group.words)
        chars = np.bincount(owner, weights=group.chars, minlength=count)
        out["n_words"][here] = np.diff(group.offsets)
        out["word_chars"][here] = chars
        for n in sorted({*NGRAM_LIMITS, WINDOW}):
            covered = _repeated_words(group, sums, owner, n)
            if n == WINDOW:
                out["n_repeat_words"][here] = np.bincount(owner[covered], minlength=count)
            if n in NGRAM_LIMITS:
                inside = np.bincount(owner[covered], weights=group.chars[covered], minlength=count)
                out[f"dup_{n}gram"][here] = inside / np.maximum(chars, 1)
    for i, text in enumerate(texts):
        lines, copies, chars, copied = _line_counts(text)
        out["n_symbols"][i] = sum(text.count(s) for s in SYMBOLS)
        out["n_dup_lines"][i] = copies
        out["dup_lines"][i] = copies / max(lines, 1)
        out["dup_line_chars"][i] = copied / max(chars, 1)
    return out


def judge(values: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts the base rule fails, and which pass all rules."""
    failed = (values["n_words"] < LEAST_WORDS) | (
        100 * values["n_repeat_words"] > MOST_REPEATED * values["n_words"])
    over = (values["dup_lines"] > LINE_LIMIT) | (values["dup_line_chars"] > LINE_CHARS_LIMIT)
    for n, most in NGRAM_LIMITS.items():
        over |= values[f"dup_{n}gram"] > most
    return failed, ~failed & ~over


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = measure_texts(byte_texts(batch))
        failed, kept = judge(values)
        columns = {"doc_id": batch.column(0), **values, "base_failed": failed, "kept": kept}
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts, shares of repeated characters and lines, ``base_failed`` and ``kept``."""
    ready(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([
        f"doc_id {kind}", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in SHARES),
        "base_failed boolean", "kept boolean",
    ])
    return narrow.mapInArrow(_measure_batches, schema)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns; each row is judged on its own, without a join."""
    ready(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = names[docs.columns.index(text_col)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(measure_texts(byte_texts(batch, place)))[1]))

    plain = docs.toDF(*names)
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
