"""Language of texts by a convolutional network over bytes, trained here in numpy.

Texts are cut into windows of ``WINDOW`` bytes (upper-case A-Z lower-cased, neighbours
share a few bytes, the last is filled up with zeros); all windows of a text count.
Each byte has an embedding; filters of several widths run over it, each gives its
largest value in the window, and a softmax layer turns these into languages. A text's
prediction is the softmax of its windows' mean scores, weighted by their bytes.

Training: the labelled rows' counts per language give a share for each, and rows whose
hash falls below it are taken, ``PER_LANGUAGE`` of each language and ``SAMPLE`` in all at
most, with up to ``WINDOWS_EACH`` windows from all over the text. That is the only bounded
sample; the driver trains on it with a fixed seed. At most ``LANGUAGES`` languages are
told apart, the most frequent. Prediction reads all rows; it gets the text alone.

Cases: null texts and texts without a letter are ``und``, with score 0, as are all if no
row is labelled. Very long texts go through in bounded batches of windows. Rows with
a null language or an empty text teach nothing. Repeated rows have equal results; equal
ids with other texts have their own. Other columns aren't read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokenloom.llm.common import byte_texts, ready

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4, 5), 16, 8
#: The bounded sample: documents of each language and in all, windows of each document, languages.
PER_LANGUAGE, SAMPLE, WINDOWS_EACH, LANGUAGES = 1000, 12_000, 3, 256
EPOCHS, BATCH, RATE = 3, 64, 0.01
UNKNOWN = "und"
_WIDEST = max(WIDTHS)
_STEP = WINDOW - _WIDEST + 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Windows that go through the network at once.
_AT_ONCE = 128


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text, one per row; an empty text has none."""
    if not text:
        return np.zeros((0, WINDOW), dtype=np.uint8)
    count = max(1, -(-(len(text) - _WIDEST + 1) // _STEP))
    padded = np.zeros((count - 1) * _STEP + WINDOW, dtype=np.uint8)
    padded[: len(text)] = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STEP]


@dataclass
class Network:
    """embed (256, E), kernel (widest * E, filters of all widths), bias, out (filters, languages), out_bias."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def convolved(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each place of each window gives under the filters, and the values that they saw."""
        n, size = windows.shape
        values = np.zeros((n, size + _WIDEST - 1, self.embed.shape[1]), dtype=np.float32)
        values[:, :size] = self.embed[windows]
        seen = np.lib.stride_tricks.sliding_window_view(values.reshape(n, -1), _WIDEST * self.embed.shape[1], axis=1)
        seen = np.ascontiguousarray(seen[:, :: self.embed.shape[1]]).reshape(n * size, -1)
        return (seen @ self.kernel).reshape(n, size, -1), seen

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """One row of language scores (before the softmax) per window."""
        best = self.convolved(windows)[0].max(axis=1)
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def _filter_mask(embedding: int) -> np.ndarray:
    """Which kernel entries exist: a filter of width w sees the first w bytes of its place."""
    rows = np.repeat(np.arange(_WIDEST), embedding)
    widths = np.repeat(WIDTHS, FILTERS)
    return (rows[:, None] < widths[None, :]).astype(np.float32)


def train(windows: np.ndarray, labels: np.ndarray, languages: int, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adam on the cross entropy, languages weighted alike; some windows are cut short, as short texts are."""
    draw = np.random.default_rng(seed)
    mask = _filter_mask(EMBEDDING)
    filters = len(WIDTHS) * FILTERS
    net = Network(
        draw.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (draw.normal(0, 1, mask.shape) * mask / np.sqrt(mask.sum(axis=0))).astype(np.float32),
        np.zeros(filters, np.float32), draw.normal(0, 0.1, (filters, languages)).astype(np.float32),
        np.zeros(languages, np.float32))
    net.embed[0] = 0  # what fills a window up says nothing
    names = ("embed", "kernel", "bias", "out", "out_bias")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    weights = 1 / np.maximum(np.bincount(labels, minlength=languages), 1)
    weights = weights / weights[labels].mean()
    steps, total = 0, max(1, epochs * -(-len(windows) // BATCH))
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(len(windows)), max(1, -(-len(windows) // BATCH))):
            x, y = windows[rows].copy(), labels[rows]
            short = np.flatnonzero(draw.random(len(rows)) < 0.3)
            x[short[:, None], np.arange(WINDOW)[None, :]] *= (
                np.arange(WINDOW)[None, :] < draw.integers(8, WINDOW, len(short))[:, None]).astype(np.uint8)
            gave, seen = net.convolved(x)
            at = gave.argmax(axis=1)  # only the largest value of a filter learns
            best = np.take_along_axis(gave, at[:, None, :], axis=1)[:, 0] + net.bias
            held = np.maximum(best, 0)
            wrong = softmax(held @ net.out + net.out_bias)
            wrong[np.arange(len(y)), y] -= 1
            wrong *= (weights[y] / len(y))[:, None]
            back = (wrong @ net.out.T) * (best > 0)
            picked = seen.reshape(len(x), WINDOW, -1)[np.arange(len(x))[:, None], at]  # (rows, filters, widest * E)
            grads = {"out": held.T @ wrong, "out_bias": wrong.sum(axis=0), "bias": back.sum(axis=0),
                     "kernel": np.einsum("nfk,nf->kf", picked, back) * mask}
            spread = np.einsum("nf,kf->nfk", back, net.kernel).reshape(-1, EMBEDDING)
            places = at[:, :, None] + np.arange(_WIDEST)
            bytes_at = np.pad(x, ((0, 0), (0, _WIDEST - 1)))[np.arange(len(x))[:, None, None], places].reshape(-1)
            grads["embed"] = np.stack([np.bincount(bytes_at, spread[:, e], 256) for e in range(EMBEDDING)], axis=1)
            grads["embed"][0] = 0
            steps += 1
            rate = RATE * (1 - 0.9 * steps / total)
            for k in names:
                g = grads[k].astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                change = rate * (first[k] / (1 - 0.9 ** steps)) / (np.sqrt(second[k] / (1 - 0.999 ** steps)) + 1e-7)
                setattr(net, k, (getattr(net, k) - change).astype(np.float32))
    return net


def training_windows(rows: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, their languages' numbers and the languages, from ``rows`` (text, lang); collected, as bounded."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    per_language = max(1, min(per_language, SAMPLE // len(languages)))
    # Twice the wanted share of the hash range: so few are taken, and the bound cuts them by hash.
    key = F.xxhash64("text", "lang")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * per_language / r["count"]))])[F.col("lang")]
    below = (key.cast("double") / 2.0 ** 64 + 0.5) < share
    taken = known.select("lang", "text", key.alias("key"), below.alias("below")).where("below").groupBy("lang", "key").agg(
        F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch), strict=True):
                every = windows_of(text)
                at = np.unique(np.linspace(0, len(every) - 1, min(len(every), WINDOWS_EACH)).astype(int))
                out += [(lang, key, every[i].tobytes()) for i in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))],
                names=["lang", "key", "window"])

    cut_out = taken.mapInArrow(cut, "lang string, key long, window binary")
    held: dict[str, list] = {}
    for r in cut_out.collect():
        held.setdefault(r["lang"], []).append((r["key"], bytes(r["window"])))
    windows, labels = [], []
    for number, lang in enumerate(languages):
        own = sorted(held.get(lang, []))
        keep = set(sorted({k for k, _ in own})[:per_language])
        own = [w for k, w in own if k in keep]
        windows += own
        labels += [number] * len(own)
    return (np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(labels, np.int64), languages)


def text_scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean language scores of each text's windows, weighted by their bytes; a bounded batch of windows at a time."""
    total = np.zeros((len(texts), len(net.out_bias)))
    weight = np.zeros(len(texts))
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            owner = np.concatenate([np.full(len(w), i) for i, w in held])
            x = np.concatenate([w for _, w in held])
            size = (x != 0).sum(axis=1) + 1e-9
            np.add.at(total, owner, net.scores(x) * size[:, None])
            np.add.at(weight, owner, size)
            held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        every = windows_of(text)
        for at in range(0, len(every), _AT_ONCE):
            held.append((i, every[at:at + _AT_ONCE]))
            waiting += len(held[-1][1])
            if waiting >= _AT_ONCE:
                flush()
                waiting = 0
    flush()
    return total / np.maximum(weight, 1e-9)[:, None]


def identify(rows: DataFrame, net: Network | None, languages: list[str]) -> DataFrame:
    """doc, text gone, the other columns of ``rows`` and lang_pred, score."""
    rest = [c for c in rows.columns if c not in ("text", "lettered")]
    types = {c: to_arrow_type(rows.schema[c].dataType) for c in rest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = np.array(batch.column(batch.schema.get_field_index("lettered")).to_pylist(), dtype=bool)
            texts = byte_texts(batch)
            names = np.full(batch.num_rows, UNKNOWN, dtype=object)
            sure = np.zeros(batch.num_rows)
            own = np.flatnonzero(lettered)
            if len(own) and net is not None:
                shares = softmax(text_scores(net, [texts[i] for i in own]))
                names[own] = np.array(languages, dtype=object)[shares.argmax(axis=1)]
                sure[own] = shares.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)).cast(types[c]) for c in rest), pa.array(names.tolist(), pa.string()),
                 pa.array(sure)], names=[*rest, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: a network trained on the rows that aren't held out, applied to all."""
    ready(docs.sparkSession)
    text = F.col(text_col).cast("string")
    out = F.coalesce(held_out, F.lit(False))
    windows, labels, languages = training_windows(
        docs.where(~out).select(text.alias("text"), F.col(lang_col).cast("string").alias("lang")))
    net = train(windows, labels, len(languages)) if languages else None
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"), text.alias("text"))
    return identify(rows, net, languages)
