"""Language-model scoring with a log-frequency Bloom filter.

Training counts words and word pairs (by 64-bit hashes). Every task adds up its own
part of the corpus and cuts the sums by the key's leading bits into blocks; a
reducer per block adds the tasks' sums and builds the block's filter. There is a block for
each ``BLOCK_BYTES`` of training text, so none grows with the corpus. A count c is
stored as the level 1 + floor(log c): the key goes in once for each level up to
that, so a probe asks for level 1, 2, ... until one is missing. Filter bits grow
with the number of stored levels (``BITS`` each).

The blocks, with the exact word counts of the base score beside them, are written to one
file if they fit ``most_bytes``. Each executor gets a copy, which its workers map: they share
it, and no process holds a model of its own. Else probes go to the blocks: chunks of
documents send each of their different words and pairs once to its block and get levels
and counts back, two shuffles whatever the size of the model. Both ways give the same scores.

Model: pair counts smoothed with word probabilities,
p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU); a text begins behind an end token.

Cases: a null text is an empty text (the end token alone). Null ids count as the
empty id text when rows are held out. Rows are scored one by one, so repeated rows
get equal scores. Empty tables give no rows; without a training text every count is 0.
A text of any length is scored whole, as one row of one task. Other columns aren't read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokenloom.llm.common import byte_texts, ready
from tokenloom.llm.wordhash import U64, Hashed, hashed_groups, mix
from tokenloom.session import stage

BITS, PROBES = 10, 5
LEVEL_BASE = 1.5
MU = 4.0
#: Largest model that is copied to every machine; a larger one stays where it is and probes go to it.
MOST_BYTES = 4 << 30
#: Training text to a block; its sums take some three times as much at most.
BLOCK_BYTES = 4 << 20
#: Tokens of a chunk of documents whose probes go out together (a longer text is a chunk of its own).
CHUNK_TOKENS = 500_000
#: Tokens a task holds before it hands on its sums.
HELD_TOKENS = 1_500_000
#: Blocks whose sums leave a task in one Arrow batch, and blocks to a stored file.
SENT_BLOCKS = STORED_BLOCKS = 16
#: Text that is hashed at once; its arrays take some hundred times as much.
HASHED_BYTES = 256 << 10
END = U64(0x5851F42D4C957F2D)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The level a count is stored as."""
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(LEVEL_BASE) + 1e-9)).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The mean of the counts that share a level; 0 for level 0."""
    top = int(levels.max(initial=0))
    table = np.zeros(top + 1)
    for q in range(1, top + 1):
        low, high = np.ceil(LEVEL_BASE ** (q - 1) - 1e-6), np.ceil(LEVEL_BASE ** q - 1e-6) - 1
        table[q] = (low + max(low, high)) / 2
    return table[levels]


def _groups(batch: pa.RecordBatch) -> Iterator[Hashed]:
    return hashed_groups(byte_texts(batch), lower=True, group_bytes=HASHED_BYTES)


def tokens_of(group: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end behind each text, the tokens before them, and each token's text."""
    count = len(group.offsets) - 1
    owner = group.owner
    tokens = np.empty(len(group.words) + count, dtype=U64)
    ends = group.offsets[1:] + np.arange(count)
    tokens[ends] = END
    tokens[np.arange(len(owner)) + owner] = group.words
    before = np.empty_like(tokens)
    before[0:1] = END
    before[1:] = tokens[:-1]
    return tokens, before, np.repeat(np.arange(count), np.diff(group.offsets) + 1)


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * U64(0x9E3779B97F4A7C15) + mix(tokens) + U64(1))


def _block_count(text_bytes: int) -> int:
    """A power of two: a block for each BLOCK_BYTES of training text, at least 64."""
    return 1 << max(6, (max(text_bytes, 1) // BLOCK_BYTES).bit_length())


def _add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _partial_sums(kind: int, parts: list[np.ndarray], shift: int) -> Iterator[pa.RecordBatch]:
    """One row per block: its different keys and how often each occurs in ``parts``, which is emptied."""
    keys = np.concatenate(parts)
    parts.clear()
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys))).astype("<u4")
    keys = keys[first]
    for blocks, own in _by_block(keys, shift):
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array([kind] * len(own), pa.int32()),
             pa.array([keys[o].tobytes() for o in own], pa.binary()),
             pa.array([counts[o].tobytes() for o in own], pa.binary())],
            names=["block", "kind", "keys", "counts"])


def _by_block(keys: np.ndarray, shift: int) -> Iterator[tuple[list[int], list[slice]]]:
    """The blocks of sorted keys and where each one's keys are, some blocks at a time."""
    blocks = keys >> U64(shift)
    begins = np.flatnonzero(np.concatenate([[len(keys) > 0], blocks[1:] != blocks[:-1]]))
    ends = np.append(begins[1:], len(keys))
    for at in range(0, len(begins), SENT_BLOCKS):
        here = slice(at, at + SENT_BLOCKS)
        yield blocks[begins[here]].tolist(), [slice(a, b) for a, b in zip(begins[here], ends[here], strict=True)]


def _places(keys: np.ndarray, level: int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    """Bit of a key's probe for a level, among ``bits`` places (below 2**32)."""
    h = mix(keys + U64((level * 0xA0761D6478BD642F + probe * 0xE7037ED1A0B428DB) & 0xFFFFFFFFFFFFFFFF))
    return ((h >> U64(32)) * np.asarray(bits, dtype=U64)) >> U64(32)


def build_filter(keys: np.ndarray, counts: np.ndarray, bits_per_level: int = BITS) -> tuple[np.ndarray, int]:
    """The filter's bits, packed into bytes, and their number."""
    levels = level_of(counts) if len(counts) else np.zeros(0, np.int64)
    size = max(64, int(levels.sum()) * bits_per_level)
    if size >= 1 << 32:
        raise ValueError("too many keys for one filter: BLOCK_BYTES is too large")
    bits = np.zeros((size + 7) // 8 * 8, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= level], levels[levels >= level]
        for probe in range(PROBES):
            bits[_places(keys, level, probe, size)] = True
    return np.packbits(bits, bitorder="little"), size


def _build_block(table: pa.Table) -> pa.Table:
    """Add the tasks' sums for one block and build its filter."""
    sums = {}
    kinds = table["kind"].to_pylist()
    for kind in (1, 2):
        own = [i for i, k in enumerate(kinds) if k == kind]
        sums[kind] = _add_up([np.frombuffer(table["keys"][i].as_buffer(), dtype="<u8") for i in own],
                             [np.frombuffer(table["counts"][i].as_buffer(), dtype="<u4") for i in own])
    (words, word_counts), (pairs, pair_counts) = sums[1], sums[2]
    bits, size = build_filter(np.concatenate([words, pairs]), np.concatenate([word_counts, pair_counts]))
    return pa.table({
        "block": pa.array([table["block"][0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary()),
        "n_bits": pa.array([size], pa.int64()), "words": pa.array([words.tobytes()], pa.binary()),
        "counts": pa.array([word_counts.astype("<i8").tobytes()], pa.binary()),
        "tokens": pa.array([int(word_counts.sum())], pa.int64()), "types": pa.array([len(words)], pa.int64()),
    })


def train_blocks(texts: DataFrame, blocks: int) -> DataFrame:
    """One row per block: its filter, and its words' exact counts. ``texts`` has the column text."""
    shift = 64 - (blocks.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, held = [], [], 0
        for batch in batches:
            for group in _groups(batch):
                tokens, before, _ = tokens_of(group)
                words.append(tokens)
                pairs.append(pair_keys(before, tokens))
                held += len(tokens)
                if held >= HELD_TOKENS:
                    yield from _partial_sums(1, words, shift)
                    yield from _partial_sums(2, pairs, shift)
                    held = 0
        if held:
            yield from _partial_sums(1, words, shift)
            yield from _partial_sums(2, pairs, shift)

    sums = texts.mapInArrow(count, "block long, kind int, keys binary, counts binary")
    return sums.groupBy("block").applyInArrow(
        _build_block, "block long, bits binary, n_bits long, words binary, counts binary, tokens long, types long")


class Slice:
    """Some neighbouring blocks, ready to be probed."""

    def __init__(self, first: int, last: int, shift: int, bits: dict[int, int], types: dict[int, int]):
        """``bits`` and ``types``: the filter bits and the different words of each block there is."""
        self.first, self.last, self.shift = first, last, shift
        self.sizes, n_bytes, n_types = (np.zeros(last - first, dtype=np.int64) for _ in range(3))
        for b in bits:
            self.sizes[b - first], n_bytes[b - first], n_types[b - first] = bits[b], (bits[b] + 7) // 8, types[b]
        self.begins = np.cumsum(n_bytes) - n_bytes
        self.word_begins = np.cumsum(n_types) - n_types
        self.n_types, self.n_bytes = int(n_types.sum()), int(n_bytes.sum())
        self.large: dict[int, int] = {}  # counts that need more than 32 bits
        self._lay_out(self._memory())

    def _memory(self) -> np.ndarray:
        return np.empty(12 * self.n_types + self.n_bytes, dtype=np.uint8)

    def _lay_out(self, memory: np.ndarray) -> None:
        a, b = 8 * self.n_types, 12 * self.n_types
        self.words, self.counts = memory[:a].view(U64), memory[a:b].view(np.uint32)
        self.bits = memory[b:b + self.n_bytes]

    def put(self, row) -> None:
        """Copy one block's row to its place."""
        b = row["block"] - self.first
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        self.bits[self.begins[b]:self.begins[b] + len(bits)] = bits
        words, counts = np.frombuffer(row["words"], dtype="<u8"), np.frombuffer(row["counts"], dtype="<i8")
        here = slice(self.word_begins[b], self.word_begins[b] + len(words))
        self.words[here] = words
        most = np.iinfo(np.uint32).max
        self.counts[here] = np.minimum(counts, most)
        self.large.update((int(words[i]), int(counts[i])) for i in np.flatnonzero(counts >= most))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys whose block is in this slice."""
        blocks = (keys >> U64(self.shift)).astype(np.int64)
        return np.flatnonzero((blocks >= self.first) & (blocks < self.last))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The stored level of each key: probes for level 1, 2, ... until one misses."""
        out = np.zeros(len(keys), dtype=np.uint8)
        block = (keys >> U64(self.shift)).astype(np.int64) - self.first
        alive = np.flatnonzero(self.sizes[block] > 0)
        level = 0
        while len(alive):
            level += 1
            for probe in range(PROBES):
                own = block[alive]
                place = _places(keys[alive], level, probe, self.sizes[own]).astype(np.int64)
                hit = (self.bits[self.begins[own] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1
                alive = alive[hit == 1]
            out[alive] = level
        return out

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Exact training counts of words."""
        if not len(self.words):
            return np.zeros(len(words), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        found = np.where(self.words[at] == words, self.counts[at], 0).astype(np.int64)
        for word, count in self.large.items():
            found[words == U64(word)] = count
        return found


class MappedSlice(Slice):
    """A slice in a file of which every executor gets one copy; its workers map it and so share its memory."""

    def _memory(self) -> np.ndarray:
        # Spark's own folder for such files: no second copy here, and gone when the session ends.
        self.path = os.path.join(SparkFiles.getRootDirectory(), f"model-{uuid.uuid4().hex}.bin")
        return np.asarray(np.memmap(self.path, np.uint8, "w+", shape=max(1, 12 * self.n_types + self.n_bytes)))

    def send(self, spark: SparkSession) -> None:
        """Write out what was put in, for the tasks that begin from now on."""
        del self.words, self.counts, self.bits  # unmaps the file
        spark.sparkContext.addFile(self.path)

    def here(self) -> MappedSlice:
        """The slice as a worker sees it."""
        if not hasattr(self, "bits"):
            self._lay_out(np.asarray(np.memmap(SparkFiles.get(os.path.basename(self.path)), np.uint8, "r")))
        return self


def _look_up(part: Slice, tokens: np.ndarray, pairs: np.ndarray, state: np.ndarray) -> None:
    """Fill in what the slice knows: rows of ``state`` are exact count, word level, pair level."""
    here = part.holds(tokens)
    if len(here):
        words, back = np.unique(tokens[here], return_inverse=True)
        state[0, here] = part.exact(words)[back]
        state[1, here] = part.levels(words)[back]
    here = part.holds(pairs)
    state[2, here] = part.levels(pairs[here])


def _token_scores(state: np.ndarray, owner: np.ndarray, n_train: int, n_types: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of each token: base rule, model."""
    total = n_train + n_types + 1
    base = np.log10((state[0] + 1) / total)
    word = count_of(state[1])
    # The token before; a text begins behind an end token, whose level is that of any text's last token.
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[first] = word[-1]
    pair = np.minimum(count_of(state[2]), history)
    return base, np.log10((pair + MU * (word + 1) / total) / (history + MU))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _sums(state: np.ndarray, owner: np.ndarray, texts: int, n_train: int, n_types: int) -> list[np.ndarray]:
    """The columns of ``SCORES`` for some texts, all of whose tokens' states are known."""
    base, model = _token_scores(state, owner, n_train, n_types)
    return [np.bincount(owner, minlength=texts), np.bincount(owner[state[0] > 0], minlength=texts),
            np.full(texts, n_train, dtype=np.int64),
            np.bincount(owner, weights=base, minlength=texts), np.bincount(owner, weights=model, minlength=texts)]


def _score_by_copies(rows: DataFrame, blocks: DataFrame, shift: int, n_train: int, n_types: int) -> DataFrame:
    """Scores by a model of which every machine holds a copy; ``rows``: doc_id, held_out, text."""
    spark = rows.sparkSession
    sizes = blocks.select("block", "n_bits", "types").collect()  # a row for each BLOCK_BYTES of training text
    part = MappedSlice(0, 1 << (64 - shift), shift, {r["block"]: r["n_bits"] for r in sizes}, {r["block"]: r["types"] for r in sizes})
    for row in blocks.toLocalIterator():
        part.put(row)
    part.send(spark)
    sent = spark.sparkContext.broadcast(part)  # all but the arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.here()
        for batch in batches:
            parts = []
            for group in _groups(batch):
                tokens, before, owner = tokens_of(group)
                state = np.zeros((3, len(tokens)), dtype=np.int64)
                _look_up(known, tokens, pair_keys(before, tokens), state)
                parts.append(_sums(state, owner, len(group.offsets) - 1, n_train, n_types))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))],
                    names=["doc_id", "held_out", *SCORES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, {RESULT}")


def _chunks(rows: DataFrame) -> DataFrame:
    """Some rows each, as the hashes of their tokens: chunk, ids, held_out, sizes (tokens of each row), tokens."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, outs, sizes, parts, held = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            columns = [pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(id_type)),
                       pa.array([outs], pa.list_(pa.bool_())), pa.array([np.concatenate(sizes).astype("<i8").tobytes()], pa.binary()),
                       pa.array([np.concatenate(parts).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "held_out", "sizes", "tokens"])

        for batch in batches:
            own_ids, own_outs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in _groups(batch):
                here = slice(group.first, group.first + len(group.offsets) - 1)
                ids += own_ids[here]
                outs += own_outs[here]
                sizes.append(np.diff(group.offsets) + 1)
                parts.append(tokens_of(group)[0])
                held += len(parts[-1])
                if held >= CHUNK_TOKENS:
                    yield chunk()
                    ids, outs, sizes, parts, held = [], [], [], [], 0
                    made += 1
        if ids:
            yield chunk()

    return rows.mapInArrow(cut, f"chunk long, ids array<{kind}>, held_out array<boolean>, sizes binary, tokens binary")


def _chunk_keys(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and pairs of a chunk's tokens; its texts end with the end token, as the one before the first does."""
    return tokens, pair_keys(np.concatenate([[END], tokens[:-1]]), tokens)


def _score_by_shuffle(rows: DataFrame, blocks: DataFrame, shift: int, n_train: int, n_types: int) -> DataFrame:
    """Scores by a model of any size: different words and pairs of a chunk meet their block, answers their chunk."""
    chunks = stage(_chunks(rows), "chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, keys in enumerate(_chunk_keys(np.frombuffer(tokens, dtype="<u8")), 1):
                    keys = np.unique(keys)
                    for own_blocks, own in _by_block(keys, shift):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own_blocks, pa.int64()), pa.array([chunk] * len(own), pa.int64()),
                             pa.array([kind] * len(own), pa.int32()), pa.array([keys[o].tobytes() for o in own], pa.binary())],
                            names=["block", "chunk", "kind", "keys"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        part = None
        for row in known.to_pylist():
            part = Slice(row["block"], row["block"] + 1, shift, {row["block"]: row["n_bits"]}, {row["block"]: row["types"]})
            part.put(row)
        counts, levels = [], []
        for kind, keys in zip(asked["kind"].to_pylist(), asked["keys"].to_pylist(), strict=True):
            keys = np.frombuffer(keys, dtype="<u8")
            nothing = np.zeros(len(keys), dtype=np.int64)
            counts.append((part.exact(keys) if part and kind == 1 else nothing).astype("<i8").tobytes())
            levels.append((part.levels(keys) if part else nothing).astype(np.uint8).tobytes())
        return pa.table({"chunk": asked["chunk"], "kind": asked["kind"], "keys": asked["keys"],
                         "counts": pa.array(counts, pa.binary()), "levels": pa.array(levels, pa.binary())})

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        told = {1: ([], [], []), 2: ([], [], [])}
        for kind, *values in zip(*(answers[c].to_pylist() for c in ("kind", "keys", "counts", "levels")), strict=True):
            for held, value, dtype in zip(told[kind], values, ("<u8", "<i8", np.uint8), strict=True):
                held.append(np.frombuffer(value, dtype=dtype))
        row = own.to_pylist()[0]
        tokens, pairs = _chunk_keys(np.frombuffer(row["tokens"], dtype="<u8"))
        state = np.zeros((3, len(tokens)), dtype=np.int64)
        for kind, asked in ((1, tokens), (2, pairs)):
            keys, counts, levels = (np.concatenate(v) for v in told[kind])
            order = np.argsort(keys, kind="stable")
            at = order[np.searchsorted(keys[order], asked)]
            if kind == 1:
                state[0] = counts[at]
            state[kind] = levels[at]
        sizes = np.frombuffer(row["sizes"], dtype="<i8")
        sums = _sums(state, np.repeat(np.arange(len(sizes)), sizes), len(sizes), n_train, n_types)
        return pa.table([pa.array(row["ids"], own.schema.field("ids").type.value_type), pa.array(row["held_out"], pa.bool_()),
                         *(pa.array(v) for v in sums)], names=["doc_id", "held_out", *SCORES])

    probes = chunks.select("chunk", "tokens").mapInArrow(ask, "block long, chunk long, kind int, keys binary")
    answers = stage(probes.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
        answer, "chunk long, kind int, keys binary, counts binary, levels binary"), "answers")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score, f"doc_id {kind}, held_out boolean, {RESULT}")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: every row, by a model of the rest."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    training = rows.where(~F.col("held_out")).select("text")
    # A first pass inside the JVM, for the number of blocks.
    count = _block_count(training.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shift = 64 - (count.bit_length() - 1)
    # Some reducers to a file, which would else hold a few hundred KB, or nothing.
    files = max(docs.sparkSession.sparkContext.defaultParallelism, count // STORED_BLOCKS)
    blocks = stage(train_blocks(training, count).coalesce(files), "blocks")
    size, n_train, n_types = (x or 0 for x in blocks.agg(
        F.sum(F.length("bits") + 12 * F.col("types")), F.sum("tokens"), F.sum("types")).first())
    way = _score_by_copies if size <= most_bytes else _score_by_shuffle
    return way(rows, blocks, shift, n_train, n_types)
