import math
import pickle
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import edge_rows
from tokenloom.llm import bloom_lm
from tokenloom.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").encode().lower()), None]


def out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def check(rows, docs):
    counts = Counter(t for i, text in docs if not out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (out(i), len(own := tokens(text)), sum(counts[t] > 0 for t in own), n,
         round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 4)) for i, text in docs)
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want


def test_query_matches_plain_counts_and_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op8_bloom_lm"](spark, sf).collect()
    check(rows, docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("text_bytes", [bloom_lm.BLOCK_BYTES, 1000])
def test_probes_sent_to_blocks_give_the_same_scores(spark, edge, no_docs, monkeypatch, text_bytes):
    """A model too large to broadcast; with a few blocks, and with very many of a few keys each."""
    monkeypatch.setattr(bloom_lm, "BLOCK_BYTES", text_bytes)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    one, other = bloom_lm.score_documents(docs), bloom_lm.score_documents(docs, most_bytes=1)
    assert other.schema == one.schema
    assert sorted(other.collect()) == sorted(one.collect())
    rows = bloom_lm.score_documents(edge, most_bytes=1).collect()
    check(rows, [(i, t) for i, t, *_ in edge_rows()])
    assert bloom_lm.score_documents(no_docs, most_bytes=-1).count() == 0


def test_blocks_grow_in_number_with_the_text():
    assert bloom_lm._block_count(0) == 64
    for size in (10 ** 9, 10 ** 12, 10 ** 14):
        count = bloom_lm._block_count(size)
        assert size / count <= bloom_lm.BLOCK_BYTES and count & (count - 1) == 0


def test_blocks_are_stored_in_few_files(spark, many_ranges, monkeypatch):
    """However many reducers make them: creating a file costs an executor a copy of its process."""
    stored, stage = [], bloom_lm.stage
    monkeypatch.setattr(bloom_lm, "stage", lambda df, label: stored.append(stage(df, label)) or stored[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        bloom_lm.score_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert stored[0].count() == 64 and len(stored[0].inputFiles()) <= 8


def test_a_model_travels_without_its_arrays(spark):
    """Workers map the file their executor got instead of holding a model each."""
    part = bloom_lm.MappedSlice(0, 2, 63, {0: 40_000_000, 1: 8}, {0: 3, 1: 0})
    words = np.array([3, 8, 9], dtype="<u8")
    part.put({"block": 0, "bits": b"\xff" * 5_000_000, "words": words.tobytes(),
              "counts": np.array([5, 1 << 40, 2], dtype="<i8").tobytes()})
    part.send(spark)
    sent = pickle.dumps(part)
    assert len(sent) < 5_000

    def look(batches):
        known = pickle.loads(sent).here()
        assert not known.bits.flags.writeable and len(known.bits) == 5_000_001
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(known.exact(keys))], ["n"])

    found = spark.createDataFrame([(8,), (3,), (4,)], "k long").coalesce(1).mapInArrow(look, "n long").collect()
    assert [r["n"] for r in found] == [1 << 40, 5, 0]


def test_hashing_takes_little_memory_at_once():
    texts = [b"some words of a text that is not long, again and again " * 20] * 4000
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary())})
    tracemalloc.start()
    try:
        total = 0
        for group in bloom_lm._groups(batch):
            tokens, before, _ = bloom_lm.tokens_of(group)
            total += len(bloom_lm.pair_keys(before, tokens))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 4000 * (20 * 12 + 1)
    assert peak < 30 << 20


def test_odd_rows(edge, no_docs):
    rows = bloom_lm.score_documents(edge).collect()
    check(rows, [(i, t) for i, t, *_ in edge_rows()])
    assert all(r["score"] < 0 for r in rows)
    assert bloom_lm.score_documents(no_docs).count() == 0


def test_without_training_texts(spark):
    held = next(i for i in range(100) if out(i))
    row = bloom_lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


def test_filter_holds_every_level():
    keys = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.random.default_rng(1).zipf(1.5, 5000).clip(1, 10 ** 6)
    bits, size = bloom_lm.build_filter(keys, counts)
    words = np.array([3, 8], dtype="<u8")
    part = bloom_lm.Slice(0, 1, 63, {0: size}, {0: 2})
    part.put({"block": 0, "bits": bits.tobytes(), "words": words.tobytes(), "counts": np.array([5, 1 << 40], dtype="<i8").tobytes()})
    assert part.exact(np.array([8, 3, 4], dtype=np.uint64)).tolist() == [1 << 40, 5, 0]
    low = keys[keys < np.uint64(1 << 63)]
    want = bloom_lm.level_of(counts)[keys < np.uint64(1 << 63)]
    got = part.levels(low)
    assert (got >= want).all() and (got == want).mean() > 0.97
    others = bloom_lm.mix(keys)
    assert (part.levels(others[others < np.uint64(1 << 63)]) > 0).mean() < 0.05


def test_levels_grow_with_counts_and_stand_for_them():
    counts = np.arange(1, 3000)
    levels = bloom_lm.level_of(counts)
    assert (np.diff(levels) >= 0).all() and levels[0] == 1
    assert (np.abs(np.log(bloom_lm.count_of(levels) / counts)) < np.log(bloom_lm.LEVEL_BASE)).all()


def test_scores_match_a_replay_from_exact_counts(spark):
    """The model's formula over exact counts, as their levels stand for them; a filter errs upwards on a hundredth of its probes."""
    docs = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    train = [tokens(t) for i, t in docs if not out(i)]
    words = Counter(t for own in train for t in own)
    pairs = Counter(p for own in train for p in zip([None, *own], own))
    n, v = sum(words.values()), len(words)

    def stands_for(count):
        return float(bloom_lm.count_of(bloom_lm.level_of(np.array([count])))[0]) if count else 0.0

    want = {}
    for i, text in docs:
        own = tokens(text)
        score = 0.0
        for before, t in zip([None, *own], own):
            word, history = stands_for(words[t]), stands_for(words[before])
            pair = min(stands_for(pairs[before, t]), history)
            score += math.log10((pair + bloom_lm.MU * (word + 1) / (n + v + 1)) / (history + bloom_lm.MU))
        want[i, len(own)] = score
    rows = bloom_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    off = np.array([(r["score"] - want[r["doc_id"], r["n_tokens"]]) / r["n_tokens"] for r in rows])
    known = np.array([not r["held_out"] for r in rows])
    assert len(off) == len(docs) and np.abs(off[known]).mean() < 0.01 and np.abs(off).mean() < 0.03
    assert np.abs(off)[np.array([r["n_tokens"] > 100 for r in rows])].max() < 0.1
    assert np.corrcoef([r["score"] for r in rows], [want[r["doc_id"], r["n_tokens"]] for r in rows])[0, 1] > 0.9999
