import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import carving, mixing
from tokenloom.operators.filters import check_vocabulary, keep_documents, short_pairs
from tokenloom.sources import mixes
from tokenloom.sources.mixes import Mix, Source, choose_mix, read_sources, spec_frame, table_mixes, tokenizer_mix, with_mix_source


def _mix(weights):
    return Mix(tuple(Source(n, w) for n, w in weights.items()), 100, 30)


def _docs(spark, sizes):
    rows = [(s, i, n) for s, ns in sizes.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "source string, doc_id long, n_tok long")


def _greedy(sizes, mix, need, per_batch):
    share, used, taken, out, start = mix.shares, dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0), [], 0
    while start < need:
        s = min(share, key=lambda k: taken[k] / share[k])
        for _ in range(per_batch):
            epoch, i = divmod(used[s], len(sizes[s]))
            out.append((start, s, epoch, i))
            start += sizes[s][i]
            taken[s] += sizes[s][i]
            used[s] += 1
    return out


@pytest.mark.parametrize("seed,need,per_batch", [(1, 4000, 4), (2, 900, 1), (3, 2500, 16)])
def test_token_deficit_equals_the_loop(spark, many_ranges, seed, need, per_batch):
    rng = random.Random(seed)
    mix = _mix({"a": 0.6, "b": 0.25, "c": 0.15})
    sizes = {s: [rng.randint(1, 60) for _ in range(n)] for s, n in {"a": 21, "b": 9, "c": 2}.items()}
    got = mixing.token_deficit_mix(_docs(spark, sizes), mix, need, per_batch)
    assert sorted((r["start"], r["source"], r["epoch"], r["doc_id"]) for r in got.collect()) == _greedy(sizes, mix, need, per_batch)


def test_epochs_of_a_source_may_pass_32_bits_together(spark):
    """Each source has fewer tokens than 2**31, what the mix reads of one has more."""
    mix = _mix({"a": 0.8, "b": 0.2})
    sizes = {"a": [700_000_000, 650_000_001], "b": [600_000_000, 1_000_000_007]}
    need = 9_000_000_000
    got = mixing.token_deficit_mix(_docs(spark, sizes), mix, need, 2).collect()
    assert sorted((r["start"], r["source"], r["epoch"], r["doc_id"]) for r in got) == _greedy(sizes, mix, need, 2)
    assert max(r["epoch"] for r in got) > 3


def test_empty_source_is_an_error(spark):
    with pytest.raises(mixing.EmptySource):
        mixing.token_deficit_mix(_docs(spark, {"a": [5]}), _mix({"a": 1, "b": 1}), 10)


def test_byte_budget_equals_the_loop(spark, many_ranges):
    rng = random.Random(7)
    mix = tokenizer_mix(0.25)
    sizes = {"text": [rng.randint(1, 50) for _ in range(80)], "code": [rng.randint(1, 50) for _ in range(40)]}
    docs = _docs(spark, sizes).withColumnRenamed("n_tok", "n_bytes")
    seen, at, want = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0), []
    while sum(seen.values()) < 1000:
        s = min(mix.shares, key=lambda k: seen[k] / mix.shares[k])
        want.append((sum(seen.values()), s, at[s]))
        seen[s] += sizes[s][at[s]]
        at[s] += 1
    got = mixing.byte_budget_mix(docs, mix, 1000)
    assert sorted((r["start"], r["source"], r["doc_id"]) for r in got.collect()) == want
    with pytest.raises(mixing.EmptySource):
        mixing.byte_budget_mix(docs, mix, 10**6)
    assert [s.name for s in tokenizer_mix(0).sources] == ["text"]


def test_carve_golden(spark):
    mixed = spark.createDataFrame([("a", 0, i, i * 25, 25) for i in range(14)], "source string, epoch int, doc_id long, start long, n_tok long")
    rows = carving.carve(mixed, 100, 30, "train", 250).collect()
    per = {}
    for r in rows:
        per.setdefault((r["split"], r["shard_idx"]), []).append((r["shard_pos"], r["n_tok"], r["doc_id"] * 25 + r["skip"]))
    assert sorted(per) == [("train", 0), ("train", 1), ("train", 2), ("val", 0)]
    for (split, idx), parts in per.items():
        pos, first = 0, 0 if split == "val" else 30 + 100 * idx
        for at, n, absolute in sorted(parts):
            assert at == pos and absolute == first + pos
            pos += n
        assert pos == (30 if split == "val" else 100)
    whole = carving.carve(mixed, 100, 0, "anneal")
    assert {(r["split"], r["shard_idx"]) for r in whole.collect()} == {("anneal", 0), ("anneal", 1), ("anneal", 2)}
    assert carving.stream_need(250, 100, 30) == 330


def test_chunks_of_a_document_used_many_times(spark):
    mixed = spark.createDataFrame([("a", e, 1, e * 4, 4) for e in range(200)], "source string, epoch int, doc_id long, start long, n_tok long")
    tokens = spark.createDataFrame([(1, [7, 8, 9, 0])], "doc_id long, ids array<int>")
    chunks = carving.shard_chunks(tokens, carving.carve(mixed, 10, 3)).orderBy("split", "shard_idx", "shard_pos").collect()
    stream = [t for _ in range(200) for t in (7, 8, 9, 0)]
    got = {}
    for c in chunks:
        got.setdefault((c["split"], c["shard_idx"]), []).extend(c["ids"])
    assert got[("val", 0)] == stream[:3]
    assert len(got) == 1 + (800 - 3) // 10
    assert all(got[("train", i)] == stream[3 + 10 * i: 13 + 10 * i] for i in range((800 - 3) // 10))


def test_unwritten_shards(spark):
    chunks = spark.createDataFrame([("train", i, 0, 5) for i in range(4)], "split string, shard_idx int, shard_pos long, n_tok int")
    left = carving.unwritten(chunks, chunks.where("shard_idx < 3"))
    assert [r["shard_idx"] for r in left.collect()] == [3]


def test_quality_and_length_rules(spark):
    docs = spark.createDataFrame(
        [(1, "x" * 51, 3.0, None, 3.0), (2, "x" * 50, 5.0, None, 3.0), (3, "x" * 60, 2.0, None, 3.0), (4, None, 5.0, None, 3.0),
         (5, "x" * 60, None, None, 3.0), (6, "x" * 60, 1.0, None, None), (7, " " * 51, None, 4.0, 3.0), (8, "é" * 51, None, 1.0, 3.0)],
        "doc_id long, text string, int_score double, score double, min_score double")
    kept = keep_documents(docs, scores=("int_score", "score"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 6, 7]


def test_mix_spec(spark, tmp_path):
    mixes = table_mixes()
    with pytest.raises(ValueError):
        choose_mix(mixes, "other")
    rows = {r["source"]: r for r in spec_frame(spark, mixes["train"]).collect()}
    assert abs(sum(r["share"] for r in rows.values()) - 1) < 1e-12 and rows["edu"]["min_score"] == 1 and rows["web"]["min_score"] is None
    raw = spark.createDataFrame([("src0", 1), ("src17", 2), ("nowhere", 3)], "source string, doc_id long")
    assert sorted((r["source"], r["doc_id"]) for r in with_mix_source(raw, mixes["train"]).collect()) == [("edu", 1), ("math", 2)]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, "t", 4)], "doc_id long, text string, int_score int").write.parquet(a)
    spark.createDataFrame([(2, "c")], "doc_id long, content string").write.parquet(b)
    mix = Mix((Source("x", 1, path=a, min_score=3), Source("y", 1, path=b, text_field="content")), 1, 0)
    assert sorted(tuple(r) for r in read_sources(spark, mix).collect()) == [("x", 1, "t", 4.0, 3.0), ("y", 2, "c", None, None)]


def test_shares_and_limits(spark):
    mixed = spark.createDataFrame([("a", 0, 1, 30), ("a", 1, 1, 30), ("b", 0, 2, 20)], "source string, epoch int, doc_id long, n_tok long")
    assert {r["source"]: (r["docs"], r["tokens"], r["share"]) for r in mixing.mix_shares(mixed).collect()} == {
        "a": (2, 60, 0.75), "b": (1, 20, 0.25)}
    assert {r["source"]: r["epochs"] for r in mixing.source_repeats(mixed).collect()} == {"a": 2, "b": 1}
    assert check_vocabulary(65536) == 65536
    with pytest.raises(ValueError):
        check_vocabulary(65537)
    pairs = spark.createDataFrame([(1, 10, 10), (2, 11, 10), (3, 10, 11)], "conv_id long, a int, b int")
    assert [r["conv_id"] for r in short_pairs(pairs, "a", "b", 10).collect()] == [1]
    union = mixing.union_sources([mixed.select("source"), mixed.select("source", "n_tok")])
    assert union.where(F.col("n_tok").isNull()).count() == 3


def test_running_shares_fill_gaps(spark):
    rows = [("train", 0, "a", 3), ("train", 0, "b", 1), ("train", 1, "b", 4), ("train", 2, "a", 2), ("val", 0, "b", 5), ("train", 0, "a", 1)]
    df = spark.createDataFrame(rows, "split string, shard_idx int, source string, n_tok int")
    got = {(r["split"], r["shard_idx"], r["source"]): (r["tokens"], r["upto"], round(r["share"], 4))
           for r in carving.running_shares(df, ["a", "b", "c"]).collect()}
    assert got == {
        ("train", 0, "a"): (4, 4, 0.8), ("train", 0, "b"): (1, 1, 0.2), ("train", 0, "c"): (0, 0, 0.0),
        ("train", 1, "a"): (0, 4, 0.4444), ("train", 1, "b"): (4, 5, 0.5556), ("train", 1, "c"): (0, 0, 0.0),
        ("train", 2, "a"): (2, 6, 0.5455), ("train", 2, "b"): (0, 5, 0.4545), ("train", 2, "c"): (0, 0, 0.0),
        ("val", 0, "a"): (0, 0, 0.0), ("val", 0, "b"): (5, 5, 1.0), ("val", 0, "c"): (0, 0, 0.0)}


def test_sources_of_unlike_schemas(spark, tmp_path):
    """Nested fields, missing and several scores, ids of other types; a missing field is named."""
    spark.createDataFrame([(1, "aa", 3, 0.5), (2, "bb", None, 0.25)], "doc_id int, text string, int_score int, score double").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([((7, ("cc",)),)], "blob struct<id:long,file:struct<body:string>>").write.parquet(str(tmp_path / "b"))
    own = mixes.Mix((mixes.Source("a", 1.0, path=str(tmp_path / "a"), min_score=2),
                     mixes.Source("b", 1.0, path=str(tmp_path / "b"), text_field="blob.file.body", id_field="blob.id")), 1, 0)
    rows = mixes.read_sources(spark, own)
    assert dict(rows.dtypes)["doc_id"] == "bigint"
    assert sorted(map(tuple, rows.collect()), key=str) == [("a", 1, "aa", 3.0, 2.0), ("a", 2, "bb", None, 2.0), ("b", 7, "cc", None, None)]
    spark.createDataFrame([("x9", "dd")], "doc_id string, text string").write.parquet(str(tmp_path / "c"))
    three = mixes.Mix((*own.sources, mixes.Source("c", 1.0, path=str(tmp_path / "c"))), 1, 0)
    assert sorted(r["doc_id"] for r in mixes.read_sources(spark, three).collect()) == ["1", "2", "7", "x9"]
    with pytest.raises(ValueError, match="lacks 'content'"):
        mixes.read_sources(spark, mixes.Mix((mixes.Source("c", 1.0, path=str(tmp_path / "c"), text_field="content"),), 1, 0))
