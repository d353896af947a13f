"""Score files, run logs and mix specifications as users have them."""

import json

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import mixing, packing
from tokenloom.session import file_system, qualified
from tokenloom.sources import mixes, runlogs, scorefiles

SCORES = "label string, task string, score double"


@pytest.mark.parametrize("folders", [False, True])
def test_a_new_score_replaces_the_old(spark, tmp_path, folders):
    path = str(tmp_path / "scores")
    models = spark.createDataFrame([("a", "p"), ("b", "q")], "label string, path string")
    for rows in ([("a", "t", 0.9), ("b", "t", 0.5)], [("a", "t", 0.1), ("a", "u", 0.2)]):
        found = spark.createDataFrame(rows, SCORES)
        own = models.join(found.select("label").distinct(), "label")
        scorefiles.write_scores(scorefiles.score_rows(found, own), path, folders=folders)
    got = sorted(tuple(r) for r in scorefiles.read_scores(spark, path).select("label", "task", "score").collect())
    assert got == [("a", "t", 0.1), ("a", "u", 0.2), ("b", "t", 0.5)]


def test_score_files_named_by_label(spark, tmp_path):
    (tmp_path / "my-model.json").write_text(json.dumps({"path": "p", "limit": None, "scores": {"t": 0.25}}, indent=1))
    (tmp_path / "other 2.json").write_text(json.dumps({"path": "p", "scores": {"t": 0.5, "u": 1.0}}))
    got = sorted(tuple(r) for r in scorefiles.read_label_files(spark, str(tmp_path)).collect())
    assert got == [("my-model", "t", 0.25), ("other 2", "t", 0.5), ("other 2", "u", 1.0)]


LINES = "session int, run string, line int, step int, split string, loss double, lr double, gnorm double, tok_s long"


def test_later_appends_come_later(spark, tmp_path):
    path = str(tmp_path / "logs")
    for loss in (5.0, 4.0, 3.0):
        runlogs.append_log(spark.createDataFrame(
            [(0, "r", i, 7, "val", loss + i / 10, 0.1, None, None) for i in range(20)], LINES).repartition(4), path)
    rows = runlogs.read_logs(spark, path).orderBy("line").select("loss").collect()
    assert [r[0] for r in rows] == [round(a + i / 10, 5) for a in (5.0, 4.0, 3.0) for i in range(20)]


def test_plain_logs(spark, tmp_path):
    (tmp_path / "tiny run").mkdir()
    (tmp_path / "tiny run" / "log.csv").write_text("1,train,2.5,0.001,0.5,100\n1,val,2.25,0.001,,\n")
    written = runlogs.write_plain_logs(spark.createDataFrame(
        [(s, "b+c 1%", i, i, "train", 1.0 * s + i, 0.1, 0.5, 9) for s in (1, 0) for i in range(3)], LINES), str(tmp_path))
    assert [r[0] for r in written.collect()] == ["b+c 1%"]
    rows = runlogs.read_plain_logs(spark, str(tmp_path)).orderBy("run", "line").collect()
    assert [(r["run"], r["loss"], r["tok_s"]) for r in rows] == [
        *[("b+c 1%", float(v), 9) for v in (0, 1, 2, 1, 2, 3)], ("tiny run", 2.5, 100), ("tiny run", 2.25, None)]


def test_mix_specification(spark, tmp_path):
    made = mixes.table_mixes()
    path = str(tmp_path / "spec")
    mixes.write_spec(spark, made, path)
    assert mixes.read_spec(spark, path) == made
    own = mixes.parse_spec(json.dumps({"shard_tokens": 5, "val_tokens": 2, "mixes": {
        "train": [{"name": "a", "weight": 3, "path": "x", "text_field": "content", "min_score": 3}],
        "anneal": [{"name": "b", "weight": 1}]}}))
    assert own["train"].val_tokens == 2 and own["anneal"].val_tokens == 0
    assert own["train"].sources[0] == mixes.Source("a", 3.0, (), "x", "content", 3)
    with pytest.raises(ValueError):
        mixes.parse_spec(json.dumps({"shard_tokens": 1, "mixes": {"train": [{"name": "a", "weight": 1, "wieght": 2}]}}))


def test_yaml_specification():
    pytest.importorskip("yaml")
    own = mixes.parse_spec("shard_tokens: 10\nval_tokens: 1\nmixes:\n  train:\n    - {name: a, weight: 0.5}\n    - {name: b, weight: 0.5}\n")
    assert own["train"].shares == {"a": 0.5, "b": 0.5} and own["train"].shard_tokens == 10


def test_a_barely_used_source_is_not_copied(spark):
    big = spark.range(20_000).select(F.lit("big").alias("source"), F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("n_tok"))
    small = spark.range(100).select(F.lit("small").alias("source"), (F.col("id") + 100_000).alias("doc_id"), F.lit(10).cast("long").alias("n_tok"))
    mix = mixes.Mix((mixes.Source("big", 0.01), mixes.Source("small", 0.99)), 100, 0)
    found = mixing.token_deficit_mix(big.unionByName(small), mix, need=10_000, per_batch=4)
    plan = found._jdf.queryExecution()
    assert found.where("source = 'big'").count() < 30
    rows = found.where("source = 'small'").groupBy().agg(F.max("epoch"), F.count(F.lit(1))).first()
    assert rows[0] == 9 and 950 < rows[1] < 1010 and plan is not None


def test_paths_get_the_scheme_spark_gives_them(spark, tmp_path):
    uri = qualified(spark, str(tmp_path))
    assert uri.startswith("file:") and file_system(uri)[1] == str(tmp_path)
    with pytest.raises(ValueError, match="no scheme"):
        file_system(str(tmp_path))


def test_packing_chains_by_doubling():
    import numpy as np

    step = np.array([2, 2, 5, 4, 6, 9, 9])
    assert packing._chain_from(step, 0).tolist() == [0, 2, 5]
    assert packing._chain_from(step, 7).tolist() == []
    last, hops = packing._hops(step)
    assert last.tolist() == [5, 5, 5, 6, 6, 5, 6] and hops.tolist() == [2, 2, 1, 2, 1, 0, 0]
