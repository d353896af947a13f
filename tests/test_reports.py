import random
import math

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import models
from tokenloom.operators import lookup, losses, prefs, runs, scores, stepplan
from tokenloom.sources import manifest, runlogs, scorefiles


def test_preference_metrics_golden(spark):
    rows = [(0, 0, -10.0, -12.0, -20.0, -15.0), (0, 1, -1.0, -1.0, -1.0, -1.0), (0, 1, -2.0, -1.0, -1.0, -1.0),
            (1, 0, 1e6, 0.0, 0.0, 0.0), (1, 0, -1e6, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "step long, micro int, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    got = {r["step"]: r for r in prefs.preference_metrics(df).collect()}

    def nls(z):
        return math.log1p(math.exp(-z))

    assert got[0]["loss"] == pytest.approx((nls(0.7) + (nls(0) + nls(-0.1)) / 2) / 2)
    assert got[0]["acc"] == 0.5 and got[0]["margin"] == pytest.approx((0.7 + (0 - 0.1) / 2) / 2)
    assert got[1]["loss"] == pytest.approx(5e4) and got[1]["pairs"] == 2


def test_pairs_collate_and_plan(spark):
    turns = [(1, 0, "user", 3), (1, 1, "assistant", 4), (1, 2, "user", 5), (2, 0, "user", 2), (3, 0, "system", 1), (3, 1, "user", 2),
             (3, 2, "assistant", 9), (3, 3, "assistant", 1), (7, 0, "assistant", 6)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, n long").withColumn(
        "ids", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: (F.col("conv_id") * 1000 + F.col("turn") * 100 + i).cast("int"))
    ).withColumn("mask", F.transform("ids", lambda i: F.lit(1)))
    from tokenloom.operators.chat import turn_offsets
    offsets = turn_offsets(df.select("conv_id", "turn", "role", "ids", "mask"))
    pairs = prefs.pair_lengths(prefs.reply_pairs(df), offsets)
    found = {r["conv_id"]: (r["other_id"], r["chosen_len"], r["rejected_len"]) for r in pairs.collect()}
    assert found == {1: (3, 7, 12), 3: (7, 12, 9), 7: (1, 6, 4)}
    planned = stepplan.preference_plan(
        pairs.withColumn("place", F.expr("CASE conv_id WHEN 3 THEN 0 WHEN 7 THEN 1 ELSE 2 END")), 3, 2, 1)
    assert {r["conv_id"]: (r["step"], r["micro"]) for r in planned.collect()} == {3: (0, 0), 7: (0, 1)}
    rows = {(r["conv_id"], r["side"]): r for r in prefs.collate(planned, prefs.pair_tokens(planned, offsets)).collect()}
    assert rows[3, 0]["slot"] == 0 and rows[3, 1]["slot"] == 1 and rows[3, 0]["width"] == 12
    assert rows[3, 1]["ids"] == [3001, 3101, 3102, 7001, 7002, 7003, 7004, 7005, 7006, 3, 3, 3]
    assert rows[3, 1]["mask"] == [1] * 9 + [0] * 3
    assert rows[7, 1]["ids"] == [1101, 1102, 1103, 1104, 3, 3] and rows[7, 0]["width"] == 6


def test_sequence_logprobs(spark):
    df = spark.createDataFrame([(1, 0, -5.0, 1), (1, 1, -1.0, 1), (1, 2, -2.0, 0), (1, 3, -4.0, 1)], "s int, p int, lp double, m int")
    assert prefs.sequence_logprobs(df, "s", "p", F.col("lp"), F.col("m")).first()["logprob"] == -5.0


def test_token_loss_groups_add_up(spark):
    rows = [(i % 4, 3.0 + i / 10, 1.0, int(i % 3 > 0)) for i in range(40)] + [(9, 5.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "g int, lse double, t double, m int")
    args = (F.col("lse"), F.col("t"), F.col("m"), 0.5)
    per = {r["g"]: r for r in losses.token_loss(df, ["g"], *args).collect()}
    whole = losses.token_loss(df, [], *args).first()
    assert per[9]["ce"] == 0 and per[9]["loss"] == 0
    assert whole["ce"] == pytest.approx(sum(r["ce"] * r["counted"] for r in per.values()) / whole["counted"])
    assert whole["loss"] == pytest.approx(whole["ce"] + 0.5 * whole["z"])
    val = losses.validation_loss(spark.createDataFrame([(1.0,), (3.0,)], "ce double")).first()
    assert val["val_loss"] == 2 and val["perplexity"] == pytest.approx(math.exp(2))


CONFIGS = [("tiny", 32768, 384, 6, 6, 2, 64, 1024, 22025856), ("small", 32768, 768, 12, 12, 4, 64, 2048, 100684032),
           ("main", 32768, 1024, 24, 16, 4, 64, 3072, 323014656)]


def test_parameter_counts(spark):
    df = spark.createDataFrame(CONFIGS, "name string, vocab int, d_model int, n_layers int, n_heads int, n_kv_heads int, head_dim int, ffn_dim int, want long")
    for r in df.select("*", models.parameter_count().alias("n"), models.parameter_count(False).alias("u"),
                       models.flops_per_token(2048).alias("f")).collect():
        assert r["n"] == r["want"] and r["u"] == r["want"] + r["vocab"] * r["d_model"]
        assert r["f"] == 6 * r["want"] + 12 * r["n_layers"] * r["n_heads"] * r["head_dim"] * 2048


def test_device_peaks(spark):
    names = ["NVIDIA GeForce RTX 4060 Ti", "Tesla T4", "NVIDIA L40", "cpu", "TPU v5 lite", "old TPU v4"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, d string")
    rows = [(r["g"], r["t"]) for r in df.select("i", models.gpu_peak(F.col("d")).alias("g"), models.tpu_peak(F.col("d")).alias("t")).orderBy("i").collect()]
    assert rows == [(44.0, None), (65.0, None), (121.0, None), (None, None), (None, 197.0), (None, None)]
    steps = spark.createDataFrame([("Tesla T4", 2.0), ("cpu", 2.0)], "d string, seconds double")
    got = {r["d"]: r for r in runs.throughput(steps, 1000, F.lit(6e9), models.gpu_peak(F.col("d")), 2).collect()}
    assert got["cpu"]["mfu"] is None and got["cpu"]["tok_s"] == 500
    assert got["Tesla T4"]["mfu"] == pytest.approx(6e9 * 1000 / 2 / (65e12 * 2))


def test_run_logs(spark, tmp_path):
    path = str(tmp_path / "logs")
    cols = "session int, run string, line long, step int, split string, loss double, lr double, gnorm double, tok_s long"
    first = [(0, "a", i, i, "train", 5.0 - i, 0.1, 1.5, 100) for i in range(5)] + [(0, "a", 9, 4, "val", 2.0, 0.1, None, None)]
    again = [(1, "a", i, 3 + i, "train", 1.0 - i, 0.1, 1.5, 100) for i in range(2)] + [(1, "a", 5, 4, "val", 1.5, 0.1, None, None)]
    other = [(0, "b", 0, 1, "train", 7.0, 0.1, 1.0, 50)]
    runlogs.append_log(spark.createDataFrame(first + other, cols), path)
    runlogs.append_log(spark.createDataFrame(again, cols), path)
    log = runs.latest_lines(runlogs.read_logs(spark, path))
    curve = [(r["step"], r["loss"]) for r in runs.loss_curve(log, "train").where("run = 'a'").collect()]
    assert curve == [(0, 5.0), (1, 4.0), (2, 3.0), (3, 1.0), (4, 0.0)]
    val = log.where("split = 'val'").first()
    assert val["loss"] == 1.5 and val["gnorm"] is None and val["tok_s"] is None
    got = {r["run"]: r for r in runs.compare_runs(log).collect()}
    assert got["a"]["final_val_loss"] == 1.5 and got["a"]["final_train_loss"] == 0.0 and got["b"]["final_val_loss"] is None


RAW = [("m1", "piqa", "acc_norm", 0.51234), ("m1", "piqa", "acc", 0.4), ("m1", "winogrande", "acc_norm", 0.9),
       ("m1", "winogrande", "acc", 0.6), ("m2", "piqa", "acc", 0.3), ("m2", "sciq", "perplexity", 3.0),
       ("m3", "piqa", "acc_norm", 0.3), ("m4", "unknown", "acc", 0.9)]


def test_scores_and_leaderboard(spark, tmp_path):
    raw = spark.createDataFrame(RAW, "label string, task string, metric string, value double")
    chosen = scores.select_scores(raw)
    assert {(r["label"], r["task"]): r["score"] for r in chosen.collect()} == {
        ("m1", "piqa"): 0.5123, ("m1", "winogrande"): 0.6, ("m2", "piqa"): 0.3, ("m3", "piqa"): 0.3}
    tasks = ["piqa", "winogrande"]
    paths = spark.createDataFrame([("m1", "p1"), ("m2", "p2"), ("m3", "p3")], "label string, path string")
    for folders in (False, True):
        target = str(tmp_path / f"scores{folders}")
        scorefiles.write_scores(scorefiles.score_rows(chosen, paths), target, folders)
        back = scorefiles.read_scores(spark, target)
        board = scores.leaderboard(scores.score_matrix(back, tasks), tasks).collect()
        assert [r["line"] for r in board] == ["| m1 | 51.2 | 60.0 | **55.6** |", "| m2 | 30.0 | – | **30.0** |",
                                              "| m3 | 30.0 | – | **30.0** |"]
        assert {r["label"] for r in scorefiles.scored_labels(spark, target).collect()} == {"m1", "m2", "m3"}
    scorefiles.write_markdown(chosen, tasks, str(tmp_path / "md"))
    lines = [line for f in sorted((tmp_path / "md").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[:3] == ["| Modèle | piqa | winogrande | Moyenne |", "|---|---|---|---|", "| m1 | 51.2 | 60.0 | **55.6** |"] and len(lines) == 5


def test_one_decimal_equals_exact_formatting(spark):
    values = [i / 10000 * 100 for i in range(0, 10001)] + [0.05, 0.25, 12.35, 99.95, 0.0]
    df = spark.createDataFrame(list(enumerate(map(float, values))), "i int, x double")
    for r in df.select("x", scores.one_decimal(F.col("x")).alias("t")).collect():
        assert r["t"] == f"{r['x']:.1f}", r["x"]


def test_models_left_to_score(spark):
    pairs = spark.createDataFrame([("a=x=y", 0), ("gpt2-124M=mine", 1), ("b=1", 2), ("b=2", 3)], "pair string, ord int")
    models_ = scores.model_list(pairs)
    found = {r["label"]: r["path"] for r in models_.collect()}
    assert found["a"] == "x=y" and found["b"] == "2" and found["gpt2-124M"] == "openai-community/gpt2" and len(found) == 6
    assert scores.model_list(pairs, None).count() == 3
    done = spark.createDataFrame([("a",), ("b",)], "label string")
    assert scores.left_to_score(models_, done).count() == 4 and scores.left_to_score(models_, done, force=True).count() == 6


def test_manifest_latest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    mixed = spark.createDataFrame([("a", 10), ("b", 5)], "source string, n_tok long")
    for done in (1, 3):
        stats = spark.createDataFrame([("train", i, 100) for i in range(done)] + [("val", 0, 30)], "split string, shard_idx int, tokens long")
        manifest.append(manifest.progress(stats, mixed, "train"), path)
    last = manifest.latest(spark, path).first()
    assert (last["written"], last["shard_idx"], last["val_done"], last["tokens_by_source"]) == (300, 3, True, {"a": 10, "b": 5})


@pytest.mark.parametrize("prefix", [True, False])
def test_first_match_of_any_table(spark, prefix):
    """The first entry in order counts, whatever it is as long as it matches."""
    draw = random.Random(5)
    keys = list({"".join(draw.choices("abc", k=draw.randint(1, 4))) for _ in range(60)}) + ["zz"]
    entries = [(i % 20, k, float(i), f"v{i}") for i, k in enumerate(keys)]
    names = ["".join(draw.choices("abcd", k=draw.randint(0, 9))) for _ in range(80)] + [None, "", "zzz", "dzz"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(0, names[0])], "i int, name string")
    table = spark.createDataFrame(entries, "ord int, key string, peak double, label string")
    got = lookup.first_match(rows, "name", table, prefix=prefix).collect()
    assert len(got) == len(names) + 1
    for r in got:
        fits = [(o, k, p, v) for o, k, p, v in entries if r["name"] is not None and (r["name"].startswith(k) if prefix else k in r["name"])]
        assert (r["peak"], r["label"]) == (min(fits)[2:] if fits else (None, None))
