"""Queries over logs and scores: losses, runs, throughput, leaderboard.

Logged values are derived from the ``events`` and ``lineitem`` tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import models
from tokenloom.operators import losses, lookup, prefs, runs, scores
from tokenloom.plans.registry import artifact, query, rounded, table
from tokenloom.plans.sqltext import case, cte, sql
from tokenloom.session import stage, staging_path
from tokenloom.sources import runlogs, scorefiles

Z_COEF = 1e-4
TOKENS_PER_STEP, SEQ_LEN = 131_072, 1024

# -- losses: one logged token per line item --------------------------------

def logged_token() -> tuple[Column, Column, Column]:
    """(log-sum-exp, target logit, mask) of a line item."""
    return F.col("l_extendedprice") / 10000.0, F.col("l_quantity") / 10.0, (F.col("l_returnflag") != "R").cast("int")


cte("token_log", "select l_orderkey // 100 as batch, l_orderkey, l_linenumber, l_extendedprice / 10000.0::DOUBLE as lse, "
    "l_quantity / 10.0::DOUBLE as target, (case when l_returnflag <> 'R' then 1 else 0 end)::DOUBLE as m from lineitem")
cte("batch_ce", "select batch, sum(m)::BIGINT as counted, sum((lse - target) * m) / greatest(sum(m), 1.0::DOUBLE) as ce, "
    "sum(lse * lse * m) / greatest(sum(m), 1.0::DOUBLE) as z from token_log group by batch", "token_log")


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("batch", F.floor(F.col("l_orderkey") / 100).cast("long"))
    return losses.token_loss(items, ["batch"], *logged_token(), Z_COEF)


@query("token_loss", sql(
    f"select batch, counted, round(ce, 6) as ce, round(z, 6) as z, round(ce + {Z_COEF}::DOUBLE * z, 6) as loss from batch_ce",
    "batch_ce"))
def token_loss(spark, sf_dir):
    found = batch_losses(spark, sf_dir)
    return found.select("batch", "counted", *[rounded(F.col(c)).alias(c) for c in ("ce", "z", "loss")])


@query("validation_loss", sql(
    "select count(*)::BIGINT as batches, round(avg(ce), 6) as val_loss, round(exp(avg(ce)), 6) as perplexity from batch_ce",
    "batch_ce"))
def validation_loss(spark, sf_dir):
    found = losses.validation_loss(batch_losses(spark, sf_dir))
    return found.select("batches", rounded(F.col("val_loss")).alias("val_loss"),
                        rounded(F.col("perplexity")).alias("perplexity"))


@query("sequence_logprobs", sql(
    "select l_orderkey as seq, round(sum((target - lse) * m), 6) as logprob from token_log where l_linenumber >= 1 "
    "group by l_orderkey", "token_log"))
def sequence_logprobs(spark, sf_dir):
    lse, target, counted = logged_token()
    found = prefs.sequence_logprobs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", target - lse, counted)
    return found.select(F.col("l_orderkey").alias("seq"), rounded(F.col("logprob")).alias("logprob"))


# -- run logs: one line per event, twenty runs -------------------------------
# Steps come again in later sessions, as when a resumed run repeats them.

cte("run_log", "select 'run-' || (user_id % 20) as run, ((event_id // 97) % 4)::INT as session, event_id as line, "
    "(event_id % 997)::INT as step, case when event_type in ('signup', 'purchase') then 'val' else 'train' end as split, "
    "value as loss, value / 1000.0::DOUBLE as lr, case when event_type in ('signup', 'purchase') then null else value / 2.0::DOUBLE "
    "end as gnorm, case when event_type in ('signup', 'purchase') then null else event_id % 5000 end as tok_s from events")
cte("latest_lines", "select * from run_log qualify row_number() over (partition by run, split, step "
    "order by session desc, line desc) = 1", "run_log", materialized=True)


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = F.col("event_type").isin("signup", "purchase")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.col("user_id") % 20).alias("run"),
        (F.floor(F.col("event_id") / 97) % 4).cast("int").alias("session"),
        F.col("event_id").alias("line"), (F.col("event_id") % 997).cast("int").alias("step"),
        F.when(val, "val").otherwise("train").alias("split"), F.col("value").alias("loss"),
        (F.col("value") / 1000.0).alias("lr"),
        F.when(~val, F.col("value") / 2.0).alias("gnorm"),
        F.when(~val, F.col("event_id") % 5000).cast("long").alias("tok_s"),
    )


@artifact
def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest line per run, split and step, after a trip through the log files."""
    path = staging_path(spark, "runlogs")
    runlogs.append_log(run_lines(spark, sf_dir), path)
    return stage(runs.latest_lines(runlogs.read_logs(spark, path)), "latest")


cte("appended_lines", "select * from run_log qualify row_number() over (partition by run, split, step "
    "order by session desc, line % 2 desc, line desc) = 1", "run_log")


@query("run_log_appended", sql("select run, split, step, loss, lr, gnorm, tok_s from appended_lines", "appended_lines"))
def run_log_appended(spark, sf_dir):
    """Two appends to the same sessions; what is appended later comes later."""
    path = staging_path(spark, "appended")
    for part in (0, 1):
        runlogs.append_log(run_lines(spark, sf_dir).where(F.col("line") % 2 == part), path)
    return runs.latest_lines(runlogs.read_logs(spark, path)).select("run", "split", "step", "loss", "lr", "gnorm", "tok_s")


@query("run_log_plain", sql("select run, split, step, loss, lr, gnorm, tok_s from latest_lines", "latest_lines"))
def run_log_plain(spark, sf_dir):
    """The logs as one plain file per run."""
    path = staging_path(spark, "plainlogs")
    runlogs.write_plain_logs(run_lines(spark, sf_dir), path).count()
    return runs.latest_lines(runlogs.read_plain_logs(spark, path)).select("run", "split", "step", "loss", "lr", "gnorm", "tok_s")


@query("run_log_latest", sql("select run, split, step, loss, lr, gnorm, tok_s from latest_lines", "latest_lines"))
def run_log_latest(spark, sf_dir):
    return logged(spark, sf_dir).select("run", "split", "step", "loss", "lr", "gnorm", "tok_s")


@query("loss_curves", sql("select run, step, loss from latest_lines where split = 'val'", "latest_lines"))
def loss_curves(spark, sf_dir):
    return runs.loss_curve(logged(spark, sf_dir), "val")


@query("run_log_compare", sql(
    "select run, max(step) as last_step, count(*) filter (where split = 'val')::BIGINT as val_points, "
    "max_by(loss, step) filter (where split = 'val') as final_val_loss, min(loss) filter (where split = 'val') as best_val_loss, "
    "max_by(loss, step) filter (where split = 'train') as final_train_loss from latest_lines group by run", "latest_lines"))
def run_log_compare(spark, sf_dir):
    return runs.compare_runs(logged(spark, sf_dir))


# -- model size and throughput: a configuration per part ---------------------

_CONFIG = {
    "vocab": "32768", "d_model": "64 * (1 + p_size)", "n_layers": "2 + p_partkey % 30", "n_heads": "4 * (1 + p_partkey % 4)",
    "n_kv_heads": "4", "head_dim": "64", "ffn_dim": "128 * (1 + p_size)",
}
cte("configs", "select p_partkey, " + ", ".join(f"({v})::BIGINT as {k}" for k, v in _CONFIG.items()) + " from part")
cte("sizes", "select *, vocab * d_model + n_layers * (2 * d_model * head_dim * (n_heads + n_kv_heads) + 2 * head_dim + "
    f"3 * d_model * ffn_dim + 2 * d_model) + d_model as params from configs", "configs")
cte("flops", f"select *, 6 * params + 12 * n_layers * n_heads * head_dim * {SEQ_LEN} as flops from sizes", "sizes")


def model_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", *[F.expr(f"CAST({v} AS BIGINT)").alias(k) for k, v in _CONFIG.items()])


@query("param_counts", sql("select p_partkey, params, flops from flops", "flops"))
def param_counts(spark, sf_dir):
    return model_configs(spark, sf_dir).select(
        "p_partkey", models.parameter_count().alias("params"), models.flops_per_token(SEQ_LEN).alias("flops"))


def _device(names: list[str]) -> Column:
    return F.element_at(F.lit(names), (F.col("event_id") % len(names) + 1).cast("int"))


def _device_sql(names: list[str]) -> str:
    return case(f"(event_id % {len(names)})::VARCHAR", {i: f"'{n}'" for i, n in enumerate(names)})


_GPUS = ["NVIDIA GeForce RTX 4060 Ti", "Tesla T4", "Tesla P100-PCIE-16GB", "NVIDIA L4", "NVIDIA A100-SXM4-80GB",
         "NVIDIA H100 PCIe", "cpu"]
_TPUS = ["TPU v3", "TPU v4", "TPU v5 lite", "TPU v5e-8", "TPU v5p", "TPU v6 lite", "old TPU v4", "cpu"]


def _peak_sql(peaks: dict[str, float], prefix: bool) -> str:
    test = "starts_with(device, '{}')" if prefix else "contains(device, '{}')"
    return "case " + " ".join(f"when {test.format(k)} then {v!r}::DOUBLE" for k, v in peaks.items()) + " end"


def _throughput_sql(names: list[str], peaks: dict[str, float], prefix: bool) -> str:
    return sql(
        "select event_id, device, tok_s, round(mfu, 9) as mfu from (select event_id, device, "
        f"floor({TOKENS_PER_STEP} / dt)::BIGINT as tok_s, flops * {TOKENS_PER_STEP} / dt / ({_peak_sql(peaks, prefix)} * 1e12::DOUBLE * 2) "
        f"as mfu from (select event_id, {_device_sql(names)} as device, value as dt, event_id % (select count(*) from part) "
        "as p_partkey from events where value > 0) join flops using (p_partkey))", "flops")


def _throughput(spark: SparkSession, sf_dir: str, names: list[str], peak) -> DataFrame:
    parts = table(spark, sf_dir, "part").count()
    steps = table(spark, sf_dir, "events").where(F.col("value") > 0).select(
        "event_id", _device(names).alias("device"), F.col("value").alias("seconds"),
        (F.col("event_id") % parts).alias("p_partkey"))
    work = model_configs(spark, sf_dir).select("p_partkey", models.flops_per_token(SEQ_LEN).alias("flops"))
    found = runs.throughput(steps.join(work, "p_partkey"), TOKENS_PER_STEP, F.col("flops"), peak(F.col("device")), devices=2)
    return found.select("event_id", "device", "tok_s", rounded(F.col("mfu"), 9).alias("mfu"))


@query("throughput_mfu", _throughput_sql(_GPUS, models.GPU_PEAKS, False))
def throughput_mfu(spark, sf_dir):
    """Peak by substring of the device name; a step per event."""
    return _throughput(spark, sf_dir, _GPUS, models.gpu_peak)


@query("throughput_mfu_tpu", _throughput_sql(_TPUS, models.TPU_PEAKS, True))
def throughput_mfu_tpu(spark, sf_dir):
    """Peak by prefix of the device kind."""
    return _throughput(spark, sf_dir, _TPUS, models.tpu_peak)


def _lookup_sql(form: str, names: list[str], peaks: dict[str, float], prefix: bool) -> str:
    return f"select event_id, '{form}' as form, device, {_peak_sql(peaks, prefix)} as peak from (select event_id, {_device_sql(names)} as device from events)"


@query("throughput_lookup", " union all ".join(
    [_lookup_sql("substring", _GPUS, models.GPU_PEAKS, False), _lookup_sql("prefix", _TPUS, models.TPU_PEAKS, True)]))
def throughput_lookup(spark, sf_dir):
    """Peaks as tables, found by equi-joins on the parts of the device names."""
    events, found = table(spark, sf_dir, "events").select("event_id"), []
    for form, names, peaks in (("substring", _GPUS, models.GPU_PEAKS), ("prefix", _TPUS, models.TPU_PEAKS)):
        entries = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(peaks.items())], "ord int, key string, peak double")
        found.append(lookup.first_match(events.select("event_id", F.lit(form).alias("form"), _device(names).alias("device")),
                                        "device", entries, prefix=form == "prefix"))
    return found[0].unionByName(found[1])


# -- scores: a model per user, a raw metric per event -------------------------

TASKS = list(scores.TASKS)
_METRICS = {"click": "acc", "view": "acc_norm", "signup": "acc", "purchase": "acc_norm", "error": "perplexity"}

cte("raw_metrics", "select label, task, metric, max_by(value, event_id) as value from (select event_id, 'model-' || user_id as label, "
    f"{case('(event_id % 10)::VARCHAR', {i: f'{chr(39)}{t}{chr(39)}' for i, t in enumerate(TASKS)}, chr(39) + 'other' + chr(39))} as task, "
    f"{case('event_type', {k: f'{chr(39)}{v}{chr(39)}' for k, v in _METRICS.items()})} as metric, "
    "((value * 100)::BIGINT % 10000) / 10000.0::DOUBLE as value from events) group by label, task, metric")
cte("task_scores", "select label, task, round(score, 4) as score from (select label, task, coalesce(max(value) filter (where metric = "
    f"{case('task', {t: f'{chr(39)}{m}{chr(39)}' for t, m in scores.TASKS.items()})}), max(value) filter (where metric = 'acc')) as score "
    "from raw_metrics where task <> 'other' group by label, task) where score is not null", "raw_metrics", materialized=True)


def raw_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.lit([*TASKS, "other"])
    metric = None
    for kind, name in _METRICS.items():
        hit = F.col("event_type") == kind
        metric = F.when(hit, name) if metric is None else metric.when(hit, name)
    cents = F.round(F.col("value") * 100).cast("long")
    found = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("model-"), F.col("user_id")).alias("label"),
        F.element_at(names, (F.col("event_id") % 10 + 1).cast("int")).alias("task"), metric.alias("metric"),
        ((cents % 10000) / 10000.0).alias("value"))
    return found.groupBy("label", "task", "metric").agg(F.max_by("value", "event_id").alias("value"))


@query("score_select", sql("select label, task, score from task_scores", "task_scores"))
def score_select(spark, sf_dir):
    return scores.select_scores(raw_metrics(spark, sf_dir))


_PIVOT = ", ".join(f"max(score) filter (where task = '{t}') as {t}" for t in TASKS)
_CELL = "coalesce(printf('%.1f', 100 * {}), '–')"


cte("board", f"select *, '| ' || label || ' | ' || "
    + " || ' | ' || ".join(_CELL.format(t) for t in TASKS)
    + " || ' | **' || printf('%.1f', 100 * mean_score) || '** |' as line from (select *, ("
    + " + ".join(f"coalesce({t}, 0.0::DOUBLE)" for t in TASKS) + ") / ("
    + " + ".join(f"({t} is not null)::INT" for t in TASKS) + f") as mean_score from (select label, {_PIVOT} from task_scores group by label))",
    "task_scores")


@query("leaderboard", sql(
    f"select label, {', '.join(TASKS)}, round(mean_score, 9) as mean_score, line from board", "board"))
def leaderboard(spark, sf_dir):
    """Scores through their files, then the table of all models, best first."""
    path = staging_path(spark, "scores")
    chosen = scores.select_scores(raw_metrics(spark, sf_dir))
    paths = chosen.select("label").distinct().withColumn("path", F.concat(F.lit("exports/"), "label"))
    scorefiles.write_scores(scorefiles.score_rows(chosen, paths), path)
    board = scores.leaderboard(scores.score_matrix(scorefiles.read_scores(spark, path)))
    return board.withColumn("mean_score", rounded(F.col("mean_score"), 9))


def _again(label) -> Column:
    """Models with an even number are scored a second time."""
    return F.regexp_extract(label, r"(\d+)$", 1).cast("long") % 2 == 0


@query("leaderboard_rescored", sql(
    "select label, task, case when regexp_extract(label, '([0-9]+)$', 1)::BIGINT % 2 = 0 then round(1.0::DOUBLE - score, 4) "
    "else score end as score from task_scores", "task_scores"))
def leaderboard_rescored(spark, sf_dir):
    """Half of the models are scored again, worse or better; only the newer scores count."""
    path = staging_path(spark, "rescored")
    chosen = stage(scores.select_scores(raw_metrics(spark, sf_dir)), "chosen")
    paths = chosen.select("label").distinct().withColumn("path", F.concat(F.lit("exports/"), "label"))
    scorefiles.write_scores(scorefiles.score_rows(chosen, paths), path)
    anew = chosen.where(_again("label")).withColumn("score", F.round(F.lit(1.0) - F.col("score"), 4))
    scorefiles.write_scores(scorefiles.score_rows(anew, paths.where(_again("label"))), path)
    return scorefiles.read_scores(spark, path)


@query("leaderboard_markdown", sql(
    f"select line as value from board union all select '| {scores.LABEL_HEAD} | {' | '.join(TASKS)} | {scores.MEAN_HEAD} |' union all "
    f"select '|---|{'---|' * (len(TASKS) + 1)}'", "board"))
def leaderboard_markdown(spark, sf_dir):
    """The Markdown file of the leaderboard, read back as lines."""
    path = staging_path(spark, "markdown")
    scorefiles.write_markdown(scores.select_scores(raw_metrics(spark, sf_dir)), TASKS, path)
    return spark.read.text(path)


_BASE = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(scores.BASELINES.items()))


@query("skip_scored", sql(
    "select label, path from (select label, path, row_number() over (partition by label order by p desc, ord desc) as r from "
    "(select split_part(pair, '=', 1) as label, substr(pair, strpos(pair, '=') + 1) as path, 0 as p, ord from "
    "(select case when c_custkey % 50 = 0 then 'gpt2-124M' else 'model-' || c_custkey end || '=exports/a=' || c_nationkey as pair, "
    f"c_custkey as ord from customer) union all select l, x, 1, o from (values {_BASE}) b(l, x, o))) where r = 1 "
    "and label not in (select label from task_scores)", "task_scores"))
def skip_scored(spark, sf_dir):
    """Models to evaluate: a pair per customer and the baselines, less those with scores."""
    label = F.when(F.col("c_custkey") % 50 == 0, F.lit("gpt2-124M")).otherwise(F.concat(F.lit("model-"), F.col("c_custkey")))
    pairs = table(spark, sf_dir, "customer").select(
        F.concat(label, F.lit("=exports/a="), F.col("c_nationkey")).alias("pair"), F.col("c_custkey").alias("ord"))
    return scores.left_to_score(scores.model_list(pairs), scores.select_scores(raw_metrics(spark, sf_dir)))
