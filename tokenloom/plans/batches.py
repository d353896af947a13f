"""Queries over shards, sequences and the step plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import carving, sequences, stepplan
from tokenloom.plans.corpus import MIXES, mixed_tokens, token_table
from tokenloom.plans.registry import artifact, digest, query, rounded
from tokenloom.plans.sqltext import BATCH_SEQS, SEQ_LEN, SHARD, VAL, ids_text, sql
from tokenloom.session import stage, staging_path
from tokenloom.sources import manifest, shardfiles
from tokenloom.streaming import ingest

STEP = BATCH_SEQS * SEQ_LEN
EVAL_TOKENS = 20_000
EPOCHS = 2
DECAY = 0.2
WARMUP = 20


def _carved(spark: SparkSession, sf_dir: str, mix: str) -> tuple[DataFrame, DataFrame]:
    mixed, total = mixed_tokens(spark, sf_dir, mix)
    return mixed, stage(carving.carve(mixed, SHARD, MIXES[mix].val_tokens, mix, total), f"carved-{mix}")


@artifact
def train_carved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _carved(spark, sf_dir, "train")


@artifact
def anneal_carved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _carved(spark, sf_dir, "anneal")


def train_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carving.shard_chunks(token_table(spark, sf_dir), train_carved(spark, sf_dir)[1])


@artifact
def train_shards(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the binary shards: what training reads."""
    path = staging_path(spark, "shards")
    shardfiles.write_shards(train_chunks(spark, sf_dir), path)
    return path


@artifact
def train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = sequences.shard_lengths(train_carved(spark, sf_dir)[1])
    return stage(sequences.shard_batches(lengths, BATCH_SEQS, SEQ_LEN), "batches")


def windows(spark: SparkSession, sf_dir: str, split: str) -> sequences.Windows:
    """Reads batches of a split out of its shard files, without a shuffle, and no other bytes."""
    def read(first: int, end: int) -> DataFrame:
        return shardfiles.read_sequences(spark, train_shards(spark, sf_dir), BATCH_SEQS, SEQ_LEN, f"{split}_*.bin",
                                         firstBatch=first, endBatch=end)
    return read


@query("shard_carve", sql(
    f"select split, shard_idx, shard_pos, n_tok, md5({ids_text('syms')}) as ids_md5 from chunks_train", "chunks_train"))
def shard_carve(spark, sf_dir):
    return train_chunks(spark, sf_dir).select("split", "shard_idx", "shard_pos", "n_tok", digest(F.col("ids")).alias("ids_md5"))


@query("shard_stats", sql(
    "select split, shard_idx, printf('%s_%05d.bin', split, shard_idx) as name, tokens, chunks, "
    "(case when split = 'val' then 0 else sum(tokens) over (partition by split order by shard_idx) end)::BIGINT as written "
    "from (select split, shard_idx, sum(n_tok)::BIGINT as tokens, count(*)::BIGINT as chunks from carved_train "
    "group by split, shard_idx)", "carved_train"))
def shard_stats(spark, sf_dir):
    return carving.shard_stats(train_carved(spark, sf_dir)[1])


@query("shard_shares_running", sql(
    "with g as (select * from (select distinct split, shard_idx from carved_train), (select distinct source from carved_train)), "
    "p as (select split, shard_idx, source, sum(n_tok)::BIGINT as t from carved_train group by split, shard_idx, source), "
    "u as (select split, shard_idx, source, coalesce(t, 0)::BIGINT as tokens, "
    "sum(coalesce(t, 0)) over (partition by split, source order by shard_idx)::BIGINT as upto from g left join p using (split, shard_idx, source)) "
    "select *, round(upto / sum(upto) over (partition by split, shard_idx)::DOUBLE, 6) as share from u", "carved_train"
).replace("\nwith g as", ",\ng as", 1))
def shard_shares_running(spark, sf_dir):
    """The make-up of all that is written, after every shard."""
    shares = carving.running_shares(train_carved(spark, sf_dir)[1], list(MIXES["train"].order))
    return shares.withColumn("share", rounded(F.col("share")))


@query("shard_stats_anneal", sql(
    "select split, shard_idx, printf('%s_%05d.bin', split, shard_idx) as name, sum(n_tok)::BIGINT as tokens, "
    "count(*)::BIGINT as chunks from carved_anneal group by split, shard_idx", "carved_anneal"))
def shard_stats_anneal(spark, sf_dir):
    """The anneal mix: no validation part, its own file names."""
    return carving.shard_stats(anneal_carved(spark, sf_dir)[1]).drop("written")


@query("shard_scan", sql(
    "select split, shard_idx, sum(n_tok)::BIGINT as tokens, sum(list_sum(list_transform(regexp_extract_all(syms, "
    "'<([0-9]+)>', 1), lambda x: x::BIGINT)))::BIGINT as id_sum from chunks_train group by split, shard_idx",
    "chunks_train"))
def shard_scan(spark, sf_dir):
    """Write the binary shards, then read them back in byte ranges."""
    path = train_shards.fresh(spark, sf_dir)
    train_shards.keep(spark, sf_dir, path)
    back = shardfiles.read_shards(spark, path)
    return back.groupBy("split", "shard_idx").agg(
        F.sum("n_tok").cast("long").alias("tokens"),
        F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("id_sum"))


@query("shard_listing", sql(
    "select printf('%s_%05d.bin', split, shard_idx) as name, sum(n_tok)::BIGINT as tokens from carved_train "
    "group by split, shard_idx", "carved_train"))
def shard_listing(spark, sf_dir):
    """Write the binary shards, publish them to a second folder and list that."""
    public = staging_path(spark, "public")
    shardfiles.publish(spark, train_shards(spark, sf_dir), public).count()
    return shardfiles.list_shards(spark, public).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "tokens")


@query("resume_missing", sql(
    "select split, shard_idx, count(*)::BIGINT as chunks, sum(n_tok)::BIGINT as tokens from carved_train "
    "where split = 'train' and shard_idx >= (select max(shard_idx) + 1 from carved_train where split = 'train') // 2 "
    "group by split, shard_idx", "carved_train"))
def resume_missing(spark, sf_dir):
    """A run that stopped half way: the shards whose files aren't there."""
    carved, path = train_carved(spark, sf_dir)[1], staging_path(spark, "half")
    half = carved.where(F.col("split") == "train").agg(F.floor((F.max("shard_idx") + 1) / 2)).first()[0]
    first = carved.where((F.col("split") == "val") | (F.col("shard_idx") < half))
    shardfiles.write_shards(carving.shard_chunks(token_table(spark, sf_dir), first), path)
    return carving.unwritten(carved, shardfiles.written_shards(spark, path)).groupBy("split", "shard_idx").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("n_tok").cast("long").alias("tokens"))


@query("mix_progress", sql(
    "select 'train' as mix, source, tokens, (select sum(n_tok)::BIGINT from carved_train where split = 'train') as written, "
    "(select max(shard_idx) + 1 from carved_train where split = 'train')::INT as shard_idx, true as val_done from "
    "(select source, sum(n_tok)::BIGINT as tokens from mix_train group by source)", "carved_train", "mix_train"))
def mix_progress(spark, sf_dir):
    """Append the progress record of the run and read the latest back."""
    mixed, carved = train_carved(spark, sf_dir)
    path = staging_path(spark, "manifest")
    manifest.append(manifest.progress(carving.shard_stats(carved), mixed, "train"), path)
    return manifest.latest(spark, path).select(
        "mix", "written", "shard_idx", "val_done", F.explode("tokens_by_source").alias("source", "tokens"))


_ROW = "split, shard_idx, batch_id, in_shard, row"


@query("shift_windows", sql(
    f"select {_ROW}, md5({ids_text(f'substr(syms, 1, {7 * SEQ_LEN})')}) as x_md5, "
    f"md5({ids_text(f'substr(syms, 8, {7 * SEQ_LEN})')}) as y_md5 from windows", "windows"))
def shift_windows(spark, sf_dir):
    seqs = sequences.shift_windows(train_chunks(spark, sf_dir), train_batches(spark, sf_dir), BATCH_SEQS, SEQ_LEN)
    return seqs.select(
        "split", "shard_idx", "batch_id", "in_shard", "row",
        digest(sequences.inputs(F.col("ids"), SEQ_LEN)).alias("x_md5"),
        digest(sequences.targets(F.col("ids"), SEQ_LEN)).alias("y_md5"))


@query("sequence_scan", sql(f"select {_ROW}, md5({ids_text('syms')}) as ids_md5 from windows", "windows"))
def sequence_scan(spark, sf_dir):
    """The same sequences, read from the binary shards without a shuffle."""
    return shardfiles.read_sequences(spark, train_shards(spark, sf_dir), BATCH_SEQS, SEQ_LEN).select(
        "split", "shard_idx", "batch_id", "in_shard", "row", digest(F.col("ids")).alias("ids_md5"))


@query("val_batches", sql(
    f"select read, (read // n)::INT as epoch, read % n as batch_id, row, md5({ids_text('syms')}) as ids_md5 from "
    "(select sum(n_batches)::BIGINT as n from batches_of_train where split = 'val'), "
    f"(select unnest(generate_series(0, {max(1, EVAL_TOKENS // STEP)} - 1)) as read) join windows w "
    "on w.batch_id = read % n and w.split = 'val'", "batches_of_train", "windows"))
def val_batches(spark, sf_dir):
    """The same evaluation batches every time; past the end of the split they repeat."""
    n = sequences.stream_batches(train_batches(spark, sf_dir))["val"]
    return sequences.val_batches(spark, windows(spark, sf_dir, "val"), n, EVAL_TOKENS, BATCH_SEQS, SEQ_LEN).select(
        "read", "epoch", "batch_id", "row", digest(F.col("ids")).alias("ids_md5"))


@query("resume_windows", sql(
    f"select batch_id, row, md5({ids_text('syms')}) as ids_md5 from windows where split = 'train' and batch_id >= "
    "(select first_batch + 3 from batches_of_train where split = 'train' and shard_idx = 1)", "windows", "batches_of_train"))
def resume_windows(spark, sf_dir):
    """Restart from the loader state in shard 1 after three batches."""
    state = {"shard_idx": 1, "pos": 3 * STEP, "epoch": 0}
    at = sequences.cursor_of(train_batches(spark, sf_dir), state, BATCH_SEQS, SEQ_LEN)
    n = sequences.stream_batches(train_batches(spark, sf_dir))["train"]
    rest = sequences.resume_from(spark, windows(spark, sf_dir, "train"), n, at)
    return rest.select("batch_id", "row", digest(F.col("ids")).alias("ids_md5"))


@query("resume_next_epoch", sql(
    f"select read, (read // n)::INT as epoch, read % n as batch_id, row, md5({ids_text('syms')}) as ids_md5 from "
    "(select n, unnest(generate_series(n + spot, n + spot + n - 1)) as read from "
    "(select sum(n_batches)::BIGINT as n, max(first_batch + 2) filter (where shard_idx = 1)::BIGINT as spot "
    "from batches_of_train where split = 'train')) join windows w on w.batch_id = read % n and w.split = 'train'",
    "batches_of_train", "windows"))
def resume_next_epoch(spark, sf_dir):
    """Restart in the second epoch, in shard 1 after two batches, and read as much as an epoch has."""
    state = {"shard_idx": 1, "pos": 2 * STEP, "epoch": 1}
    batches = train_batches(spark, sf_dir)
    at, n = sequences.cursor_of(batches, state, BATCH_SEQS, SEQ_LEN), sequences.stream_batches(batches)["train"]
    return sequences.resume_from(spark, windows(spark, sf_dir, "train"), n, at, n).select(
        "read", "epoch", "batch_id", "row", digest(F.col("ids")).alias("ids_md5"))


@query("sequence_range", sql(
    f"select {_ROW}, md5({ids_text('syms')}) as ids_md5 from windows w, (select sum(n_batches)::BIGINT as n from batches_of_train "
    "where split = 'train') where w.split = 'train' and batch_id >= n // 4 and batch_id <= n // 2", "windows", "batches_of_train"))
def sequence_range(spark, sf_dir):
    """The second quarter of an epoch: only its bytes are read from the shard files."""
    n = sequences.stream_batches(train_batches(spark, sf_dir))["train"]
    own = windows(spark, sf_dir, "train")(n // 4, n // 2 + 1)
    return own.select("split", "shard_idx", "batch_id", "in_shard", "row", digest(F.col("ids")).alias("ids_md5"))


@query("resume_manifest", sql(
    "select split, shard_idx, count(*)::BIGINT as chunks, sum(n_tok)::BIGINT as tokens from carved_train "
    "where split = 'train' and shard_idx >= (select max(shard_idx) + 1 from carved_train where split = 'train') // 2 "
    "group by split, shard_idx", "carved_train"))
def resume_manifest(spark, sf_dir):
    """As ``resume_missing``, from the manifest that the first run's job committed with its shards."""
    carved, path = train_carved(spark, sf_dir)[1], staging_path(spark, "committed")
    half = carved.where(F.col("split") == "train").agg(F.floor((F.max("shard_idx") + 1) / 2)).first()[0]
    first = carved.where((F.col("split") == "val") | (F.col("shard_idx") < half))
    shardfiles.write_shards(carving.shard_chunks(token_table(spark, sf_dir), first), path, commit="job")
    return carving.unwritten(carved, shardfiles.committed_shards(spark, path)).groupBy("split", "shard_idx").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("n_tok").cast("long").alias("tokens"))


@query("shard_manifest", sql(
    "select split, shard_idx, printf('%s_%05d.bin', split, shard_idx) as name, sum(n_tok)::BIGINT as tokens, true as same "
    "from carved_train group by split, shard_idx", "carved_train"))
def shard_manifest(spark, sf_dir):
    """The manifest of a committed job against the files: sizes, and checksums computed anew."""
    path = staging_path(spark, "manifested")
    shardfiles.write_shards(train_chunks(spark, sf_dir), path, commit="job")
    listed = shardfiles.committed_shards(spark, path)
    return listed.join(shardfiles.shard_checksums(spark, path), "name").select(
        "split", "shard_idx", "name", "tokens", ((F.col("found") == F.col("crc32")) & (F.col("bytes") == 2 * F.col("tokens"))).alias("same"))


@query("stream_batches_resumed", sql(
    f"select read, (read // n)::INT as epoch, read % n as batch_id, row, md5({ids_text('syms')}) as ids_md5 from "
    "(select n, unnest(generate_series(n + spot, n + spot + n - 1)) as read from "
    "(select sum(n_batches)::BIGINT as n, max(first_batch + 2) filter (where shard_idx = 1)::BIGINT as spot "
    "from batches_of_train where split = 'train')) join windows w on w.batch_id = read % n and w.split = 'train'",
    "batches_of_train", "windows"))
def stream_batches_resumed(spark, sf_dir):
    """The endless loader as a stream, from a state in the second epoch: stopped after a third, restarted from its checkpoint."""
    n = sequences.stream_batches(train_batches(spark, sf_dir))["train"]
    state = {"shard_idx": 1, "pos": 2 * STEP, "epoch": 1}
    at = sequences.cursor_of(train_batches(spark, sf_dir), state, BATCH_SEQS, SEQ_LEN)
    out, place = staging_path(spark, "streamed"), staging_path(spark, "loader")
    for until in (at + n // 3, at + n):
        read = shardfiles.stream_sequences(spark, train_shards(spark, sf_dir), BATCH_SEQS, SEQ_LEN, until, state)
        coded = read.select("read", "epoch", "batch_id", "row", digest(F.col("ids")).alias("ids_md5"))
        ingest.append_batches(coded, lambda batch: batch, out, place).awaitTermination()
    return spark.read.parquet(out).drop("batch")


_STREAMS = (
    "(select 'train' as stream, shard_idx, n_batches, first_batch from batches_of_train where split = 'train' union all "
    "select 'anneal', shard_idx, n_batches, first_batch from batches_of_anneal)")


@query("step_plan", sql(
    f"with sizes as (select stream, sum(n_batches)::BIGINT as n from {_STREAMS} group by stream), "
    f"run as (select ((select sum(n_tok)::BIGINT from carved_train where split = 'train') * {EPOCHS}) // {STEP} as total), "
    f"cut as (select total, total - greatest(1, floor(total * {DECAY}::DOUBLE)::BIGINT) as begins, "
    f"greatest(1, floor(total * {DECAY}::DOUBLE)::BIGINT) as d from run), "
    "steps as (select unnest(generate_series(0, total - 1)) as step, begins, d from cut), "
    "read as (select step, case when step >= begins then 'anneal' else 'train' end as stream, "
    "case when step >= begins then step - begins else step end as cursor, "
    f"case when step < {WARMUP} then (step + 1) / {WARMUP}::DOUBLE when step < begins then 1.0::DOUBLE else "
    "1.0::DOUBLE - sqrt(least(1.0::DOUBLE, (step - begins) / d::DOUBLE)) end as f from steps) "
    f"select step, r.stream, cursor, (cursor // n)::INT as epoch, cursor % n as batch_id, b.shard_idx, "
    f"cursor % n - b.first_batch as in_shard, (cursor % n - b.first_batch + 1) * {STEP} as pos, round(f, 9) as lr_factor "
    f"from read r join sizes using (stream) join {_STREAMS} b on b.stream = r.stream and cursor % n >= b.first_batch "
    "and cursor % n < b.first_batch + b.n_batches", "batches_of_train", "batches_of_anneal", "carved_train"
).replace("\nwith sizes as", ",\nsizes as", 1))
def step_plan(spark, sf_dir):
    """Two passes over the train tokens, the last fifth of the steps on the anneal stream."""
    train, anneal = train_carved(spark, sf_dir)[1], anneal_carved(spark, sf_dir)[1]
    batches = train_batches(spark, sf_dir).unionByName(
        sequences.shard_batches(sequences.shard_lengths(anneal), BATCH_SEQS, SEQ_LEN))
    tokens = train.where(F.col("split") == "train").agg(F.sum("n_tok")).first()[0]
    steps = stepplan.total_steps(tokens * EPOCHS, BATCH_SEQS, SEQ_LEN)
    plan = stepplan.step_plan(spark, steps, sequences.stream_batches(batches), lr=1.0, warmup=WARMUP, decay_frac=DECAY)
    return stepplan.locate(plan, batches, BATCH_SEQS, SEQ_LEN).select(
        "step", "stream", "cursor", "epoch", "batch_id", "shard_idx", "in_shard", "pos",
        rounded(F.col("lr"), 9).alias("lr_factor"))


CUT, REWARM, MIN_FRAC = 0.9, 0.5, 0.1


@query("step_plan_resumed", sql(
    f"with run as (select ((select sum(n_tok)::BIGINT from carved_train where split = 'train') * {EPOCHS}) // {STEP} as total), "
    f"cut as (select total, greatest(1, floor(total * {DECAY}::DOUBLE)::BIGINT) as d, floor(total * {REWARM}::DOUBLE)::BIGINT as since, "
    f"floor(total * {CUT}::DOUBLE)::BIGINT as ends from run), "
    "steps as (select unnest(generate_series(since, ends - 1)) as step, total - d as begins, d, since from cut) "
    f"select step, step % n as batch_id, round((case when step < {WARMUP} then (step + 1) / {WARMUP}::DOUBLE "
    f"when step < begins then 1.0::DOUBLE else {MIN_FRAC}::DOUBLE + {1 - MIN_FRAC!r}::DOUBLE * (1.0::DOUBLE - "
    "sqrt(least(1.0::DOUBLE, (step - begins) / d::DOUBLE))) end) * "
    f"least(1.0::DOUBLE, (step - since + 1) / {max(1, WARMUP // 4)}::DOUBLE), 9) as lr_factor from steps, "
    "(select sum(n_batches)::BIGINT as n from batches_of_train where split = 'train')", "batches_of_train", "carved_train"
).replace("\nwith run as", ",\nrun as", 1))
def step_plan_resumed(spark, sf_dir):
    """A run without anneal stream, resumed half way in another framework and cut short."""
    tokens = train_carved(spark, sf_dir)[1].where(F.col("split") == "train").agg(F.sum("n_tok")).first()[0]
    steps = stepplan.total_steps(tokens * EPOCHS, BATCH_SEQS, SEQ_LEN)
    since = int(steps * REWARM)
    plan = stepplan.step_plan(
        spark, steps, sequences.stream_batches(train_batches(spark, sf_dir)), lr=1.0, warmup=WARMUP, decay_frac=DECAY,
        min_frac=MIN_FRAC, rewarm_from=since, max_steps=int(steps * CUT), anneal=False)
    return plan.where(F.col("step") >= since).select("step", "batch_id", rounded(F.col("lr"), 9).alias("lr_factor"))


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sequences there are, without a token."""
    return sequences.batch_rows(train_batches(spark, sf_dir).where(F.col("split") == "train"), BATCH_SEQS)


@query("worker_rows_torch", sql(
    f"select {_ROW}, (row // 4)::INT as rank, ((row % 4) // 2)::INT as accum from windows where split = 'train'", "windows"))
def worker_rows_torch(spark, sf_dir):
    """Two ranks of micro-batches of two."""
    own = train_rows(spark, sf_dir)
    return sequences.torch_rows(own, BATCH_SEQS, 2, 2).select(
        "split", "shard_idx", "batch_id", "in_shard", "row", "rank", "accum")


@query("worker_rows_jax", sql(
    f"select {_ROW}, (row // 4)::INT as accum, ((row % 4) // 2)::INT as device from windows where split = 'train'", "windows"))
def worker_rows_jax(spark, sf_dir):
    """Passes of two devices with micro-batches of two."""
    own = train_rows(spark, sf_dir)
    return sequences.jax_rows(own, BATCH_SEQS, 2, 2).select(
        "split", "shard_idx", "batch_id", "in_shard", "row", "accum", "device")
