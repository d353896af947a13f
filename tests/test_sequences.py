import math

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import schedule
from tokenloom.operators import carving, sequences, stepplan
from tokenloom.sources import shardfiles


def _shards(spark, n, size, piece=70):
    rows = [("train", s, p, min(piece, size - p), [p + i + s * size for i in range(min(piece, size - p))])
            for s in range(n) for p in range(0, size, piece)]
    return spark.createDataFrame(rows, "split string, shard_idx int, shard_pos long, n_tok int, ids array<int>")


def _stream(n, size, b, t):
    """Every batch of one epoch, as the loop over flat arrays gives them."""
    out = []
    for s in range(n):
        for p in range(0, size - b * t, b * t):
            if p + b * t + 1 <= size:
                out.append([[s * size + p + r * t + i for i in range(t + 1)] for r in range(b)])
    return out


@pytest.mark.parametrize("n,size,per_shard", [(3, 1000, 31), (6, 500, 15)])
def test_windows_equal_the_loop(spark, many_ranges, n, size, per_shard):
    chunks = _shards(spark, n, size)
    batches = sequences.shard_batches(sequences.shard_lengths(chunks), 2, 16)
    assert {r["n_batches"] for r in batches.collect()} == {per_shard}
    rows = sequences.shift_windows(chunks, batches, 2, 16).collect()
    want = _stream(n, size, 2, 16)
    assert len(rows) == 2 * len(want) == 2 * n * per_shard
    for r in rows:
        assert r["ids"] == want[r["batch_id"]][r["row"]]


def test_shift_and_resume(spark):
    chunks = _shards(spark, 3, 1000)
    batches = sequences.shard_batches(sequences.shard_lengths(chunks), 2, 16)
    rows = sequences.shift_windows(chunks, batches, 2, 16).select(
        "batch_id", "row", sequences.inputs(F.col("ids"), 16).alias("x"), sequences.targets(F.col("ids"), 16).alias("y"))
    by = {(r["batch_id"], r["row"]): r for r in rows.collect()}
    assert all(r["x"][1:] == r["y"][:-1] for r in by.values())
    assert by[0, 0]["y"][-1] == by[0, 1]["x"][0]
    # After 41 batches the loader stands in shard 1 after ten of its batches.
    at = sequences.cursor_of(batches, {"shard_idx": 1, "pos": 10 * 32, "epoch": 0}, 2, 16)
    assert at == 41
    rest = {(r["read"], r["row"]): r["x"] for r in sequences.resume_from(spark, rows, 93, at).collect()}
    assert rest == {k: r["x"] for k, r in by.items() if k[0] >= 41}
    # In a later epoch the same batches come again, and reads go past its end.
    later = {(r["read"], r["epoch"], r["batch_id"], r["row"]): r["x"]
             for r in sequences.resume_from(spark, rows, 93, 93 + 90, 6).collect()}
    assert later == {(n, n // 93, n % 93, r): by[n % 93, r]["x"] for n in range(183, 189) for r in (0, 1)}
    assert sequences.cursor_of(batches, {"shard_idx": 4, "pos": 0, "epoch": 2}, 2, 16) == 2 * 93 + 31


@pytest.mark.parametrize("options", [{}, {"perTask": 70}])
def test_sequences_from_files_equal_the_loop(spark, tmp_path, options):
    path = str(tmp_path / "shards")
    shardfiles.write_shards(_shards(spark, 3, 1000).unionByName(_shards(spark, 1, 100).withColumn("split", F.lit("val"))), path)
    rows = shardfiles.read_sequences(spark, path, 2, 16, **options).collect()
    want = _stream(3, 1000, 2, 16)
    assert len([r for r in rows if r["split"] == "val"]) == 2 * 3 and len(rows) == 2 * (93 + 3)
    for r in rows:
        assert r["ids"] == (want[r["batch_id"]][r["row"]] if r["split"] == "train" else
                            [32 * r["batch_id"] + 16 * r["row"] + i for i in range(17)])
        assert r["in_shard"] == (r["batch_id"] - 31 * r["shard_idx"])


class _Counting:
    """A file system that notes the ranges read from its files."""

    def __init__(self, system, read):
        self.system, self.read = system, read

    def __getattr__(self, name):
        return getattr(self.system, name)

    def open_input_file(self, path):
        system, read = self.system, self.read

        class File:
            def __enter__(self):
                self.f = system.open_input_file(path)
                return self

            def __exit__(self, *_):
                self.f.close()

            def read_at(self, n, at):
                read.append((path, at, n))
                return self.f.read_at(n, at)

        return File()


def _bytes_read(monkeypatch, reader):
    """Rows, and ranges read, of a reader in this process."""
    read = []
    plain = shardfiles.file_system
    with monkeypatch.context() as m:
        m.setattr(shardfiles, "file_system", lambda uri: (_Counting(plain(uri)[0], read), plain(uri)[1]))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return rows, read


def test_only_the_bytes_of_a_range_are_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "shards")
    shardfiles.write_shards(_shards(spark, 3, 1000).unionByName(_shards(spark, 1, 100).withColumn("split", F.lit("val"))), path)
    want = _stream(3, 1000, 2, 16)
    for options, batches, ranges in [
        ({"firstbatch": 40, "endbatch": 44}, range(40, 44), 1), ({"firstbatch": 29, "endbatch": 34}, range(29, 34), 2),
        ({"firstshard": 1, "endshard": 2}, range(31, 62), 1), ({"firstshard": 1, "endshard": 2, "firstbatch": 60}, (60, 61), 1),
        ({"firstbatch": 93}, (), 0), ({"firstbatch": 5, "endbatch": 5}, (), 0), ({}, range(93), 3),
    ]:
        reader = shardfiles.SequenceReader({"path": "file:" + path, "batchseqs": "2", "seqlen": "16", "pattern": "train_*", **options})
        rows, read = _bytes_read(monkeypatch, reader)
        assert len(read) == ranges and sum(n for _, _, n in read) == len(batches) * 64 + 2 * ranges
        assert sorted((r["batch_id"], r["row"]) for r in rows) == [(b, i) for b in batches for i in (0, 1)]
        assert all(r["ids"] == want[r["batch_id"]][r["row"]] for r in rows)
    rows, read = _bytes_read(monkeypatch, shardfiles.ShardReader({"path": "file:" + path, "pattern": "train_*", "firstshard": 2}))
    assert read == [(path + "/train_00002.bin", 0, 2000)] and {r["shard_idx"] for r in rows} == {2}


def test_tasks_follow_the_cores(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "shards")
    shardfiles.write_shards(_shards(spark, 3, 1000), path)
    assert shardfiles.read_sequences(spark, path, 2, 16).rdd.getNumPartitions() == 1
    many = shardfiles.read_sequences(spark, path, 2, 16, perTask=64)
    assert many.rdd.getNumPartitions() > 40 and many.count() == 2 * 93
    monkeypatch.setattr(shardfiles, "LEAST_PER_TASK", 100)
    reader = shardfiles.SequenceReader({"path": "file:" + path, "batchseqs": "2", "seqlen": "16", "tasks": "8"})
    assert 8 <= len(reader.partitions()) <= 11
    # Two uses of one table don't disturb each other.
    both = many.where("batch_id < 3").unionByName(many.where("batch_id > 90"))
    assert sorted({r["batch_id"] for r in both.collect()}) == [0, 1, 2, 91, 92]


def test_reads_over_the_end_of_an_epoch_are_two_ranges(spark, tmp_path):
    path = str(tmp_path / "shards")
    shardfiles.write_shards(_shards(spark, 3, 1000), path)
    windows = shardfiles.read_sequences(spark, path, 2, 16, "train_*.bin")
    read = lambda a, e: shardfiles.read_sequences(spark, path, 2, 16, firstBatch=a, endBatch=e)
    for first, reads in ((90, 6), (10, 4), (5, 93), (186, 1)):
        for source in (windows, read):
            own = sequences.batches_between(source, first, reads, 93)
            assert {r["batch_id"] for r in own.select("batch_id").collect()} == {(first + i) % 93 for i in range(reads)}
    batches = sequences.shard_batches(sequences.shard_lengths(_shards(spark, 3, 1000)), 2, 16)
    columns = ["split", "shard_idx", "batch_id", "in_shard", "row"]
    assert sorted(sequences.batch_rows(batches, 2).select(columns).collect()) == sorted(windows.select(columns).collect())


def test_endless_stream_keeps_its_place(spark, tmp_path):
    from tokenloom.streaming import ingest

    path, out, place = (str(tmp_path / n) for n in ("shards", "out", "checkpoint"))
    shardfiles.write_shards(_shards(spark, 3, 1000), path)
    want, seen = _stream(3, 1000, 2, 16), 0
    for until in (95, 95, 130, 300):
        stream = shardfiles.stream_sequences(spark, path, 2, 16, until, {"shard_idx": 1, "pos": 320, "epoch": 0})
        ingest.append_batches(stream, lambda b: b, out, place).awaitTermination()
        rows = spark.read.parquet(out).collect()
        assert sorted((r["read"], r["row"]) for r in rows) == [(n, i) for n in range(41, until) for i in (0, 1)]
        assert all(r["ids"] == want[r["batch_id"]][r["row"]] and (r["epoch"], r["batch_id"]) == divmod(r["read"], 93) for r in rows)
        assert len(rows) > seen or until == 95
        seen = len(rows)


def test_job_commit_lists_whole_shards_alone(spark, tmp_path):
    path, chunks = str(tmp_path / "shards"), _shards(spark, 4, 300)
    gap = chunks.where("not (shard_idx = 3 and shard_pos = 70)")
    assert shardfiles.committed_shards(spark, path).count() == 0
    with pytest.raises(Exception, match="not whole"):
        shardfiles.write_shards(gap, path, commit="job")
    assert not list((tmp_path / "shards").glob("*.bin")) and shardfiles.committed_shards(spark, path).count() == 0
    shardfiles.write_shards(chunks.where("shard_idx in (0, 2)"), path, commit="job")
    done = shardfiles.committed_shards(spark, path)
    assert sorted((r["shard_idx"], r["name"], r["tokens"]) for r in done.collect()) == [(0, "train_00000.bin", 300), (2, "train_00002.bin", 300)]
    shardfiles.write_shards(carving.unwritten(chunks, done), path, commit="job")
    both = shardfiles.committed_shards(spark, path).join(shardfiles.shard_checksums(spark, path), "name").collect()
    assert sorted(r["shard_idx"] for r in both) == [0, 1, 2, 3]
    assert all(r["crc32"] == r["found"] and r["bytes"] == 600 for r in both)
    (tmp_path / "shards" / "train_00001.bin").write_bytes(b"x" * 600)
    bad = shardfiles.committed_shards(spark, path).join(shardfiles.shard_checksums(spark, path), "name").where("crc32 <> found")
    assert [r["shard_idx"] for r in bad.collect()] == [1]


def test_wrapping_and_val_batches(spark):
    reads = {r["read"]: (r["epoch"], r["batch_id"]) for r in sequences.cursor_batches(spark, 60, 45, 40).collect()}
    assert reads[44] == (0, 44) and reads[45] == (1, 0) and reads[99] == (2, 9)
    assert sequences.val_batch_count(20e6, 8, 2048) == 1220 and sequences.val_batch_count(1, 8, 2048) == 1
    chunks = _shards(spark, 1, 100).withColumn("split", F.lit("val"))
    batches = sequences.shard_batches(sequences.shard_lengths(chunks), 2, 16)
    windows = sequences.shift_windows(chunks, batches, 2, 16)
    got = sequences.val_batches(spark, windows, sequences.stream_batches(batches)["val"], 32 * 5, 2, 16)
    assert sorted((r["read"], r["batch_id"], r["row"]) for r in got.collect()) == [(i, i % 3, r) for i in range(5) for r in (0, 1)]
    with pytest.raises(ValueError):
        sequences.cursor_batches(spark, 1, 0)


def test_shard_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    chunks = _shards(spark, 3, 1000)
    shardfiles.write_shards(chunks, path)
    names = [(r["path"].rsplit("/", 1)[1], r["tokens"]) for r in shardfiles.list_shards(spark, path, "train_*.bin").collect()]
    assert names == [(f"train_{i:05d}.bin", 1000) for i in range(3)]
    raw = (tmp_path / "shards" / "train_00001.bin").read_bytes()
    assert len(raw) == 2000 and int.from_bytes(raw[2:4], "little") == 1001
    for options in ({}, {"chunk": 7, "perTask": 333}):
        back = {}
        for r in shardfiles.read_shards(spark, path, **options).orderBy("shard_idx", "shard_pos").collect():
            assert r["n_tok"] == len(r["ids"]) and len(back.get(r["shard_idx"], [])) == r["shard_pos"]
            back.setdefault(r["shard_idx"], []).extend(r["ids"])
        assert back == {s: list(range(s * 1000, s * 1000 + 1000)) for s in range(3)}
    (tmp_path / "shards" / "notes.txt").write_text("x")
    (tmp_path / "shards" / "progress.json").write_text("{}")
    copied = shardfiles.publish(spark, path, str(tmp_path / "public")).collect()
    assert sorted(r["name"] for r in copied) == ["progress.json"] + [n for n, _ in names]
    assert (tmp_path / "public" / "train_00001.bin").read_bytes() == raw
    with pytest.raises(FileNotFoundError):
        shardfiles.list_shards(spark, path, "nothing_*.bin")
    with pytest.raises(Exception, match="no shard matches"):
        shardfiles.read_shards(spark, path, "nothing_*.bin").collect()


def test_interrupted_write_continues(spark, tmp_path):
    path = str(tmp_path / "shards")
    chunks = _shards(spark, 4, 300)
    shardfiles.write_shards(chunks.where("shard_idx in (0, 2)"), path)
    done = shardfiles.written_shards(spark, path)
    assert sorted(done.collect()) == [("train", 0), ("train", 2)]
    shardfiles.write_shards(carving.unwritten(chunks, done), path)
    back = shardfiles.read_shards(spark, path).select("shard_idx", F.posexplode("ids").alias("i", "id"), "shard_pos")
    assert back.count() == 1200
    assert back.where(F.col("id") != F.col("shard_idx") * 300 + F.col("shard_pos") + F.col("i")).count() == 0


def test_state_after_a_step_points_at_the_next(spark):
    batches = sequences.shard_batches(sequences.shard_lengths(_shards(spark, 3, 1000)), 2, 16)
    plan = stepplan.step_plan(spark, 200, sequences.stream_batches(batches), anneal=False)
    for r in stepplan.locate(plan, batches, 2, 16).where("step in (0, 30, 31, 92, 93, 150)").collect():
        state = {"shard_idx": r["shard_idx"], "pos": r["pos"], "epoch": r["epoch"]}
        assert sequences.cursor_of(batches, state, 2, 16) == r["step"] + 1


def test_shard_writer_refuses_gaps_and_wide_ids(spark, tmp_path):
    rows = "split string, shard_idx int, shard_pos long, n_tok int, ids array<int>"
    gap = spark.createDataFrame([("train", 0, 0, 1, [1]), ("train", 0, 5, 1, [2])], rows)
    with pytest.raises(Exception, match="not whole"):
        shardfiles.write_shards(gap, str(tmp_path / "gap"))
    wide = spark.createDataFrame([("train", 0, 0, 1, [70000])], rows)
    with pytest.raises(Exception, match="two bytes"):
        shardfiles.write_shards(wide, str(tmp_path / "wide"))
    assert not list((tmp_path / "gap").glob("*.bin")) and not list((tmp_path / "wide").glob("*.bin"))


def test_shard_table(spark, tmp_path):
    path = str(tmp_path / "table")
    shardfiles.write_shard_table(_shards(spark, 2, 100), path)
    assert spark.read.parquet(path).where("split = 'train' and shard_idx = 1").agg(F.sum("n_tok")).first()[0] == 100


def test_worker_rows(spark):
    rows = spark.range(16).select(F.col("id").cast("int").alias("row"))
    torch = {r["row"]: (r["rank"], r["accum"]) for r in sequences.torch_rows(rows, 16, 2, 2).collect()}
    jax = {r["row"]: (r["accum"], r["device"]) for r in sequences.jax_rows(rows, 16, 2, 4).collect()}
    for row in range(16):
        assert torch[row] == (row // 8, (row % 8) // 2)
        assert jax[row] == (row // 8, (row % 8) // 2)
    with pytest.raises(ValueError):
        sequences.torch_rows(rows, 16, 3, 2)
    with pytest.raises(ValueError):
        sequences.jax_rows(rows, 16, 3, 2)


def _factor(step, total, warmup, frac, low=0.0):
    if step < warmup:
        return (step + 1) / warmup
    d = max(1, int(total * frac))
    return 1.0 if step < total - d else low + (1 - low) * (1 - math.sqrt(min(1.0, (step - total + d) / d)))


def test_schedule_golden(spark):
    df = spark.range(100).select(schedule.warm_stable_decay(F.col("id"), 100, 10, 0.2).alias("f"))
    f = [r["f"] for r in df.collect()]
    assert f[0] == 0.1 and f[9] == 1 and f[50] == 1 and f[80] == 1
    assert f[90] == pytest.approx(1 - math.sqrt(0.5)) and f[99] == pytest.approx(1 - math.sqrt(0.95)) and f[99] < 0.25
    assert all(a >= b for a, b in zip(f[80:], f[81:]))
    assert f == pytest.approx([_factor(s, 100, 10, 0.2) for s in range(100)])


def test_step_plan(spark):
    assert stepplan.total_steps(2e10, 256, 2048) == 38146 and stepplan.total_steps(5e8, 128, 1024) == 3814
    assert schedule.decay_steps(38146, 0.2) == 7629
    plan = stepplan.step_plan(spark, 100, {"train": 30, "anneal": 7}, lr=2.0, warmup=10, decay_frac=0.2, min_frac=0.1,
                              rewarm_from=50, max_steps=95)
    rows = {r["step"]: r for r in plan.collect()}
    assert sorted(rows) == list(range(95))
    for s, r in rows.items():
        stream, cursor, size = ("anneal", s - 80, 7) if s >= 80 else ("train", s, 30)
        assert (r["stream"], r["cursor"], r["epoch"], r["batch_id"]) == (stream, cursor, cursor // size, cursor % size)
        assert r["lr"] == pytest.approx(2 * _factor(s, 100, 10, 0.2, 0.1) * min(1, (s - 50 + 1) / 2))
    only = stepplan.step_plan(spark, 100, {"train": 30}, decay_frac=0.2)
    assert {r["stream"] for r in only.collect()} == {"train"}
    main = stepplan.step_plan(spark, 38146, {"train": 47500, "anneal": 5700})
    assert main.where("stream = 'anneal'").agg(F.min("step")).first()[0] == 30517
    assert main.where("stream = 'anneal' and epoch = 1").agg(F.min("cursor")).first()[0] == 5700


def test_sft_plan(spark):
    rows = spark.range(21).select(F.col("id").alias("row_id"))
    got = stepplan.sft_plan(rows, 21, 4, 2, 1.5).collect()
    assert max(r["step"] for r in got) + 1 == 7 and len(got) == 28
    first = [r["row_id"] for r in got if r["epoch"] == 0]
    assert len(set(first)) == 20
    assert all(r["micro"] == r["slot"] // 2 and r["step"] // 5 == r["epoch"] for r in got)
    assert stepplan.sft_plan(rows, 21, 32, 4, 2).count() == 0
