"""Binary token shards: two-byte ids, no header, little-endian; and their listing.

``format("tokenshards")`` writes one file per shard and reads byte ranges of
shards in parallel; a range of shards or of batches is chosen before files are opened, so
only its bytes are read. (These ranges are options: filters that Spark pushes into a
Python source are kept with the loaded relation, so two differently filtered uses of one
DataFrame would change each other's rows.) ``format("tokensequences")`` gives
training sequences as a table, ``format("tokenstream")`` as an endless stream that keeps its place.

Shards are committed by task (each has its name as soon as it is whole, and what an
interrupted job has written can be kept) or by job: then they wait under other names
until all are whole, and the driver names them and adds them to the manifest of the
folder, with their sizes and checksums. The functions below give paths the scheme that Spark itself
resolves them to, so tasks open the same place as Spark's own readers; the bare
formats take only paths with a scheme.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import sys
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

from tokenloom.session import file_system, folder_entries, qualified, ship_package

FORMAT = "tokenshards"
SEQUENCES, STREAMED = "tokensequences", "tokenstream"
#: Tokens one task reads: 128 MB at most, and less where that leaves cores without work, down to 512 KB.
PER_TASK, LEAST_PER_TASK = 1 << 26, 1 << 18
#: Tokens a task reads and hands on at once.
BLOCK = 1 << 20
MANIFEST, PENDING = "_manifest", "_pending"
CHUNK = "split string, shard_idx int, shard_pos long, n_tok int, ids array<int>"
SEQUENCE = "split string, shard_idx int, batch_id long, in_shard long, row int, ids array<int>"
STREAM = f"read long, epoch int, {SEQUENCE}"
_NAME = re.compile(r"^(.*)_(\d{5,})\.bin$")


def _write_all(out, ids: np.ndarray, check: int) -> int:
    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
        raise ValueError("token id does not fit into two bytes")
    data = ids.astype("<u2").tobytes()
    out.write(data)
    return zlib.crc32(data, check)


def _finish(system: fs.FileSystem, temp: str, final: str) -> None:
    """Give a whole shard its name. A repeated task replaces it by the same bytes."""
    try:
        system.move(temp, final)
    except OSError:
        if system.get_file_info(final).type != fs.FileType.File:
            raise
        system.delete_file(final)
        system.move(temp, final)


@dataclass
class _Written(WriterCommitMessage):
    """The shards of one task: (split, shard_idx, pending file, tokens, checksum)."""

    shards: list[tuple[str, int, str, int, int]] = field(default_factory=list)


class ShardWriter(DataSourceArrowWriter):
    """Streams sorted chunks to files, one shard after the other; see the module for the two ways to commit."""

    def __init__(self, path: str, by_job: bool):
        self.path, self.by_job = path, by_job

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = file_system(self.path)
        pending = posixpath.join(base, PENDING)
        system.create_dir(pending, recursive=True)
        out, current, temp, expected, check = None, None, "", 0, 0
        done = _Written()

        def finish() -> None:
            out.close()
            done.shards.append((*current, posixpath.basename(temp), expected, check))
            if not self.by_job:
                _finish(system, temp, posixpath.join(base, "%s_%05d.bin" % current))

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                split, shard, pos, lists = (
                    batch.column(c) for c in ("split", "shard_idx", "shard_pos", "ids"))
                # Rows of one shard follow each other: their ids are one stretch of the batch.
                same = split.dictionary_encode().indices.to_numpy().astype(np.int64) * (1 << 32) + shard.to_numpy()
                firsts = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
                ids = lists.flatten().to_numpy()
                ends = np.cumsum(lists.value_lengths().to_numpy())
                begins, pos = ends - lists.value_lengths().to_numpy(), pos.to_numpy()
                for a, b in zip(firsts, np.r_[firsts[1:], batch.num_rows]):
                    key = (split[a].as_py(), shard[a].as_py())
                    if key != current:
                        if out is not None:
                            finish()
                        temp = posixpath.join(pending, uuid.uuid4().hex)
                        out, current, expected, check = system.open_output_stream(temp), key, 0, 0
                    if (pos[a:b] != expected + begins[a:b] - begins[a]).any():
                        raise ValueError(f"shard {key} is not whole at position {expected}")
                    check = _write_all(out, ids[begins[a]:ends[b - 1]], check)
                    expected += int(ends[b - 1] - begins[a])
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(temp)
            raise
        if out is not None:
            finish()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """All tasks are done: name the shards, then list them in one manifest file that appears whole."""
        if not self.by_job:
            return
        system, base = file_system(self.path)
        rows = []
        for split, shard, temp, tokens, check in sorted(s for m in messages if m for s in m.shards):
            name = "%s_%05d.bin" % (split, shard)
            _finish(system, posixpath.join(base, PENDING, temp), posixpath.join(base, name))
            rows.append(json.dumps({"split": split, "shard_idx": shard, "name": name, "tokens": tokens, "crc32": check}))
        if not rows:
            return
        folder = posixpath.join(base, MANIFEST)
        system.create_dir(folder, recursive=True)
        temp = posixpath.join(base, PENDING, uuid.uuid4().hex)
        with system.open_output_stream(temp) as out:
            out.write(("\n".join(rows) + "\n").encode())
        system.move(temp, posixpath.join(folder, f"{uuid.uuid4().hex}.json"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """The job failed: what finished tasks left pending goes; nothing of it was ever listed."""
        system, base = file_system(self.path)
        for _, _, temp, _, _ in (s for m in messages if m and self.by_job for s in m.shards):
            system.delete_file(posixpath.join(base, PENDING, temp))


@dataclass(frozen=True)
class _Range:
    """Tokens ``begin … end-1`` of one shard file."""

    path: str
    split: str
    shard: int
    begin: int
    end: int


class _Ranges(InputPartition):
    """What one task reads: part of a large file, or several small ones."""

    def __init__(self, ranges: list[_Range]):
        super().__init__(ranges)


def shard_files(path: str, pattern: str) -> list[tuple[str, str, int, int]]:
    """(path, split, shard, tokens) of the matching files by split and shard; none at all is an error."""
    system, base = file_system(path)
    out = []
    for info in system.get_file_info(fs.FileSelector(base)):
        name = posixpath.basename(info.path)
        m = _NAME.match(name)
        if info.type == fs.FileType.File and m and fnmatch.fnmatch(name, pattern):
            out.append((info.path, m[1], int(m[2]), info.size // 2))
    if not out:
        raise FileNotFoundError(f"no shard matches {pattern!r} in {path!r}")
    return sorted(out, key=lambda f: f[1:3])


class ShardReader(DataSourceReader):
    """Options as in :class:`TokenShards`."""

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.bin")
        self.chunk = int(options.get("chunk", 4096))
        self.per_task, self.tasks = int(options.get("pertask", 0)), int(options.get("tasks", 1))
        self.shards = range(int(options.get("firstshard", 0)), int(options.get("endshard", 1 << 31)))

    def share(self, total: int) -> int:
        """Tokens per task."""
        return self.per_task or min(PER_TASK, max(LEAST_PER_TASK, -(-total // self.tasks)))

    def partitions(self) -> list[_Ranges]:
        files = [f for f in shard_files(self.path, self.pattern) if f[2] in self.shards]
        share = self.share(sum(f[3] for f in files))
        return _dealt([(_Range(path, split, shard, b, min(b + share, n)), min(share, n - b))
                       for path, split, shard, n in files for b in range(0, n, share)], share)

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.value:
            yield from self._read(part)

    def _read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        schema = pa.schema([("split", pa.string()), ("shard_idx", pa.int32()), ("shard_pos", pa.int64()),
                            ("n_tok", pa.int32()), ("ids", pa.list_(pa.int32()))])
        with system.open_input_file(part.path) as f:
            step = max(1, BLOCK // self.chunk) * self.chunk
            for at in range(part.begin, part.end, step):
                n = min(step, part.end - at)
                ids = np.frombuffer(f.read_at(n * 2, at * 2), dtype="<u2").astype(np.int32)
                offsets = np.r_[np.arange(0, n, self.chunk), n].astype(np.int32)
                rows = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.split] * rows), pa.array(np.full(rows, part.shard, np.int32)),
                    pa.array(at + offsets[:-1].astype(np.int64)), pa.array(np.diff(offsets), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                ], schema=schema)


def _dealt(parts: list[tuple[object, int]], share: int) -> list[_Ranges]:
    """Parts in order, as many to a task as its share holds."""
    groups, size = [], share
    for part, n in parts:
        if size + n > share:
            groups.append([])
            size = 0
        groups[-1].append(part)
        size += n
    return [_Ranges(g) for g in groups]


class TokenShards(DataSource):
    """Options: ``pattern`` (default ``*.bin``), ``chunk`` and ``perTask`` in tokens, ``tasks``,
    ``firstShard`` and ``endShard``; for writing ``commit`` by task or job.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CHUNK

    def reader(self, schema) -> ShardReader:
        return ShardReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], self.options.get("commit", "task") == "job")


def _sequence_batches(path: str, part: _Range, base: int, b: int, t: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Batches ``begin … end-1`` of a shard: their numbers in the shard, and the columns of a row per sequence.

    Some MB are read at once; neighbouring sequences overlap by one token.
    """
    system, _ = file_system(path)
    per = max(1, BLOCK // (b * t))
    with system.open_input_file(part.path) as f:
        for at in range(part.begin, part.end, per):
            n = min(per, part.end - at)
            ids = np.frombuffer(f.read_at((n * b * t + 1) * 2, at * b * t * 2), dtype="<u2").astype(np.int32)
            rows = np.lib.stride_tricks.sliding_window_view(ids, t + 1)[::t]
            batch = np.repeat(np.arange(at, at + n), b)
            yield batch, [
                pa.array([part.split] * (n * b)), pa.array(np.full(n * b, part.shard, np.int32)), pa.array(base + batch),
                pa.array(batch), pa.array(np.tile(np.arange(b, dtype=np.int32), n)),
                pa.ListArray.from_arrays(pa.array(np.arange(n * b + 1, dtype=np.int32) * (t + 1)), pa.array(rows.ravel()))]


class SequenceReader(ShardReader):
    """Whole batches of training sequences, cut straight out of the files.

    The shards are in name order, so the batch number of a sequence follows
    from the file sizes alone; of the wanted batches only their own bytes are read.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.batch_seqs, self.seq_len = int(options["batchseqs"]), int(options["seqlen"])
        self.first, self.end = int(options.get("firstbatch", 0)), int(options.get("endbatch", 1 << 62))

    def partitions(self) -> list[_Ranges]:
        step = self.batch_seqs * self.seq_len
        first: dict[str, int] = {}
        runs: list[tuple[_Range, int]] = []
        for path, split, shard, tokens in shard_files(self.path, self.pattern):
            base, n = first.get(split, 0), max(0, tokens - 1) // step
            first[split] = base + n
            a, e = max(base, self.first), min(base + n, self.end)
            if shard in self.shards and a < e:
                runs.append((_Range(path, split, shard, a - base, e - base), base))
        share = max(1, self.share(step * sum(r.end - r.begin for r, _ in runs)) // step)
        return _dealt([((_Range(r.path, r.split, r.shard, a, min(a + share, r.end)), base), min(share, r.end - a))
                       for r, base in runs for a in range(r.begin, r.end, share)], share)

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        for part, base in partition.value:
            for _, columns in _sequence_batches(self.path, part, base, self.batch_seqs, self.seq_len):
                yield pa.RecordBatch.from_arrays(columns, names=["split", "shard_idx", "batch_id", "in_shard", "row", "ids"])


class SequenceStream(DataSourceStreamReader):
    """An endless loader over the shards of one split: past the last shard the next epoch begins.

    Its offsets are loader states ``(epoch, shard_idx, pos)``, the place of the next token
    to read. It starts at option ``state`` or, with a checkpoint, where that ended, and
    reads up to ``until`` (reads since the start of epoch 0); a later run with a larger
    ``until`` goes on from there.
    """

    def __init__(self, options: dict):
        self.path, self.b, self.t = options["path"], int(options["batchseqs"]), int(options["seqlen"])
        self.files = shard_files(self.path, options.get("pattern", "train_*.bin"))
        if len({f[1] for f in self.files}) != 1:
            raise ValueError("a stream reads the shards of one split")
        step = self.b * self.t
        self.sizes = [max(0, f[3] - 1) // step for f in self.files]
        self.first = [sum(self.sizes[:i]) for i in range(len(self.sizes))]
        self.total = sum(self.sizes)
        if not self.total:
            raise ValueError("the stream holds no whole batch")
        self.state, self.until = json.loads(options.get("state", "{}")), int(options["until"])
        self.tasks = int(options.get("tasks", 1))

    def offset(self, read: int) -> dict:
        at = bisect_right(self.first, read % self.total) - 1
        return {"epoch": read // self.total, "shard_idx": at, "pos": (read % self.total - self.first[at]) * self.b * self.t}

    def read_of(self, offset: dict) -> int:
        at = int(offset.get("shard_idx", 0)) % len(self.files)
        return int(offset.get("epoch", 0)) * self.total + self.first[at] + int(offset.get("pos", 0)) // (self.b * self.t)

    def initialOffset(self) -> dict:
        return self.offset(self.read_of(self.state))

    def latestOffset(self) -> dict:
        return self.offset(max(self.until, self.read_of(self.state)))

    def partitions(self, start: dict, end: dict) -> list[_Ranges]:
        reads, parts = range(self.read_of(start), self.read_of(end)), []
        share = max(1, min(PER_TASK // (self.b * self.t), -(-len(reads) // self.tasks)))
        at = reads.start
        while at < reads.stop:
            shard = bisect_right(self.first, at % self.total) - 1
            begin = at % self.total - self.first[shard]
            n = min(self.sizes[shard] - begin, reads.stop - at, share)
            path, split, number, _ = self.files[shard]
            parts.append(((_Range(path, split, number, begin, begin + n), self.first[shard], at // self.total), n))
            at += n
        return _dealt(parts, share)

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        for part, base, epoch in partition.value:
            for batch, columns in _sequence_batches(self.path, part, base, self.b, self.t):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(epoch * self.total + base + batch), pa.array(np.full(len(batch), epoch, np.int32)), *columns],
                    names=["read", "epoch", "split", "shard_idx", "batch_id", "in_shard", "row", "ids"])

    def commit(self, end: dict) -> None:
        """Nothing to give back: shards stay."""


class TokenSequences(DataSource):
    """Options: ``batchSeqs`` and ``seqLen``, ``pattern``, ``perTask`` in tokens, ``tasks``,
    ``firstShard`` and ``endShard``, ``firstBatch`` and ``endBatch``.
    """

    @classmethod
    def name(cls) -> str:
        return SEQUENCES

    def schema(self) -> str:
        return SEQUENCE

    def reader(self, schema) -> SequenceReader:
        return SequenceReader({k.lower(): v for k, v in self.options.items()})



class TokenStream(DataSource):
    """Options: ``batchSeqs``, ``seqLen`` and ``until``; ``pattern``, ``state`` and ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return STREAMED

    def schema(self) -> str:
        return STREAM

    def streamReader(self, schema) -> SequenceStream:
        return SequenceStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TokenShards)
    spark.dataSource.register(TokenSequences)
    # The process that plans a Python stream doesn't see shipped files: its source goes there by value.
    own = [sys.modules[__name__], sys.modules[file_system.__module__]]
    for module in own:
        cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(TokenStream)
    finally:
        for module in own:
            cloudpickle.unregister_pickle_by_value(module)


def write_shards(chunks: DataFrame, path: str, commit: str = "task") -> None:
    """One file per shard. A shard, bounded by its fixed size, is written by one task.

    ``commit="job"``: no shard has its name, and none is in the manifest, before all are whole.
    """
    register(chunks.sparkSession)
    (
        chunks.select("split", "shard_idx", "shard_pos", "n_tok", "ids")
        .repartition("split", "shard_idx")
        .sortWithinPartitions("split", "shard_idx", "shard_pos")
        .write.format(FORMAT).option("commit", commit).mode("append").save(qualified(chunks.sparkSession, path))
    )


def read_shards(spark: SparkSession, path: str, pattern: str = "*.bin", **options) -> DataFrame:
    """Shard files as chunks ``split, shard_idx, shard_pos, n_tok, ids``."""
    register(spark)
    reader = spark.read.format(FORMAT).option("pattern", pattern).option("tasks", spark.sparkContext.defaultParallelism)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(qualified(spark, path))


def read_sequences(spark: SparkSession, path: str, batch_seqs: int, seq_len: int, pattern: str = "*.bin",
                   **options) -> DataFrame:
    """Training sequences straight from shard files, without a shuffle.

    The same rows as :func:`tokenloom.operators.sequences.shift_windows` over
    the same shards.
    """
    register(spark)
    reader = spark.read.format(SEQUENCES).option("pattern", pattern).option("batchSeqs", batch_seqs).option(
        "seqLen", seq_len).option("tasks", spark.sparkContext.defaultParallelism)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(qualified(spark, path))


def stream_sequences(spark: SparkSession, path: str, batch_seqs: int, seq_len: int, until: int, state: dict | None = None,
                     pattern: str = "train_*.bin") -> DataFrame:
    """The endless loader as a stream: ``read, epoch`` and the columns of :func:`read_sequences`; see :class:`SequenceStream`."""
    register(spark)
    return (
        spark.readStream.format(STREAMED).option("pattern", pattern).option("batchSeqs", batch_seqs)
        .option("seqLen", seq_len).option("until", until).option("state", json.dumps(state or {}))
        .option("tasks", spark.sparkContext.defaultParallelism).load(qualified(spark, path)))


def committed_shards(spark: SparkSession, path: str) -> DataFrame:
    """``split, shard_idx, name, tokens, crc32`` of the shards that jobs have committed; of a shard written again, all entries."""
    schema = "split string, shard_idx int, name string, tokens long, crc32 long"
    if not folder_entries(spark, f"{path}/{MANIFEST}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/{MANIFEST}")


def shard_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``name, found, bytes``: the checksum of every shard file, read block by block in its own task."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column("path").to_pylist():
                system, at = file_system(uri)
                found = size = 0
                with system.open_input_stream(at) as f:
                    while data := f.read(4 * BLOCK):
                        found, size = zlib.crc32(data, found), size + len(data)
                rows.append({"name": posixpath.basename(at), "found": found, "bytes": size})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("found", pa.int64()), ("bytes", pa.int64())]))

    return files.repartition("path").mapInArrow(check, "name string, found long, bytes long")


def list_shards(spark: SparkSession, path: str, pattern: str = "*.bin") -> DataFrame:
    """Shard files by name with their token counts; none at all is an error."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        .select("path", F.floor(F.col("length") / 2).cast("long").alias("tokens")).orderBy("path")
    )
    if found.isEmpty():
        raise FileNotFoundError(f"no shard matches {pattern!r} in {path!r}")
    return found


def written_shards(spark: SparkSession, path: str) -> DataFrame:
    """``split, shard_idx`` of the shard files that are there, from their names alone."""
    name = F.element_at(F.split("path", "/"), -1)
    return list_shards(spark, path).select(
        F.regexp_extract(name, _NAME.pattern, 1).alias("split"),
        F.regexp_extract(name, _NAME.pattern, 2).cast("int").alias("shard_idx"))


def write_shard_table(chunks: DataFrame, path: str) -> None:
    """The columnar form: partition folders by split and shard."""
    chunks.repartition("split", "shard_idx").sortWithinPartitions("split", "shard_idx", "shard_pos").write.mode(
        "append").partitionBy("split", "shard_idx").parquet(path)


def publish(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy the ``.bin`` and ``.json`` files of a folder, each in its own task.

    Returns the copied names and sizes; file contents never pass the driver.
    """
    ship_package(spark)
    target = qualified(spark, target)
    files = (
        spark.read.format("binaryFile").load(source).select("path", "length")
        .where(F.col("path").rlike(r"\.(bin|json)$"))
    )

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = file_system(target)
        to.create_dir(base, recursive=True)
        for batch in batches:
            names = []
            for path in batch.column("path").to_pylist():
                system, at = file_system(path)
                names.append(posixpath.basename(at))
                temp = posixpath.join(base, f".{names[-1]}.{uuid.uuid4().hex}")
                fs.copy_files(at, temp, source_filesystem=system, destination_filesystem=to)
                to.move(temp, posixpath.join(base, names[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(names), batch.column("length")], ["name", "bytes"])

    return files.repartition("path").mapInArrow(copy, "name string, bytes long")
