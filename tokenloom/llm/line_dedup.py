"""Line dedup: later copies of repeated runs of lines are deleted.

A run is some consecutive lines of one text. A line is deleted if it lies in a
run of ``MIN_WORDS`` words or more that also begins at an earlier place of the
corpus (by id, then line). The maximal repeated runs are the union of such runs.

Suffixes of the line sequences are ranked by prefix doubling: two suffixes have
equal rank 0 if their first lines are equal, and equal rank k + 1 if their
ranks k agree, both at their first line and 2**k lines on. Only ranks shared by two suffixes or
more go on, so the tables hold repeated lines alone and shrink from round to
round. The suffixes that share their first L lines form an interval of the suffix
array of common prefix length L or more; it is found by two ranks k that overlap
(2**k <= L < 2**(k+1)). A run with enough words is covered by its shortest such
runs, from each first line on and up to each last line. So intervals are looked up for
these alone, and in each all but the first suffix are later copies.

Cases: a null text stays null and has no line. Lines are split at \\n and equal if
all their characters are. Blank lines have no words, but are part of runs.
Rows with equal ids and texts are one document and get equal results. Null ids come
first. Empty tables give no rows. A text that loses all its lines becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import ready, text_key
from tokenloom.session import stage

MIN_WORDS = 10
_WORD = r"[^\x20\x09-\x0D]+"
#: What is no word.
_BLANK = " \t\n\x0b\x0c\r"


def shortest_runs(doc: np.ndarray, line: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (indexes) of the shortest runs with ``least`` words, from each line on and up to each line.

    Rows are sorted by document and line; a run has neither a gap nor two documents.
    """
    count = len(doc)
    breaks = np.ones(count, dtype=bool)
    breaks[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1] + 1)
    stretch = np.cumsum(breaks)
    after = np.cumsum(words)
    before = after - words
    ends = np.searchsorted(after, before + least, side="left")
    from_here = np.flatnonzero((ends < count) & (stretch[np.minimum(ends, count - 1)] == stretch))
    starts = np.searchsorted(before, after - least, side="right") - 1
    up_to = np.flatnonzero((starts >= 0) & (stretch[np.maximum(starts, 0)] == stretch))
    starts = np.minimum(starts, np.arange(count))
    pairs = np.unique(np.concatenate([
        np.stack([from_here, ends[from_here]], axis=1), np.stack([starts[up_to], up_to], axis=1)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _runs(active: DataFrame, least: int) -> DataFrame:
    """(pos, other, size, k): a shortest run, the place where its second rank k begins, its lines."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)  # narrow rows of one partition
        if not len(table):
            return
        pos, doc, line, words = (table[c].to_numpy() for c in ("pos", "d", "line", "words"))
        starts, ends = shortest_runs(doc, line, words, least)
        size = ends - starts + 1
        k = np.floor(np.log2(size)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pos[starts]), pa.array(pos[ends - (1 << k) + 1]), pa.array(size), pa.array(k.astype(np.int32))],
            names=["pos", "other", "size", "k"])

    ordered = active.repartition("d").sortWithinPartitions("d", "line").select("pos", "d", "line", "words")
    return ordered.mapInArrow(find, "pos long, other long, size long, k int")


def _next_rank(ranks: DataFrame, k: int) -> DataFrame:
    """Ranks k + 1 from ranks k: (pos, d, line, rank) of suffixes that share their first 2**(k+1) lines."""
    later = ranks.select(F.col("d").alias("d2"), (F.col("line") - (1 << k)).alias("line2"), F.col("rank").alias("rank2"))
    pairs = stage(ranks.join(later, (F.col("d") == F.col("d2")) & (F.col("line") == F.col("line2"))).select(
        "pos", "d", "line", "rank", "rank2"), "rank_pairs")
    shared = stage(
        pairs.groupBy("rank", "rank2").agg(F.min("pos").alias("new"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"), "shared_ranks")
    return pairs.join(shared, ["rank", "rank2"]).select("pos", "d", "line", F.col("new").alias("rank"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, key, line, size): runs of lines to delete, from (doc, key, text)."""
    split = docs.where("text IS NOT NULL").select("doc", "key", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    lines = stage(split.select(
        "doc", "key", "line", F.xxhash64("content").alias("h1"), F.xxhash64("content", F.lit(1)).alias("h2"),
        F.regexp_count("content", F.lit(_WORD)).alias("words")), "lines")
    twice = stage(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    # The most common line is a key of very many rows: stored before rows are made distinct, as Spark
    # splits the partitions of a join alone, but not of one that an aggregation reads.
    repeated = stage(lines.join(twice, ["h1", "h2"]), "repeated_lines")
    # Stored in corpus order, so that a place's number tells which comes first.
    places = stage(
        repeated.distinct().orderBy("doc", "key", "line")
        .withColumn("pos", F.monotonically_increasing_id()), "places")
    homes = places.groupBy("doc", "key").agg(F.min("pos").alias("d"))
    active = stage(places.join(
        homes.toDF("home", "home_key", "d"),
        F.col("doc").eqNullSafe(F.col("home")) & (F.col("key") == F.col("home_key"))).drop("home", "home_key"), "active")
    runs = stage(_runs(active, min_words), "runs")

    # Stored like the other tables that hold one row per class: the join then meets a table of known
    # size, and does not lie on the shuffle that has gathered each class for counting.
    first = stage(
        active.groupBy("h1", "h2").agg(F.min("pos").alias("rank"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"), "first_ranks")
    ranks = stage(active.join(first, ["h1", "h2"]).select("pos", "d", "line", "rank"), "ranks")
    top = runs.agg(F.max("k")).first()[0]
    named = None
    for k in range((top if top is not None else -1) + 1):
        # The runs of 2**k to 2**(k+1) - 1 lines are named by two ranks k.
        own = runs.where(F.col("k") == k)
        both = own.join(ranks.select("pos", F.col("rank").alias("r1")), "pos").join(
            ranks.select(F.col("pos").alias("other"), F.col("rank").alias("r2")), "other").select("pos", "size", "r1", "r2")
        named = both if named is None else named.unionByName(both)
        if k < top:
            ranks = stage(_next_rank(ranks, k), "ranks")
    if named is None:
        return active.select("doc", "key", "line", F.lit(0).cast("long").alias("size")).limit(0)
    named = stage(named, "named_runs")
    heads = stage(named.groupBy("size", "r1", "r2").agg(F.min("pos").alias("head")), "heads")
    copies = named.join(heads, ["size", "r1", "r2"]).where("pos > head").select("pos", "size")
    return copies.join(active, "pos").select("doc", "key", "line", "size")


def _rewritten(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``docs`` as c0, c1, … with the text's later copies deleted, and n_lines, n_deleted, worded."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), text_key(text_col).alias("key"),
                       F.col(text_col).cast("string").alias("text"))
    id_text = F.coalesce(F.col("doc").cast("string"), F.lit("\0"))
    deleted = stage(
        later_copies(rows, min_words).groupBy(id_text.alias("__doc"), F.col("key").alias("__key"))
        .agg(F.collect_set(F.struct("line", "size")).alias("runs")), "deleted_runs")
    # By position, so that no name of the table can clash with one of these.
    inner = [f"c{i}" for i in range(len(docs.columns))]
    own, place = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    renamed = docs.toDF(*inner)
    keyed = renamed.withColumns({
        "__doc": F.coalesce(F.col(own).cast("string"), F.lit("\0")),
        "__key": F.xxhash64(F.coalesce(F.col(place), F.lit("")))})
    plain = keyed.join(deleted, ["__doc", "__key"], "left").select(*inner, "runs").withColumn(place, F.col(place).cast("string"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(place)).to_pylist()
            n_lines, n_deleted, worded = [], [], []
            for i, (content, runs) in enumerate(zip(texts, batch.column(names.index("runs")).to_pylist(), strict=True)):
                own = content.split("\n") if content is not None else []
                gone = np.zeros(len(own) + 1, dtype=np.int64)
                for r in runs or ():
                    gone[r["line"]] += 1
                    gone[r["line"] + r["size"]] -= 1
                kept = own
                if runs:
                    stays = np.cumsum(gone)[:-1] == 0
                    kept = [x for x, k in zip(own, stays, strict=True) if k]
                    texts[i] = "\n".join(kept)
                n_lines.append(len(own))
                n_deleted.append(len(own) - len(kept))
                worded.append(any(x.strip(_BLANK) for x in kept) if runs else True)
            columns = [pa.array(texts, pa.string()) if n == place else batch.column(names.index(n)) for n in inner]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64()), pa.array(worded, pa.bool_())],
                names=[*inner, "n_lines", "n_deleted", "worded"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(rewrite, f"{fields}, n_lines long, n_deleted long, worded boolean")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the text's later copies deleted, and __n_lines, __n_deleted, __worded."""
    return _rewritten(docs, min_words, id_col, text_col).toDF(*docs.columns, "__n_lines", "__n_deleted", "__worded")


def delete_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows with later copies deleted; a row whose every line with a word was deleted goes."""
    done = _rewritten(docs, min_words, id_col, text_col)
    return done.where("worded").drop("n_lines", "n_deleted", "worded").toDF(*docs.columns)
