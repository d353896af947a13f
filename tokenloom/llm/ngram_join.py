"""N-gram Jaccard self-join with banded MinHash and exact verification.

A text is its set of five-word shingles (lower-case A-Z; a text of fewer words is
one shingle). Texts with equal sets are one class, and one of them goes on.

Bands in place of a forest: a signature gives each of ``TREES`` trees the digest of its
first ``matched_length`` minima, of ``DEPTH`` at most. That length follows from the threshold
and the target probability alone, not from the data; longer labels aren't computed, as
texts that share them share this prefix too. Nodes with two members or more connect
their members in a star, and components of these stars hold all candidate pairs.

Verification: only members of components read their texts again and send their
shingle sets, once, to their component. A large component is dealt into tiles by a hash,
and each pair of tiles is a unit of its own, so no task gets a whole hot group. Units
compare sets exactly and give, per member, its number of links and the
smallest member it is connected to: never one row per pair.

Cases: null and empty texts have no shingle and no link; each is its own class.
Repeated rows are copies of each other. A null id can be the smallest of its class.
Empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokenloom.llm.common import byte_texts, ready, text_key
from tokenloom.llm.components import components
from tokenloom.llm.wordhash import U64, Hashed, hashed_groups, mix, ngram_hashes, running_words
from tokenloom.session import stage

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
RECALL = 0.9995
#: A tile's members and shingles, on average.
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 20
_COLUMNS = 8192
#: A plan of at most so many narrow rows (some 100 MB) is broadcast.
BROADCAST_ROWS = 500_000
_FACTORS = mix(np.arange(1, TREES * DEPTH + 1, dtype=U64)) | U64(1)
_SHIFTS = mix(np.arange(1001, TREES * DEPTH + 1001, dtype=U64))


def matched_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten the matched prefix until a pair at the threshold meets in some tree with probability ``recall``."""
    length = depth
    while length > 1 and 1 - (1 - threshold ** length) ** trees < recall:
        length -= 1
    return length


def shingle_sets(group: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingles of each text of the group, and where each text's begin."""
    count = len(group.offsets) - 1
    sums, owner = running_words(group.words), group.owner
    sizes = np.diff(group.offsets)
    hashes = ngram_hashes(sums, WORDS)
    whole = np.flatnonzero(owner[: len(hashes)] == owner[WORDS - 1:]) if len(hashes) else np.zeros(0, np.int64)
    parts, owners = [hashes[whole]], [owner[whole]]
    for n in range(1, WORDS):  # short texts are one shingle
        short = np.flatnonzero(sizes == n)
        if len(short):
            parts.append(ngram_hashes(sums, n)[group.offsets[short]])
            owners.append(short)
    shingles, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    fresh = np.ones(len(shingles), dtype=bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[fresh], owner[fresh]
    return shingles, np.searchsorted(owner, np.arange(count + 1))


def _labels(shingles: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """Per text (none of them empty) and tree, the node of its label's prefix."""
    nodes = np.empty((len(begins), TREES), dtype=U64)
    for tree in range(TREES):
        node = np.full(len(begins), tree + 1, dtype=U64)
        for level in range(length):
            k = tree * DEPTH + level
            node = mix(node ^ np.minimum.reduceat(shingles * _FACTORS[k] + _SHIFTS[k], begins))
        nodes[:, tree] = node
    return nodes


def signatures(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """doc, key, n (shingles), same (digest of the set), nodes (one per tree): a row per text with a word."""
    length = matched_length(threshold, recall)
    id_type = to_arrow_type(docs.schema["doc"].dataType)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for group in hashed_groups(byte_texts(batch), lower=True):
                shingles, cuts = shingle_sets(group)
                sizes = np.diff(cuts)
                rows = np.flatnonzero(sizes)
                if not len(rows):
                    continue
                begins = cuts[:-1][rows]
                digest = np.stack([np.add.reduceat(mix(shingles), begins),
                                   np.add.reduceat(mix(shingles ^ U64(0x94D049BB133111EB)), begins)], axis=1)
                nodes = _labels(shingles, begins, length).view(np.int64)
                here = pa.array(rows + group.first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(here).cast(id_type), keys.take(here), pa.array(sizes[rows]),
                     pa.array([d.tobytes() for d in digest], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * TREES),
                                              pa.array(nodes.reshape(-1)))],
                    names=["doc", "key", "n", "same", "nodes"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc {kind}, key long, n long, same binary, nodes array<long>")


def _sets_of(docs: DataFrame) -> DataFrame:
    """The rows with their shingles for text; a task sends each member once, however often it holds its row."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            members = batch.column(0).to_pylist()
            fresh = [i for i, m in enumerate(members) if m not in sent and not sent.add(m)]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for group in hashed_groups(byte_texts(batch), lower=True):
                shingles, cuts = shingle_sets(group)
                count = len(cuts) - 1
                rest = [c.slice(group.first, count) for c in batch.columns[:-1]]
                sets = pa.array([shingles[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest, sets], names=[*batch.schema.names[:-1], "shingles"])
    return docs.mapInArrow(read, "member long, root long, copies long, parts long, tile long, shingles binary")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left set shares with each right set."""
    sides = [*left, *right]
    owner = np.repeat(np.arange(len(sides)), [len(s) for s in sides])
    values = np.concatenate(sides)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1  # others overlap with nothing
    owner, column = owner[shared], np.cumsum(fresh[shared]) - 1
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        table = np.zeros((len(sides), _COLUMNS), dtype=np.float32)
        table[owner[a:b], column[a:b] - at] = 1
        out += table[: len(left)] @ table[len(left):].T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    shared = _overlaps(left, right).astype(float)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - shared
    return shared >= threshold * union - 1e-9


def verify_unit(tiles: list[int], members: np.ndarray, copies: np.ndarray, sets: list[np.ndarray],
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked copies of each member, and the smallest member its links connect it to, within a unit.

    A unit of one tile compares all pairs; a unit of two tiles those across.
    """
    first = np.array(tiles) == min(tiles)
    if first.all():
        rows = cols = np.arange(len(members))
    else:
        rows, cols = np.flatnonzero(first), np.flatnonzero(~first)
    linked = _linked([sets[i] for i in rows], [sets[i] for i in cols], threshold)
    if first.all():
        np.fill_diagonal(linked, False)
    links = np.zeros(len(members), dtype=np.int64)
    links[rows] = linked @ copies[cols]
    if not first.all():
        links[cols] = linked.T @ copies[rows]
    root, high = members.copy(), np.iinfo(np.int64).max
    while True:
        now = root.copy()
        if linked.size:
            now[rows] = np.minimum(now[rows], np.where(linked, root[cols][None, :], high).min(axis=1))
            now[cols] = np.minimum(now[cols], np.where(linked, now[rows][:, None], high).min(axis=0))
        if (now == root).all():
            return links, root
        root = now


def _verify(units: DataFrame, threshold: float) -> DataFrame:
    """(member, links, root, parts) of every member in every unit where it has a link."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, own in groupby(rows(batches), key=lambda r: r[:3]):
            own = list({r[4]: r for r in own}.values())  # a repeated row comes from several tasks
            members = np.array([r[4] for r in own], dtype=np.int64)
            copies = np.array([r[5] for r in own], dtype=np.int64)
            sets = [np.frombuffer(r[6], dtype="<u8") for r in own]
            links, root = verify_unit([r[3] for r in own], members, copies, sets, threshold)
            out += [(m, n, r, own[0][7]) for m, n, r in zip(members.tolist(), links.tolist(), root.tolist(), strict=True) if n]
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    keys = ["root", "low", "high"]
    grouped = units.repartition(*keys).sortWithinPartitions(*keys).select(
        *keys, "tile", "member", "copies", "shingles", "parts")
    return grouped.mapInArrow(run, "member long, links long, root long, parts long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["member", "links", "root", "parts"])


def _join_rows(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc, key, same), and per different set its member data (same, first, links, root_first)."""
    signed = stage(signatures(docs, threshold, recall), "signatures")
    # One member per different set. Stored, so that the numbers are drawn once.
    members = stage(
        signed.groupBy("same").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "key")).alias("first"),
            F.first("n").alias("n"), F.first("nodes").alias("nodes"))
        .withColumn("member", F.monotonically_increasing_id()), "members")
    placed = members.select("member", F.explode("nodes").alias("node"))
    nodes = placed.groupBy("node").agg(F.min("member").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = placed.join(nodes, "node").select(F.col("member").alias("a"), "b")
    groups = stage(components(stars).withColumnRenamed("node", "member"), "groups")

    plan = groups.join(members.select("member", "n", "copies", "first"), "member")
    sizes = groups.join(members.select("member", "n"), "member").groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("long").alias("parts"))
    plan = stage(plan.join(sizes, "root").select(
        "member", "root", "copies", "parts", F.col("first.doc").alias("m_doc"), F.col("first.key").alias("m_key"),
        F.pmod(F.xxhash64("member"), F.col("parts")).alias("tile")), "tiles")
    # The texts of members alone. A plan of bounded size goes to the texts; a larger one meets them in a shuffle.
    wanted = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    texts = docs.join(wanted, docs["doc"].eqNullSafe(wanted["m_doc"]) & (docs["key"] == wanted["m_key"])).select(
        "member", "root", "copies", "parts", "tile", "text")
    units = _sets_of(texts).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    ).select("*", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    linked = stage(_verify(units, threshold), "links")

    # Components that were one unit are done; the others' stars are joined.
    apart = linked.where("parts > 1")
    roots = linked.where("parts = 1").select("member", F.col("root"))
    if not apart.isEmpty():
        roots = roots.unionByName(
            components(apart.select(F.col("member").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "member"))
    counts = linked.groupBy("member").agg(F.sum("links").alias("links"))
    known = members.join(counts, "member", "left").join(roots, "member", "left").select(
        "member", "same", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("root", "member").alias("root"))
    known = stage(known, "linked_members")
    firsts = known.groupBy("root").agg(F.min("first").alias("class_first"))
    return signed, stage(known.join(firsts, "root").select("same", "copies", "links", "class_first"), "classes")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id of its class), n_links (other rows at the threshold or above), n_copies.

    Copies (rows with the same shingles) count as links too; n_copies has them alone.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), text_key(text_col).alias("key"),
                       F.col(text_col).cast("string").alias("text"))
    signed, classes = _join_rows(rows, threshold, recall)
    found = signed.join(classes, "same").select(
        F.col("doc").alias("doc_id"), F.col("class_first.doc").alias("class_id"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    empty = rows.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(
        F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return found.unionByName(empty)


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each class, and every row without a word, with all their columns."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), text_key(text_col).alias("key"),
                       F.col(text_col).cast("string").alias("text"))
    _, classes = _join_rows(rows, threshold, recall)
    # By position, so that no name of the table can clash with one of these.
    inner = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*inner)
    own, place = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    name = F.coalesce(F.col(own).cast("string"), F.lit("\0"))
    stays = classes.select(F.coalesce(F.col("class_first.doc").cast("string"), F.lit("\0")).alias("__doc"),
                           F.col("class_first.key").alias("__key")).distinct()
    text = F.coalesce(F.col(place).cast("string"), F.lit(""))
    keyed = renamed.withColumns({"__doc": name, "__key": F.xxhash64(text), "__worded": text.rlike(r"[^\x20\x09-\x0D]")})
    chosen = keyed.where("__worded").join(stays, ["__doc", "__key"])
    # Equal rows share id and text; the join has already brought them together.
    one = chosen.withColumn("__copy", F.row_number().over(Window.partitionBy("__doc", "__key").orderBy("__key")))
    kept = one.where("__copy = 1").select(*inner).unionByName(keyed.where("NOT __worded").select(*inner))
    return kept.toDF(*docs.columns)
