"""Ranked lexical search, term at a time, with a limited set of accumulators.

Index: tasks read whole texts once and write blocks of documents, each an inverted
index of its own: per term of the queries the documents that hold it, with their
counts. Queries come in slices of bounded bytes, so a task knows a bounded number
of terms; more slices are more passes, and their number grows with the queries alone.

Search: a task goes through its blocks. For each query, terms are read rarest first
and add to one accumulator per document. Once the terms that are left can't lift a
new document to the ``top``-th partial score (or to the score that ``top`` documents
of earlier blocks of the task have reached), no accumulator is created any more; the
survivors are still updated exactly by all terms, and drop out when even the rest
can't save them. Bounds are the term's weight times its largest part in the block.
A block gives ``top`` rows per query at most, and one ordering per query merges them.

Scores: with N documents that have a term, L terms in all, n terms of a document,
df documents with a term and tf of it in one document, w = floor(1000 ln((2N+2)/(2df+1))),
m = 100-25+(25nN div L), and a term gives w * (10^9 tf div (1000 tf + 12 m)).

Cases: null and empty texts have no terms; as documents they count for nothing, as
queries they find nothing. Very long texts count whole. Equal scores go by ascending
id, a null id first. Repeated documents are found as often as they are there; queries
with equal id and text count once, equal ids with different texts are queries of their
own. Empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokenloom.llm.common import byte_texts, ready
from tokenloom.session import stage

TOP = 20
#: Texts of queries that one pass answers: this bounds what each task knows of them.
SLICE_BYTES = 1 << 20
#: A block ends with so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Upper-case letters to lower-case ones, all that is no term to spaces.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of digits, letters and what lies beyond ASCII; A-Z lower-cased."""
    return text.translate(_TERMS).split()


@dataclass
class Query:
    """What a task knows of one query: term numbers from the rarest on, weights with repeats."""

    item: object
    terms: np.ndarray
    weights: np.ndarray


def index_blocks(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """One row per block of ``docs`` (doc, text): counts of all its documents, inverted lists of the numbered terms.

    Documents of a block are in id order; ``places`` of a term's list refer to that order.
    """
    id_type = to_arrow_type(docs.schema["doc"].dataType)

    def block(n_docs: int, n_terms: int, rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]) if r[0] is not None else (False, 0))
        sizes = [len(r[2]) for r in rows]
        term = np.fromiter((t for r in rows for t in r[2]), np.int32, sum(sizes))
        tf = np.fromiter((c for r in rows for c in r[2].values()), np.int64, len(term))
        place = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        found, counts = np.unique(term, return_counts=True)
        lists = [pa.array([r[0] for r in rows], id_type), *(pa.array(v) for v in (
            np.array([r[1] for r in rows], np.int64), found, counts.astype(np.int64), place[order], tf[order]))]
        return pa.RecordBatch.from_arrays(
            [pa.array([n_docs]), pa.array([n_terms]),
             *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists)],
            names=["n_docs", "n_terms", "docs", "sizes", "terms", "counts", "places", "tfs"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = postings = 0
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch), strict=True):
                words = terms_of(text)
                n_docs += bool(words)
                n_terms += len(words)
                own = Counter(map(numbers.get, words))
                own.pop(None, None)
                if own:
                    rows.append((doc, len(words), own))
                    postings += len(own)
                if len(rows) == BLOCK_DOCS or postings > BLOCK_POSTINGS:
                    yield block(n_docs, n_terms, rows)
                    n_docs = n_terms = postings = 0
                    rows = []
        if n_docs:
            yield block(n_docs, n_terms, rows)

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(read, f"n_docs long, n_terms long, docs array<{kind}>, sizes array<long>, terms array<int>, "
                                 "counts array<long>, places array<int>, tfs array<long>")


class Block:
    """The inverted lists of a block with the parts that each posting adds per unit of weight."""

    def __init__(self, row: pa.RecordBatch, n_docs: int, n_terms: int):
        def values(name: str) -> np.ndarray:
            return row.column(row.schema.get_field_index(name)).flatten().to_numpy()

        self.docs = row.column(row.schema.get_field_index("docs")).flatten()
        m = 75 + 25 * values("sizes") * n_docs // n_terms
        self.places, tf = values("places"), values("tfs")
        parts = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.places])
        terms = values("terms")
        ends = np.cumsum(values("counts"))
        self.span = dict(zip(terms.tolist(), zip((ends - values("counts")).tolist(), ends.tolist(), strict=True), strict=True))
        self.parts = parts
        self.most = dict(zip(terms.tolist(), np.maximum.reduceat(parts, ends - values("counts")).tolist(), strict=True)) if len(terms) else {}

    def best(self, query: Query, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``top`` best documents, best first, of those that reach ``least``."""
        lists = [(self.span[t], w, w * self.most[t]) for t, w in zip(query.terms.tolist(), query.weights.tolist(), strict=True)
                 if t in self.span]
        rest = sum(bound for _, _, bound in lists)  # what all terms from here on can add
        scores = np.zeros(len(self.docs), dtype=np.int64)
        kth, survivors = max(least, 1), None
        for (a, b), weight, bound in lists:
            if survivors is None and rest < kth:
                survivors = scores > 0
            places, gains = self.places[a:b], weight * self.parts[a:b]
            if survivors is not None:
                own = survivors[places]
                places, gains = places[own], gains[own]
            scores[places] += gains
            rest -= bound
            if survivors is not None:
                survivors &= scores + rest >= kth
            # A partial score only grows, so the top-th is one that `top` documents reach.
            begun = scores[scores > 0] if survivors is None else scores[survivors]
            if len(begun) >= top:
                kth = max(kth, int(np.partition(begun, len(begun) - top)[len(begun) - top]))
        places = np.flatnonzero(scores >= kth if survivors is None else survivors & (scores >= kth))
        chosen = places[np.lexsort((places, -scores[places]))[:top]]
        return chosen, scores[chosen]


def _search(index: DataFrame, queries: list[Query], n_docs: int, n_terms: int, top: int, number: int,
            item_type: pa.DataType, kinds: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)  # best scores of the blocks so far
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1), n_docs, n_terms)
                found = []
                for q, query in enumerate(queries):
                    places, scores = block.best(query, top, int(reached[q][-1]) if len(reached[q]) == top else 0)
                    if len(places):
                        found.append((q, places, scores))
                        reached[q] = -np.sort(-np.concatenate([reached[q], scores]))[:top]
                if found:
                    q = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q.astype(np.int64) * 2 ** 20 + number), pa.array([queries[i].item for i in q], item_type),
                         block.docs.take(pa.array(np.concatenate([f[1] for f in found]))),
                         pa.array(np.concatenate([f[2] for f in found]))],
                        names=["query", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, f"query long, item_id {kinds[0]}, doc_id {kinds[1]}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where(
        F.col("text").isNotNull()).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / slice_bytes))
    item_type, kinds = to_arrow_type(asked.schema["item"].dataType), (
        asked.schema["item"].dataType.simpleString(), texts.schema["doc"].dataType.simpleString())
    found = []
    for number in range(slices):
        own = asked.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == number).collect()
        counted = [(r["item"], c) for r in own if (c := Counter(terms_of(r["text"].encode())))]
        counted.sort(key=lambda x: (str(x[0]), sorted(x[1].items())))
        numbers = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
        index = stage(index_blocks(texts, numbers), "lexical-index")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        # A row per term of this slice at most.
        df = dict(index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(
            F.sum("t.counts")).collect())
        queries = []
        for item, counts in counted:
            known = sorted((df[numbers[t]], numbers[t], c) for t, c in counts.items() if numbers[t] in df)
            weights = np.array([c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d, _, c in known], np.int64)
            queries.append(Query(item, np.array([t for _, t, _ in known], np.int32)[weights > 0], weights[weights > 0]))
        found.append(_search(index, queries, n_docs or 0, n_terms or 0, top, number, item_type, kinds))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id")))
    return reduce(DataFrame.unionByName, found).withColumn("rank", place).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")
