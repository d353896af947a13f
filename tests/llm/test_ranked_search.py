import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import edge_rows, prose
from tokenloom.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    """Every score of every document, by the formula."""
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(size > 0 for _, _, size in own), sum(size for _, _, size in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, counts, size in own:
            m = 75 + 25 * size * n // total if total else 0
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * counts[t] // (1000 * counts[t] + 12 * m))
                        for t, k in Counter(terms(text)).items() if counts[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, rank, doc if known else None, -low) for rank, (low, known, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(repr, out))


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def items():
    return [(1, " ".join(prose(2, 60).split()[:20])), (1, " ".join(prose(3, 80).split()[5:9])), (2, None), (3, "!! ,,"),
            (4, "SAME line of text, same LINE w3x77 zzz"), (4, "SAME line of text, same LINE w3x77 zzz"), (None, "just three café"),
            (5, prose(1, 4000))]


def test_ranks_match_all_scores(spark, edge, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, t) for i, t, *_ in edge_rows()]
    for top, slice_bytes in ((20, 1 << 20), (2, 1 << 20), (3, 9000)):
        assert rows(rs.ranked_search(edge, asked, top, slice_bytes=slice_bytes)) == plain(docs, items, top)


def test_frequent_and_rare_words_over_many_blocks(spark, monkeypatch):
    draw = random.Random(5)
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(i, " ".join(draw.choices([f"t{k}" for k in range(300)], weights, k=draw.randrange(1, 60)))) for i in range(1500)]
    docs += [(5000 + i, docs[7][1]) for i in range(60)]  # ties beyond the result
    items = [(i, " ".join(draw.choices([f"t{k}" for k in range(300)], k=6)) + " t0 t1 t2 t0") for i in range(12)] + [(99, docs[7][1])]
    got = rs.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                           spark.createDataFrame(items, "item_id long, text string"), 5)
    assert rows(got) == plain(docs, items, 5)


def test_accumulators_are_limited_and_scores_stay_whole():
    """A block by hand: few accumulators, the same best documents as with all of them."""
    draw = np.random.default_rng(3)
    import pyarrow as pa
    n, lists = 400, []
    for size in (5, 40, 390):
        lists.append((np.sort(draw.choice(n, size, replace=False)).astype(np.int32), draw.integers(1, 9, size)))
    row = pa.RecordBatch.from_pylist([{
        "docs": list(range(n)), "sizes": [50] * n, "terms": [0, 1, 2], "counts": [5, 40, 390],
        "places": np.concatenate([p for p, _ in lists]).tolist(), "tfs": np.concatenate([t for _, t in lists]).tolist()}])
    block = rs.Block(row, n, 50 * n)
    weights = np.array([9000, 2000, 1])
    scores = np.zeros(n, np.int64)
    for w, (places, _), (a, b) in zip(weights, lists, [block.span[t] for t in range(3)], strict=True):
        scores[places] += w * block.parts[a:b]
    best = np.lexsort((np.arange(n), -scores))[:4]
    places, found = block.best(rs.Query("q", np.array([0, 1, 2], np.int32), weights), 4, 0)
    assert places.tolist() == best.tolist() and found.tolist() == scores[best].tolist()
    assert len(block.best(rs.Query("q", np.array([0, 1, 2], np.int32), weights), 4, int(scores.max()) + 1)[0]) == 0


def test_empty_tables(spark, edge, no_docs, items):
    asked = spark.createDataFrame([(*r, 1, "s") for r in items], "item_id long, text string, rank int, score string")
    assert rs.ranked_search(no_docs, asked).count() == 0
    assert rs.ranked_search(edge, asked.limit(0)).count() == 0
