import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import bond_scan

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, anchor_id string, score string, ids string"


def plain(rows, every=10, k=5):
    """All scores, sorted."""
    good = {(i, tuple(math.floor(256 * x) for x in v), c) for i, v, c in rows
            if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    low = lambda i: (i is not None, i or 0)
    out = []
    for a, v, c in good:
        if a is None or a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), low(i), i, d) for i, w, d in good))
        for minus, _, p, _ in [s for s in scored if s[3] == c and s[2] != a][:k]:
            fits = [s for s in scored if s[3] != c and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:k]
            out += [(a, p, rank, s[2], -minus, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(map(repr, out))


def mined(spark, rows, every=10):
    df = spark.createDataFrame([(*r, 1, "a", "s", "i") for r in rows], SCHEMA).repartition(3)
    vectors = df.withColumn("embedding", bond_scan.quantised(F.col("embedding")))
    found = bond_scan.hard_negatives(vectors, F.col("vec_id") % every == 0)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(repr(tuple(r)) for r in found.select(*columns).collect())


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(bond_scan, "BLOCK_VALUES", 300)
    monkeypatch.setattr(bond_scan, "GROUP", 4)


def test_negatives_match_all_scores(spark, small_blocks):
    draw = np.random.default_rng(1)
    centres = draw.normal(0, 0.4, (6, 16))
    rows = [(i, (centres[draw.integers(6)] + draw.normal(0, 0.2, 16)).tolist(), int(draw.integers(3))) for i in range(240)]
    assert mined(spark, rows) == plain(rows)


def test_hot_label_ties_and_odd_rows(spark, small_blocks):
    draw = np.random.default_rng(2)
    same = draw.normal(0, 0.5, 8).round(1).tolist()
    rows = [(i, same, i % 2 if i % 3 else 0) for i in range(90)]  # equal vectors, one label with most rows
    rows += [(1, same, 1), (200, same[:3], 1), (201, [], 0), (210, [0.0] * 8, 0), (211, [0.0] * 8, 1)]
    rows += [(220, None, 1), (221, same, None), (222, [None] * 8, 1), (223, [math.inf] * 8, 1), (224, [math.nan] * 8, 0)]
    rows += [(None, same, 1), (None, same, 0), (30, [-x for x in same], 1), (300, [1e9] * 8, 0), (301, [1e9] * 8, 1)]
    assert mined(spark, rows) == plain(rows)


def test_scan_drops_candidates_and_keeps_scores():
    draw = np.random.default_rng(3)
    table = draw.integers(-200, 200, (32, 500))
    block = bond_scan.Block({"dims": 32, "ids": list(range(500)), "labels": ["x"] * 500, "columns": np.ascontiguousarray(table).tobytes()})
    vector = np.zeros(32, np.int64)
    vector[:3], vector[3:] = (500, -300, 200), draw.integers(-3, 3, 29)
    looked = []

    def prune(lower, upper):
        looked.append(len(lower))
        return upper >= np.partition(lower, len(lower) - 5)[len(lower) - 5]

    places, scores = block.scan(vector, np.arange(500), prune)
    want = vector @ table
    assert scores.tolist() == want[places].tolist()
    assert set(np.argsort(-want, kind="stable")[:5]) <= set(places.tolist())
    assert looked[-1] < looked[0]


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 0)]) == []  # no anchor
    assert mined(spark, [(0, [1.0], 1), (2, [1.0], 0)]) == []  # no positive
