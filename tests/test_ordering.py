import hashlib

import pytest

from pyspark.sql import functions as F

from tokenloom.operators import ordering
from tokenloom.operators.ordering import epoch_permutations, running_totals, seeded_order, seeded_sample


def test_running_totals_across_ranges(spark, many_ranges):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", (i * 37) % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = {r["id"]: (r["before"], r["place"]) for r in
           running_totals(df, ["id"], {"v": "before"}, group_by=["g"], rank="place").collect()}
    seen, count = {}, {}
    for i, g, v in rows:
        assert got[i] == (seen.get(g, 0), count.get(g, 0))
        seen[g], count[g] = seen.get(g, 0) + v, count.get(g, 0) + 1


def test_running_totals_without_group(spark, many_ranges):
    df = spark.range(300).withColumn("v", F.col("id") + 1)
    out = running_totals(df, ["id"], {"v": "before"}, rank="place")
    assert out.where((F.col("before") != F.col("id") * (F.col("id") + 1) / 2) | (F.col("place") != F.col("id"))).count() == 0
    assert out.count() == 300


def test_lift_rows_are_bounded_by_ranges(spark, many_ranges):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), F.lit(1).alias("v"))
    out = running_totals(df, ["id"], {"v": "before"}, group_by=["g"])
    assert out.where(F.col("before") != F.floor(F.col("id") / 2)).count() == 0


def _key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_seeded_order_and_sample(spark, many_ranges):
    df = spark.range(100).withColumn("text", F.concat(F.lit("t"), "id"))
    want = sorted(range(100), key=lambda i: (_key(5, i), i))
    got = seeded_order(df, 5, ["id"]).orderBy("place").collect()
    assert [r["id"] for r in got] == want and all(r["text"] == f"t{r['id']}" for r in got)
    first = seeded_sample(df, 5, ["id"], 17).orderBy("place").collect()
    assert [r["id"] for r in first] == want[:17]


def test_epoch_permutations_differ(spark):
    rows = epoch_permutations(spark.range(50), ["id"], 3, 10).collect()
    orders = [[r["id"] for r in sorted((r for r in rows if r["epoch"] == e), key=lambda r: r["place"])] for e in range(3)]
    for e, order in enumerate(orders):
        assert order == sorted(range(50), key=lambda i: (_key(e * 10, i), i))
    assert orders[0] != orders[1] != orders[2]


@pytest.mark.parametrize("n,buffer", [(0, 5), (4, 5), (5, 5), (60, 1), (200, 7), (150, 40)])
def test_buffered_shuffle_equals_the_loop(spark, n, buffer):
    def draw(key):
        return hashlib.md5(key.encode()).hexdigest()

    held, out = list(range(min(n, buffer))), []
    for step, item in enumerate(range(buffer, n)):
        slot = int(draw(f"3:{step}")[:12], 16) % buffer
        out.append(held[slot])
        held[slot] = item
    out += [held[s] for s in sorted(range(len(held)), key=lambda s: (draw(f"3:end:{s}"), s))]
    got = ordering.buffered_shuffle(spark.range(n), ["id"], 3, buffer).orderBy("place").collect()
    assert [r["id"] for r in got] == out and [r["place"] for r in got] == list(range(n))
