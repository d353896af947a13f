import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import edge_rows
from tokenloom.llm import quality
from tokenloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words, seen, copies, repeated = WORD.findall(text), set(), 0, set()
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    for i in range(len(words) - 7):
        if grams[tuple(words[i:i + 8])] > 1:
            repeated.update(range(i, i + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(repeated)


def covered_share(text, n):
    """Share of word characters inside n-grams found twice."""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    inside = {j for i in range(len(words) - n + 1) if grams[tuple(words[i:i + n])] > 1 for j in range(i, i + n)}
    return sum(len(words[j]) for j in inside) / max(1, sum(map(len, words)))


def test_counts_on_odd_rows(edge):
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in quality.COUNTS))
                   for r in quality.quality_rules(edge).collect())
    assert found == sorted((i is None, i or 0, *plain(t)) for i, t, *_ in edge_rows())


def test_query_matches_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op1_quality_rules"](spark, sf).collect():
        n = plain(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        for size in quality.NGRAM_LIMITS:
            assert abs(r[f"dup_{size}gram"] - covered_share(texts[r["doc_id"]], size)) < 1e-12
        assert not (r["base_failed"] and r["kept"])


def test_repetitive_texts_go_and_plain_ones_stay(edge):
    rows = {r["doc_id"]: r["kept"] for r in quality.quality_rules(edge).where("doc_id > 4").collect()}
    assert rows == {5: True, 6: True, 7: True, 8: True, 9: False, 10: False, 11: False}


def test_keep_good_keeps_columns_and_agrees(edge, no_docs):
    good = quality.keep_good(edge)
    assert good.schema == edge.schema
    assert good.count() == quality.quality_rules(edge).where("kept").count()
    assert good.where(F.col("c0") != "c").count() == 0
    assert quality.keep_good(no_docs).count() == quality.quality_rules(no_docs).count() == 0
