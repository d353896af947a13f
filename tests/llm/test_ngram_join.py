import random
from collections import Counter

import pytest

from tests.llm.conftest import edge_rows, prose
from tokenloom.llm import ngram_join
from tokenloom.llm.components import components


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(texts, threshold=0.8):
    """Links of each row, and the class (smallest row of its component)."""
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(sets))), Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [links[i] for i in range(len(sets))], [top(i) for i in range(len(sets))]


def edited(text, changes, seed):
    words, draw = text.split(), random.Random(seed)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def crowd():
    """A hot group of near copies, exact copies, small groups, and single texts."""
    base = prose(10, 150)
    texts = [edited(base, k % 7, k) for k in range(120)] + [base] * 40
    for g in range(15):
        one = prose(100 + g, 90)
        texts += [one, edited(one, 1, g), edited(one, 2, g + 50), edited(one, 30, g)]
    return texts + [prose(1000 + i, 30) for i in range(30)] + ["a b", "A b", "a b c", "", None]


@pytest.mark.parametrize("tile_rows", [1024, 7])
def test_links_and_classes_match_all_pairs(spark, crowd, monkeypatch, tile_rows):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile_rows)
    docs = spark.createDataFrame(list(enumerate(crowd)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r for r in ngram_join.jaccard_join(docs).collect()}
    links, classes = plain(crowd)
    assert [found[i]["n_links"] for i in range(len(crowd))] == links
    assert [found[i]["class_id"] for i in range(len(crowd))] == classes
    kept = ngram_join.keep_one_of_each(docs)
    assert sorted(r[0] for r in kept.collect()) == sorted(set(classes))


def test_odd_rows(edge, no_docs):
    rows = ngram_join.jaccard_join(edge).collect()
    assert len(rows) == len(edge_rows())
    links, _ = plain([t for _, t, *_ in edge_rows()])
    assert sorted(r["n_links"] for r in rows) == sorted(links)
    kept = ngram_join.keep_one_of_each(edge)
    assert kept.schema == edge.schema
    # Gone: a repeated row of 4, 5 (as 4), 7 (as 6), a repeated row of 8; texts without words all stay.
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: -1 if i is None else i)
    assert ids == [None, None, 1, 2, 3, 4, 4, 6, 8, 9, 10, 11]
    assert ngram_join.jaccard_join(no_docs).count() == ngram_join.keep_one_of_each(no_docs).count() == 0


def test_prefix_is_shortened_until_the_target():
    assert ngram_join.matched_length(recall=0.5) > ngram_join.matched_length(recall=0.9995) >= 1
    length = ngram_join.matched_length()
    assert 1 - (1 - 0.8 ** length) ** ngram_join.TREES >= ngram_join.RECALL


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 901), (901, 900)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(500, 560), 500), 900: 900, 901: 900}


def test_columns_of_any_name(spark):
    texts = ["the same five words here", "the same five words here", "", "other words that differ much"]
    rows = [(i, t, f"a{i}", f"b{i}", i, f"c{i}", f"d{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc string, __key string, __worded int, __copy string, c0 string")
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]
