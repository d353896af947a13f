import re

import pytest

from tests.llm.conftest import edge_rows, prose
from tokenloom.llm import positional_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, width=10):
    own, hit, found = words(text), set(), set()
    for item, content in items:
        w = words(content)
        for s in range(max(len(w) - width, 0) + 1 if w else 0):
            window = w[s:s + width]
            for p in range(len(own) - len(window) + 1):
                if own[p:p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found), bool(hit)


@pytest.fixture(scope="module")
def items():
    passage = " ".join(prose(50, 40).split())
    return [(1, passage), (2, "Just three words"), (3, None), (3, "!!"), (4, "x"), (None, "CAFÉ w1x"),
            (5, passage.upper()), (6, "same line here same line")]


def both(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, key int, pos string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return docs.repartition(3), bench


def test_hits_match_plain_search(spark, items):
    passage = items[0][1].split()
    texts = [t for _, t, *_ in edge_rows() if len(t or "") < 3000] + [
        " ".join(passage), " ".join(passage[5:30]), " ".join(passage[:9]), "a " + " ".join(passage[3:13]) + " b",
        " ".join(passage[:12] + passage[:12]), "café w1x just three words x", "CAFÉ w1x", "the same line here same line here same line"]
    rows = [(i // 2, t, "1", 0, "p", 9) for i, t in enumerate(texts)] + [(None, "x", "1", 0, "p", 9), (0, texts[0], "1", 0, "p", 9)]
    docs, bench = both(spark, rows, items)
    got = positional_index.contamination(docs, bench).collect()
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got)
    assert found == sorted(((i is None, i or 0), *plain(t, items)) for i, t, *_ in rows)
    kept = positional_index.drop_contaminated(docs, bench)
    assert kept.schema == docs.schema
    assert kept.count() == sum(not plain(t, items)[3] for _, t, *_ in rows)


def test_very_long_texts_match_a_dictionary_of_windows(spark, items):
    """40,000 words, with windows at both ends, in the middle and overlapping, against a look-up of every place."""
    long = next(t for _, t, *_ in edge_rows() if len(words(t)) >= 40_000).split()
    passage = items[0][1].split()
    bench = [*items[:1], (7, " ".join(long[:10])), (8, " ".join(long[20_000:20_025])), (9, " ".join(long[-10:]))]
    rows = [(1, " ".join(long), "", 0, "", 0), (2, " ".join(passage[:12] + long + passage[-11:]), "", 0, "", 0),
            (3, " ".join(reversed(long)), "", 0, "", 0)]
    windows = {}
    for item, text in bench:
        w = words(text)
        for s in range(len(w) - 9):
            windows.setdefault(tuple(w[s:s + 10]), set()).add(str(item))
    want = {}
    for i, text, *_ in rows:
        own, hit, found = words(text), set(), set()
        for p in range(len(own) - 9):
            if (who := windows.get(tuple(own[p:p + 10]))):
                hit.update(range(p, p + 10))
                found |= who
        want[i] = (len(own), len(hit), sorted(found))
    docs, bench_table = both(spark, rows, bench)
    got = positional_index.contamination(docs, bench_table).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    assert [len(want[i][2]) for i in (1, 2, 3)] == [3, 4, 0]


def test_empty_tables(spark, items):
    docs, bench = both(spark, [(1, "just three words", "", 0, "", 0)], items)
    assert positional_index.contamination(docs.limit(0), bench).count() == 0
    clean = positional_index.contamination(docs, bench.limit(0)).collect()
    assert [(r["n_hit"], r["items"], r["contaminated"]) for r in clean] == [(0, [], False)]


def test_proximity_finds_moved_words_and_exact_does_not(spark):
    passage = prose(51, 10).split()
    docs, bench = both(spark, [(1, " ".join(passage[:5] + ["inserted"] + passage[5:]), "", 0, "", 0),
                               (2, " ".join(passage[:3]), "", 0, "", 0)], [(1, " ".join(passage))])
    assert positional_index.find_windows(docs, bench)[1].count() == 0
    near = positional_index.find_windows(docs, bench, slop=1)[1].collect()
    assert {r["doc"] for r in near} == {1}


def test_no_python_in_the_plan(spark, items):
    docs, bench = both(spark, [(1, "just three words", "", 0, "", 0)], items)
    plan = positional_index.contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
