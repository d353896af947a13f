import random

from tests.llm.conftest import SCHEMA, edge_rows
from tokenloom.llm import line_dedup
from tokenloom.llm.queries import OP5_SQL  # noqa: F401  (the query is compared with it in test_queries)


def plain(rows, least):
    """Lines left of each (order, text) by trying every run against all earlier places."""
    lines = [t.split("\n") if t is not None else [] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    first: dict[tuple, tuple] = {}
    for at, i in enumerate(order):
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                first.setdefault(tuple(lines[i][a:b]), (at, a))
    out = [None] * len(rows)
    for at, i in enumerate(order):
        gone = set()
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                if sum(len(x.split()) for x in lines[i][a:b]) >= least and first[tuple(lines[i][a:b])] < (at, a):
                    gone.update(range(a, b))
        out[i] = None if rows[i][1] is None else "\n".join(x for k, x in enumerate(lines[i]) if k not in gone)
    return out


def test_random_texts_match_all_runs(spark):
    draw = random.Random(5)
    pool = ["a b c", "d e", "", "f", "g h i j k", "l m n o p q r s t u v", " "]
    texts = ["\n".join(draw.choice(pool) if draw.random() < 0.7 else f"only {draw.random()} here"
                       for _ in range(draw.randrange(0, 14))) for _ in range(60)]
    texts += [texts[3], texts[10] + "\nmore", "x y\n" * 9, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for least in (1, 4, 10):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, least).collect()}
        assert [got[i] for i in range(len(texts))] == plain(list(enumerate(texts)), least)


def test_odd_rows(spark, edge, no_docs):
    done = line_dedup.dedup_lines(edge)
    assert done.columns == [*edge.columns, "__n_lines", "__n_deleted", "__worded"]
    rows = done.collect()
    assert len(rows) == len(edge_rows())
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["text"] for r in by_id[1]] == [None] and [r["text"] for r in by_id[2]] == [""]
    # Repeated rows are one document; 5 is a copy of a text of 4; 11 keeps its first line; 6 is first, 7 its copy.
    assert len({r["text"] for r in by_id[8]}) == 1 and by_id[8][0]["__n_deleted"] == 0
    assert by_id[5][0]["text"] == "" and not by_id[5][0]["__worded"]
    assert by_id[11][0]["__n_deleted"] == 29
    assert by_id[6][0]["__n_deleted"] == 0 and by_id[7][0]["__n_deleted"] > 3000
    kept = line_dedup.delete_copies(edge)
    assert kept.schema == edge.schema and kept.count() == len(edge_rows()) - 1
    assert line_dedup.dedup_lines(no_docs).count() == 0
    lines = spark.createDataFrame([r for r in edge_rows() if r[1] is None], SCHEMA)
    assert line_dedup.delete_copies(lines).count() == 2


def test_columns_of_any_name_and_words_of_odd_spaces(spark):
    """Own columns keep their values, and a no-break space or a separator alone is still a word."""
    run = "one line of twelve words that will be there again and again here"
    rows = [(i, run + end, f"a{i}", f"b{i}", i, f"d{i}", f"e{i}") for i, end in enumerate(["", "\n ", "\n\x1c", "\n \t", ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc string, __key string, __worded int, __runs string, c1 string")
    left = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.delete_copies(docs).collect()}
    assert left == {0: (run, *rows[0][2:]), 1: (" ", *rows[1][2:]), 2: ("\x1c", *rows[2][2:])}
    assert line_dedup.dedup_lines(docs).count() == 5
