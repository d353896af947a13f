"""The queries with SQL against a second engine, and the whole pipeline against plain loops."""

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_line_dedup, test_ngram_join, test_positional_index, test_quality
from tests.llm.test_best_fit import check_packing
from tokenloom.llm import line_dedup, quality
from tokenloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, name):
    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        result = db.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        got = QUERIES[name](spark, SF)
        columns = sorted(got.columns)
        assert sorted(names) == columns
        want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want


def plain_stages(rows, items):
    """(doc_id, text) of each stage's result, by loops."""
    good = []
    for i, text in rows:
        values = quality.measure_texts([text.encode()])
        assert tuple(int(values[c][0]) for c in quality.COUNTS) == test_quality.plain(text)
        if quality.judge(values)[1][0]:
            good.append((i, text))
    yield good
    left = test_line_dedup.plain(good, line_dedup.MIN_WORDS)
    deduped = [(i, new) for (i, old), new in zip(good, left, strict=True) if new.split() or new == old]
    yield deduped
    _, classes = test_ngram_join.plain([t for _, t in deduped])
    single = [row for k, row in enumerate(deduped) if classes[k] == k]
    yield single
    yield [(i, t) for i, t in single if not test_positional_index.plain(t, items)[3]]


def test_pipeline_matches_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    now = docs
    for (name, apply), want in zip(corpus_pipeline.STAGES[:-1], plain_stages(rows, items), strict=True):
        now = spark.createDataFrame(apply(spark, now, SMALL).collect(), docs.schema)
        assert now.columns == docs.columns, name
        assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == want, name
        assert all(r["n_chars"] == len(r["text"]) for r in now.collect()), name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    check_packing(corpus_pipeline.run(spark, SMALL).collect(), ids, dict(want))


def test_stages_take_odd_and_empty_tables(spark, edge, no_docs):
    for name, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, edge, SMALL).schema == edge.schema, name
        assert apply(spark, no_docs, SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, SMALL).count() == 0
