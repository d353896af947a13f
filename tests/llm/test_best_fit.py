import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import edge_rows, prose
from tokenloom.llm import best_fit
from tokenloom.llm.queries import QUERIES


@functools.cache
def _tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def plain_ids():
    return lambda text: [*_tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, plain_ids, texts):
    """Every piece is there, holds its ids, and sequences are gapless and not too long."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = plain_ids(texts[doc])
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:at], dtype="<u4").tobytes())
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_query_packs_everything_tightly(spark, plain_ids):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_best_fit_packing"](spark, sf).collect()
    count = check_packing(rows, plain_ids, texts)
    assert count <= -(-sum(r["length"] for r in rows) // 1024) + 4


def test_many_tasks_are_joined_over_levels(spark, plain_ids, monkeypatch):
    monkeypatch.setattr(best_fit, "FAN_IN", 3)
    texts = {i: prose(i, 5 + i % 60) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(20)
    rows = best_fit.pack_best_fit(docs).collect()
    count = check_packing(rows, plain_ids, texts)
    assert count <= -(-sum(r["length"] for r in rows) // 1024) + 3


@pytest.mark.parametrize("words", [(5, 60), (300, 460)])
def test_no_sequence_is_lost_by_what_is_not_passed_on(spark, monkeypatch, words):
    """As many sequences as with every underfull bin passed on, where tasks hold many of them."""
    monkeypatch.setattr(best_fit, "FAN_IN", 2)
    monkeypatch.setattr(best_fit, "LEVELS", 4)
    low, high = words
    rows = [(i, prose(i, low + i * 7919 % (high - low))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)

    def sequences():
        return best_fit.pack_best_fit(docs).select("sequence_id").distinct().count()

    found = sequences()
    monkeypatch.setattr(best_fit, "passed_at", lambda level: 1 << 30)
    assert found == sequences()


def test_odd_rows(edge, no_docs, plain_ids):
    rows = best_fit.pack_best_fit(edge).collect()
    assert sum(r["length"] for r in rows) == sum(len(plain_ids(t)) for _, t, *_ in edge_rows())
    assert sum(r["piece"] == 0 for r in rows) == len(edge_rows())
    assert best_fit.pack_best_fit(no_docs).count() == 0


ODD = ["", "a", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n\nb c", "x<|endoftext|> y <|endoftext|>", "it's we'll", "a　 b",
       "1 234 5a !! \t\t x", "é à b", "a\x1c b", "a\x85 b", "a​ b", "﻿ a", "don 't I 'm", "a  b"]


@settings(deadline=None)  # the first call loads the vocabulary
@given(st.lists(st.sampled_from([*ODD, "word", "\n", "'s ", "Übung "])).map("".join))
def test_ids_are_the_tokenizers(text):
    assert best_fit.encoder()(text).tolist() == _tokenizer().encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_never_overfills(sizes):
    bins, offsets, fills = best_fit.best_fit(np.array(sizes, dtype=np.int64), 64)
    assert max(fills, default=0) <= 64 and sum(fills) == sum(sizes)
    assert sum(f <= 32 for f in fills) <= 1  # two half-empty bins would have been one
    for b in range(len(fills)):
        own = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in own] == np.cumsum([0, *(s for _, s in own)])[:-1].tolist()


def test_cut_puts_the_short_piece_first():
    assert best_fit.cut(1024) == [(0, 1024)]
    assert best_fit.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]
    assert best_fit.cut(2048) == [(0, 1024), (1024, 1024)]
