import re

import numpy as np

from tests.llm.conftest import prose
from tokenloom.llm import wordhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_words_are_told_apart_as_a_pattern_would():
    texts = [b"", b" ", b"a b  a\tb\n", "é é ü\xa0x".encode(), prose(5, 3000).encode(), b"A a"]
    seen: dict[int, bytes] = {}
    groups = list(wordhash.hashed_groups(texts, lower=False))
    for g in groups:
        for t in range(len(g.offsets) - 1):
            own = WORD.findall(texts[g.first + t])
            hashes = g.words[g.offsets[t]:g.offsets[t + 1]].tolist()
            assert len(own) == len(hashes)
            assert [len(w.decode()) for w in own] == g.chars[g.offsets[t]:g.offsets[t + 1]].tolist()
            for w, h in zip(own, hashes, strict=True):
                assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_long_texts_hash_as_short_ones_do(monkeypatch):
    text = prose(6, 2000).encode()
    whole = next(wordhash.hashed_groups([text], lower=True))
    monkeypatch.setattr(wordhash, "GROUP_BYTES", 100)
    cut = next(wordhash.hashed_groups([text], lower=True))
    assert (whole.words == cut.words).all() and (whole.chars == cut.chars).all()


def test_ngrams_are_equal_where_their_words_are():
    words = np.array([3, 1, 2, 3, 1, 2, 9], dtype=np.uint64)
    sums = wordhash.running_words(words)
    three = wordhash.ngram_hashes(sums, 3)
    assert three[0] == three[3] and len(set(three.tolist())) == 4
    assert len(wordhash.ngram_hashes(sums, 8)) == 0
