"""Encoding pieces with a BPE vocabulary inside Arrow batches.

The regex split runs in the JVM; only distinct pieces of a batch reach the
merge loop, and a worker remembers the pieces it has seen. No shuffle is
needed, and the cost follows distinct words rather than corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.text import BYTE_BASE, END_OF_TEXT, FIRST_MERGE, pieces

_NONE = np.iinfo(np.int64).max
_REMEMBER = 100_000
# Pieces of a batch, and bytes of new pieces, that are worked on at once.
_AT_ONCE = 1 << 17


def _some_rows(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """The rows of a batch, as many at a time as have ``_AT_ONCE`` values, at least one."""
    ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < len(ends):
        below = (ends[at - 1] if at else 0) + _AT_ONCE
        end = max(at + 1, int(np.searchsorted(ends, below, side="right")))
        yield lists.slice(at, end - at)
        at = end


class PieceEncoder:
    """Lowest-rank-first merging of many byte strings at once."""

    def __init__(self, merges: list[tuple[int, int]], first_id: int = FIRST_MERGE):
        self._first = first_id
        pairs = np.array(merges, dtype=np.int64).reshape(-1, 2)
        keys = (pairs[:, 0] << 20) | pairs[:, 1]
        self._rank_of = np.argsort(keys, kind="stable")
        self._keys = keys[self._rank_of]
        # Pieces seen so far by number; their ids are one after the other.
        self._known: dict[str, int] = {}
        self._flat, self._size = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _ranks(self, ids: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the merge starting at each position, or a huge number."""
        ranks = np.full(len(ids), _NONE)
        if len(self._keys) == 0 or len(ids) < 2:
            return ranks
        key = (ids[:-1] << 20) | ids[1:]
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        hit = (self._keys[at] == key) & (word[:-1] == word[1:])
        ranks[:-1][hit] = self._rank_of[at[hit]]
        return ranks

    def merge(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge flat ids of many words; ``word`` is the ascending word of each id.

        Only words in which some pair merges are touched, round by round.
        """
        ranks = self._ranks(ids, word)
        hits = np.flatnonzero(ranks != _NONE)
        if not len(hits):
            return ids, word
        busy = np.zeros(int(word[-1]) + 1, dtype=bool)
        busy[word[hits]] = True
        inside = busy[word]
        work_ids, work_word, ranks = ids[inside], word[inside], ranks[inside]
        done_ids, done_word = [ids[~inside]], [word[~inside]]
        while len(work_ids):
            starts = np.flatnonzero(np.r_[True, work_word[1:] != work_word[:-1]])
            best = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.r_[starts, len(work_ids)]))
            active = best != _NONE
            if not active.all():
                done_ids.append(work_ids[~active])
                done_word.append(work_word[~active])
                work_ids, work_word, ranks, best = work_ids[active], work_word[active], ranks[active], best[active]
                if not len(work_ids):
                    break
            # A pair of equal tokens can overlap itself: merge from the left,
            # so only even places of a run of hits.
            where = np.flatnonzero(ranks == best)
            begins = np.r_[True, np.diff(where) != 1]
            where = where[(where - where[begins][np.cumsum(begins) - 1]) % 2 == 0]
            work_ids[where] = self._first + best[where]
            keep = np.ones(len(work_ids), dtype=bool)
            keep[where + 1] = False
            work_ids, work_word = work_ids[keep], work_word[keep]
            ranks = self._ranks(work_ids, work_word)
        # Every word is whole in one part: put the parts back by word offset.
        size = np.zeros(len(busy), dtype=np.int64)
        for w in done_word:
            size += np.bincount(w, minlength=len(size))
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.int64)
        for i, w in zip(done_ids, done_word):
            if len(w):
                first = np.r_[True, w[1:] != w[:-1]]
                at = np.flatnonzero(first)
                out[begin[w] + np.arange(len(w)) - at[np.cumsum(first) - 1]] = i
        return out, np.repeat(np.arange(len(size)), size)

    def words_to_merge(self, ids: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Marks the ids of all words in which some pair merges."""
        hits = np.flatnonzero(self._ranks(ids, word) != _NONE)
        busy = np.zeros(int(word[-1]) + 1 if len(word) else 0, dtype=bool)
        busy[word[hits]] = True
        return busy[word]

    def _encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ids = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64) + BYTE_BASE
        ids, word = self.merge(ids, np.repeat(np.arange(len(words)), sizes))
        return ids.astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int32)

    def encode_many(self, words: list[bytes]) -> list[np.ndarray]:
        ids, sizes = self._encode_flat(words)
        return np.split(ids, np.cumsum(sizes)[:-1]) if words else []

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words in one array; where each word begins there, and its size."""
        known = self._known
        at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        fresh = np.flatnonzero(at < 0)
        flat, size = self._flat, self._size
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            coded = [w.encode() for w in new]
            # Merging takes many times the bytes of the words: some of them at a time.
            ends = np.cumsum([len(w) for w in coded])
            parts, done = [], 0
            while done < len(coded):
                below = (ends[done - 1] if done else 0) + _AT_ONCE
                end = max(done + 1, int(np.searchsorted(ends, below, side="right")))
                parts.append(self._encode_flat(coded[done:end]))
                done = end
            at[fresh] = np.arange(len(size), len(size) + len(fresh))
            flat = np.concatenate([flat, *(p[0] for p in parts)])
            size = np.concatenate([size, *(p[1] for p in parts)])
            # The frequent words come early; later ones are encoded batch by batch.
            if len(known) < _REMEMBER:
                known.update(zip(new, at[fresh].tolist()))
                self._flat, self._size = flat, size
        begin = np.cumsum(size, dtype=np.int32) - size
        return flat, begin[at], size[at]

    def encode_batch(self, lists: pa.ListArray) -> pa.ListArray:
        """Ids of a batch of piece lists, one id list per row.

        Some rows at a time, as the arrays it takes are many times the size of the ids.
        """
        parts = [self._encode_rows(some) for some in _some_rows(lists)]
        return pa.concat_arrays(parts) if parts else self._encode_rows(lists)

    def _encode_rows(self, lists: pa.ListArray) -> pa.ListArray:
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        flat, begin, size = self._look_up(coded.dictionary.to_pylist())
        use = coded.indices.to_numpy(zero_copy_only=False)
        n = size[use]
        ends = np.cumsum(n, dtype=np.int32)
        spots = np.repeat(begin[use] - ends + n, n)
        spots += np.arange(len(spots), dtype=np.int32)
        offsets = np.r_[0, np.cumsum(counts)]
        tok = np.r_[np.int32(0), ends][offsets]
        return pa.ListArray.from_arrays(pa.array(tok, pa.int32()), pa.array(flat[spots], pa.int32()))


def encoder(merges: list[tuple[int, int]]):
    """Column function: text → ids, with the given merges (at most 65,536)."""
    coder = PieceEncoder(merges)

    @F.arrow_udf("array<int>")
    def encode_lists(lists: pa.Array) -> pa.Array:
        return coder.encode_batch(lists)

    def encode(text: Column) -> Column:
        return encode_lists(pieces(F.coalesce(text, F.lit(""))))

    return encode


def with_end_of_text(ids: Column) -> Column:
    return F.concat(ids, F.array(F.lit(END_OF_TEXT)))


def decoder(tokens: list[bytes | None]):
    """Column function: ids → text. Special tokens stand for nothing; broken
    UTF-8 (a cut inside a character) becomes replacement characters."""
    size = np.array([0 if t is None else len(t) for t in tokens], dtype=np.int64)
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(t or b"" for t in tokens), dtype=np.uint8)

    def decode_rows(lists: pa.Array) -> list[str]:
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        n = size[ids]
        ends = np.cumsum(n)
        spots = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(begin[ids], n)
        data = flat[spots].tobytes()
        at = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]

    @F.arrow_udf("string")
    def decode_lists(lists: pa.Array) -> pa.Array:
        return pa.array([text for some in _some_rows(lists) for text in decode_rows(some)], pa.string())

    return decode_lists
