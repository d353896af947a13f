"""BPE vocabularies of full size: merges are drafted on the driver and verified by Spark.

A round of training that fixes a few merges costs a Spark job, so tens of thousands
of merges take hours. Here a job fixes thousands. The driver holds the most frequent
pieces (at most ``HEAD``) and drafts the next merges from them and from the exact
counts of all pairs. Tasks then carry out the drafted merges, in order, on all
pieces, and report what each step changes in the pair counts. With these exact
changes the driver replays the draft: it takes the most frequent pair each time, as long
as that is a drafted step which no step it has passed over touches in any piece. Such a
step changes the same with or without them, so what the tasks reported holds, but for
the number of its token. The rest of the draft is undone. The
first step always stands, so the result is that of the one-at-a-time rule whatever the
draft was worth. If the pieces are no more than ``HEAD``, drafts are right to the end.

A pair gains occurrences only in the step that makes the younger of its tokens, and
only loses them later. So counts are complete, and pairs that are too rare may be
forgotten (beyond ``KEPT``), until the most frequent one falls below what was forgotten:
then all pairs are counted again.

Inside a task or the driver a piece is a string with one character per token; merging
is a replacement, from the left, as for any run of equal tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.encode import PieceEncoder
from tokenloom.functions.text import FIRST_MERGE, byte_ids
from tokenloom.operators.bpe import MERGES_SCHEMA, _apply, _layout, pair_counts
from tokenloom.operators.filters import check_vocabulary
from tokenloom.session import stage

#: Pieces the driver drafts from, and pieces a verifying task holds, at most on average.
HEAD, PER_TASK = 1_000_000, 100_000
#: Steps of a first and of the longest draft, and of the longest that tasks carry out on flat arrays of ids.
SHORT, LONG, FLAT = 64, 8192, 256
#: Pairs whose counts the driver keeps; twice as many are cut back to these.
KEPT = 1 << 20
#: Merges after which the stored pieces are written anew.
STALE = 512
# Token ids as characters in order: from _BASE on, around the surrogates.
_BASE, _GAP, _SKIP = 0x100, 0xD700, 0x800


def _char(token: int) -> str:
    return chr(_BASE + token + (_SKIP if token >= _GAP else 0))


def _words(ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """One string per piece, out of the flat ids of many."""
    text = (ids + _BASE + np.where(ids >= _GAP, _SKIP, 0)).astype("<u4").tobytes().decode("utf-32-le")
    ends = np.cumsum(sizes).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _pair(left: int, right: int) -> str:
    return _char(left) + _char(right)


def _ids(pair: str) -> tuple[int, int]:
    left, right = (c - _BASE - (_SKIP if c >= _BASE + _GAP + _SKIP else 0) for c in map(ord, pair))
    return left, right


class Pieces:
    """Pieces with their counts, and where each pair occurs (entries may be out of date)."""

    def __init__(self, words: list[str], counts: list[int], only: set[str] | None = None):
        self.words, self.counts, self.only = words, counts, only
        self.where: dict[str, list[int]] = {}
        for at, word in enumerate(words):
            self._note(at, word)

    def _note(self, at: int, word: str) -> None:
        for a, b in pairwise(word):
            pair = a + b
            if self.only is None or pair in self.only:
                self.where.setdefault(pair, []).append(at)

    def merge(self, pair: str, token: str, undo: list | None = None) -> dict[str, int]:
        """Make one token of every occurrence of the pair; what changes in the pair counts."""
        change: dict[str, int] = {}
        words, counts, where, only = self.words, self.counts, self.where, self.only
        for at in set(self.where.pop(pair, ())):
            old = words[at]
            new = old.replace(pair, token)
            if new == old:
                continue
            if undo is not None:
                undo.append((at, old))
            words[at], n = new, counts[at]
            for a, b in pairwise(old):
                key = a + b
                change[key] = change.get(key, 0) - n
            for a, b in pairwise(new):
                key = a + b
                change[key] = change.get(key, 0) + n
                if (a == token or b == token) and (only is None or key in only):
                    where.setdefault(key, []).append(at)
        return change

    def restore(self, undo: list[tuple[int, str]]) -> None:
        for at, old in reversed(undo):
            self.words[at] = old
            self._note(at, old)


class PairCounts:
    """Exact counts of pairs with the most frequent on top; ties go to the smaller left, then right token.

    Pairs that aren't here come after ``limit``, a (minus count, pair); without one there are none.
    """

    def __init__(self, counts: dict[str, int], least: int, limit: tuple[int, str] | None = None):
        self.counts, self.least, self.limit = counts, least, limit
        self.heap = [(-n, pair) for pair, n in counts.items()]
        heapq.heapify(self.heap)

    @property
    def floor(self) -> int:
        """The count below which pairs needn't be kept."""
        return max(self.least, -self.limit[0]) if self.limit else self.least

    def top(self) -> str | None:
        """The most frequent pair of all, if it is known."""
        heap, counts = self.heap, self.counts
        while heap:
            low, pair = heap[0]
            now = counts.get(pair, 0)
            if now == -low:
                return pair if now >= self.least and (self.limit is None or heap[0] <= self.limit) else None
            heapq.heappop(heap)
            if now > 0:
                heapq.heappush(heap, (-now, pair))
        return None

    def apply(self, merged: str, change: dict[str, int]) -> None:
        counts, floor = self.counts, self.floor
        counts.pop(merged, None)
        for pair, n in change.items():
            left = counts.get(pair, 0) + n
            if n > 0 and left >= floor:  # a pair with the new token: this is all it ever gains
                counts[pair] = left
                heapq.heappush(self.heap, (-left, pair))
            elif pair in counts:
                if left >= floor:
                    counts[pair] = left
                else:
                    del counts[pair]

    def forget(self, kept: int) -> None:
        """Keep the ``kept`` most frequent pairs, once there are twice as many."""
        if len(self.counts) > 2 * kept:
            first = heapq.nsmallest(kept, ((-n, pair) for pair, n in self.counts.items()))
            self.__init__({pair: -low for low, pair in first}, self.least, first[-1])

    def copy(self) -> PairCounts:
        other = object.__new__(PairCounts)
        other.counts, other.least, other.limit, other.heap = dict(self.counts), self.least, self.limit, list(self.heap)
        return other


def draft(head: Pieces, exact: PairCounts, first: int, steps: int) -> tuple[list[str], list[list]]:
    """The next merges as the head sees them, carried out on it, with what it takes to undo each."""
    guess, pairs, undos = exact.copy(), [], []
    while len(pairs) < steps and (pair := guess.top()) is not None:
        undos.append([])
        now = guess.counts[pair]
        change = head.merge(pair, _char(first + len(pairs)), undos[-1])
        if (seen := -change.get(pair, 0)) not in (0, now):  # the other pieces are taken to be like the head
            change = {p: round(n * now / seen) for p, n in change.items()}
        guess.apply(pair, change)
        pairs.append(pair)
    return pairs, undos


def _verify(before: PieceEncoder, pairs: list[str], first: int):
    """What each drafted step changes in the pair counts over the pieces of a task."""
    only = set(pairs)
    steps = list(map(_ids, pairs))
    old = np.array([(a << 20) | b for a, b in steps if a < first and b < first], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        counts: list[int] = []
        flat: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, word, n = _layout(batch)
            ids, word = before.merge(ids, word)
            # A piece without one of these pairs is never touched.
            hit = np.flatnonzero((word[:-1] == word[1:]) & np.isin((ids[:-1] << 20) | ids[1:], old))
            busy = np.zeros(len(n), dtype=bool)
            busy[word[hit]] = True
            own = busy[word]
            if len(steps) <= FLAT:
                flat.append((ids[own], np.cumsum(busy)[word[own]] - 1, n[busy]))
                continue
            words += _words(ids[own], np.bincount(word[own], minlength=len(n))[busy])
            counts += n[busy].tolist()
        if len(steps) <= FLAT:
            yield from _flat_changes(flat, steps, first)
            return
        held = Pieces(words, counts, only)
        out: list[tuple[int, str, int]] = []
        for step, pair in enumerate(pairs):
            out += [(step, p, n) for p, n in held.merge(pair, _char(first + step)).items() if n]
            if len(out) > 100_000:
                yield _rows(out)
                out = []
        yield _rows(out)
    return run


def _pairs_at(ids: np.ndarray, word: np.ndarray, n: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that begin at any of the places, each place once, and the counts of their pieces."""
    mark = np.zeros(len(ids) + 1, dtype=bool)  # the last entry takes place -1
    for at in places:
        mark[at] = True
    at = np.flatnonzero(mark[:max(len(ids) - 1, 0)])
    at = at[word[at] == word[at + 1]]
    return (ids[at].astype(np.int64) << 20) | ids[at + 1], n[word[at]]


def _flat_changes(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: list[tuple[int, int]], first: int):
    """As carrying out the steps on :class:`Pieces`: each looks through all ids at once, which is faster for few steps."""
    if not parts:
        return
    n = np.concatenate([p[2] for p in parts])
    base = np.cumsum([0, *(len(p[2]) for p in parts)])
    ids = np.concatenate([p[0] for p in parts]).astype(np.int32)
    word = np.concatenate([p[1] + at for p, at in zip(parts, base)]).astype(np.int32)
    for step, (a, b) in enumerate(steps):
        hit = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
        hit = hit[word[hit] == word[hit + 1]]
        if not len(hit):
            continue
        if a == b:  # from the left: only even places of a run of hits, which ends with the piece
            begins = np.r_[True, (np.diff(hit) != 1) | (np.diff(word[hit]) != 0)]
            hit = hit[(hit - hit[begins][np.cumsum(begins) - 1]) % 2 == 0]
        keys, amounts = _pairs_at(ids, word, n, hit - 1, hit, hit + 1)
        ids[hit] = first + step
        keep = np.ones(len(ids), dtype=bool)
        keep[hit + 1] = False
        ids, word, hit = ids[keep], word[keep], hit - np.arange(len(hit))
        new_keys, new_amounts = _pairs_at(ids, word, n, hit - 1, hit)
        group, pair = pd.factorize(np.concatenate([keys, new_keys]))
        total = np.zeros(len(pair), dtype=np.int64)
        np.add.at(total, group, np.concatenate([-amounts, new_amounts]))
        pair, total = pair[total != 0], total[total != 0]
        both = np.stack([pair >> 20, pair & 0xFFFFF], axis=1).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(pair), step, np.int32)), pa.array(_words(both, np.full(len(pair), 2)), pa.string()),
             pa.array(total, pa.int64())], ["step", "pair", "n"])


def _rows(out: list[tuple[int, str, int]]) -> pa.RecordBatch:
    step, pair, n = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array(pair, pa.string()), pa.array(n, pa.int64())],
                                      ["step", "pair", "n"])


def verified_changes(words: DataFrame, pending: list[tuple[int, int]], staged: int, pairs: list[str], first: int,
                     floor: int) -> list[dict[str, int]]:
    """Exact changes of each drafted step over all pieces; new pairs below the floor are left out."""
    found = words.mapInArrow(_verify(PieceEncoder(pending, FIRST_MERGE + staged), pairs, first),
                             "step int, pair string, n long").groupBy("step", "pair").agg(F.sum("n").alias("n"))
    rows = found.where((F.col("n") < 0) | (F.col("n") >= floor)).toArrow()
    changes: list[dict[str, int]] = [{} for _ in pairs]
    for step, pair, n in zip(*(rows.column(c).to_pylist() for c in ("step", "pair", "n")), strict=True):
        changes[step][pair] = n
    return changes


def replay(exact: PairCounts, pairs: list[str], changes: list[dict[str, int]], first: int) -> tuple[list[str], int]:
    """The next merges that the verified steps of a draft give, and how many of them are the draft's own beginning.

    The most frequent pair is taken, in whatever place the draft has it. A step holds without
    those before it that were passed over if it meets none of their tokens, and none of them takes
    its pair away. Its token gets the number of its turn; ties are decided by these numbers.
    """
    place = {pair: j for j, pair in enumerate(pairs)}
    drafted: dict[str, str] = {}  # by the token's final number
    final: dict[str, str] = {}
    merged: list[str] = []
    passed: set[int] = set()
    straight = reach = 0
    while (pair := exact.top()) is not None:
        known = "".join(drafted.get(c, c) for c in pair)
        j = place.get(known)
        if j is None:
            break
        before = {i for i in passed if i < j} | set(range(reach, j))
        if before:
            tokens = {_char(first + i) for i in before}
            if any(not tokens.isdisjoint(p) for p in changes[j]) or any(known in changes[i] for i in before):
                break
        if j == straight == len(merged):
            straight += 1
        passed |= set(range(reach, j))
        passed.discard(j)
        reach = max(reach, j + 1)
        token = _char(first + len(merged))
        drafted[token], final[_char(first + j)] = _char(first + j), token
        exact.apply(pair, {"".join(final.get(c, c) for c in p): n for p, n in changes[j].items()})
        merged.append(pair)
    return merged, straight


def _least_count(words: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pieces occur that often."""
    log = F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("log")
    size, least = 0, 1 << 62
    for r in words.groupBy(log).count().orderBy(F.desc("log")).collect():  # 63 rows at most
        size += r["count"]
        if size > most:
            break
        least = 1 << r["log"]
    return least


def train_drafted(spark: SparkSession, counts: DataFrame, vocab_size: int, min_frequency: int = 2, head_size: int = HEAD,
                  kept: int = KEPT, longest: int = LONG) -> DataFrame:
    """Merges of a byte-level vocabulary from ``counts(piece, n)``: the rows of :func:`tokenloom.operators.bpe.train_bpe`."""
    check_vocabulary(vocab_size)
    room = vocab_size - FIRST_MERGE
    words = counts.select(byte_ids(F.col("piece")).alias("ids"), F.col("n").cast("long").alias("n")).where(F.size("ids") > 1)
    words = stage(words, "bpe-pieces")
    total = words.count()
    # A task per core at least; small ones cost more than their work.
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PER_TASK))
    frequent = words.where(F.col("n") >= _least_count(words, head_size)).toArrow()
    lists = frequent.column("ids").combine_chunks()
    head = Pieces(_words(lists.flatten().to_numpy(), lists.value_lengths().to_numpy()), frequent.column("n").to_pylist())
    words = stage(words.repartition(parts), "bpe-words")

    merges: list[tuple[int, int]] = []
    staged, steps = 0, longest if total <= head_size else min(SHORT, longest)
    exact: PairCounts | None = None
    while len(merges) < room:
        if exact is None or (exact.limit and exact.top() is None):
            rows = pair_counts(words, merges[staged:], FIRST_MERGE + staged).where(F.col("n") >= min_frequency).orderBy(
                F.desc("n"), "left", "right").limit(kept).collect()
            last = (-rows[-1]["n"], _pair(rows[-1]["left"], rows[-1]["right"])) if len(rows) == kept else None
            exact = PairCounts({_pair(r["left"], r["right"]): r["n"] for r in rows}, min_frequency, last)
        if exact.top() is None:
            break
        first = FIRST_MERGE + len(merges)
        pairs, undos = draft(head, exact, first, min(steps, room - len(merges)))
        changes = verified_changes(words, merges[staged:], staged, pairs, first, exact.floor)
        found, straight = replay(exact, pairs, changes, first)
        good = len(found)
        for undo in reversed(undos[straight:]):
            head.restore(undo)
        for turn in range(straight, good):
            head.merge(found[turn], _char(first + turn))
        merges += [_ids(p) for p in found]
        exact.forget(kept)
        steps = min(longest, 2 * steps) if good == len(pairs) else max(16, min(longest, 2 * good))
        if len(merges) - staged >= STALE and len(merges) < room:
            done = PieceEncoder(merges[staged:], FIRST_MERGE + staged)
            words = stage(words.mapInArrow(_apply(done), "ids array<int>, n long").repartition(parts), "bpe-words")
            staged = len(merges)
    return spark.createDataFrame([(i, a, b, FIRST_MERGE + i) for i, (a, b) in enumerate(merges)], MERGES_SCHEMA)
