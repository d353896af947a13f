import hashlib
import heapq
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tokenloom.functions import encode
from tokenloom.functions.encode import PieceEncoder, decoder, encoder, with_end_of_text
from tokenloom.functions.text import BYTE_BASE, FIRST_MERGE, SPECIAL_TOKENS, SPLIT_PATTERN, byte_ids, pieces
from tokenloom.operators import bpe, bpe_draft, bpe_ranges
from tokenloom.plans import QUERIES, corpus

SAMPLES = [
    "if (a <= b) { return 'x'; }\n\t// one-two 007 3rd", "The owl said: wait... what?", "", "🙂🙂 emoji 👩‍👩‍👧",
    "é combining ñ", "a\r\nb\r\n\r\nc", "tabs\t\tand  runs   of    spaces ", "<|im_end|> and <|endoftext|> as text",
    "it's I'LL they've", "  x　y", "\x00\x1f control", "aaaaaaaaaaa", "漢字かな交じり文", "\n \n  \n",
]


def test_pieces_equal_an_independent_regex_engine(spark):
    pattern = regex.compile(SPLIT_PATTERN)
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, text string")
    for r in df.select("i", pieces(F.col("text")).alias("p")).collect():
        assert r["p"] == [m.group(0) for m in pattern.finditer(SAMPLES[r["i"]])], SAMPLES[r["i"]]
        assert "".join(r["p"]) == SAMPLES[r["i"]]


def test_byte_ids(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, text string")
    for r in df.select("i", byte_ids(F.col("text")).alias("ids")).collect():
        assert r["ids"] == [b + BYTE_BASE for b in SAMPLES[r["i"]].encode()]


def _merge_once(ids, pair, new):
    out, i = [], 0
    while i < len(ids):
        if tuple(ids[i:i + 2]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def _train(counts, room):
    words, out = [([b + BYTE_BASE for b in p.encode()], n) for p, n in counts], []
    while len(out) < room:
        found = {}
        for ids, n in words:
            for pair in zip(ids, ids[1:]):
                found[pair] = found.get(pair, 0) + n
        found = {k: v for k, v in found.items() if v >= 2}
        if not found:
            break
        best = min(found, key=lambda k: (-found[k], k))
        words = [(_merge_once(ids, best, FIRST_MERGE + len(out)), n) for ids, n in words]
        out.append(best)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batched_training_equals_one_merge_at_a_time(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 1 else "abcde"
    words = {"".join(rng.choices(letters, k=rng.randint(1, 9))): rng.randint(1, 6) for _ in range(60)}
    counts = list(words.items())
    got = bpe.merge_list(bpe.train_bpe(spark, spark.createDataFrame(counts, "piece string, n long"), FIRST_MERGE + 60,
                                       rounds_per_stage=5))
    assert got == _train(counts, 60)


@pytest.mark.parametrize("watched", [1, 5, 40])
def test_training_with_few_watched_pairs_counts_again(spark, monkeypatch, watched):
    monkeypatch.setattr(bpe, "WATCHED", watched)
    rng = random.Random(watched)
    counts = list({"".join(rng.choices("abcd", k=rng.randint(1, 9))): rng.randint(1, 3) for _ in range(50)}.items())
    got = bpe.merge_list(bpe.train_bpe(spark, spark.createDataFrame(counts, "piece string, n long"), FIRST_MERGE + 30))
    assert got == _train(counts, 30)


def test_large_training_query_equals_one_merge_at_a_time(spark):
    """The whole registered vocabulary, from the pieces the engine has counted."""
    sf = "/root/testdata/sf0.001"
    texts = corpus.mixing.taken_rows(corpus.byte_sources(spark, sf), corpus.byte_mix(spark, sf), "doc_id")
    words = [([b + BYTE_BASE for b in r[0].encode()], r[1]) for r in bpe.piece_counts(texts).collect()]
    # Counts of all pairs, and the words each is in, kept up to date merge by merge.
    count, where = Counter(), defaultdict(set)
    for w, (ids, n) in enumerate(words):
        for pair in zip(ids, ids[1:]):
            count[pair] += n
            where[pair].add(w)
    want = []
    while len(want) < corpus.LARGE:
        best = min(count, key=lambda k: (-count[k], k))
        for w in where.pop(best):
            ids, n = words[w]
            for pair in zip(ids, ids[1:]):
                count[pair] -= n
            ids = _merge_once(ids, best, FIRST_MERGE + len(want))
            words[w] = (ids, n)
            for pair in zip(ids, ids[1:]):
                count[pair] += n
                where[pair].add(w)
        del count[best]
        want.append(best)
    rows = QUERIES["bpe_train_large"](spark, sf).orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in rows] == want and [r["rank"] for r in rows] == list(range(corpus.LARGE))
    merges = want
    coded = {r["doc_id"]: r for r in QUERIES["bpe_encode_large"](spark, sf).collect()}
    pattern, known = regex.compile(SPLIT_PATTERN), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40).collect():
        out = []
        for m in pattern.finditer(r["text"]):
            if m.group(0) not in known:
                ids = [b + BYTE_BASE for b in m.group(0).encode()]
                for rank, pair in enumerate(merges):
                    ids = _merge_once(ids, pair, FIRST_MERGE + rank) if len(ids) > 1 else ids
                known[m.group(0)] = ids
            out += known[m.group(0)]
        out.append(0)
        assert coded[r["doc_id"]]["n_tok"] == len(out)
        assert coded[r["doc_id"]]["ids_md5"] == hashlib.md5("".join(f"{i}," for i in out).encode()).hexdigest()


def _replay(pieces_counted, room):
    """One merge at a time with a heap over the counts of all pairs, to the end of pairs that occur twice."""
    words = [([b + BYTE_BASE for b in piece.encode()], n) for piece, n in pieces_counted]
    count, where, out = Counter(), defaultdict(set), []
    for w, (ids, n) in enumerate(words):
        for pair in zip(ids, ids[1:]):
            count[pair] += n
            where[pair].add(w)
    heap = [(-n, pair) for pair, n in count.items()]
    heapq.heapify(heap)
    while heap and len(out) < room:
        low, best = heapq.heappop(heap)
        if count[best] != -low:
            if count[best] >= 2:
                heapq.heappush(heap, (-count[best], best))
            continue
        if -low < 2:
            break
        changed = set()
        for w in where.pop(best):
            ids, n = words[w]
            for pair in zip(ids, ids[1:]):
                count[pair] -= n
            ids = _merge_once(ids, best, FIRST_MERGE + len(out))
            words[w] = (ids, n)
            for pair in zip(ids, ids[1:]):
                count[pair] += n
                where[pair].add(w)
                changed.add(pair)
        count[best] = 0
        for pair in changed:
            heapq.heappush(heap, (-count[pair], pair))
        out.append(best)
    return out


def test_full_training_equals_one_merge_at_a_time(spark):
    """Every merge there is at the smallest size, from the query, and ids encoded with them."""
    sf = "/root/testdata/sf0.001"
    texts = corpus.mixing.taken_rows(corpus.byte_sources(spark, sf), corpus.byte_mix(spark, sf), "doc_id")
    want = _replay([(r[0], r[1]) for r in bpe.piece_counts(texts).collect()], corpus.FULL - FIRST_MERGE)
    rows = QUERIES["bpe_train_full"](spark, sf).orderBy("rank").collect()
    assert len(want) > 10_000
    assert [(r["rank"], r["left"], r["right"], r["new_id"]) for r in rows] == [
        (i, a, b, FIRST_MERGE + i) for i, (a, b) in enumerate(want)]
    words = bpe.token_bytes(want)
    found = {r["id"]: r for r in QUERIES["vocabulary_full"](spark, sf).collect()}
    assert len(found) == FIRST_MERGE + len(want)
    assert all(found[i]["token_hex"] == w.hex().upper() for i, w in enumerate(words) if w is not None)
    coded = {r["doc_id"]: r for r in QUERIES["bpe_encode_full"](spark, sf).collect()}
    rank, pattern, known = {p: i for i, p in enumerate(want)}, regex.compile(SPLIT_PATTERN), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        out = []
        for m in pattern.finditer(r["text"]):
            if m.group(0) not in known:
                ids = [b + BYTE_BASE for b in m.group(0).encode()]
                while (best := min((rank[p] for p in zip(ids, ids[1:]) if p in rank), default=None)) is not None:
                    ids = _merge_once(ids, want[best], FIRST_MERGE + best)
                known[m.group(0)] = ids
            out += known[m.group(0)]
        assert coded[r["doc_id"]]["ids_md5"] == hashlib.md5("".join(f"{i}," for i in [*out, 0]).encode()).hexdigest()


@pytest.mark.parametrize("head,kept,longest", [(1000, 1 << 20, 100), (7, 1 << 20, 100), (1, 12, 8), (0, 1000, 3)])
def test_drafted_training_is_exact_whatever_the_draft_is_worth(spark, head, kept, longest):
    """Few pieces to draft from, few pairs kept and short drafts: more rounds, the same merges."""
    rng = random.Random(head)
    counts = list({"".join(rng.choices("abcd", k=rng.randint(1, 9))): rng.randint(1, 30) for _ in range(60)}.items())
    got = bpe.merge_list(bpe_draft.train_drafted(spark, spark.createDataFrame(counts, "piece string, n long"), FIRST_MERGE + 40,
                                                 head_size=head, kept=kept, longest=longest))
    assert got == _train(counts, 40)


@pytest.mark.parametrize("flat", [0, 256])
def test_steps_of_a_draft_may_trade_places(spark, monkeypatch, flat):
    """The rare pieces turn the order of two pairs that never meet: one round still settles both, with final numbers."""
    monkeypatch.setattr(bpe_draft, "FLAT", flat)
    counts = [("abx", 20), ("cdy", 19), ("efz", 7), ("gh", 6), *((f"q{c}cd", 1) for c in "ijkl")]
    df = spark.createDataFrame(counts, "piece string, n long")
    rounds, verified = [], bpe_draft.verified_changes
    monkeypatch.setattr(bpe_draft, "draft", _swapped(bpe_draft.draft))
    monkeypatch.setattr(bpe_draft, "verified_changes", lambda *a: rounds.append(1) or verified(*a))
    got = bpe.merge_list(bpe_draft.train_drafted(spark, df, FIRST_MERGE + 8, head_size=4))
    assert got == _train(counts, 8)
    assert len(rounds) == 1


def test_flat_steps_change_what_steps_on_strings_change():
    rng = random.Random(5)
    words = [[rng.choice([260, 261, 262]) for _ in range(rng.randint(2, 9))] for _ in range(300)]
    counts = [rng.randint(1, 9) for _ in words]
    steps = [(260, 260), (261, 263), (263, 260), (262, 262), (266, 266), (999, 260), (260, 261)]
    held = bpe_draft.Pieces(["".join(map(bpe_draft._char, w)) for w in words], list(counts))
    want = {(step, p, n) for step, (a, b) in enumerate(steps)
            for p, n in held.merge(bpe_draft._pair(a, b), bpe_draft._char(263 + step)).items() if n}
    parts = []
    for some in (slice(0, 120), slice(120, 300)):
        sizes = [len(w) for w in words[some]]
        parts.append((np.concatenate(words[some]), np.repeat(np.arange(len(sizes)), sizes), np.array(counts[some])))
    got = [tuple(r.values()) for b in bpe_draft._flat_changes(parts, steps, 263) for r in b.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want


def _swapped(draft):
    """A draft that has its first two steps the wrong way round."""
    def run(head, exact, first, steps):
        pairs, undos = draft(head, exact, first, steps)
        head.restore([u for undo in undos for u in undo])
        swap = {bpe_draft._char(first): bpe_draft._char(first + 1), bpe_draft._char(first + 1): bpe_draft._char(first)}
        pairs = ["".join(swap.get(c, c) for c in p) for p in [pairs[1], pairs[0], *pairs[2:]]]
        undos = [[] for _ in pairs]
        for i, pair in enumerate(pairs):
            head.merge(pair, bpe_draft._char(first + i), undos[i])
        return pairs, undos
    return run


def test_drafted_training_of_repeats_and_nothing(spark):
    counts = [("a" * 9, 5), ("b" * 4, 5), ("ab" * 3, 2), ("x", 9), ("é" * 3, 2)]
    df = spark.createDataFrame(counts, "piece string, n long")
    assert bpe.merge_list(bpe_draft.train_drafted(spark, df, FIRST_MERGE + 50)) == _train(counts, 50)
    rare = spark.createDataFrame([("abc", 1), ("xyz", 1)], "piece string, n long")
    assert bpe.merge_list(bpe_draft.train_drafted(spark, rare, FIRST_MERGE + 10)) == []
    assert bpe.merge_list(bpe_draft.train_drafted(spark, rare.limit(0), FIRST_MERGE + 10)) == []


@pytest.mark.parametrize("most,told", [(1000, 1 << 20), (60, 1 << 20), (12, 40), (0, 7)])
def test_training_by_ranges_is_exact_whatever_fits(spark, most, told):
    """All pieces at once, some segments a round, and none: more rounds, the same merges."""
    rng = random.Random(most)
    counts = list({"".join(rng.choices("abcd", k=rng.randint(1, 9))): rng.randint(1, 30) for _ in range(60)}.items())
    counts += [("a" * 9, 5), ("b" * 11, 5), ("ab" * 3, 2), ("é" * 3, 2)]
    df = spark.createDataFrame(dict(counts).items(), "piece string, n long")
    size = 40 if most else 12
    got = bpe.merge_list(bpe_ranges.train_by_ranges(spark, df, FIRST_MERGE + size, most=most, told=told))
    assert got == _train(list(dict(counts).items()), size)


def test_training_by_ranges_ends_with_the_pairs(spark):
    counts = [("a" * 9, 5), ("b" * 4, 5), ("ab" * 3, 2), ("x", 9), ("é" * 3, 2)]
    df = spark.createDataFrame(counts, "piece string, n long")
    assert bpe.merge_list(bpe_ranges.train_by_ranges(spark, df, FIRST_MERGE + 50)) == _train(counts, 50)
    rare = spark.createDataFrame([("abc", 1), ("xyz", 1)], "piece string, n long")
    assert bpe.merge_list(bpe_ranges.train_by_ranges(spark, rare, FIRST_MERGE + 10)) == []
    assert bpe.merge_list(bpe_ranges.train_by_ranges(spark, rare.limit(0), FIRST_MERGE + 10)) == []


def test_segments_end_where_a_pair_is_rare():
    """Neighbouring words don't touch, and equal segments of a task come as one row."""
    words = [[300, 301, 302], [301, 302], [302, 300, 301, 300], [5000, 70_000 - 2_000], [300, 301]]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array([2, 3, 5, 7, 11], pa.int64())], ["ids", "n"])
    kept = np.sort(np.array([(a << 20) | b for a, b in [(300, 301), (301, 302), (5000, 68_000)]]))
    got = {s: n for b in bpe_ranges._cut(kept)(iter([batch])) for s, n in zip(*(c.to_pylist() for c in b.columns))}
    text = lambda *ids: "".join(map(bpe_draft._char, ids))
    assert got == {text(300, 301, 302): 2, text(301, 302): 3, text(300, 301): 16, text(5000, 68_000): 7}


def test_vocabulary_file_with_gaps_is_refused(spark, tmp_path):
    merges = spark.createDataFrame([(0, 101, 102, 260), (1, 260, 101, 261)], bpe.MERGES_SCHEMA)
    bpe.write_vocabulary(merges, str(tmp_path / "v"))
    assert bpe.merge_list(bpe.read_vocabulary(spark, str(tmp_path / "v"))) == [(101, 102), (260, 101)]
    bpe.write_vocabulary(merges.where("rank = 1"), str(tmp_path / "w"))
    with pytest.raises(ValueError, match="gaps"):
        bpe.read_vocabulary(spark, str(tmp_path / "w"))


def test_encode_equals_replaying_the_merges(spark):
    rng = random.Random(4)
    corpus = ["".join(rng.choices("abcde é\n", k=200)) for _ in range(20)] + SAMPLES
    docs = spark.createDataFrame(list(enumerate(corpus)), "i int, text string")
    merges = bpe.merge_list(bpe.train_bpe(spark, bpe.piece_counts(docs), FIRST_MERGE + 80))
    assert len(merges) == 80
    coded = docs.select("i", with_end_of_text(encoder(merges)(F.col("text"))).alias("ids"))
    pattern = regex.compile(SPLIT_PATTERN)
    for r in coded.collect():
        want = []
        for m in pattern.finditer(corpus[r["i"]]):
            ids = [b + BYTE_BASE for b in m.group(0).encode()]
            for rank, pair in enumerate(merges):
                ids = _merge_once(ids, pair, FIRST_MERGE + rank)
            want += ids
        assert r["ids"] == want + [0]
    back = coded.select("i", decoder(bpe.token_bytes(merges))(F.col("ids")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in back} == dict(enumerate(corpus))


def test_encoder_without_merges_and_vocabulary(spark):
    assert [list(x) for x in PieceEncoder([]).encode_many([b"a", b"", b"bc"])] == [[101], [], [102, 103]]
    merges = spark.createDataFrame([(0, 101, 102, 260), (1, 260, 101, 261)], bpe.MERGES_SCHEMA)
    rows = {r["id"]: r for r in bpe.vocabulary(spark, merges).collect()}
    assert bytes(rows[261]["token_bytes"]) == b"aba" and len(rows) == 262
    assert [bytes(rows[i]["token_bytes"]).decode() for i in range(4)] == SPECIAL_TOKENS and rows[3]["special"]


def test_cut_inside_a_character_decodes(spark):
    df = spark.createDataFrame([([BYTE_BASE + 0xC3],)], "ids array<int>")
    assert df.select(decoder(bpe.token_bytes([]))(F.col("ids"))).first()[0] == "�"


def test_large_vocabulary_of_rare_pairs_stops(spark):
    counts = spark.createDataFrame([("abc", 1), ("xyz", 1)], "piece string, n long")
    assert bpe.merge_list(bpe.train_bpe(spark, counts, FIRST_MERGE + 10)) == []


def test_a_batch_is_encoded_some_rows_at_a_time(monkeypatch):
    """Rows of any size, empty and null ones among them, give the same ids, and no part takes more than its share."""
    rows = [["ab", "abc"], [], None, ["abab"] * 9, ["c"], ["ab", "c", "ab"]]
    merges = [(101, 102), (260, 103)]
    whole = PieceEncoder(merges).encode_batch(pa.array(rows, pa.list_(pa.string()))).to_pylist()
    assert whole[0] == [260, 261] and whole[5] == [260, 103, 260] and [len(w) for w in whole] == [2, 0, 0, 18, 1, 3]
    sizes, part = [], PieceEncoder._encode_rows
    monkeypatch.setattr(encode, "_AT_ONCE", 4)
    monkeypatch.setattr(PieceEncoder, "_encode_rows", lambda self, some: sizes.append(len(some.flatten())) or part(self, some))
    assert PieceEncoder(merges).encode_batch(pa.array(rows, pa.list_(pa.string()))).to_pylist() == whole
    assert sizes == [2, 9, 4]


def test_new_pieces_are_merged_some_bytes_at_a_time(monkeypatch):
    """However long a row, merging (which takes many times the bytes) gets few of its pieces at once, and each piece once."""
    row = [c * 3 for c in "abcdefghi"] + ["aaaaaaa", "bc"] * 3
    sizes, merge = [], PieceEncoder.merge
    monkeypatch.setattr(encode, "_AT_ONCE", 6)
    monkeypatch.setattr(PieceEncoder, "merge", lambda self, ids, word: sizes.append(len(ids)) or merge(self, ids, word))
    coder, a = PieceEncoder([(101, 101), (102, 103)]), 101
    coded = coder.encode_batch(pa.array([row, ["bc"]], pa.list_(pa.string()))).to_pylist()
    assert coded == [[260, a] + [x + i for i in range(1, 9) for x in [a] * 3] + [260, 260, 260, a, 261] * 3, [261]]
    assert sum(sizes) == 36 and max(sizes) <= 7


def test_pieces_are_counted_in_batches(spark):
    """No row per piece: batches are counted where they are. Null and empty texts have none."""
    texts = ["so it is", None, "", "it is, it is", " \n"] * 40
    found = bpe.piece_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    pattern = regex.compile(SPLIT_PATTERN)
    assert {r["piece"]: r["n"] for r in found.collect()} == Counter(m.group(0) for t in texts for m in pattern.finditer(t or ""))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
