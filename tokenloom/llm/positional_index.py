"""Benchmark decontamination with a distributed positional inverted index, in DataFrame code alone.

1. The words of the benchmark's windows are counted over all documents.
2. The index stores a posting (term, document, position) for every occurrence of a
   term that is among the ``RARE`` rarest of some window. Each document also has one
   posting of the empty term, with its number of words.
3. A window's rarest term gives its candidates: occurrences, moved back by the
   term's offset in the window. The next rare terms' lists, moved likewise, are
   intersected with them in turn.
4. Only documents that are left are indexed for the remaining terms, and a
   candidate stands if every one of those is at its place.

Small tables (terms, windows) are stored first, so that Spark knows their size and
broadcasts them only below its threshold; above it, it shuffles.

Cases: a null text has no words. A window is ``width`` words; an item with fewer, but
at least one, is one window. Rows with equal ids and texts each give a row; equal ids
with other texts stay apart. Items that share an id count as one; a null item id is the
empty string. Empty tables give no rows, or documents without hits. A text of any length is
searched whole. Other columns aren't read, whatever their names; ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import equal_keys, ready, text_key
from tokenloom.session import stage

WIDTH = 10
RARE = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOC = ["doc", "key"]


def words_of(text: Column) -> Column:
    """Lower-case (A-Z alone) words: digits, ASCII letters and everything beyond ASCII."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, width: int = WIDTH, item_col: str = "item_id",
                      text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(win, size, words): the different windows; (win, item): the items they are from."""
    words = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                         words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    cut = stage(words.select(
        "item", F.explode(F.expr(f"transform(sequence(0, greatest(size(all) - {width}, 0)), s -> slice(all, s + 1, {width}))"))
        .alias("words")), "windows")
    # Stored, so that the ids are drawn once.
    numbered = stage(cut.select("words").distinct().select(
        F.monotonically_increasing_id().alias("win"), F.size("words").alias("size"), "words"), "window_ids")
    return numbered, stage(cut.join(numbered, "words").select("win", "item").distinct(), "window_items")


def index_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc, key, n_words, pos) of the given terms, one row per occurrence.

    ``docs`` has doc, key and text; ``terms`` one column, term. Position 0 is the
    empty term that opens every document.
    """
    split = docs.select(*_DOC, words_of(F.col("text")).alias("words"))
    spread = split.select(
        *_DOC, F.size("words").cast("long").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "term"))
    return spread.join(terms, "term")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents; counted per task before the shuffle."""
    found = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(terms, "term")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _ranked_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(win, size, off, term, rank): a window's terms, the rarest first."""
    terms = windows.select("win", "size", F.posexplode("words").alias("off", "term"))
    order = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "term", "off")
    return terms.join(counts, "term", "left").select(
        "win", "size", "off", "term", (F.row_number().over(order) - 1).alias("rank"))


def _intersect(found: DataFrame, ranked: DataFrame, postings: DataFrame, rank: int, slop: int) -> DataFrame:
    """Candidates whose term of this rank is at its place, or at most ``slop`` from it."""
    wanted = ranked.where(F.col("rank") == rank).select("win", F.col("off").alias("t_off"), F.col("term").alias("t"))
    short = found.where(F.col("size") <= rank)  # windows of fewer terms have no such list
    asked = found.where(F.col("size") > rank).join(wanted, "win")
    there = postings.select(F.col("doc").alias("p_doc"), F.col("key").alias("p_key"),
                            F.col("term").alias("p_term"), F.col("pos").alias("p_pos"))
    same = asked["doc"].eqNullSafe(there["p_doc"]) & (asked["key"] == there["p_key"]) & (asked["t"] == there["p_term"])
    place = asked["start"] + asked["t_off"]
    near = (there["p_pos"] == place) if slop == 0 else (F.abs(there["p_pos"] - place) <= slop)
    return asked.join(there, same & near, "left_semi").select(*found.columns).unionByName(short)


def phrase_matches(docs: DataFrame, postings: DataFrame, windows: DataFrame, ranked: DataFrame,
                   slop: int = 0) -> DataFrame:
    """(win, size, doc, key, start): places where a window occurs, start counted from 1.

    ``slop`` 0 finds exact phrases. Above 0, every term may be up to ``slop`` places
    off its place relative to the rarest: a proximity match.
    """
    first = ranked.where(F.col("rank") == 0).select("win", "size", "off", "term")
    found = first.join(postings, "term").select(
        "win", "size", *_DOC, (F.col("pos") - F.col("off")).alias("start"), "n_words")
    if slop == 0:
        found = found.where((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n_words")))
    found = found.drop("n_words")
    for rank in range(1, RARE):
        found = _intersect(found, ranked, postings, rank, slop)
    found = stage(found.distinct(), "candidates")

    rest = stage(ranked.where(F.col("rank") >= RARE), "rest_terms")
    left = stage(found.select(*_DOC).distinct(), "candidate_docs")
    again = docs.join(left, equal_keys(docs, left, _DOC), "left_semi").distinct()
    more = index_terms(again, rest.select("term").distinct())
    asked = found.join(rest.select("win", "off", "term"), "win").select(
        *found.columns, "term", (F.col("start") + F.col("off")).alias("place"))
    there = more.select(F.col("doc").alias("p_doc"), F.col("key").alias("p_key"),
                        F.col("term").alias("p_term"), F.col("pos").alias("p_pos"))
    same = asked["doc"].eqNullSafe(there["p_doc"]) & (asked["key"] == there["p_key"]) & (asked["term"] == there["p_term"])
    near = (there["p_pos"] == asked["place"]) if slop == 0 else (F.abs(there["p_pos"] - asked["place"]) <= slop)
    whole = (
        asked.join(there, same & near, "left_semi").groupBy(*found.columns).agg(F.count(F.lit(1)).alias("seen"))
        .where(F.col("seen") == F.col("size") - RARE).drop("seen")
    )
    return whole.unionByName(found.where(F.col("size") <= RARE))


def find_windows(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per document row (doc, key, n_words); matches (win, size, doc, key, start); (win, item)."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    windows, from_items = benchmark_windows(items, width, item_col, item_text_col)
    vocabulary = stage(windows.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    counts = stage(term_counts(rows, vocabulary), "term_counts")
    ranked = stage(_ranked_terms(windows, counts), "ranked")
    opening = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    indexed = stage(ranked.where(F.col("rank") < RARE).select("term").distinct().unionByName(opening), "index_terms")
    postings = stage(index_terms(rows, indexed), "postings")
    matches = stage(phrase_matches(rows, postings.where("pos > 0"), windows, ranked, slop), "matches")
    return postings.where("pos = 0").select(*_DOC, "n_words"), matches, from_items


def _hit_words(matches: DataFrame) -> DataFrame:
    """(doc, key, n_hit): words inside any match; each match adds what lies behind those before it."""
    before = Window.partitionBy(*_DOC).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.select(*_DOC, "start", "size").distinct().select(
        *_DOC, "start", "size", F.max(F.col("start") + F.col("size")).over(before).alias("reached"))
    new = F.col("start") + F.col("size") - F.greatest("start", F.coalesce("reached", "start"))
    return spans.groupBy(*_DOC).agg(F.sum(F.greatest(new, F.lit(0))).alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), contaminated: one row per document row."""
    facts, matches, from_items = find_windows(docs, items, width, 0, id_col, text_col)
    own_items = (
        matches.select(*_DOC, "win").distinct().join(from_items, "win").groupBy(*_DOC)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    hits = _hit_words(matches)
    found = stage(hits.join(own_items.toDF("o_doc", "o_key", "items"),
                            F.col("doc").eqNullSafe(F.col("o_doc")) & (F.col("key") == F.col("o_key")))
                  .select(F.col("doc").alias("h_doc"), F.col("key").alias("h_key"), "n_hit", "items"), "hits")
    joined = facts.join(found, F.col("doc").eqNullSafe(F.col("h_doc")) & (F.col("key") == F.col("h_key")), "left")
    return joined.select(
        F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows without a hit word, with all their columns."""
    _, matches, _ = find_windows(docs, items, width, 0, id_col, text_col)
    hit = stage(matches.select(F.col("doc").alias("__hit_doc"), F.col("key").alias("__hit_key")).distinct(), "hit_docs")
    same = docs[id_col].eqNullSafe(hit["__hit_doc"]) & (
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == hit["__hit_key"])
    return docs.join(hit, same, "left_anti")
