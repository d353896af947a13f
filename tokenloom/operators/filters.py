"""Row filters of the corpus, chat and preference jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import MAX_VOCAB, long_enough


def score_at_least(min_score: Column, *scores: Column) -> Column:
    """Quality rule: no minimum, or the first present score reaches it.

    A row without any score passes. A null score counts as absent.
    """
    return min_score.isNull() | (F.coalesce(*scores, min_score) >= min_score)


def keep_documents(docs: DataFrame, min_score: str = "min_score", scores: tuple[str, ...] = ("score",),
                   text: str = "text") -> DataFrame:
    """Documents that pass the quality and the length rule."""
    rule = score_at_least(F.col(min_score), *[F.col(s) for s in scores])
    return docs.where(rule & long_enough(F.col(text)))


def short_pairs(pairs: DataFrame, chosen_len: str, rejected_len: str, max_len: int = 1024) -> DataFrame:
    """Pairs with both sides within ``max_len`` tokens; longer ones drop out whole."""
    return pairs.where((F.col(chosen_len) <= max_len) & (F.col(rejected_len) <= max_len))


def check_vocabulary(size: int) -> int:
    """Two-byte token ids allow 65,536 entries."""
    if size > MAX_VOCAB:
        raise ValueError(f"vocabulary of {size} exceeds {MAX_VOCAB}")
    return size
