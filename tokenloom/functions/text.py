"""Column expressions over text: lengths, pre-tokenisation, bytes as symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The special tokens, in id order, and the pre-tokenisation
# pattern. Vocabulary and piece borders must equal them for right results.
SPECIAL_TOKENS = ["<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|pad|>"]
SPLIT_PATTERN = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
)

END_OF_TEXT, IM_START, IM_END, PAD = range(len(SPECIAL_TOKENS))
BYTE_BASE = len(SPECIAL_TOKENS)
FIRST_MERGE = BYTE_BASE + 256
MAX_VOCAB = 65536
MIN_CHARS = 50


def pieces(text: Column) -> Column:
    """Lossless pre-tokens of a text; ``(?U)`` gives Unicode white space."""
    return F.regexp_extract_all(text, F.lit("(?U)" + SPLIT_PATTERN), F.lit(0))


def long_enough(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Non-empty and strictly more than ``min_chars`` code points, untrimmed."""
    return F.char_length(text) > min_chars


def byte_ids(text: Column) -> Column:
    """Token ids of the UTF-8 bytes of a text, before any merge.

    Decoding the bytes as Latin-1 gives one character per byte.
    """
    one_per_byte = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.split(one_per_byte, ""), lambda c: (F.ascii(c) + BYTE_BASE).cast("int"))
    )
