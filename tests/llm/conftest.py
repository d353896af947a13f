import random

import pytest

WORDS = [f"w{i}x" for i in range(400)]
SCHEMA = ("doc_id long, text string, lang string, n_words string, kept int, key string, pos int, bin string, "
          "shard string, score string, runs int, c0 string")


def prose(seed: int, words: int) -> str:
    """Different words at random; lines of eleven words or so."""
    draw = random.Random(seed)
    out = []
    for i in range(words):
        out.append(draw.choice(WORDS) + str(draw.randrange(1000)))
        out.append("\n" if i % 11 == 10 else " ")
    return "".join(out).strip()


def edge_rows() -> list[tuple]:
    """Nulls, empties, a long text, ties, repeated rows, equal ids with other texts."""
    long = prose(1, 40_000)
    texts = [
        (None, None), (None, prose(2, 60)), (1, None), (2, ""), (3, " \n\n\t "), (4, "just three words"),
        (4, "just three words"), (4, prose(3, 80)), (5, prose(3, 80)), (6, long), (7, long + " end"),
        (8, "naïve café " + prose(4, 50)), (8, "naïve café " + prose(4, 50)), (9, "x" * 5000),
        (10, "same line here " * 40), (11, "\n".join(["one line of text that is repeated many times over again"] * 30)),
    ]
    return [(i, t, "en", "7", 1, "k", 0, "b", "s", "0.5", 3, "c") for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
