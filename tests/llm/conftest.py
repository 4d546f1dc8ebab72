import random

import pytest

SCHEMA = "doc_id bigint, text string, n_words bigint, runs string, score double, rank int, shard int, spans string"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of (doc_id, text), with more columns whose names the operators use themselves."""

    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, 1, "x", 0.5, 2, 3, "y") for i, t in rows], SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def messy():
    """Null and empty texts, a null id, repeated rows, signs beyond ASCII, and a very long text."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    return [(1, None), (2, ""), (None, "a text without an id"), (3, "one"), (3, "one"), (4, "Ünïcode 日本 😀 \t\n end"),
            (5, " ".join(draw.choice(words) for _ in range(20_000))), (6, "   \n  "), (7, "x" * 5000)]
