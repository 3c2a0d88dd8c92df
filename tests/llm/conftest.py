from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

#: Column names that operators use themselves, as extra input columns.
CLASHING = ["_id", "_text", "score", "ids", "decoded", "word", "cls", "pseudonyms", "found", "keep_id", "row", "doc", "_whole"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       *[T.StructField(n, T.StringType()) for n in CLASHING]])


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(("th", "er", "on", "é", "ing", "a", "st")) for _ in range(rng.randint(1, 4)))
                    for _ in range(words))


def odd_texts() -> list[tuple[int | None, str | None]]:
    """NULLs, empty and blank texts, repeated rows, ties, near copies, a NULL id, and one very long text."""
    rng = random.Random(4)
    base = prose(rng, 120)
    near = base.replace(" ", "  ", 1) + " end"
    shared = prose(rng, 90)
    rows = [(1, None), (2, ""), (3, " \n "), (4, base), (5, base.upper()), (6, near), (7, base), (7, base), (8, "one two"),
            (9, "One  two"), (10, shared + " " + prose(rng, 60)), (11, prose(rng, 60) + " " + shared), (None, "no id here"),
            (13, prose(rng, 9000)), (14, "é😀\tß"), (15, "x" * 3000), (16, "call +1 (988) 555-2485 or card 4041894974608795")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    """The odd texts with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, *["z"] * len(CLASHING)) for i, t in odd_texts()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
