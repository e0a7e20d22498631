"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

WORDS = "the river moves past old stone walls while people carry bread and letters to the market every morning".split()


def prose(seed: int, n: int = 60) -> str:
    return " ".join(WORDS[(seed * 31 + i * i * 7 + i) % len(WORDS)] + (str(seed) if i % 9 == 0 else "") for i in range(n)) + "."


ROWS = [
    (1, prose(1), "en", "a", 1),
    (2, prose(1).upper(), "en", "a", 1),
    (3, prose(2), "fr", None, 1),
    (4, prose(2), None, "b", 1),
    (5, None, "en", "b", 1),
    (6, "", None, "b", 1),
    (7, "   \n\t ", "en", "c", 1),
    (8, "word", "en", "c", 1),
    (8, "word", "en", "c", 1),
    (8, "other words here", "fr", "c", 1),
    (None, "an id is missing", "en", "a", 1),
    (9, "Grüße aus Köln, żółw 中文 😀 ▁ x", "de", "a", 1),
    (10, " ".join([prose(s) for s in range(400)]), "en", "a", 1),
    (11, "x" * 30_000, "en", "a", 1),
    (12, "12345 !!! ###", "en", "a", 1),
    (13, prose(1) + " extra", "en", "a", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(hard):
    """The same rows with columns that operators might make themselves."""
    from pyspark.sql import functions as F

    names = "fp digest kept score label slots n_tokens root u v m shard slot rank key keep_id group_size row_id component_id size copies ids".split()
    return hard.select("*", *[F.lit("mine").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
