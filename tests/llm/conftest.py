import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, words string, row long, fp long, size long, key string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, 1, 2, "w", 3, 4, 5, "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdeéß ") for _ in range(8)) + rng.choice(["", ".", "\n"]) for _ in range(30_000))
    return [(1, "Hello World"), (2, "hello world"), (2, "hello world"), (None, "HELLO WORLD"), (3, None), (4, ""), (None, None), (5, long), (6, "".join(c.upper() if c.isascii() else c for c in long)), (7, "x"), (8, "É é"), (9, "é é"), (10, "a" * 9000), (11, " \n\t ")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])
