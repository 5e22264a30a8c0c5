"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, spans string, row long, length int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "   \n\t "), (103, "x" * 5000), (104, "<|endoftext|> a <|endoftext|>"), (105, "日本語 текст  two spaces\r\n"), (3, rows[3][1]), (3, "another text"), (None, "no id"), (None, None)]
    rows += [(200 + k, rows[5][1]) for k in range(4)] + [(300, " ".join(rng.choices(words, k=6000)))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, odd_docs):
    return spark.createDataFrame([(i, t, "xx", "s", None, 7, "k", "p", 1, 2) for i, t in odd_docs], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
