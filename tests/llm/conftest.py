import random

import pytest

SF = "/root/testdata/sf0.001"
#: columns that clash with names used inside the operators
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node int, shard int, spans int, found int, th int, doc int, members int, taken int"


def rows(texts, start=0):
    return [(start + i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None if t is None else len(t), *[7] * 9) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, start=0: spark.createDataFrame(rows(texts, start), SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, letters of several scripts, ties, a periodic and a very long text."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    long = " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(20_000))
    return [None, "", " \t\n", "one", "Ein Wort", "ab " * 900, long, long[:5000] + "x" + long[5000:], "same text here " * 3, "same text here " * 3, "日本語 のテキスト é", "1234 !!", None, long[30_000:33_000]]


@pytest.fixture(scope="session")
def odd(make, odd_texts):
    return make(odd_texts)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
