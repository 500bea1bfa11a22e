import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, spans string, key string, version int, n_lines string, component_id string"
LONG = "word " * 60_000 + "end"


def rows(*texts, first=0):
    return [(first + i, t, "en", "s", None, 1.0, "x", "y", "z", 1, "n", "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with results."""
    return lambda data: spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def edge(make):
    """NULLs in every column, empty and blank and very long texts, repeated rows and equal texts."""
    data = rows(None, "", "   \n\t ", "one", LONG, "Same line of some text here\nand another one", "Same line of some text here\nand another one", "é ñ 日本語 🦄\n\nx")
    data += [data[5], data[5], (None,) * 12, (None, "text without a key, twice", *data[0][2:]), (None, "text without a key, twice", *data[0][2:])]
    return make(data)


@pytest.fixture(scope="session")
def nothing(make):
    return make([]).limit(0)
