import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) rows with extra columns whose names an operator may use itself."""

    def build(rows):
        full = [(i, t, "en", "src", None if t is None else len(t), "h", 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, id int")

    return build


EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (6, "x " * 30_000)]


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
