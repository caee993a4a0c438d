import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string, node int")

    return make
