import pytest

HOSTILE = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, digest string, shard int, token string, label int"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents with extra columns whose names clash with those that operators use inside."""

    def make(rows):
        full = [(i, t, None, "src0", len(t) if t is not None else None, "x", 1, "y", 2, "z", 3) for i, t in rows]
        return spark.createDataFrame(full, HOSTILE)

    return make


#: Nulls, empty and very long texts, ties and repeated rows.
CASES = [(1, "Same Text"), (2, "same text"), (2, "same text"), (3, None), (4, ""), (None, "no id"), (None, None), (5, "word " * 30_000), (6, "é" * 5000), (7, "\n\n"), (8, "Same Text ")]


@pytest.fixture(scope="session")
def cases():
    return CASES
