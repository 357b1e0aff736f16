import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents with NULL ids and texts, empty and repeated rows, and extra columns with clashing names."""

    def build(texts, schema="doc_id long, text string, key string, label int, words string, n_chars long"):
        rows = [(i, t, "k", 1, "w", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return build
