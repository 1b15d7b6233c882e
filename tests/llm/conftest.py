import pytest


@pytest.fixture
def frame(spark):
    """A documents-like table from {doc_id: text} or (doc_id, text) rows, with other columns of clashing names."""

    def make(rows, extra=False):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        if extra:
            return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], "doc_id long, text string, key string, sha string, rep long, fp long")
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make
