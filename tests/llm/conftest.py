import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, score double"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or longer rows, with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(*r, None, None, None)[:4] + (7, 1, 2, 0.5) for r in rows], DOCS)

    return make


@pytest.fixture
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, LABELS)
