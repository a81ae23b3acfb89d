import pytest


@pytest.fixture
def docs(spark):
    """A table of (doc_id, text) from a list of texts."""

    def make(texts, first=0):
        return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], "doc_id long, text string")

    return make
