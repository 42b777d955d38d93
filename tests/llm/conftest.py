import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, in three partitions."""
    def make(pairs, lang="en"):
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(3)
    return make


@pytest.fixture
def scratch(spark):
    from tributary.llm.common import Scratch
    return Scratch(spark)
