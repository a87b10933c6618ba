import pytest

from pyspark.sql import types as T

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(texts, sources=("a",)):
    return [(i, t, "en", sources[k % len(sources)], len(t or "")) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Function: (doc_id, text) pairs -> a frame with the columns of documents and two that clash with names used inside."""

    def make(texts, sources=("a",)):
        rows = [(*r, "x", 7) for r in doc_rows(texts, sources)]
        return spark.createDataFrame(rows, DOC_SCHEMA + ", _key string, Score int")

    return make


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Repeated row, the same id and text twice."), (5, "Repeated row, the same id and text twice."), (None, "No id here.")]


@pytest.fixture(scope="session")
def edges():
    return [*EDGES, (6, "long " * 60_000 + "end"), (7, "x" * 3000)]


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, T.StructType().add("doc_id", "long").add("quality", "integer").add("toxic", "integer"))
