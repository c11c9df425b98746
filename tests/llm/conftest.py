import pytest
from pyspark.sql import functions as F

from ..conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, kept int, bucket string, _id int, id long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture
def frame(spark):
    """Documents of (doc_id, text) rows, with extra columns whose names operators use inside."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, 7, "b", 1, 2) for i, t in rows], SCHEMA)

    return make


#: null, empty, blank, tied, repeated and long texts, and a null id
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (None, None), (9, "x " * 40_000), (8, "É ▁ ñ 漢字 😀\x00 z")]
