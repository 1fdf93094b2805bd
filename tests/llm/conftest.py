import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("key", T.LongType()),
                     T.StructField("part", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (ids 0.. unless given), with two extra columns whose
    names clash with inner ones of the operators."""
    def make(texts, ids=None, lang="en", source="s", parts=1):
        rows = [(i, t, lang, source, None if t is None else len(t), 7, "x")
                for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
        return spark.createDataFrame(rows, DOCS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def sample_texts():
    """Whole texts of the smallest test table."""
    import duckdb
    return [r[0] for r in duckdb.connect().sql(
        "SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()]


EDGE = [None, "", " ", "\n\n\n", "a", "Ab ab AB", "é\n\nß  x", "word " * 3000, "tie", "tie",
        "one two three four five six seven eight nine ten eleven", "x" * 5000, "漢字 🙂\t\x0b\r\n end ", "<|endoftext|> it's"]


@pytest.fixture(scope="session")
def edge_texts():
    return list(EDGE)


@pytest.fixture(scope="session")
def folder():
    import tempfile
    return tempfile.mkdtemp(prefix="marquee-test-", dir="/tmp")
