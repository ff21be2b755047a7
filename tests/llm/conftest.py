import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return make


#: Rows that every operator has to take: null and empty texts, a null id, repeated rows, one very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a text without an id"), (4, "same text twice"), (4, "same text twice"), (5, "long " * 60000)]


@pytest.fixture
def odd(documents):
    """Such rows, with a column more whose name clashes with what operators make."""
    from pyspark.sql import functions as F

    return documents(ODD).withColumn("score", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("spans", F.lit(2)).withColumn("key", F.lit(3)).withColumn("shard", F.lit(4))
