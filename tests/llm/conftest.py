import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A function that makes documents of texts, with extra columns whose names operators use themselves."""

    def make(texts, ids=None, lang="en", source="s", extra=False):
        rows = [(i if ids is None else ids[i], t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS).repartition(3) if rows else spark.createDataFrame([], DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({"score": F.lit("x"), "fp": F.lit(1.5), "n_hit": F.lit(True), "rule": F.lit(None).cast("string"), "topic": F.lit("t"), "items": F.lit(3), "spans": F.lit("y"), "hits": F.lit(0)})
        return df

    return make


#: Null, empty, blank, letterless, one and two words, ties and repeats, and a long text.
ODD = [None, "", " \n\t", "12 34 !!", "one", "Two words", "same text here again", "same text here again", "ä ö ü", "x " * 30_000]


@pytest.fixture
def odd():
    return list(ODD)
