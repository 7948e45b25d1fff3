import pytest
from pyspark.sql import types as T

#: Extra columns whose names the operators use themselves.
EXTRA = ["ids", "key", "score", "fp", "rid", "row", "word", "lang_pred"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
                    + [T.StructField(c, T.StringType()) for c in EXTRA])

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of documents from (doc_id, text[, lang]) rows, with extra columns that clash with names in use."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, *(["x"] * len(EXTRA))) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def messy(docs_of):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    return docs_of([(1, None), (2, ""), (3, " \n\t "), (4, "The same words here.", "en"), (4, "The same words here.", "en"), (None, "The same words here.", None),
                    (None, None), (5, LONG, "en"), (6, "12345 !!! ???"), (7, "ÀÉ Straße ß 中文 \x00\x1f 😀", "de"), (8, "one\ntwo\none\n\n", "fr")])
