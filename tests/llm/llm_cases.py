"""Small tables with the cases that every operator must handle."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("uid", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("a.b", T.StringType()),
    ]
)
LONG = " ".join(f"word{i % 997} piece{i % 31}" for i in range(20_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree nearby today"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns whose names clash with inner ones."""
    full = [(i, t, lang, source, None if t is None else len(t), "u", "n", "x") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


EDGE = [
    (1, PASSAGE, "en", "a"),
    (2, PASSAGE.replace(" ", "\n"), "en", "a"),
    (3, PASSAGE + " and then", "en", "b"),
    (4, None, "en", "a"),
    (5, "", None, "a"),
    (6, "   \t\n ", "en", None),
    (7, "one", "en", "b"),
    (7, "one", "en", "b"),
    (8, "One two three", "fr", "c"),
    (None, "one two three", "fr", "c"),
    (9, LONG, "en", "c"),
    (10, LONG + " end", "en", None),
    (11, "ünïcödé wörds are hére too, sürely", "de", "c"),
    (12, "12 34 !!", "en", "b"),
]
