"""Rows that every operator must stand: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def hard_documents(spark):
    rows = [(1, "one two three four five six", "en", "a", 27), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, LONG, "en", None, len(LONG)),
            (None, "no id here", "de", "b", 10), (5, "Größe ß 日本 \U0001f600 end", "de", "b", 15), (5, "Größe ß 日本 \U0001f600 end", "de", "b", 15),
            (6, "one two three four five six", "en", "a", 27), (7, "   ", "fr", "a", 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df, names):
    """Extra columns named like the operator's own."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
