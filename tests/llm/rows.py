"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

LONG = "the quick brown fox jumps over the lazy dog " * 3000


def documents(spark, texts, **more):
    rows = [(i, t) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def odd(spark):
    """Rows that every operator on documents must take."""
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", None), (4, LONG, "y"), (4, LONG, "y"), (None, "a line without an id", "z"),
            (None, None, None), (5, "!!! 123", "x"), (6, "Straße\nÉcole 漢字 😀\n\n", "x"), (7, "a line without an id", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr(
        "*", "1 AS n_lines", "2 AS leaks", "3 AS spans", "4 AS ids", "5 AS score", "6 AS kept", "7 AS id", "8 AS rules", "9 AS n", "10 AS hashes")


def empty(spark):
    return odd(spark).where("false")
