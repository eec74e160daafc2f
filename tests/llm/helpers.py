"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGE = [
    (1, "the house of the rising sun and the river", "en", "a", 41), (2, "the house of the rising sun and the river", "en", "a", 41), (2, "the house of the rising sun and the river", "en", "a", 41),
    (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n", None, "b", 3), (6, "x", "de", None, 1), (7, LONG, "en", "c", len(LONG)),
    (8, "die Häuser und der Fluß \U0001f600 漢字 <|endoftext|> it's", "de", "c", 40), (None, "the house of the rising sun and the sea", "en", None, 39), (9, "12345 !!! 678", "fr", "b", 13),
]


def edge(spark):
    """The edge rows beside columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, DOCUMENT)
    return df.withColumns({c: F.lit("x") for c in ("size", "shard", "slot", "key", "set", "cell", "rule", "host", "node", "finish", "tag", "n", "weight", "score")})


def empty(spark):
    return spark.createDataFrame([], DOCUMENT)
