"""Edge rows shared by the tests of the text operators."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()),
    ("source", T.StringType()), ("n_chars", T.LongType()))])
CLASH = ("id", "t", "h", "fp", "size", "score", "label", "sid", "block", "gone", "__id", "__hash", "ids", "key", "value")

LINES = [f"the line number {i} of a passage that documents share with each other" for i in range(8)]
LONG = "\n".join(f"row {i} of a long text with words {i * 7919 % 1000} and more {i * 104729 % 977}" for i in range(3000))

ROWS = [
    (1, "\n".join(LINES), "en", "a", 1),
    (2, "\n".join(LINES), "en", "a", 1),  # an exact copy
    (3, "\n".join(["before it", *LINES[2:7], "after it"]), "en", None, 1),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n\n ", "en", "b", 5),
    (7, LONG, "en", "c", 1),
    (7, LONG, "en", "c", 1),  # a repeated row
    (7, "another text with the same id as a long one", "en", "c", 1),
    (None, "a text without an id that nobody else has", "de", "ä", 1),
    (None, "one more text without an id but other words", "de", "ä", 1),
    (8, "x" * 40_000, "en", "b", 40_000),  # one unsplit run
    (9, "tie tie tie tie\n" * 9, "fr", "b", 1),
    (10, "short", "fr", "Z", 5),
    (11, "you are an idiot and a moron. <|endoftext|> you stupid clown", "en", "a", 1),
    (12, "Released under the MIT License. Licensed under CC BY-NC 4.0", "en", "a", 1),
    (13, "Größe 漢字 🙂 naïve café ÀÉ", "de", "é", 1),
]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))
