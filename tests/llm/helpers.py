"""Small document tables with the awkward rows every operator must take."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i}" for i in range(60_000))
TEXT = "The quick brown fox jumps over the lazy dog while seven other animals look on from the fence by the barn"
ROWS = [
    (1, TEXT, "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "de", "b", 4),
    (5, TEXT, "en", "a", 5), (5, TEXT, "en", "a", 5), (None, TEXT + " at noon", None, "b", 9), (7, LONG, "en", "b", len(LONG)),
    (8, "naïve ÉCOLE ▁ \u0000 日本 😀", "fr", "b", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """The same rows with further columns named like columns that operators add."""
    names = ("n", "cls", "key", "toxic", "spans", "host", "path", "rule", "comp", "th", "edits", "hash", "payload", "digest", "first", "kept", "bad")
    return docs.select("*", *[F.lit("x").alias(name) for name in names])


def same_rows(a, b):
    def ordered(df):
        return sorted(map(str, df.select(sorted(df.columns)).collect()))

    return ordered(a) == ordered(b)
