"""Small documents with every awkward case, and plain versions of the operators."""

import zlib

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (4, "word", "en", "a", 4),
    (5, "one two three four five six seven eight nine ten", "en", "b", 48),
    (6, "one two three four five six seven eight nine ten", "en", "b", 48),
    (6, "one two three four five six seven eight nine ten", "en", "b", 48),
    (7, "x" * 70_000, "en", "c", 70_000),
    (8, "lorem ipsum dolor " * 4_000, "en", "c", 72_000),
    (9, "naïve “quotes” 漢字 \U0001d518   end\r\n", "fr", None, 30),
    (None, "a text without a number that goes on for a while", "en", "d", 48),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def clashing(df):
    """The same documents with columns named like the operators' own."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("ids", "point", "a", "b", "spans", "score", "link", "bits", "k", "range", "_parts", "block")})


def fold(doc_id, buckets):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % buckets


def words(text):
    return (text or "").encode().lower().split()


def rows(df):
    return [r.asDict() for r in df.collect()]
