"""A small table of awkward rows: nulls everywhere, empty and long texts, ties, repeated rows and clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h long, at long, size long, bits double, n long, range long, base string, k1 long"
LONG = "the quick brown fox jumps over a lazy dog and runs far away from here " * 3000
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", "a", 33),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n", "en", "a", 3),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG, "en", "b", len(LONG)),
    (8, "é" * 5000, "fr", "b", 5000),
    (9, "12345 67890 !!!", None, "b", 15),
    (None, "a text without any number to name it", "en", None, 36),
    (None, None, None, None, None),
    (10, "x", "en", "c", 1),
    (11, "\U0001f600 \U0001f680 漢字 кириллица", "zh", "c", 16),
]


def documents(spark, rows=None):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, 6, 7, "z", 8) for r in (ROWS if rows is None else rows)], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
