"""Small tables that every operator must stand: nulls, empty and long texts, repeats, clashing names, no rows."""

ODD = [
    (1, "the quick brown fox jumps over the lazy dog and then the quick brown fox sleeps well", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "the quick brown fox jumps over the lazy dog and then the quick brown fox sleeps well", "en"),
    (4, "the quick brown fox jumps over the lazy dog and then the quick brown fox sleeps well", "en"),
    (5, "  \n\t ", "xx"),
    (6, "Ñandú ²½ naïve 日本語 😀 x" * 3, "es"),
    (None, "a text without an id", "en"),
    (7, "word " * 30_000, "en"),
    (8, "a" * 5_000, "en"),
    (9, "one", None),
]


def odd_documents(spark, empty=False):
    """documents with extra columns whose names clash with those used inside."""
    rows = [] if empty else [(i, t, la, "src", None, 1, "k", 2.0, "x") for i, t, la in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, key string, fp double, place string")
