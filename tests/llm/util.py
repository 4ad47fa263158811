"""Small inputs that hold the awkward cases: nulls, empty and very long texts, ties, repeated rows, further columns."""

import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, token int, root string, spans string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names that operators use."""
    full = [(i, t, lang, source, len(t) if t else 0, 7, 8, "x", "y") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    words = [f"w{k % 97}x{k * k % 1009}" for k in range(30_000)]
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"), (2, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (2, "one two three four five six seven eight nine ten eleven", "en", "a"), (3, None, "en", "b"), (4, "", None, "b"), (None, "no id here but words", "de", None),
        (5, " \n\t ", "fr", None), (6, " ".join(words), "en", "c"), (7, "ünïcode wörds — ñandú x y 日本語 text 😀", None, "c"), (8, "a b c", "en", "d"), (9, "a b  c", "en", "d"),
    ]
    return documents(spark, rows)


def empty(spark):
    return spark.createDataFrame([], DOCS)
