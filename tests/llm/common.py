"""Plain Python versions of what the contracts call words, and small tables with every odd case."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return words((text or "").translate(LOWER))


#: Null columns, empty and blank texts, a very long one, ties and repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n\x0b\x0c\r ", "de", "b"),
    (5, "one", "en", None),
    (6, "lorem ipsum dolor sit amet " * 20_000, "la", "a"),
    (7, "x" * 300_000, "en", "a"),
    (None, "a row without an id stands here for itself", "en", "c"),
    (None, None, None, None),
    (8, "Ünïcödé 日本語 text with odd\u0085spaces \U0001f600", "en", "c"),
]


def odd(spark):
    """The odd rows with columns whose names clash with those that operators use inside."""
    rows = [(*r, 1, 2, "k", 0.5, "t") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, n int, key string, score double, words string")


def labels(spark, empty=False):
    rows = [] if empty else [(i, i % 2, (i // 2) % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
