"""Rows that every operator must take without harm."""

LONG = "lorem ipsum dolor sit amet consectetur " * 3000

# id, text, lang, source, n_chars and columns whose names clash with those of results and internals.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, keep string, score double, spans string, band long"
CLASH = (1, 2, "x", 0.5, "s", 3)


def odd_documents(spark):
    rows = [
        (1, "Short text.", "en", "a", 11),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t\n ", "en", "b", 5),
        (5, LONG, "en", "b", len(LONG)),
        (6, LONG, "en", None, len(LONG)),
        (None, "a row without an id, which is long enough to be a line of its own", "en", "a", 10),
        (7, "twice the same row and the same id, word for word and mark for mark", "en", "a", 9),
        (7, "twice the same row and the same id, word for word and mark for mark", "en", "a", 9),
        (8, "Ünïcode – 中文 and \U0001f600 password= \"hunter22\" end", "de", "c", 9),
    ]
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
