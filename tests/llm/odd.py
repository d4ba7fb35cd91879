"""Odd rows that every operator takes, and names that clash with those used inside."""

#: Columns with names that the operators use inside.
CLASHES = ("row", "page", "host", "key", "n", "digest", "node", "tokens", "identity", "level_0", "hash", "block", "component", "lang_pred", "score", "mark")


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


ODD_ROWS = [
    (1, None, None, None), (2, "", "en", ""), (3, " \t\n", "en", "a"), (None, "some text here", None, "a"), (None, None, None, None),
    (4, "word", "en", "a"), (5, "long " * 60_000, "en", "a"), (6, "x" * 250_000, "de", "b"), (7, "same text", "en", "b"), (7, "same text", "en", "b"),
    (8, "ünïcode ßtraße 東京 и текст 😀.", "de", "b"), (9, "1234 5678 !!! ---", "en", "b"),
]
