"""Near-dedup where one id has rows with different texts, against all pairs of rows."""

import random

from parapet.llm import near_dup
from test_near_copies import brute


def rows_found(df, **more):
    return sorted(tuple(r) for r in near_dup.near_duplicates(df, **more).collect())


def by_rows(rows, n=2):
    """Brute force over rows; a component is named by its smallest id."""
    out = brute(list(enumerate(t for _, t in rows)), n)
    least = {}
    for k, _, c, _ in out:
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], size, least[c], least[c] == rows[k][0]) for k, size, c, _ in out)


def test_two_texts_of_one_id(documents):
    """Ids 9 and 3 are near one text of id 5 each; the texts of 5 are not near each other."""
    x, y = ([f"{c}{i}" for i in range(60)] for c in "xy")
    rows = [(5, " ".join(x)), (5, " ".join(y)), (9, " ".join(x[:-2])), (3, " ".join(y[:-2]))]
    want = [(3, 57, 3, True), (5, 59, 3, False), (5, 59, 5, True), (9, 57, 5, False)]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        assert rows_found(documents(order)) == by_rows(order) == want


def test_families_with_repeated_ids(documents):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, last = [], []
    for i in range(90):
        words = [word() for _ in range(rng.randint(20, 70))] if i % 4 == 0 else list(last)
        words[rng.randrange(len(words))] = word()
        last = words
        rows.append((rng.randrange(30), " ".join(words)))
    rng.shuffle(rows)
    assert rows_found(documents(rows), block=7) == rows_found(documents(rows)) == by_rows(rows)
