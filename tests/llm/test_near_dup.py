"""Near-dedup against all pairs by brute force."""

import random
import re
from collections import Counter, defaultdict

from odd import ODD_ROWS
from parapet.llm import graph, near_dup
from parapet.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, t in rows:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(t or "")]
        sets[i] = set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} - {()}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    lists = defaultdict(list)
    for i in sorted(sets):
        for j, both in Counter(j for v in sets[i] for j in lists[v]).items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for v in sets[i]:
            lists[v].append(i)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def found(df, **more):
    return sorted(tuple(r) for r in near_dup.near_duplicates(df, **more).collect())


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op2_near_dedup"](spark, data).collect())) == brute(rows)


def test_families_in_small_blocks(documents):
    """A family with chains of edits and a shared passage, compared across blocks."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage, rows, last = [word() for _ in range(60)], [], None
    for i in range(120):
        if i % 3 == 0:
            words = [word() for _ in range(rng.randint(5, 60))] + passage
        else:
            words = list(last)
            for _ in range(rng.randint(1, 9)):
                words[rng.randrange(len(words))] = word()
        last = words
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + n, " ".join(passage[:n])) for n in range(1, 9)]
    assert found(documents(rows), block=7) == found(documents(rows)) == brute(rows)


def test_odd_rows(documents):
    known = [r for r in ODD_ROWS if r[0] is not None]
    want = brute([(i, t) for i, t, *_ in known])
    got = found(documents(known, clashes=True))
    assert sorted(set(got)) == want and got.count((7, 1, 7, True)) == 2
    nulls = [r for r in near_dup.near_duplicates(documents(ODD_ROWS)).collect() if r.doc_id is None]
    assert len(nulls) == 2 and all(r.component_id is None and r.kept for r in nulls)
    assert found(documents([])) == []


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 - i, 101 - i) for i in range(30)] + [(200, 201), (201, 200), (300, 300)]
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 71 for i in range(71, 102)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
