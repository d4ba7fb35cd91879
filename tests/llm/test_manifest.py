"""The Merkle manifest: layout, trees of several layers and odd rows against a plain computation."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from odd import ODD_ROWS
from parapet.llm import manifest, veb


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """All levels, and each leaf's siblings as (before, after) from below."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i:i + 16])) for i in range(0, len(x), 16)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for x in levels[:-1]:
            start = i // 16 * 16
            path.append(("".join(x[start:i]), "".join(x[i + 1:start + 16])))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        head = "".join(map(field, (i, source, lang, n)))
        other = text
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None:
            other = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups[source].append(((i is not None, i or 0), sha(head + field(text)), sha(head + field(other)), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in names}
    root, over = tree([made[s][0] for s in names]) if names else (None, [])
    out = []
    for s, above in zip(names, over):
        for (_, leaf, other, i), path in zip(sorted(groups[s], key=lambda x: x[:2]), made[s][1]):
            folded = other
            for b, a in path + above:
                folded = sha(b + folded + a)
            out.append((i, leaf, made[s][0], root, sha("".join(b + a for b, a in path + above)), folded, folded == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in manifest.verify(df).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_layout(n):
    """Addresses are a permutation, subtrees are contiguous, and the stored nodes are those of the plain tree."""
    height = max(veb.height_of(n), 2)
    places = np.concatenate([veb.address(level, np.arange(veb.width(n, level)), n, height) for level in range(height + 1)])
    assert sorted(places.tolist()) == list(range(veb.size(n, height)))
    assert veb.address(height, np.zeros(1), n, height)[0] == 0
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    height = veb.height_of(n)
    nodes = veb.build(leaves, height)
    root, paths = tree([x.hex() for x in leaves])
    assert nodes[:32].hex() == root and veb.leaves_of(nodes, n, height) == leaves
    levels = veb.siblings(nodes, n, height)
    assert all([levels[d][i // 16**d] for d in range(height)] == paths[i] for i in range(0, n, 7))


def test_lower_trees_lie_together():
    """Four node levels are cut in two and two: the root with its children first, then each lower tree in one run."""
    n, height = 4096, 3
    assert veb.address(2, np.arange(16), n, height).tolist() == list(range(1, 17))
    for tree_ in (0, 1, 255):
        top = int(veb.address(1, np.array([tree_]), n, height)[0])
        assert top == 17 + tree_ * 17
        assert veb.address(0, np.arange(16) + 16 * tree_, n, height).tolist() == list(range(top + 1, top + 17))


def test_layers(spark, documents, monkeypatch):
    """Blocks of 16 leaves, so that trees of groups and the tree over groups have several layers."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, f"Text {rng.random()}", "en", "hot" if i % 2 else f"s{i % 44}") for i in range(1, 700)]
    rng.shuffle(rows)
    want = brute([(*r, len(r[1])) for r in rows])
    assert got(documents(rows, clashes=True)) == want
    assert {r[6] for r in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_tables(documents, n):
    rows = [(i, f"T{i}", None, None) for i in range(n)]
    assert got(documents(rows)) == brute([(*r, len(r[1])) for r in rows])


def test_odd_rows(documents):
    rows = [*ODD_ROWS, *[(50, "Same", "en", "a")] * 40, (50, "Other", "en", "a"), (-5, "X", None, "ä"), (10**12, "Y", "", "z")]
    assert got(documents(rows, clashes=True)) == brute([(*r, None if r[1] is None else len(r[1])) for r in rows])


def test_null_and_empty_groups_differ(documents):
    rows = [(1, "a", None, None), (2, "b", None, ""), (3, "c", None, "+")]
    assert len({r[2] for r in got(documents(rows))}) == 3 and got(documents(rows)) == brute([(*r, 1) for r in rows])
