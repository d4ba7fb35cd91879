"""Substring dedup against a count of all windows."""

import hashlib
from collections import Counter

import numpy as np
from odd import ODD_ROWS
from hypothesis import given, settings
from hypothesis import strategies as st
from parapet.llm import substrings
from parapet.llm.queries import QUERIES


def brute(rows, width):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s:s + width] for _, b in raw for s in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - width + 1):
            if count[b[s:s + width]] > 1:
                gone[s:s + width] = True
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(df, **more):
    return sorted(map(tuple, substrings.dedup_substrings(df, **more).collect()), key=repr)


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op5_substrings"](spark, data).collect()), key=repr) == brute(rows, 400)


def test_short_windows_in_small_blocks(documents):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("ab é"), 90)) for _ in range(6)]
    rows = [(i, base[rng.integers(6)][:rng.integers(20, 90)] + "".join(rng.choice(list("abcd"), 30)) + base[rng.integers(6)][rng.integers(40):]) for i in range(80)]
    rows += [(90, "ab" * 100), (91, "a" * 70), (92, base[0]), (92, base[0]), (93, "z" * 19)]
    want = brute(rows, 24)
    assert found(documents(rows), width=24, gram=8) == want
    assert found(documents(rows), width=24, gram=8, block=5) == want


def test_odd_rows(documents):
    rows = [r for r in ODD_ROWS if r[0] not in (5, 6)]
    assert found(documents(rows, clashes=True), width=8, gram=4) == brute([(i, t) for i, t, *_ in rows], 8)
    assert [r[:4] for r in found(documents([(5, "long " * 60_000), (6, "x" * 250_000)]))] == [(5, 300_000, 300_000, 1), (6, 250_000, 250_000, 1)]
    assert found(documents([])) == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(3, 12))
def test_every_window_names_one_anchor(raw, width):
    raw = bytes(b % 3 for b in raw)
    hashes, place, first, last = substrings.text_anchors(raw, width, 2)
    windows = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert windows == list(range(max(0, len(raw) - width + 1)))
    assert all(s <= p <= s + width - 2 for p, a, b in zip(place, first, last) for s in (a, b))
    named = {}
    for h, p, a, b in zip(hashes, place, first, last):
        for s in range(a, b + 1):
            assert named.setdefault(raw[s:s + width], (h, p - s)) == (h, p - s)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=9), min_size=1, max_size=40), st.integers(1, 3))
def test_suffix_order(tails, width):
    """Suffixes of several buckets, each with its own first bytes, in the order of their bytes; equal ones keep their places."""
    head = [bytes([120 + i % 3]) * width for i in range(len(tails))]
    suffixes = sorted((h + t.encode() for h, t in zip(head, tails)), key=lambda x: x[:width])
    raw = np.frombuffer(b"".join(suffixes), np.uint8)
    rest = np.array([len(x) for x in suffixes])
    starts = np.cumsum(rest) - rest
    bucket = np.unique([x[:width] for x in suffixes], return_inverse=True)[1]
    sums, power = substrings._prefix(raw, np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64))
    order = substrings.suffix_order(bucket, starts, rest, width, raw, sums, power)
    assert order.tolist() == sorted(range(len(suffixes)), key=lambda i: suffixes[i])


def test_hash_collisions_are_found_by_bytes(documents, monkeypatch):
    """With a hash that hardly tells windows apart, the bytes still decide."""
    prefix = substrings._prefix

    def weak(raw, values):
        """a and b hash alike."""
        same = values.copy()
        same[ord("a")] = same[ord("b")]
        return prefix(raw, same)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc"), 60)) for _ in range(12)]
    contexts = [t.encode() for t in texts] + [texts[0][5:].encode() + b"zz", texts[3][:40].encode()]
    group, shift = np.zeros(len(contexts), np.uint64), np.zeros(len(contexts), np.int64)
    contexts += [contexts[1].replace(b"a", b"b"), contexts[2][:30].replace(b"b", b"a") + contexts[2][30:]]
    group, shift = np.zeros(len(contexts), np.uint64), np.zeros(len(contexts), np.int64)
    shift[12] = 5
    monkeypatch.setattr(substrings, "_prefix", weak)
    owner, inside, hit, _ = substrings.repeated(group, shift, contexts, 20)
    at = Counter((int(shift[o] + i), contexts[o][i:i + 20]) for o, i in zip(owner, inside))
    assert [at[int(shift[o] + i), contexts[o][i:i + 20]] > 1 for o, i in zip(owner, inside)] == hit.tolist()


def test_periodic_text(documents):
    rows = [(0, "ab" * 300), (1, "x" + "ab" * 200 + "y"), (2, "abc" * 150), (3, "ab" * 30 + "abc" * 30), (4, "q" * 25 + "ab" * 12)]
    assert found(documents(rows), width=24, gram=8) == brute(rows, 24) == found(documents(rows), width=24, gram=8, block=7)
