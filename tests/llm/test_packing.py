"""Packing: exact round trip, ids as the tokenizer gives them, no overlap, little padding, edge rows."""

import zlib
from collections import defaultdict

import numpy as np
from odd import ODD_ROWS
from hypothesis import given, settings
from hypothesis import strategies as st
from parapet.llm import packing
from parapet.llm.queries import QUERIES, vocabulary
from tokenizers import Tokenizer

WORDS = packing.WordTokenizer(vocabulary())
TOKENIZER = Tokenizer.from_file(vocabulary())


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'stmdrevl aB1²ß é\n\t\x1c\x85\xa0<|"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_ids_are_those_of_the_tokenizer(texts):
    found = WORDS.encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [whole(t)[:-1] for t in texts]


def test_special_tokens_and_long_runs():
    texts = ["<|endoftext|> a", "it's we'll ''s !'s", "%" * 5000, "a1" * 4000, "don'"]
    assert [np.frombuffer(f, "<u4").tolist() for f in WORDS.encode(texts)] == [whole(t)[:-1] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9), st.integers(1, 80))
def test_choice_is_the_best_sum(lengths, room):
    from collections import Counter

    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    found = packing.choose(Counter(lengths), room)
    assert sum(found) == max(s for s in sums if s <= room) and not Counter(found) - Counter(lengths)


def check(rows, texts):
    """Every id of every document once and in order, gapless sequences; returns the padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0
    assert pieces.keys() == texts.keys()
    for doc, found in pieces.items():
        ids, at = np.array(whole(texts[doc]), "<u4"), 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = QUERIES["op1_packing"](spark, data).collect()
    assert check(rows, texts) < 0.01 * sum(r.length for r in rows)


def test_odd_rows(documents):
    single = {i: t for i, t, *_ in ODD_ROWS if i not in (None, 7)}
    df = documents([(i, t) for i, t in single.items()], clashes=True)
    check(packing.pack(df, vocabulary(), ids=False).collect(), single)
    out = packing.pack(documents(ODD_ROWS), vocabulary()).collect()
    assert sum(r.length for r in out) == sum(len(whole(t)) for _, t, *_ in ODD_ROWS)
    assert all(len(r.ids) == r.length for r in out)
    assert packing.pack(documents([]), vocabulary()).collect() == []
