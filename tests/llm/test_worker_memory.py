"""What a task of packing or substring dedup holds at most: two workers share some 1,000 MB with each other."""

import random
import tracemalloc

import numpy as np
import pandas as pd
from parapet.llm import language, near_dup, packing, shingles, substrings
from parapet.llm.queries import vocabulary


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_packing_holds_small_tables():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(200)]

    def work():
        tokenizer = packing.WordTokenizer(vocabulary())
        part, size = [], 0
        for t in texts * 10:
            part.append(t)
            size += len(t)
            if size >= packing.SLICE:
                tokenizer.encode(part)
                part, size = [], 0

    assert peak(work) < 150


def test_a_long_text_leaves_no_tables():
    tokenizer = packing.WordTokenizer(vocabulary())
    before = len(tokenizer.power)
    text = "some words " * (before // 5)
    ids = np.frombuffer(tokenizer.encode([text])[0], "<u4")
    assert ids.tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(tokenizer.power) == len(tokenizer.inverse) == before


def test_shingle_slices_are_small():
    texts = [b"a few words that repeat " * 40] * 3000

    def work():
        for part in shingles.sliced(texts):
            shingles.shingle_sets(part)

    assert peak(work) < 80


def test_a_crowded_block_of_windows():
    rng = np.random.default_rng(1)
    common = bytes(rng.integers(97, 123, 500, np.uint8))
    contexts = [bytes(rng.integers(97, 123, 120, np.uint8)) + common + bytes(rng.integers(97, 123, 120, np.uint8)) for _ in range(substrings.BLOCK)]
    group, shift = np.full(len(contexts), 5, np.uint64), np.full(len(contexts), -100)
    found = []
    assert peak(lambda: found.extend(substrings.repeated(group, shift, contexts, 400))) < 260
    owner, inside, hit, _ = found
    assert hit[(inside >= 120) & (inside <= 220)].all()
    assert not hit[(inside < 100) | (inside > 240)].any()


def test_factors_of_powers():
    raw = np.random.default_rng(2).integers(0, 256, 3 * substrings.HASHED + 77, np.uint8)
    half = len(raw) // 2
    twice = np.concatenate((raw[:half], raw[:half]))
    sums, power = substrings._prefix(twice, np.arange(1, 257, dtype=np.uint64))
    starts = np.arange(0, half - 900, 701)
    assert (substrings._hashes(sums, power, starts, 900) == substrings._hashes(sums, power, starts + half, 900)).all()
    assert len(np.unique(substrings._hashes(sums, power, starts, 900))) == len(starts)


def test_language_looks_up_few_codes_at_once():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefgh "), 1000)) * 2 for _ in range(1000)]
    model = language.build({"a": np.arange(9, dtype=np.uint64), "b": np.arange(5, 12, dtype=np.uint64)}, "a")
    language.predict(model, texts[:1])  # tables that a worker keeps
    assert peak(lambda: language.predict(model, texts)) < 25
    assert peak(lambda: language.predict(model, ["".join(texts[:400])])) < 40


def test_sets_leave_a_task_in_parts():
    texts = ["a few words that repeat " * 40 + str(i) for i in range(8000)]
    batch = pd.DataFrame({"doc_id": range(len(texts)), "mark": 0, "text": texts})
    next(near_dup._sets(5)(iter([batch.head(1)])))  # tables that a worker keeps
    rows = []
    assert peak(lambda: rows.extend(len(part) for part in near_dup._sets(5)(iter([batch])))) < 15
    assert sum(rows) == len(texts) and len(rows) > 10
