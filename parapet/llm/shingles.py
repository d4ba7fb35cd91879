"""Words and shingles (some words that follow each other) of many texts at once, as 64-bit hashes computed by numpy.

A text is lower-cased in A-Z and its words are runs of other bytes than space and tab to
carriage return, in UTF-8. A word's hash is a polynomial over random values of its bytes; the
shingles of a text are mixed from the hashes of words that follow each other.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from parapet.llm.state import kept

BASE = 0x9E3779B97F4A7C15
#: Bytes that are worked on at once (or one longer text).
SLICE = 1 << 19
_EVEN, _ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def byte_values() -> np.ndarray:
    return np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _EVEN
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the end of each text in them."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    value, lower = kept("byte values", byte_values), kept("lower", _lower)
    # A power of two, so that long texts of many lengths share a few tables.
    size = 1 << max(len(raw) - 1, 2 * SLICE - 1).bit_length()
    power, inverse = kept(("powers", size), lambda: (powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[lower[raw]] * power[:len(raw)])))
    before = np.concatenate(([True], space[:-1]))
    begins, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    hashes = mixed((sums[ends] - sums[begins]) * inverse[begins])
    return hashes, np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts]))


def shingle_sets(texts: list[bytes], words: int = 2) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``words`` words; a shorter text is one shingle, no word is none."""
    hashes, upto = word_hashes(texts)
    begins = np.concatenate(([0], upto[:-1])).astype(np.int64)
    chain, whole = hashes, np.zeros(len(texts), np.uint64)
    for n in range(1, words):
        short = upto - begins == n
        whole[short] = chain[begins[short]]
        chain = mixed(chain[:-1] * _ODD + hashes[n:])
    out = []
    for i, (start, end) in enumerate(zip(begins.tolist(), upto.tolist())):
        if end - start >= words:
            found = np.sort(chain[start:end - words + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        else:
            out.append(whole[i:i + 1] if end > start else hashes[:0])
    return out


def sliced(texts: Iterable[bytes], limit: int = SLICE):
    """Consecutive groups of texts of about ``limit`` bytes."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part
