"""Packing documents into sequences by minimum bin slack.

Tokenising and packing happen in the same task, so token ids are never shuffled. A document's
ids, closed by an end id, are cut into pieces of the capacity; full pieces are sequences of their
own. The remainders wait in a pool. A window is filled with the longest remainder and the multiset
of other lengths whose sum comes closest to what is left: a subset-sum over the pool's lengths,
with sums as the bits of one integer and counts split in powers of two, stops as soon as the window
can be filled; the counts are backtracked from the steps' bitsets. The pool is refilled in
between, so there are always many lengths to choose from. When a task's documents are used up, a
window that stays open is closed at powers of two, where a sequence needs no padding: it is cut
into sequences of the binary digits of its sum.

Sequence ids are the number of the partition and a count within it, so a task that runs again
makes the same ids from the same rows.

Defined results: a null or empty text is the end id alone; repeated rows and repeated or null
keys are documents of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.llm.state import kept, settled

CAPACITY, END_ID = 4096, 2
#: Remainders that are held before windows are filled, and words whose ids a worker keeps.
POOL, CACHED_WORDS = 1024, 500_000
#: Characters that are tokenised at once (or one longer text; a worker holds some 80 bytes for each), and words that are encoded in one call.
SLICE, WORDS_A_CALL = 1 << 19, 2000
SPACE, LETTER, NUMBER, OTHER = range(4)
BASE = 0x9E3779B97F4A7C15
# Separators that engines see differently.
ODD = bytes([*range(0x1C, 0x20), 0x85, 0xA0])


class WordTokenizer:
    """Ids of texts by a tokenizers file whose words end with ``</w>``, with a cache of whole words.

    Plain Latin texts are split here as the file says (lower case, contractions, letters, single
    digits, other marks), by numpy over the bytes of many texts. Words are told apart by 64-bit
    hashes, and only those that are not in the cache yet are encoded by the tokenizer. Any other
    text goes through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.kind = np.full(256, OTHER, np.uint8)
        for c in range(256):
            self.kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
        self.kind[[ord(c) for c in " \t\n\x0b\x0c\r"]] = SPACE
        # Odd random values of bytes, and the powers of an odd base and of its inverse modulo 2**64.
        self.value = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
        self.power, self.inverse = self._powers(BASE), self._powers(pow(BASE, -1, 1 << 64))
        self._forget()

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(2 * SLICE, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def _forget(self) -> None:
        self.hashes, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.store = np.empty(0, "<u4")

    @staticmethod
    def plain(text: str) -> bytes | None:
        """The bytes of a text that can be split here: Latin-1 without odd separators or special tokens."""
        try:
            raw = text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if "<|" in text or len(raw.translate(None, ODD)) < len(raw) else raw

    def _words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word in bytes that end with white space."""
        kind = self.kind[raw]
        change = np.empty(len(raw), bool)
        change[0], change[1:] = True, kind[1:] != kind[:-1]
        start = (change | (kind == NUMBER)) & (kind != SPACE)
        quotes = np.flatnonzero(start[:-3] & (raw[:-3] == ord("'")))
        one, two = raw[quotes + 1], raw[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for at, n in ((quotes[short], 2), (quotes[long], 3)):
            start[at + 1] = False
            start[at + n] |= kind[at + n] == LETTER
        begins = np.flatnonzero(start)
        stops = np.flatnonzero(change & (kind == SPACE))
        upto = stops[np.searchsorted(stops, begins)] if len(begins) else begins
        return begins, np.minimum(upto, np.append(begins[1:], len(raw)))

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """``hashes`` are sorted and not in the cache."""
        sizes, ids = [], []
        for i in range(0, len(words), WORDS_A_CALL):
            call = words[i:i + WORDS_A_CALL]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(call)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[found]) + 1
            if len(ends) != len(call):
                raise ValueError("the tokenizer doesn't close every word")
            sizes.append(np.diff(ends, prepend=0))
            ids.append(found)
        size = np.concatenate(sizes)
        at = np.searchsorted(self.hashes, hashes)
        self.first = np.insert(self.first, at, len(self.store) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.store = np.concatenate([self.store, *ids])

    def _plain_ids(self, texts: list[bytes]) -> list[bytes]:
        joined = b"\n".join(texts) + b"\n   "
        raw = np.frombuffer(joined, np.uint8)
        power, inverse = self.power, self.inverse
        if len(raw) > len(power):  # a long text: its tables go with it
            power, inverse = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(raw), b, np.uint64)))) for b in (power[1], inverse[1]))
        begins, ends = self._words(raw)
        if not len(begins):
            return [b""] * len(texts)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value[raw] * power[:len(raw)])))
        hashes = (sums[ends] - sums[begins]) * inverse[begins]
        fresh, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(fresh) > CACHED_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, fresh)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == fresh[known]
        if not known.all():
            spans = where[~known]
            self._learn(fresh[~known], [joined[a:b].decode("latin-1") for a, b in zip(begins[spans].tolist(), ends[spans].tolist())])
            at = np.searchsorted(self.hashes, fresh)
        size = self.size[at][which]
        upto = np.cumsum(size)
        ids = self.store[np.repeat(self.first[at][which] - (upto - size), size) + np.arange(upto[-1])]
        edges = np.cumsum([len(t) + 1 for t in texts])
        words = np.searchsorted(begins, edges)
        cuts = np.concatenate(([0], upto))[words]
        return [part.tobytes() for part in np.split(ids, cuts[:-1])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        raw = [self.plain(t) for t in texts]
        rest = [t for t, r in zip(texts, raw) if r is None]
        whole = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        split = [r for r in raw if r is not None]
        here = iter(self._plain_ids(split) if split else ())
        return [np.array(next(whole).ids, "<u4").tobytes() if r is None else next(here) for r in raw]


def choose(counts: Counter, room: int) -> list[int]:
    """Lengths whose sum comes closest to ``room`` without passing it, each used as often as it is counted at most."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & full
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> best & 1:
            best -= length * times
            chosen += [length] * times
    return chosen


class Packer:
    """Cuts documents and fills sequences; ``rows`` gathers (document, start, ids, tokens, sequence, offset)."""

    def __init__(self, capacity: int, pool: int):
        self.capacity, self.pool, self.sequence = capacity, pool, 0
        self.waiting: dict[int, list] = {}
        self.counts: Counter = Counter()
        self.rows: list[tuple] = []

    def add(self, document, raw: bytes) -> None:
        tokens, size = len(raw) // 4, self.capacity
        for start in range(0, tokens - tokens % size, size):
            self._put([(document, start, raw[start * 4:(start + size) * 4], tokens)])
        if tokens % size:
            start = tokens - tokens % size
            self.waiting.setdefault(tokens % size, []).append((document, start, raw[start * 4:], tokens))
            self.counts[tokens % size] += 1
        if self.counts.total() >= self.pool:
            while self.counts.total() > self.pool // 2:
                self._put(self._window())

    def _take(self, length: int):
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        return self.waiting[length].pop()

    def _window(self) -> list[tuple]:
        longest = max(self.counts)
        window = [self._take(longest)]
        if longest < self.capacity:
            window += [self._take(n) for n in choose(self.counts, self.capacity - longest)]
        return window

    def _put(self, window: list[tuple]) -> None:
        offset = 0
        for document, start, raw, tokens in window:
            self.rows.append((document, start, raw, tokens, self.sequence, offset))
            offset += len(raw) // 4
        self.sequence += 1

    def finish(self) -> None:
        while self.counts:
            window = self._window()
            total = sum(len(w[2]) // 4 for w in window)
            while total:
                size = total if total == self.capacity else 1 << (total.bit_length() - 1)
                part, room = [], size
                while room:
                    document, start, raw, tokens = window.pop(0)
                    n = min(room, len(raw) // 4)
                    part.append((document, start, raw[:n * 4], tokens))
                    if n * 4 < len(raw):
                        window.insert(0, (document, start + n, raw[n * 4:], tokens))
                    room -= n
                self._put(part)
                total -= size


def pack(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    pool: int = POOL, ids: bool = True,
) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the ``ids`` themselves."""
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([source.schema[0], *[T.StructField(name, T.LongType()) for name in longs]])
    if ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    closing = int(end_id).to_bytes(4, "little")

    @settled
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept(("tokenizer", vocabulary), lambda: WordTokenizer(vocabulary))
        packer, first, kind = Packer(capacity, pool), TaskContext.get().partitionId() << 40, None

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = [
                pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
                pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                pa.array([first + r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64()),
            ]
            if ids:
                columns.append(pa.array([np.frombuffer(r[2], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            keys, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            while at < len(keys):
                part, size = [], 0
                while at + len(part) < len(keys) and size < SLICE:
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1])
                for document, raw in zip(keys[at:], tokenizer.encode(part)):
                    packer.add(document, raw + closing)
                at += len(part)
                yield out()
        if kind is not None:
            packer.finish()
            yield out()

    return source.mapInArrow(work, schema)
