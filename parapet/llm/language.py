"""Language ID by bit-sliced Bloom filters: one lookup tells all languages that have an n-gram.

Learning counts character n-grams per language on a sample of labelled documents of about
SAMPLE_DOCS per language (a documented bound; rows are chosen by a hash of the id, at a rate that
follows the language's count). A language keeps its TOP_GRAMS most frequent n-grams, without
those that another language uses CONTRAST times as often. All languages share one table of
slots; slot s holds a bit mask with the bits of the languages for which some n-gram set s. The
AND of an n-gram's HASHES slots is the mask of the languages that have it.

Prediction looks up every n-gram of the whole text and adds up the bits per language. A filter
that is full to a share f answers for f**HASHES of strange n-grams, so a count c of n becomes
(c - n f**HASHES) / (1 - f**HASHES). The largest corrected count wins; the score is its share of
the text's n-grams, from 0 to 1.

Defined results: a null text, or one without letters (Unicode category L), gives ``und`` and
score 0; ties go to the first language in alphabetical order; a text with letters but no known
n-gram gets the most frequent learned language and score 0; without any labelled document all
predictions are ``und``; a null id counts as the text ''; repeated rows each keep their row; an
empty table gives an empty table; very long texts are read in pieces that overlap.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parapet.llm.state import kept, settled

SAMPLE_DOCS, TOP_GRAMS, CONTRAST = 2_000, 20_000, 4.0
ORDERS, HASHES, SLOT_BITS = (2, 4), 2, 18
#: Characters in which a long text is read, and codes whose n-grams are looked up at once: a worker holds some 60 bytes for each of those.
PIECE, GATHERED = 1 << 20, 1 << 17
UNKNOWN = "und"
_OUT = "lang_pred string, score double"


def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def normalised(text: str) -> np.ndarray:
    """Code points in lower case; every run of other characters than letters is one 0, also at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(kept("letters", _letters)[codes], codes, 0).astype(np.uint32)
    codes = np.concatenate((np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)))
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit value for each run of ``order`` codes."""
    if len(codes) < order:
        return np.empty(0, np.uint64)
    out = np.full(len(codes) - order + 1, order, np.uint64)
    for i in range(order):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i:len(codes) - order + 1 + i].astype(np.uint64)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, index of the text per code) of some GATHERED codes; a text longer than PIECE comes in several pieces.

    Between two texts stand two zeros, so that no n-gram of letters reaches across them.
    """
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush():
        return np.concatenate(held), np.repeat(np.array(owners), [len(h) for h in held])

    for i, text in enumerate(texts):
        for start in range(0, max(len(text), 1), PIECE):
            # An overlap of the longest order less one; n-grams of the cut itself are not worth telling apart.
            codes = normalised(text[max(0, start - max(ORDERS) + 1):start + PIECE])
            held.append(codes)
            owners.append(i)
            size += len(codes)
            if size >= GATHERED:
                yield flush()
                held, owners, size = [], [], 0
    if held:
        yield flush()


def all_grams(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(value, owner) of the n-grams inside one text, order by order, GATHERED at a time."""
    for order in ORDERS:
        for at in range(0, max(1, len(codes) - order + 1), GATHERED):
            values = grams(codes[at:at + GATHERED + order - 1], order)
            begin, end = owner[at:at + len(values)], owner[at + order - 1:at + order - 1 + len(values)]
            inside = begin == end
            yield values[inside], begin[inside]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    common: int
    slots: np.ndarray
    false_rate: np.ndarray


def _slots(values: np.ndarray) -> Iterator[np.ndarray]:
    for h in range(HASHES):
        yield ((values >> np.uint64(h * 23)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def build(kept_grams: dict[str, np.ndarray], common: str) -> Model:
    """The filters of the languages from their n-grams; the masks have as many bytes as the languages need."""
    languages = tuple(sorted(kept_grams))
    words = -(-len(languages) // 64)
    slots = np.zeros((1 << SLOT_BITS, words), np.uint64)
    rates = []
    for i, name in enumerate(languages):
        bit = np.uint64(1 << (i % 64))
        for at in _slots(kept_grams[name]):
            slots[at, i // 64] |= bit
        rates.append(float(((slots[:, i // 64] & bit) != 0).mean()) ** HASHES)
    if len(languages) <= 8:
        slots = slots.astype(np.uint8)
    return Model(languages, languages.index(common) if common in languages else 0, slots, np.array(rates))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    texts = ["" if t is None else t for t in texts]
    n, size = len(texts), len(model.languages)
    hits, total, lettered = np.zeros((size, n)), np.zeros(n), np.zeros(n, bool)
    for codes, owner in pieces(texts):
        here, m = slice(owner[0], owner[-1] + 1), owner[-1] + 1 - owner[0]
        owner = owner - owner[0]
        lettered[here] |= np.bincount(owner, codes != 0, m) > 0
        for values, of in all_grams(codes, owner):
            total[here] += np.bincount(of, minlength=m)
            mask = None
            for at in _slots(values):
                mask = model.slots[at] if mask is None else mask & model.slots[at]
            for i in range(size):
                bit = mask.dtype.type(1 << (i % 64))
                hits[i, here] += np.bincount(of[(mask[:, i // 64] & bit) != 0], minlength=m)
    if not size:
        return [UNKNOWN] * n, [0.0] * n
    rate = model.false_rate[:, None]
    right = np.clip((hits - total * rate) / np.maximum(1 - rate, 1e-9), 0, None)
    best = right.argmax(axis=0)
    top = right[best, np.arange(n)]
    best = np.where(top > 0, best, model.common)
    score = np.clip(top / np.maximum(total, 1), 0, 1)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
    return names, np.where(lettered, score, 0.0).tolist()


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@settled
def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang", sort=False):
            for codes, owner in pieces(part["text"].tolist()):
                found = np.concatenate([v for v, _ in all_grams(codes, owner)])
                values, n = np.unique(found, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": values.view(np.int64), "n": n})


def _sliced(texts: pa.Array) -> Iterator[list[str | None]]:
    """Consecutive texts of about GATHERED characters, so that few of a batch are Python's at once."""
    part, size = [], 0
    for text in texts:
        part.append(text.as_py())
        size += len(part[-1] or "")
        if size >= GATHERED:
            yield part
            part, size = [], 0
    if part:
        yield part


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Filters from the labelled documents that are not held out."""
    rows = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model((), 0, np.zeros((1 << SLOT_BITS, 1), np.uint8), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, SAMPLE_DOCS / n))])
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < rate[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = sample.mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("lang"))
    found = found.withColumn("share", share).withColumn("most", F.max("share").over(W.partitionBy("gram")))
    found = found.where(F.col("share") * CONTRAST >= F.col("most"))
    found = found.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    top = found.where(F.col("place") <= TOP_GRAMS).select("lang", "gram").toPandas()
    grams_of = {name: part["gram"].to_numpy().view(np.uint64) for name, part in top.groupby("lang")}
    return build(grams_of, min(counts, key=lambda name: (-counts[name], name)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct of ``lang_pred`` and ``score`` for the column ``text`` of ``docs``."""
    # Plain parts: workers need not know this package to read them.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.common, model.slots, model.false_rate))

    @F.arrow_udf(_OUT)
    @settled
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        learned = Model(*shared.value)
        for batch in batches:
            names, scores = [], []
            for part in _sliced(batch):
                found = predict(learned, part)
                names += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return told(F.col(text))
