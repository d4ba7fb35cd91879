"""Exact substring dedup: every byte inside a WIDTH-byte string that also starts elsewhere is removed.

A suffix array of the whole corpus is not needed: two equal WIDTH-byte strings start at suffixes
that agree on WIDTH bytes, so only suffixes that can agree have to be sorted together. Content
decides which can: every WIDTH-byte window names its anchor, the GRAM-byte string with the least
hash in it (the last one of equals), so equal windows have equal anchors at the same place.
Windows of one anchor occurrence follow each other, and about one byte in 170 is an anchor.

1. Anchors of every distinct text are counted; one that occurs once has no equal windows.
2. Texts with repeated anchors give the bytes around each occurrence, which meet by anchor.
3. There windows that agree on WIDTH bytes by a prefix polynomial hash share a bucket. Of each run of
   such windows the first one's suffix is put in order with those of its bucket, by mergesort
   (:func:`suffix_order`): two suffixes are compared by their common extension, a binary search over
   prefix hashes. Neighbours in this order have the longest extensions; these are verified byte by
   byte, so one comparison confirms a whole run of windows; one that fails is settled by its window's bytes.
   Suffixes that share no window hash can't be equal and are left out of the order.
4. Confirmed windows become byte spans, merged per text.

Equal texts are one text with a count; a text that is there twice loses everything if it has
WIDTH bytes. An anchor with more than BLOCK occurrences is dealt to several tasks: each settles
its own, and windows found only once there meet again as single rows by 128-bit cryptographic hashes of their bytes.

Defined results: a null text counts as empty; texts shorter than WIDTH keep all bytes; matches
never cross documents; repeated rows and repeated or null ids are documents of their own; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.shingles import BASE, byte_values, mixed, powers
from parapet.llm.state import kept
from parapet.staging import stage

WIDTH, GRAM, BLOCK = 400, 64, 6_000
#: Bytes in which anchors are searched at once; bits that a place in them takes.
PIECE, PLACE_BITS = 1 << 20, 21
#: Context bytes that are sorted at once, at least one anchor's.
BATCH = 1 << 21
#: Bytes that are compared in one go, window hashes that are made in one go, and rows of windows that leave a task in one go.
COMPARED, HASHED, MARKS = 1 << 20, 1 << 18, 1 << 16
#: Bytes that the low factor of a power spans; a divisor of HASHED.
STEP = 1 << 12

Factors = tuple[np.ndarray, np.ndarray]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the hash's base and, scaled, of its inverse, each as a low and a high factor, so that 8 MB serve 2**31 bytes."""
    low, high, down, far = (t for base in (BASE, pow(BASE, -1, 1 << 64)) for t in (powers(base, STEP), powers(pow(base, STEP, 1 << 64), (1 << 31) // STEP)))
    # As the exponent that is left of a piece's, so that anchors are those of a single table of its size.
    return low, high, down * np.uint64(pow(BASE, 2 * PIECE - 1, 1 << 64)), far


def _prefix(raw: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, Factors]:
    """Prefix sums of the polynomial hash, and the factors of the powers of its base's inverse."""
    low, high, *inverse = kept("base powers", _tables)
    sums = np.zeros(len(raw) + 1, np.uint64)
    for at in range(0, len(raw), HASHED):
        part = raw[at:at + HASHED]
        power = (high[at // STEP:-(-(at + len(part)) // STEP), None] * low).ravel()
        np.cumsum(values[part] * power[:len(part)], out=sums[at + 1:at + 1 + len(part)])
        sums[at + 1:at + 1 + len(part)] += sums[at]
    return sums, tuple(inverse)


def _hashes(sums: np.ndarray, power: Factors, starts: np.ndarray, width) -> np.ndarray:
    """Hashes of ``width`` bytes from each start, alike for equal bytes wherever they stand."""
    low, high = power
    return (sums[starts + width] - sums[starts]) * (low[starts & (STEP - 1)] * high[starts // STEP])


def anchors(raw: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last start of the windows that name it; for one piece of one text."""
    n = len(raw)
    if n < width:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    sums, power = _prefix(raw, kept("byte values", byte_values))
    grams = mixed(_hashes(sums, power, np.arange(n - gram + 1), gram))
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    reach, span = 1, width - gram + 1
    least = packed
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = span - reach
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    place = (low - (least & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    return grams[place[first]], place[first], first, last


def text_anchors(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of a whole text; one of several pieces is searched piece by piece, with all of its windows."""
    data, parts = np.frombuffer(raw, np.uint8), []
    for start in range(0, max(1, len(data) - width + 1), PIECE):
        found = anchors(data[start:start + PIECE + width - 1], width, gram)
        parts.append((found[0], *(x + start for x in found[1:])))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _found(batches: Iterator[pd.DataFrame], width: int, gram: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [text_anchors(b"" if t is None else t.encode("utf-8", "surrogatepass"), width, gram) for t in batch["text"]]
        names = ("hash", "place", "first", "last")
        columns = {name: [r[i].view(np.int64) if not i else r[i] for r in rows] for i, name in enumerate(names)}
        yield pd.DataFrame({"digest": batch["digest"], **columns})


def _contexts(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """The bytes of the windows of each repeated anchor."""
    for batch in batches:
        for digest, text, found in zip(batch["digest"], batch["text"], batch["found"]):
            raw = text.encode("utf-8", "surrogatepass")
            yield pd.DataFrame({
                "hash": [f["hash"] for f in found], "blocks": [f["blocks"] for f in found], "digest": [digest] * len(found),
                "first": [f["first"] for f in found], "shift": [f["first"] - f["place"] for f in found],
                "bytes": [raw[f["first"]:f["last"] + width] for f in found],
            })


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray, width: int, sums: np.ndarray, power: Factors) -> np.ndarray:
    """The common extension of suffixes that agree on ``width`` bytes by hash, up to ``most``, by binary search."""
    low, high = np.full(len(a), width), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = _hashes(sums, power, a, middle) == _hashes(sums, power, b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from a and b are the same, byte by byte; about COMPARED bytes are looked at in one go."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(size)
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - size[start] + COMPARED, "right")))
        n = size[start:stop]
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = raw[np.repeat(a[start:stop], n) + steps] != raw[np.repeat(b[start:stop], n) + steps]
        out[start:stop] = np.bincount(np.repeat(np.arange(stop - start), n), differ, stop - start) == 0
        start = stop
    return out


def suffix_order(bucket: np.ndarray, starts: np.ndarray, rest: np.ndarray, width: int, raw: np.ndarray, sums: np.ndarray, power: Factors) -> np.ndarray:
    """The order of suffixes inside their buckets, by mergesort; ``bucket`` ascends, a suffix has ``rest`` bytes and agrees with its bucket on ``width``.

    Two suffixes are compared by their common extension, a binary search over prefix hashes, and the byte
    after it; one that ends there comes first. All merges of a level are done at once: a suffix moves by the number of
    suffixes of the other run that come before it, itself a binary search.
    """
    n = len(bucket)
    order = np.arange(n)
    begin = np.searchsorted(bucket, bucket, "left")
    end = np.searchsorted(bucket, bucket, "right")
    place = np.arange(n) - begin

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(rest[a], rest[b])
        common = _common(starts[a], starts[b], most, width, sums, power)
        ended = common == most
        at = np.where(ended, 0, common)
        less = np.where(ended, rest[a] < rest[b], raw[starts[a] + at] < raw[starts[b] + at])
        return less | (or_equal & ended & (rest[a] == rest[b]))

    run = 1
    while run < (end - begin).max(initial=0):
        number = place // run
        other = begin + (number ^ 1) * run
        low = np.minimum(other, end)
        first, high = low.copy(), np.minimum(other + run, end)
        late = number % 2 == 1  # of the second run: equal ones of the first come before
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            goes = before(order[middle], order[open_], late[open_])
            low[open_] = np.where(goes, middle + 1, low[open_])
            high[open_] = np.where(goes, high[open_], middle)
        target = begin + (number // 2) * 2 * run + (place - number * run) + (low - first)
        merged_order = np.empty_like(order)
        merged_order[target] = order
        order = merged_order
        run *= 2
    return order


def repeated(group: np.ndarray, shift: np.ndarray, contexts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the contexts: index of the context, start in it, whether it has an equal in its group, and a hash.

    ``group`` is the anchor's hash and ``shift`` the first window's start from the anchor.
    """
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    base = np.cumsum(size) - size
    n = size - width + 1
    # Four bytes a number: there is a row for every window of a crowded anchor.
    owner = np.repeat(np.arange(len(contexts), dtype=np.int32), n)
    inside = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
    starts = base.astype(np.int32)[owner] + inside
    sums, power = _prefix(raw, kept("byte values", byte_values))
    key = np.empty(len(owner), np.uint64)
    for at in range(0, len(owner), HASHED):
        some = slice(at, at + HASHED)
        mine = owner[some]
        key[some] = mixed(_hashes(sums, power, starts[some], width) ^ mixed(group[mine] + (shift[mine] + inside[some]).astype(np.uint64)))
    order = np.argsort(key, kind="stable").astype(np.int32)
    same = key[order[1:]] == key[order[:-1]]
    bucket = np.empty(len(key), np.int32)  # of equal keys
    bucket[order] = np.cumsum(np.concatenate(([True], ~same)), dtype=np.int32) - 1 if len(key) else 0
    heads = np.flatnonzero(np.concatenate(([True], ~same))).astype(np.int32)  # first place of each bucket in the order
    state = np.zeros(len(key), np.uint8)  # 1: a candidate, 2: confirmed
    state[order[1:][same]] = 1
    state[order[:-1][same]] = 1
    rest = lambda at: size[owner[at]] - inside[at]
    while True:
        # The first open candidate of each run; its extension confirms those that follow it.
        todo = np.flatnonzero(state == 1)
        if not len(todo):
            break
        todo = todo[np.concatenate(([True], (todo[1:] != todo[:-1] + 1) | (owner[todo[1:]] != owner[todo[:-1]])))]
        # Their suffixes in order, with two others of each bucket, so that none is alone; the longest extension is that of a neighbour.
        suffix = np.unique(np.concatenate((todo, order[heads[bucket[todo]]], order[heads[bucket[todo]] + 1])))
        suffix = suffix[np.argsort(bucket[suffix], kind="stable")]
        suffix = suffix[suffix_order(bucket[suffix], starts[suffix].astype(np.int64), rest(suffix), width, raw, sums, power)]
        by_number = np.argsort(suffix)
        place = by_number[np.searchsorted(suffix, todo, sorter=by_number)]
        common, other = np.zeros(len(todo), np.int64), np.full(len(todo), -1)
        for step in (-1, 1):
            near = suffix[np.clip(place + step, 0, len(suffix) - 1)]
            pair = np.flatnonzero((near != todo) & (bucket[near] == bucket[todo]))
            a, b = todo[pair], near[pair]
            found = _common(starts[a], starts[b], np.minimum(rest(a), rest(b)), width, sums, power)
            better = found > common[pair]
            common[pair[better]], other[pair[better]] = found[better], b[better]
        good = _equal(raw, starts[todo], starts[other], common)
        for i in np.flatnonzero(~good):
            window = raw[starts[todo[i]]:][:width].tobytes()
            twins = np.flatnonzero(key == key[todo[i]])
            hit = any(t != todo[i] and raw[starts[t]:][:width].tobytes() == window for t in twins)
            state[todo[i]] = 2 if hit else 0
        count = (common - width + 1)[good]
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        state[np.repeat(todo[good], count) + steps] = 2
    return owner, inside, state == 2, key


def _spans(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Spans (digest, start, stop) of confirmed windows; for anchors in several blocks also hashes of the rest."""
    held: list[pd.DataFrame] = []
    size, last = 0, None

    def work() -> Iterator[pd.DataFrame]:
        rows = pd.concat(held, ignore_index=True)
        block = rows["block"].to_numpy(np.uint64)
        group = mixed(rows["hash"].to_numpy(np.int64).view(np.uint64) ^ mixed(block + np.uint64(7)))
        shift, first = rows["shift"].to_numpy(), rows["first"].to_numpy()
        owner, inside, hit, key = repeated(group, shift, rows["bytes"].tolist(), width)
        at = np.flatnonzero(hit)
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))) if len(at) else np.empty(0, bool)
        begin, end = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
        digest = rows["digest"].to_numpy()
        yield pd.DataFrame({
            "digest": digest[owner[begin]], "start": first[owner[begin]] + inside[begin], "stop": first[owner[begin]] + inside[end] + width,
            "mark": None, "alone": False,
        })
        split = np.flatnonzero(rows["blocks"].to_numpy()[owner] > 1).astype(np.int32)
        if not len(split):
            return
        # One row for each different window of the block; only those found once still need a partner.
        _, one = np.unique(key[split], return_index=True)
        split = split[one]
        del one, key
        contexts, hashes = rows["bytes"].tolist(), [h.tobytes() for h in rows["hash"].to_numpy()]
        # A crowded block has millions of them, so they leave some at a time.
        for at in range(0, len(split), MARKS):
            some = split[at:at + MARKS]
            places = zip(owner[some].tolist(), inside[some].tolist())
            marks = [hashlib.blake2b(contexts[o][i:i + width] + hashes[o], digest_size=16).digest() for o, i in places]
            begin = first[owner[some]] + inside[some]
            yield pd.DataFrame({"digest": digest[owner[some]], "start": begin, "stop": begin + width, "mark": marks, "alone": ~hit[some]})

    for batch in batches:
        for key, part in batch.groupby(["hash", "block"], sort=False):
            if key != last and size >= BATCH:
                yield from work()
                held, size = [], 0
            held.append(part)
            size += int(part["bytes"].map(len).sum())
            last = key
    if held:
        yield from work()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that some span covers."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for digest, text, spans in zip(batch["digest"], batch["text"], batch["spans"]):
            raw = text.encode("utf-8", "surrogatepass")
            found = merged([(s["start"], s["stop"]) for s in spans])
            rest, at = hashlib.sha256(), 0
            for start, stop in found:
                rest.update(raw[at:start])
                at = stop
            rest.update(raw[at:])
            rows.append((digest, sum(b - a for a, b in found), len(found), rest.hexdigest()))
        yield pd.DataFrame(rows, columns=["digest", "removed", "runs", "left"])


def removed_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (digest, text): texts with a repeated window (digest, text), and spans (digest, start, stop), not merged."""
    found = docs.mapInPandas(lambda b: _found(b, width, gram), "digest binary, hash array<long>, place array<long>, first array<long>, last array<long>")
    each = found.groupBy("digest").agg(F.any_value(F.arrays_zip("hash", "place", "first", "last")).alias("found"))
    each = stage(each, "substring-anchors")
    occurrences = each.select("digest", F.explode("found").alias("f")).select("digest", "f.*")
    often = occurrences.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # Written, so that the join may split an anchor with very many occurrences.
    often = stage(often.select("hash", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "substring-often")
    wanted = occurrences.join(often, "hash").groupBy("digest").agg(
        F.collect_list(F.struct("hash", "blocks", "place", "first", "last")).alias("found")
    )
    texts = stage(wanted.join(docs, "digest").dropDuplicates(["digest"]), "substring-texts")
    contexts = texts.mapInPandas(
        lambda b: _contexts(b, width), "hash long, blocks long, digest binary, first long, shift long, bytes binary"
    ).withColumn("block", F.pmod(F.xxhash64("digest", "first"), F.col("blocks")))
    dealt = contexts.repartition("hash", "block").sortWithinPartitions("hash", "block")
    spans = stage(dealt.mapInPandas(lambda b: _spans(b, width), "digest binary, start long, stop long, mark binary, alone boolean"), "substring-spans")
    marks = spans.where(F.col("mark").isNotNull())
    shared = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("mark")
    late = marks.where("alone").join(shared, "mark", "left_semi").select("digest", "start", "stop")
    return texts.select("digest", "text"), spans.where(F.col("mark").isNull()).select("digest", "start", "stop").union(late)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Per row ``key``, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that are left."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(key), t.alias("text"), F.sha2(t.cast("binary"), 256).alias("sha"))
    whole = whole.withColumn("digest", F.unhex(F.substring("sha", 1, 32)))
    texts, spans = removed_spans(whole.select("digest", "text").where(F.octet_length("text") >= width), width, gram, block)
    listed = spans.groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = listed.join(texts, "digest").mapInPandas(_cut, "digest binary, removed long, runs long, left string")
    rows = whole.select(key, "digest", "sha", F.octet_length("text").cast("long").alias("n_bytes"))
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(counts, "digest").join(cut, "digest", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    none = F.lit(0).cast("long")
    return rows.select(
        key, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", none)).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("runs", none)).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
    )
