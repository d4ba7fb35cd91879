"""MinHash near-dedup: bottom-k sketches of one hash function, verified on full sets.

A document's set has the 64-bit hashes of its distinct shingles of ``words`` words (a shorter text
is one shingle as a whole); the SKETCH smallest are its sketch. Documents with the same set form a class and are represented by a text of their smallest id. That
id is the class's node; of several classes of one smallest id, all but one take a 64-bit hash instead.

Inverted lists are kept for runs of RUN values that follow each other in a sketch. Frequent
shingles make long lists, runs of them hardly ever. Two sets with a Jaccard similarity of 0.8
share such a run: always, if their sets fit in the sketch (the values of one set missing in the
other cut the shared ones into runs, one of which has three values or more; sets of up to five
shingles also post runs of two), and else but for a chance below 2e-10 a pair. For such larger sets
the estimate (0.5 or more, from 64 draws at least) also misses a pair just at 0.8 with about 2e-8.

A list sends its documents to the group of its smallest document, its pivot, where documents meet
once instead of once per shared run. A group is compared in tasks of BLOCK documents: overlaps of
sketches, the estimate from the union of two sketches up to the smaller one's end, then the exact
Jaccard similarity of full sets for estimates of 0.5 or more. A task returns its links as stars
only, never pairs. Documents of a group with several blocks that are not connected by these links
yet are compared across blocks in a second round, so results don't depend on blocks; a document goes
only to blocks that hold another component than its own. Components are found by joins; nothing of
all documents is collected.

Defined results: a null or blank text has an empty set, is linked with nothing and kept; a null id
takes no part, has no component and is kept; rows that repeat an id are judged by their own text;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm import shingles
from parapet.llm.graph import components
from parapet.llm.state import settled
from parapet.staging import stage

SKETCH, RUN, BLOCK = 64, 3, 500
#: Words of a shingle.
WORDS = 2
#: Linked if SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (80, 100)
ESTIMATE = 0.5
_COLUMNS_AT_ONCE = 8192


def run_keys(values: np.ndarray) -> np.ndarray:
    """A hash of each run of RUN values of the sketch; up to five values, also of each run of two."""
    sketch = values[:SKETCH]

    def runs(n: int) -> np.ndarray:
        count = max(0, len(sketch) - n + 1)
        out = np.full(count, n, np.uint64)
        for i in range(n):
            out = shingles.mixed(out * np.uint64(shingles.BASE) + sketch[i:i + count])
        return out

    if len(values) <= 3:
        return np.empty(0, np.uint64)
    return runs(RUN) if len(values) > 5 else np.concatenate((runs(RUN), runs(2)))


def _sets(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    @settled
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for part in shingles.sliced(b"" if t is None else t.encode("utf-8", "surrogatepass") for t in batch["text"]):
                rows, sets = batch.iloc[at:at + len(part)], shingles.shingle_sets(part, words)
                at += len(part)
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"], "mark": rows["mark"], "n": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "keys": [run_keys(s).view(np.int64) for s in sets],
                })

    return run


def _incidence(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Which set has which value, for values of two sets or more, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[which] > 1
    column = (np.cumsum(n > 1) - 1)[which[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, _COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, (start, start + _COLUMNS_AT_ONCE))
        out = np.zeros((len(sets), min(_COLUMNS_AT_ONCE, total - start)), np.float32)
        out[owner[a:b], column[a:b] - start] = 1
        yield out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of every two sets."""
    out = np.zeros((len(sets), len(sets)))
    for part in _incidence(sets):
        out += part @ part.T
    return out


def estimates(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities on the union of two sketches, up to the end of the one that ends first."""
    sketches = [s[:SKETCH] for s in sets]
    ends = np.array([s[SKETCH - 1] if len(s) > SKETCH else ~np.uint64(0) for s in sets])
    within = np.stack([np.searchsorted(s, ends, "right") for s in sketches])
    both = overlaps(sketches)
    return both / np.maximum(within + within.T - both, 1)


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which two sets are similar enough, as a symmetric matrix."""
    out = np.zeros((len(sets), len(sets)), bool)
    likely = estimates(sets) >= ESTIMATE
    np.fill_diagonal(likely, False)
    some = np.flatnonzero(likely.any(axis=0))
    if len(some):
        both = overlaps([sets[i] for i in some])
        n = np.array([len(sets[i]) for i in some])
        union = n[:, None] + n[None, :] - both
        out[np.ix_(some, some)] = likely[np.ix_(some, some)] & (SHARE[1] * both >= SHARE[0] * union)
    return out


def stars(nodes: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """The components of a matrix of links, each as links to its smallest node."""
    label = nodes.copy()
    while True:
        least = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == label).all():
            return [(int(a), int(b)) for a, b in zip(nodes, label) if a != b]
        label = least


def _compare(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links of groups that come one after another, told apart by ``pivot``, ``i`` and ``j``.

    Where ``component`` is given, documents of one component count as linked already.
    """
    def work(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held).drop_duplicates("node")
        texts = [t.encode("utf-8", "surrogatepass") for t in rows["text"]]
        nodes, found = rows["node"].to_numpy(np.int64), []
        if len(nodes) > 1:
            sets = [s for part in shingles.sliced(texts) for s in shingles.shingle_sets(part, words)]
            near = linked(sets)
            if "component" in rows:
                component = rows["component"].to_numpy(np.int64)
                near |= component[:, None] == component[None, :]
            found = stars(nodes, near)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    @settled
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            for key, part in batch.groupby(["pivot", "i", "j"], sort=False):
                if key != last and held:
                    yield work(held)
                    held = []
                held.append(part)
                last = key
        if held:
            yield work(held)

    return run


def _compared(rows: DataFrame, words: int) -> DataFrame:
    """Links inside each group (pivot, i, j) of ``rows``."""
    dealt = rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    return dealt.mapInPandas(_compare(words), "a long, b long")


def links(docs: DataFrame, classes: DataFrame, block: int = BLOCK, words: int = WORDS) -> DataFrame:
    """Links (a, b) between classes, enough to connect all that are similar.

    ``docs`` has doc_id, text and the text's mark; ``classes`` has node, low, the mark of low's text
    in the class, and keys. The mark keeps apart the texts of one id.
    """
    listed = classes.select("node", "low", "mark", F.explode("keys").alias("key"))
    lists = listed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = listed.join(lists, "key").select("pivot", "node", "low", "mark").distinct()
    members = stage(members, "near-members")
    blocks = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("pivot", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    texts = docs.select(F.col("doc_id").alias("low"), "mark", "text").distinct()
    rows = stage(members.join(blocks, "pivot").join(texts, ["low", "mark"]).drop("low", "mark"), "near-texts")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # The pivot goes to every block; it links most groups there and then.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = rows.withColumn("i", F.explode(F.when(F.col("node") == F.col("pivot"), every).otherwise(F.array(own)))).withColumn("j", F.col("i"))
    found = stage(_compared(placed, words), "near-links")
    wide = rows.where(F.col("blocks") > 1)
    if wide.isEmpty():
        return found
    connected = components(found)
    wide = wide.join(connected, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
    wide = wide.withColumn("own", own)
    held = wide.groupBy("pivot", "own").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    held = held.groupBy("pivot").agg(F.collect_list(F.struct("own", "least", "most")).alias("held"), F.min("least").alias("least"), F.max("most").alias("most"))
    held = held.where(F.col("least") != F.col("most")).select("pivot", "held")
    # A document meets the other blocks that hold another component than its own.
    foreign = F.filter("held", lambda b: (b["own"] != F.col("own")) & ((b["least"] != F.col("component")) | (b["most"] != F.col("component"))))
    tiles = wide.join(held, "pivot").withColumn("other", F.explode(F.transform(foreign, lambda b: b["own"]))).drop("held")
    tiles = tiles.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other")
    return found.union(stage(_compared(tiles, words), "near-links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, words: int = WORDS) -> DataFrame:
    """Per row doc_id, n_shingles (of ``words`` words), component_id and kept (whether it is its component's smallest id)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    sets = stage(rows.mapInPandas(_sets(words), "doc_id long, mark long, n long, digest binary, keys array<long>"), "near-sets")
    known = sets.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.any_value("keys").alias("keys"))
    classes = classes.select("digest", F.col("least.doc_id").alias("low"), "least.mark", "keys")
    classes = stage(classes, "near-classes").withColumn("node", F.col("low"))
    several = classes.groupBy("low").agg(F.min("digest").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    repeated = not several.isEmpty()
    if repeated:
        other = F.col("digest") > F.col("first")
        classes = classes.join(several.select("low", "first"), "low", "left")
        classes = stage(classes.withColumn("node", F.when(other, F.xxhash64("low", "digest")).otherwise(F.col("low"))).drop("first"), "near-classes")
    connected = components(links(rows, classes, block, words))
    if repeated:
        # A component's smallest node may be a hash; its name is its smallest id.
        least = connected.join(classes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least"))
        connected = connected.join(least, "component").select("node", F.col("least").alias("component"))
    found = known.select("doc_id", "n", "digest").join(classes.select("digest", "low", "node"), "digest")
    found = found.join(connected, "node", "left").select("doc_id", "n", F.coalesce("component", "low").alias("component_id"))
    alone = sets.where(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.union(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
