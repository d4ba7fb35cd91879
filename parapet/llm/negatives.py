"""Hard negatives of anchor rows by exact integer scores, in tiles of anchors and candidates.

Vectors become integers, floor(SCALE * x). In a first round every anchor meets the rows of its own
label, block by block, and keeps its best POSITIVES; in a second one it meets all rows, and every
block keeps, for each positive, the best rows of other labels whose scores lie between the two
shares of the positive's. The blocks' lists are merged by rank. Scores of a tile come from wide
integers (:mod:`kronecker`): one multiplication per component of an anchor for all candidates of the tile.

Rows are dealt to blocks by a hash, with as many blocks as the label (first round) or the table (second
round) needs, so a label that holds most rows has many blocks. A tile holds ANCHOR_CELLS and
CANDIDATE_CELLS components at most on average, whatever the number of rows and dimensions.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part;
rows are told apart by their place, not their id, so repeated rows are rows of their own, and rows only
meet rows of their dimension; an empty vector scores 0; a score beyond a long counts as the nearest
long; an anchor without positives, or a positive without negatives, gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parapet.llm.kronecker import Packed
from parapet.staging import stage

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score in percent of its positive's.
SHARES = (30, 90)
#: Components of a tile's anchors and candidates.
ANCHOR_CELLS, CANDIDATE_CELLS = 1 << 17, 1 << 19


def usable(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """The written rows that take part: row, vec_id, label, d, and the integers ``v`` (or doubles, if some don't fit an int)."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"), finite.alias("finite"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND finite")
    largest = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 0.0
    kind = next((kind for kind, bits in (("smallint", 15), ("int", 31)) if SCALE * largest < 2**bits - 1), None)
    whole = F.transform("x", lambda x: F.floor(x * SCALE)).cast(f"array<{kind}>") if kind else F.col("x")
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("x").alias("d"), whole.alias("v")), "vectors")


def _matrix(vectors: pd.Series) -> np.ndarray:
    if not len(vectors) or vectors.iloc[0].dtype != np.float64:
        return np.stack(vectors.to_numpy()).astype(np.int64)
    # Beyond 2**53 a double is whole, and its product might not be a finite double.
    whole = lambda x: int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)
    out = np.empty((len(vectors), len(vectors.iloc[0])), object)
    for i, vector in enumerate(vectors):
        out[i] = [whole(x) for x in vector.tolist()]
    return out


def _scores(anchors: pd.DataFrame, candidates: pd.DataFrame):
    """Each anchor's row number in its frame with its scores for all candidates."""
    vectors = [list(map(int, v)) for v in _matrix(anchors["v"])]
    most = max(sum(map(abs, v)) for v in vectors)
    packed = Packed(_matrix(candidates["v"]), most)
    for i, vector in enumerate(vectors):
        yield i, packed.products(vector)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties by place."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    # ~x orders like -x, also at the ends of a long.
    return places[np.argsort(~scores[places], kind="stable")][:k]


def _by_id(candidates: pd.DataFrame) -> pd.DataFrame:
    return candidates.sort_values(["vec_id", "row"], ignore_index=True)


def positives_of(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` other rows of each anchor in one tile of a label."""
    out = []
    if len(anchors) and len(candidates):
        candidates = _by_id(candidates)
        rows, ids = candidates["row"].to_numpy(), candidates["vec_id"].to_numpy()
        own = anchors["row"].to_numpy()
        for i, scores in _scores(anchors, candidates):
            found = [p for p in best(scores, k + 1) if rows[p] != own[i]][:k]
            out += [(own[i], rows[p], ids[p], scores[p]) for p in found]
    return pd.DataFrame(out, columns=["anchor", "row", "positive_id", "positive_score"])


def negatives_of(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int, shares: tuple[int, int]) -> pd.DataFrame:
    """The best ``k`` rows of other labels for each anchor and positive in one tile."""
    out = []
    if len(anchors) and len(candidates):
        candidates = _by_id(candidates)
        ids, labels = candidates["vec_id"].to_numpy(), candidates["label"].to_numpy()
        frame = list(zip(*[anchors[c] for c in ("row", "vec_id", "label", "positives")]))
        for i, scores in _scores(anchors, candidates):
            row, anchor_id, label, positives = frame[i]
            other = np.flatnonzero(labels != label)
            mine = scores[other]
            for place, (positive_id, score) in enumerate(positives.reshape(-1, 2).tolist()):
                low, high = -(-shares[0] * score // 100), shares[1] * score // 100
                if low > high:
                    continue
                fits = np.flatnonzero((mine >= low) & (mine <= high))
                found = other[fits[best(mine[fits], k)]]
                out += [(row, place, anchor_id, positive_id, ids[p], score, scores[p]) for p in found]
    return pd.DataFrame(out, columns=["anchor", "place", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])


def _tiles(anchors: DataFrame, candidates: DataFrame, keys: list[str]):
    """Both sides cogrouped by ``keys`` and by every pair of an anchor block and a candidate block."""
    blocks = lambda cells: F.ceil(F.count(F.lit(1)) * F.greatest(F.first("d"), F.lit(1)) / cells)
    left, right = (df.groupBy(*keys).agg(blocks(cells).alias(name)) for df, cells, name in ((anchors, ANCHOR_CELLS, "n_a"), (candidates, CANDIDATE_CELLS, "n_c")))
    counts = left.join(right, keys)
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    # Both sides come from one table; renaming tells their columns apart.
    named = lambda df: [F.col(name).alias(name) for name in df.columns]
    a = anchors.join(counts, keys).select(*named(anchors), block("n_a").alias("a"), every("n_c").alias("c"))
    b = candidates.join(counts, keys).select(*named(candidates), block("n_c").alias("c"), every("n_a").alias("a"))
    return a.groupBy(*keys, "a", "c").cogroup(b.groupBy(*keys, "a", "c"))


def mine(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``is_anchor`` is over ``vec_id``."""
    rows = usable(df, key, vector, F.col("label") if label is None else label)
    anchors = rows.where(is_anchor)

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return positives_of(a, b, positives)

    def hard(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return negatives_of(a, b, negatives, shares)

    met = _tiles(anchors, rows, ["label", "d"]).applyInPandas(near, "anchor long, row long, positive_id long, positive_score long")
    order = W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "row")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    # A list of (id, score) pairs, best first, as one flat array.
    pairs = F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score")))
    flat = F.flatten(F.transform(pairs, lambda p: F.array(p["positive_id"], p["positive_score"])))
    chosen = stage(ranked.groupBy(F.col("anchor").alias("row")).agg(flat.alias("positives")), "positives")

    schema = "anchor long, place int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    met = _tiles(anchors.join(chosen, "row"), rows, ["d"]).applyInPandas(hard, schema)
    order = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def moved_label() -> Column:
    """The label, made wrong where the id is divisible by seven."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


SQL = f"""
WITH vectors AS (
  SELECT ROW_NUMBER() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.u AS a, a.vec_id AS anchor_id, b.u AS b, b.vec_id AS other_id, a.label = b.label AS same,
    CASE WHEN len(a.v) = 0 THEN 0 ELSE CAST(list_inner_product(a.v, b.v) AS BIGINT) END AS score
  FROM vectors a JOIN vectors b ON len(a.v) = len(b.v) AND a.u <> b.u WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY ROW_NUMBER() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= {POSITIVES}
)
SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  CAST(ROW_NUMBER() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same
  AND {SHARES[0]} * p.score <= 100 * n.score AND 100 * n.score <= {SHARES[1]} * p.score
QUALIFY rank <= {NEGATIVES}
"""
