"""Exact interpolated quantiles without gathering the values anywhere.

The built-in ``percentile`` keeps a map of all distinct values in one task per group.
Here each pass counts values in a fixed number of buckets and keeps only the buckets
that hold a wanted rank; the next pass splits those buckets again, until a bucket holds
a single value. A pass is one map-side aggregate, and what reaches the driver is at most
``buckets`` rows of counts, whatever the size of the table. Several columns share their passes.

With ``accuracy`` a mergeable sketch answers in a single pass instead: the value returned is one of the
column's, and its rank is off by at most rows / ``accuracy``. Off by default.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.functions.numbers import finite_or_null

BUCKETS = 8192
# Ranges that one pass splits; more of them take more passes.
RANGES = 1_000


@dataclass(frozen=True)
class Moments:
    """Number, range, mean and sample deviation of a group's values, found in the first pass."""

    n: int
    low: float
    high: float
    mean: float
    deviation: float | None


@dataclass
class Quantiles:
    """Quantile values and moments per group; the group of an ungrouped call is None."""

    table: dict[Any, dict[float, float]] = field(default_factory=dict)
    moments: dict[Any, Moments] = field(default_factory=dict)

    def value(self, prob: float, group: Any = None) -> float | None:
        return self.table.get(group, {}).get(prob)

    def frame(self, df: DataFrame, by: str, names: dict[float, str]) -> DataFrame:
        """One row per group with a column per quantile (``names``: probability -> column)."""
        rows = [(group, *[found.get(p) for p in names]) for group, found in self.table.items()]
        fields = [T.StructField(by, df.schema[by].dataType)]
        fields += [T.StructField(n, T.DoubleType()) for n in names.values()]
        return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def _interpolate(stats: dict[int, float], n: int, prob: float) -> float:
    position = (n - 1) * prob
    low = math.floor(position)
    below, above = stats[low], stats[min(low + 1, n - 1)]
    return below + (above - below) * (position - low)


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], by: str | None = None, accuracy: int | None = None) -> Quantiles:
    """Linear-interpolation quantiles of ``column``, per value of ``by`` when given.

    ``by`` must be a label column (few groups); nulls in either column and non-finite values are left out.
    ``accuracy`` asks for the sketch instead.
    """
    return stacked_quantiles(df, (column,), probs, by, accuracy)[column]


def stacked_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: str | None = None, accuracy: int | None = None) -> dict[str, Quantiles]:
    """:func:`exact_quantiles` of several columns, all found in the same passes."""
    group = F.col(by) if by else F.lit("")
    if len(columns) == 1:
        values = df.select(F.struct(F.lit(0).alias("i"), group.alias("by")).alias("g"), finite_or_null(F.col(columns[0]).cast("double")).alias("v"))
    else:
        values = df.select(F.inline(F.array(*[
            F.struct(F.struct(F.lit(i).alias("i"), group.alias("by")).alias("g"), finite_or_null(F.col(c).cast("double")).alias("v")) for i, c in enumerate(columns)
        ])))
    found = {c: Quantiles() for c in columns}
    for (i, key), (quantiles, moments) in _find(values.where("g.by IS NOT NULL AND v IS NOT NULL"), probs, accuracy).items():
        mine = found[columns[i]]
        mine.table[key if by else None], mine.moments[key if by else None] = quantiles, moments
    return found


def _find(values: DataFrame, probs: Sequence[float], accuracy: int | None) -> dict[Any, tuple[dict[float, float], Moments]]:
    """Quantiles and moments of ``v`` per ``g``."""
    first = [F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")]
    if accuracy is not None:
        first.append(F.percentile_approx("v", list(probs), accuracy).alias("q"))
    bounds = values.groupBy("g").agg(*first).collect()
    moments = {row.g: Moments(row.n, row.lo, row.hi, row.mean, row.std) for row in bounds}
    if accuracy is not None:
        return {row.g: (dict(zip(probs, row.q)), moments[row.g]) for row in bounds}

    known, pending = defaultdict(dict), []
    for row in bounds:
        ranks = {min(math.floor((row.n - 1) * p) + step, row.n - 1) for p in probs for step in (0, 1)}
        pending.append((row.g, row.lo, row.hi, 0, sorted(ranks)))

    while True:
        unresolved = []
        for g, lo, hi, before, ranks in pending:
            if lo == hi:
                known[g].update({r: lo for r in ranks})
            else:
                unresolved.append((g, lo, hi, before, ranks))
        if not unresolved:
            break
        pending = [p for at in range(0, len(unresolved), RANGES) for p in _split(values, unresolved[at : at + RANGES])]
        if [p[:3] for p in pending] == [u[:3] for u in unresolved]:
            raise RuntimeError("the ranges don't narrow")
    return {g: ({p: _interpolate(known[g], m.n, p) for p in probs}, m) for g, m in moments.items()}


def _split(values: DataFrame, ranges: list[tuple]) -> list[tuple]:
    """One pass: histogram every range and return the buckets that hold a wanted rank.

    The ranges are at most ``RANGES`` rows and are broadcast; a value meets those of its group only.
    """
    per_range = max(256, BUCKETS // len(ranges))
    schema = T.StructType([T.StructField("rg", values.schema["g"].dataType), *[T.StructField(x, T.DoubleType()) for x in ("rlo", "rhi", "width")], T.StructField("r", T.IntegerType())])
    table = values.sparkSession.createDataFrame([(g, lo, hi, (hi - lo) / per_range or (hi - lo), i) for i, (g, lo, hi, _, _) in enumerate(ranges)], schema)
    hit = values.join(F.broadcast(table), (F.col("g") == F.col("rg")) & F.col("v").between(F.col("rlo"), F.col("rhi")))
    bucket = F.least(F.floor((F.col("v") - F.col("rlo")) / F.col("width")), F.lit(per_range - 1).cast("bigint"))
    rows = (
        hit.select("r", bucket.alias("b"), "v")
        .groupBy("r", "b").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    histogram = defaultdict(list)
    for row in rows:
        histogram[row.r].append(row)
    found = []
    for i, (g, _, _, before, ranks) in enumerate(ranges):
        seen = before
        for row in sorted(histogram[i], key=lambda h: h.b):
            here = [r for r in ranks if seen <= r < seen + row.n]
            if here:
                found.append((g, row.lo, row.hi, seen, here))
            seen += row.n
    return found
