"""K-means for many groups, feature sets and cluster counts in the same passes.

The report needs hundreds of models. Fitting them one after the other would read the table
hundreds of times; here every pass advances all of them. A pass sends the centroids to the
tasks, labels each Arrow batch for all models of its group, and sums per model and cluster
inside the task, so only centroid sums are shuffled and nothing but centroids reaches the
driver.

Coordinates are fixed-point integers. Their sums are exact in any order, so a fit of a staged
point table does not depend on the partitioning, on retries or on lost executors. (The means and
deviations behind the coordinates are floating-point sums: staged anew, a coordinate on the edge
between two units of 1e-6 may fall to the other.) Starting centroids follow the
k-means++ rule over all points: the point with the smallest ``-ln(u) / d²`` is a draw with
probability proportional to ``d²``, where ``u`` is a hash of the point's id.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.functions.keys import uniform
from parapet.functions.numbers import truncate
from parapet.operators import kernels
from parapet.operators.quantiles import Quantiles, stacked_quantiles
from parapet.staging import stage

# Features, feature sets and cluster counts of the reports.
NUMERIC = ("sqmeters", "height_used", "year_built")
ELBOW_NUMERIC = ("gfa", "year_built")
COMBINATIONS = {
    "base": ("occ_cls",),
    "material": ("occ_cls", "material_type"),
    "foundation": ("occ_cls", "foundation_type"),
    "both": ("occ_cls", "material_type", "foundation_type"),
}
# Names of the statistics.
SHORT = {"sqmeters": "sqmeters", "height_used": "height", "year_built": "year", "gfa": "gfa"}
DOMINANT = {"material_type": "dominant_material", "foundation_type": "dominant_foundation"}
MAIN_K = 7
ELBOW_K = range(2, 16)
PLAIN_K = range(2, 10)
FEATURE_K = range(2, 8)
SAMPLE_K = range(2, 10)
PLAIN_MIN_ROWS = 10
FEATURE_MIN_ROWS = 11
MAX_ITERATIONS = 300
TOLERANCE = 1e-4
SEED = 42

UNITS = 1_000_000
MAX_LABELS = 1_000
# Group statistics are broadcast up to so many groups.
BROADCAST_GROUPS = 10_000
# A pass reads only the groups of its models up to so many.
FILTER_GROUPS = 1_000
# Centroids that a pass sends to every task; models beyond that are fitted in further batches.
CENTROID_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Model:
    """One fit: its group, the categorical features it uses besides the numeric ones, and k."""

    group: str
    combo: str
    features: tuple[str, ...]
    k: int


@dataclass(frozen=True)
class Design:
    """The layout of a centroid: numeric slots, one slot per label, and a last slot that is 0."""

    numeric: tuple[str, ...]
    labels: tuple[tuple[str, tuple[str, ...]], ...]

    def slots(self) -> list[tuple[str, str]]:
        return [(feature, label) for feature, found in self.labels for label in found]

    @property
    def size(self) -> int:
        return len(self.numeric) + len(self.slots()) + 1


@dataclass(frozen=True)
class Centroid:
    vector: tuple[float, ...]
    bias: float
    n: int = 0


Centroids = dict[Model, list[Centroid]]


@dataclass(frozen=True)
class Group:
    """Rows of a group, and the mean and population deviation of each numeric feature."""

    n: int
    means: tuple[float, ...]
    deviations: tuple[float, ...]


# --- features -----------------------------------------------------------------------------
def combination(name: str, columns: Sequence[str] | None = None) -> tuple[str, ...] | None:
    """The categorical features of a combination; None when ``columns`` lacks one of them."""
    features = COMBINATIONS[name]
    return features if columns is None or set(features) <= set(columns) else None


def usable_combination(name: str, present: Sequence[str]) -> tuple[str, ...]:
    """As :func:`combination`, but optional features without any value are left out."""
    return tuple(f for f in COMBINATIONS[name] if f == "occ_cls" or f in present)


def _scaled(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (value - mean) / deviation).otherwise(0.0)


def _fixed(scaled: Column) -> Column:
    return F.round(scaled * UNITS).cast("bigint")


def standardise(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Add ``<column>_z``: centred and divided by the population deviation; a constant column is 0.

    With ``by`` the statistics are those of the row's group.
    """
    measures = [m for c in columns for m in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_dev"))]
    if by is None:
        row = df.agg(*measures).first()
        joined = df.withColumns({name: F.lit(row[name]).cast("double") for name in row.asDict()})
    else:
        stats = df.groupBy(by).agg(*measures)
        joined = df.join(stats, by)
    scaled = {f"{c}_z": _scaled(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_dev")) for c in columns}
    return joined.withColumns(scaled).drop(*[f"{c}_{m}" for c in columns for m in ("mean", "dev")])


def fit_labels(df: DataFrame, columns: Sequence[str]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The sorted labels of each column, all found in one pass."""
    if not columns:
        return ()
    pairs = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in columns])
    limit = MAX_LABELS * len(columns)
    rows = df.select(F.inline(pairs)).where("v IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labels in {', '.join(columns)}: not categorical")
    return tuple((c, tuple(sorted(r.v for r in rows if r.f == c))) for c in columns)


def one_hot(df: DataFrame, labels: Iterable[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Indicator columns ``<column>=<label>``; an unknown or null value is 0 in all of them."""
    return df.withColumns({
        f"{c}={label}": F.coalesce((F.col(c) == label).cast("double"), F.lit(0.0)) for c, found in labels for label in found
    })


def by_class(df: DataFrame) -> DataFrame:
    """Every row once in the group ``all`` and once in the group of its class."""
    return df.withColumn("grp", F.explode(F.array(F.lit("all"), F.col("occ_cls"))))


def label_slots(design: Design) -> dict[str, Column]:
    """The slot of each categorical feature's label; the last slot for an unknown or null one."""
    empty, at, slots = design.size - 1, len(design.numeric), {}
    for i, (feature, found) in enumerate(design.labels):
        position = F.lit(empty)
        for j, label in enumerate(found):
            position = F.when(F.col(feature) == label, at + j).otherwise(position)
        slots[f"s{i}"] = position
        at += len(found)
    return slots


def points(df: DataFrame, design: Design, name: str, groups: dict[str, Group]) -> DataFrame:
    """The staged table all passes read: grp, pid, fixed-point x0.., label slots s0.., and the raw columns.

    The statistics are one row per group, which the driver holds, and are broadcast if they are few.
    """
    stats = [f"_{kind}{i}" for kind in ("mean", "deviation") for i in range(len(design.numeric))]
    schema = T.StructType([T.StructField("grp", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in stats]])
    table = df.sparkSession.createDataFrame([(g, *found.means, *found.deviations) for g, found in groups.items()], schema)
    joined = df.join(F.broadcast(table) if len(groups) <= BROADCAST_GROUPS else table, "grp")
    fixed = {f"x{i}": _fixed(_scaled(F.col(c), F.col(f"_mean{i}"), F.col(f"_deviation{i}"))) for i, c in enumerate(design.numeric)}
    made = joined.withColumns({**fixed, **label_slots(design)}).withColumnRenamed("build_id", "pid").drop(*stats)
    # In order of group and labels, so that a pass works on many rows of one kind at once.
    return stage(made, name, spread_by="pid", rows=sum(g.n for g in groups.values()), sort_by=("grp", *label_slots(design)))


# --- one pass -----------------------------------------------------------------------------
def _group_models(centroids: Centroids, index: dict[Model, int]) -> kernels.GroupModels:
    """The centroids as arrays per group, the only thing a pass sends to the tasks.

    Their size depends on labels, models and k, never on the number of points; see :func:`_batches`.
    """
    out: kernels.GroupModels = {}
    for model, found in centroids.items():
        arrays = np.array([c.vector for c in found]), np.array([c.bias for c in found])
        out.setdefault(model.group, []).append((index[model], *arrays))
    return out


def _batches(models: Iterable[Model], design: Design, most: int | None = None) -> list[list[Model]]:
    """Models in order, cut where their centroids would exceed ``most`` bytes."""
    room, out, used = most or CENTROID_BYTES, [], math.inf
    for model in models:
        size = 8 * model.k * (design.size + 1)
        if used + size > room:
            out.append([])
            used = 0
        out[-1].append(model)
        used += size
    return out


def _centroid(model: Model, design: Design, n: int, values: Sequence[int]) -> Centroid:
    """From the sums of the numeric slots and the counts of the label slots."""
    n_num = len(design.numeric)
    numeric = [s / n / UNITS for s in values[:n_num]]
    shares = [c / n if f in model.features else 0.0 for (f, _), c in zip(design.slots(), values[n_num:])]
    return Centroid((*numeric, *shares, 0.0), float(len(model.features) + sum(s * s for s in shares)), n)


# --- fitting ------------------------------------------------------------------------------
def _seeds(table: DataFrame, design: Design, models: Sequence[Model], seed: int) -> Centroids:
    """Starting centroids. Models that differ only in k share a sequence, so k passes serve all."""
    longest: dict[Model, int] = {}
    for m in models:
        family = Model(m.group, m.combo, m.features, 0)
        longest[family] = max(longest.get(family, 0), m.k)
    index = {family: i for i, family in enumerate(longest)}
    found: Centroids = {family: [] for family in longest}
    n_num, n_cat = len(design.numeric), len(design.labels)
    place = [f"x{i}" for i in range(n_num)] + [f"s{i}" for i in range(n_cat)]
    schema = f"model bigint, score double, pid {table.schema['pid'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in place)
    for step in range(max(longest.values())):
        drawn = table.withColumn("u", uniform(F.md5(F.concat(F.col("pid").cast("string"), F.lit(f"#{seed}#{step}")).cast("binary"))))
        if step == 0:
            rows = drawn.groupBy("grp").agg(F.min(F.struct("u", "pid", *place)).alias("m")).collect()
            first = {r.grp: tuple(r.m)[2:] for r in rows}
            picks = {family: first[family.group] for family in longest if family.group in first}
        else:
            open_now = {f: c for f, c in found.items() if c and longest[f] > step}
            kernel = kernels.best_draws(n_num, n_cat, float(UNITS), _group_models(open_now, index))
            scored = drawn.select("grp", "pid", "u", *place).mapInArrow(kernel, schema)
            rows = scored.groupBy("model").agg(F.min(F.struct("score", "pid", *place)).alias("m")).collect()
            by_model = {r.model: tuple(r.m)[2:] for r in rows}
            picks = {family: by_model[index[family]] for family in open_now if index[family] in by_model}
        for family, at in picks.items():
            found[family].append(_from_point(family, design, at))
    seeds = {m: found[Model(m.group, m.combo, m.features, 0)][: m.k] for m in models}
    return {m: found for m, found in seeds.items() if found}


def _from_point(model: Model, design: Design, at: tuple) -> Centroid:
    n_num = len(design.numeric)
    hot = set(at[n_num:])
    return _centroid(model, design, 1, (*at[:n_num], *[int(n_num + i in hot) for i in range(len(design.slots()))]))


def fit(
    table: DataFrame, design: Design, models: Sequence[Model], seed: int = SEED,
    max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE,
) -> Centroids:
    """Lloyd's iterations for all models until each has moved less than ``tolerance``.

    A model that has settled leaves the following passes; one that has not after
    ``max_iterations`` is returned with a warning. A cluster that loses all its points is
    dropped, so a model may end with fewer than k. Clusters are numbered by their
    centroid, so numbers do not depend on the order in which seeds were drawn. Models whose
    centroids are too large for one pass are fitted batch by batch.
    """
    out: Centroids = {}
    for batch in _batches(models, design):
        out |= _fit_batch(table, design, batch, seed, max_iterations, tolerance)
    return out


def _fit_batch(table: DataFrame, design: Design, models: Sequence[Model], seed: int, max_iterations: int, tolerance: float) -> Centroids:
    index = {m: i for i, m in enumerate(models)}
    current = _seeds(table, design, models, seed)
    active = dict(current)
    n_num, n_cat = len(design.numeric), len(design.labels)
    narrow = table.select("grp", *[f"x{i}" for i in range(n_num)], *[f"s{i}" for i in range(n_cat)])
    values = [f"v{i}" for i in range(design.size)]
    schema = "model bigint, cluster bigint, n bigint, " + ", ".join(f"{v} bigint" for v in values)
    for _ in range(max_iterations):
        if not active:
            break
        open_models = _group_models(active, index)
        kernel = kernels.partial_sums(n_num, n_cat, design.size, float(UNITS), open_models)
        # Groups whose models have all settled are not sent to the tasks.
        left = narrow.where(F.col("grp").isin(list(open_models))) if len(open_models) <= FILTER_GROUPS else narrow
        rows = left.mapInArrow(kernel, schema).groupBy("model", "cluster").agg(
            F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values]
        ).collect()
        gathered: dict[int, dict[int, tuple]] = {}
        for row in rows:
            gathered.setdefault(row.model, {})[row.cluster] = tuple(row)[2:]
        for model in list(active):
            moved, fresh = 0.0, []
            for number, sums in sorted(gathered[index[model]].items()):
                new, old = _centroid(model, design, sums[0], sums[1:]), active[model][number]
                moved += sum((a - b) ** 2 for a, b in zip(new.vector, old.vector))
                fresh.append(new)
            current[model] = fresh
            if moved <= tolerance:
                del active[model]
            else:
                active[model] = fresh
    if active:
        warnings.warn(f"{len(active)} of {len(models)} models did not settle in {max_iterations} iterations", stacklevel=3)
    return {m: sorted(found, key=lambda c: c.vector) for m, found in current.items()}


def assign(table: DataFrame, design: Design, centroids: Centroids) -> DataFrame:
    """Label every point for every model: the point's columns, combo, k, cluster and d2."""
    if not centroids:
        return _assign_batch(table, design, centroids)
    parts = [_assign_batch(table, design, {m: centroids[m] for m in batch}) for batch in _batches(centroids, design)]
    return reduce(DataFrame.unionByName, parts)


def _assign_batch(table: DataFrame, design: Design, centroids: Centroids) -> DataFrame:
    groups: dict[str, list[Model]] = {}
    for model in centroids:
        groups.setdefault(model.group, []).append(model)
    kernel = kernels.all_labels(
        len(design.numeric), len(design.labels), float(UNITS), _group_models(centroids, {m: i for i, m in enumerate(centroids)})
    )
    schema = T.StructType([*table.schema.fields, T.StructField("clusters", T.ArrayType(T.IntegerType())), T.StructField("distances", T.ArrayType(T.DoubleType()))])
    names = pa.table({
        "grp": pa.array(list(groups)),
        "models": pa.array([[{"combo": m.combo, "k": m.k} for m in found] for found in groups.values()],
                           pa.list_(pa.struct([("combo", pa.string()), ("k", pa.int32())]))),
    })
    labelled = table.mapInArrow(kernel, schema).join(F.broadcast(table.sparkSession.createDataFrame(names)), "grp")
    each = labelled.select(*table.columns, F.inline(F.arrays_zip("models", "clusters", "distances")))
    return each.select(*table.columns, "models.combo", "models.k", F.col("clusters").alias("cluster"), F.col("distances").alias("d2"))


# --- reports ------------------------------------------------------------------------------
@dataclass(frozen=True)
class Fitted:
    """A staged point table, its layout, the statistics of its groups and the fitted centroids."""

    table: DataFrame
    design: Design
    groups: dict[str, Group]
    centroids: Centroids

    def labels(self) -> DataFrame:
        return assign(self.table, self.design, self.centroids)

    def staged_labels(self) -> DataFrame:
        """:meth:`labels` written once, for reports that aggregate them several times."""
        return stage(self.labels(), "labels")

    def sums(self, measures: Sequence[str] = ()) -> DataFrame:
        """Per cluster of every model: grp, combo, k, cluster, n, d2, slot counts v0.., and of each measure the sums a, b about the shift c.

        Points are labelled and summed in the same pass; labels are not returned anywhere. One row
        per cluster leaves a task, so the result has at most as many rows as there are centroids.
        """
        out = None
        for batch in _batches(self.centroids, self.design):
            part = self._batch_sums({m: self.centroids[m] for m in batch}, list(measures))
            out = part if out is None else out.unionByName(part)
        return self._batch_sums({}, list(measures)) if out is None else out

    def _batch_sums(self, centroids: Centroids, measures: list[str]) -> DataFrame:
        design, index = self.design, {m: i for i, m in enumerate(centroids)}
        n_num, n_cat = len(design.numeric), len(design.labels)
        means = self._means([m for m in measures if m not in design.numeric])
        shifts = {}
        for model, found in centroids.items():
            group = self.groups[model.group]
            of = lambda c, i: group.means[i] + c.vector[i] * group.deviations[i]  # noqa: B023, E731
            at = {name: i for i, name in enumerate(design.numeric)}
            shifts[index[model]] = np.array([[of(c, at[m]) if m in at else means[model.group][m] for m in measures] for c in found], float).reshape(len(found), len(measures))
        kernel = kernels.cluster_sums(n_num, n_cat, design.size, float(UNITS), _group_models(centroids, index), measures, shifts)
        whole, parts = ["n", *[f"v{i}" for i in range(design.size)]], ["d2", *[f"{c}{i}" for i in range(len(measures)) for c in "ab"]]
        constants = [f"c{i}" for i in range(len(measures))]
        schema = ", ".join(["model bigint", "cluster bigint", *[f"{c} bigint" for c in whole], *[f"{c} double" for c in (*parts, *constants)]])
        read = [f"x{i}" for i in range(n_num)] + [f"s{i}" for i in range(n_cat)] + [m for m in measures]
        summed = self.table.select("grp", *read).mapInArrow(kernel, schema).groupBy("model", "cluster").agg(
            *[F.sum(c).alias(c) for c in (*whole, *parts)], *[F.first(c).alias(c) for c in constants]
        )
        names = self.table.sparkSession.createDataFrame([(i, m.group, m.combo, m.k) for m, i in index.items()], "model bigint, grp string, combo string, k int")
        # One row per model; the driver holds their centroids.
        return summed.join(F.broadcast(names), "model").select("grp", "combo", "k", F.col("cluster").cast("int").alias("cluster"), *whole, *parts, *constants)

    def _means(self, measures: list[str]) -> dict[str, dict[str, float]]:
        """Means per group of measures that are no features."""
        if not measures:
            return {}
        rows = self.table.groupBy("grp").agg(*[F.avg(m).alias(m) for m in measures]).collect()
        return {r.grp: {m: r[m] for m in measures} for r in rows}

    def statistics(self, with_area: bool = False, dominant: bool = False) -> DataFrame:
        """:func:`cluster_stats` with the totals of each model, from one pass; ``dominant`` adds what :func:`dominant_features` tells."""
        measures = (*NUMERIC, *(("gfa",) if with_area else ()))
        out = [F.col(c) for c in ("grp", "combo", "k", "cluster", "n")]
        for i, c in enumerate(measures):
            off = F.col(f"a{i}") / F.col("n")
            mean = F.col(f"c{i}") + off
            spread = F.sqrt(F.greatest(F.col(f"b{i}") / F.col("n") - off * off, F.lit(0.0)))
            out += [(truncate(mean) if c == "year_built" else mean).alias(f"avg_{SHORT[c]}"), spread.alias(f"std_{SHORT[c]}")]
        slots = [(feature, label, f"v{len(self.design.numeric) + i}") for i, (feature, label) in enumerate(self.design.slots())]
        for feature, into in DOMINANT.items() if dominant else ():
            counts = F.array(*[F.struct((-F.col(v)).alias("o"), F.lit(label).alias("label")) for f, label, v in slots if f == feature])
            users = [name for name, found in COMBINATIONS.items() if feature in found]
            out.append(F.when(F.col("combo").isin(*users), F.array_min(counts)["label"]).alias(into))
        model = Window.partitionBy("grp", "combo", "k")
        out += [F.sum("d2").over(model).alias("wcss"), F.sum("n").over(model).alias("total_buildings")]
        return self.sums(measures).select(*out)

    def wcss(self) -> DataFrame:
        """Rows and sum of squared distances per model, from one pass."""
        return self.sums().groupBy("grp", "combo", "k").agg(F.sum("n").alias("n"), F.sum("d2").alias("wcss"))

    def shares(self) -> DataFrame:
        """Size and share of each cluster of each model, for a treemap, from one pass."""
        total = F.sum("n").over(Window.partitionBy("grp", "combo", "k"))
        return self.sums().select("grp", "combo", "k", "cluster", "n", (F.col("n") / total).alias("share"))


def _groups(df: DataFrame, numeric: Sequence[str]) -> dict[str, Group]:
    """Statistics per group; the driver holds a model of each group anyway."""
    rows = df.groupBy("grp").agg(F.count(F.lit(1)), *[F.avg(c) for c in numeric], *[F.stddev_pop(c) for c in numeric]).collect()
    return {r[0]: Group(r[1], tuple(r)[2:2 + len(numeric)], tuple(r)[2 + len(numeric):]) for r in rows}


def fit_groups(
    grouped: DataFrame, numeric: Sequence[str], combos: dict[str, tuple[str, ...]], ks: Sequence[int],
    min_rows: int, name: str, **options: float,
) -> Fitted:
    """One model per group with at least ``min_rows`` rows, combination and k (k at most the rows)."""
    groups = _groups(grouped, numeric)
    features = sorted({f for found in combos.values() for f in found})
    design = Design(tuple(numeric), fit_labels(grouped, features))
    table = points(grouped, design, name, groups)
    models = [
        Model(group, combo, tuple(found), k)
        for group, stats in sorted(groups.items()) if stats.n >= min_rows
        for combo, found in combos.items() for k in ks if k <= stats.n
    ]
    return Fitted(table, design, groups, fit(table, design, models, **options) if models else {})


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("build_id", *columns).dropna("any")


def plain_clusters(df: DataFrame, ks: Sequence[int] = PLAIN_K, **options: float) -> Fitted:
    """Numeric features only, for all buildings and each class."""
    rows = _complete(df, (*NUMERIC, "occ_cls", "material_type", "foundation_type", "gfa"))
    return fit_groups(by_class(rows), NUMERIC, {"plain": ()}, ks, PLAIN_MIN_ROWS, "plain-clusters", **options)


def feature_clusters(df: DataFrame, ks: Sequence[int] = FEATURE_K, **options: float) -> Fitted:
    """Every feature combination, for all buildings and each class."""
    rows = _complete(df, (*NUMERIC, "occ_cls", "material_type", "foundation_type"))
    return fit_groups(by_class(rows), NUMERIC, COMBINATIONS, ks, FEATURE_MIN_ROWS, "feature-clusters", **options)


def main_clusters(cluster_rows: DataFrame, k: int = MAIN_K, **options: float) -> Fitted:
    """The main clustering over the complete-case table."""
    rows = cluster_rows.withColumn("grp", F.concat(F.lit("all"), F.substring("occ_cls", 1, 0)))
    return fit_groups(rows, NUMERIC, {"base": COMBINATIONS["base"]}, [k], 1, "main-clusters", **options)


def elbow_clusters(below_outliers: DataFrame, ks: Sequence[int] = ELBOW_K, **options: float) -> Fitted:
    """Models for the elbow curve, on area, year and class."""
    rows = below_outliers.withColumn("grp", F.concat(F.lit("all"), F.substring("occ_cls", 1, 0)))
    return fit_groups(rows, ELBOW_NUMERIC, {"base": COMBINATIONS["base"]}, ks, 1, "elbow-clusters", **options)


def _known(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def sample_clusters(sample: DataFrame, ks: Sequence[int] = SAMPLE_K, **options: float) -> Fitted:
    """Every combination on a sample; each combination uses the rows complete in its own features."""
    optional = ("material_type", "foundation_type")
    known = sample.agg(*[F.count(c).alias(c) for c in optional]).first()
    present = [c for c in optional if known[c]]
    combos = {name: usable_combination(name, present) for name in COMBINATIONS}
    complete = F.array_compact(F.array(*[F.when(_known((*NUMERIC, *found)), F.lit(name)) for name, found in combos.items()]))
    rows = sample.select("build_id", *NUMERIC, "occ_cls", *optional).withColumn("grp", F.explode(complete))
    features = sorted({f for found in combos.values() for f in found})
    design = Design(NUMERIC, fit_labels(rows, features))
    groups = _groups(rows, NUMERIC)
    table = points(rows, design, "sample-clusters", groups)
    models = [Model(name, name, found, k) for name, found in combos.items() for k in ks if name in groups and k <= groups[name].n]
    return Fitted(table, design, groups, fit(table, design, models, **options) if models else {})


def wcss(labels: DataFrame) -> DataFrame:
    """Rows and sum of squared distances per model."""
    return labels.groupBy("grp", "combo", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("wcss"))


def cluster_stats(labels: DataFrame, with_area: bool = False, with_model: bool = False) -> DataFrame:
    """Size, mean and population deviation per cluster; clusters without rows do not appear.

    ``with_model`` adds the ``wcss`` and ``total_buildings`` of the cluster's model, in the same pass.
    """
    columns = (*NUMERIC, *(("gfa",) if with_area else ()))
    measures = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        mean = truncate(F.avg(c)) if c == "year_built" else F.avg(c)
        measures += [mean.alias(f"avg_{SHORT[c]}"), F.stddev_pop(c).alias(f"std_{SHORT[c]}")]
    if not with_model:
        return labels.groupBy("grp", "combo", "k", "cluster").agg(*measures)
    stats = labels.groupBy("grp", "combo", "k", "cluster").agg(*measures, F.sum("d2").alias("_d2"))
    model = Window.partitionBy("grp", "combo", "k")
    return stats.withColumns({"wcss": F.sum("_d2").over(model), "total_buildings": F.sum("n").over(model)}).drop("_d2")


def dominant_features(labels: DataFrame) -> DataFrame:
    """Clusters of models that use material or foundation, with the most frequent value of each.

    Both features are counted in one pass; ties go to the smaller label.
    """
    key = ("grp", "combo", "k", "cluster")
    used = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.when(F.col("combo").isin(*[c for c, found in COMBINATIONS.items() if f in found]), F.col(f)).alias("value"))
        for f in DOMINANT
    ])
    counts = labels.select(*key, F.inline(used)).where("value IS NOT NULL").groupBy(*key, "feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct((-F.col("_n")).alias("o"), F.col("value"))
    best = [F.min_by(F.when(F.col("feature") == f, F.col("value")), F.when(F.col("feature") == f, order)).alias(into) for f, into in DOMINANT.items()]
    return counts.groupBy(*key).agg(*best)


def cluster_analysis(labels: DataFrame) -> DataFrame:
    """Per cluster of the main model: size, most common class, and mean, median and spread of area and year.

    Medians, means and spreads of both columns come from the same passes; sizes and classes from one count.
    """
    found = stacked_quantiles(labels, ("gfa", "year_built"), (0.5,), by="cluster")
    clusters = sorted({c for q in found.values() for c in q.table})
    rows = [(c, *[x for q in found.values() for x in _middle(q, c)]) for c in clusters]
    measures = [f"{name}_{x}" for name in ("area", "year") for x in ("mean", "median", "std")]
    table = labels.sparkSession.createDataFrame(rows, T.StructType([labels.schema["cluster"], *[T.StructField(m, T.DoubleType()) for m in measures]]))
    counts = labels.where("cluster IS NOT NULL").groupBy("cluster", "occ_cls").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct((-F.col("_n")).alias("o"), F.col("occ_cls"))
    sizes = counts.groupBy("cluster").agg(
        F.sum("_n").alias("n"), F.min_by(F.col("occ_cls"), F.when(F.col("occ_cls").isNotNull(), order)).alias("most_common_occ"))
    # One row per cluster of one model.
    joined = sizes.join(F.broadcast(table), "cluster", "left")
    return joined.withColumns({"year_mean": truncate(F.col("year_mean")), "year_median": truncate(F.col("year_median"))})


def _middle(found: Quantiles, group: int) -> tuple[float | None, float | None, float]:
    """Mean, median and sample deviation (0 for a single value) of a group."""
    m = found.moments.get(group)
    return (m.mean, found.value(0.5, group), m.deviation or 0.0) if m else (None, None, 0.0)


def cluster_shares(labels: DataFrame) -> DataFrame:
    """Size and share of each cluster of each model, for a treemap."""
    sizes = labels.groupBy("grp", "combo", "k", "cluster").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("grp", "combo", "k").agg(F.sum("n").alias("_total"))
    return sizes.join(totals, ["grp", "combo", "k"]).select("grp", "combo", "k", "cluster", "n", (F.col("n") / F.col("_total")).alias("share"))


def align_labels(df: DataFrame, labels: DataFrame, id_column: str = "build_id") -> DataFrame:
    """Bring labels back to the full frame; rows that were not clustered get null."""
    return df.join(labels, id_column, "left")


def sample_label_columns(fitted: Fitted, sample: DataFrame) -> DataFrame:
    """The sample with ``cluster_<combo>_k<k>`` per model, ``cluster_k<k>`` for base, and ``cluster`` for base k 7.

    Each row is labelled for all models where it stands: the coordinates of every combination are columns of the
    row, null where it lacks a feature, and a task adds the label columns. Nothing is shuffled or joined.
    """
    design = fitted.design
    features = {m.group: m.features for m in fitted.centroids}
    columns, labelled = sample.columns, sample
    for batch in _batches(fitted.centroids, design):
        names = {i: f"cluster_{m.combo}_k{m.k}" for i, m in enumerate(batch)}
        place = {}
        for group in dict.fromkeys(m.group for m in batch):
            stats, known = fitted.groups[group], _known((*design.numeric, *features[group]))
            for i, c in enumerate(design.numeric):
                scaled = _scaled(F.col(c), F.lit(stats.means[i]).cast("double"), F.lit(stats.deviations[i]).cast("double"))
                place[f"{group}_x{i}"] = F.when(known, _fixed(scaled))
        ready = labelled.withColumns({**place, **label_slots(design)})
        models = _group_models({m: fitted.centroids[m] for m in batch}, {m: i for i, m in enumerate(batch)})
        kernel = kernels.wide_labels(len(design.numeric), len(design.labels), float(UNITS), models, names, columns)
        # Columns leave a task group by group.
        added = [names[number] for found in models.values() for number, _, _ in found]
        schema = T.StructType([*labelled.schema.fields, *[T.StructField(name, T.IntegerType()) for name in added]])
        labelled, columns = ready.mapInArrow(kernel, schema), [*columns, *added]
    base = {f"cluster_k{m.k}": F.col(f"cluster_base_k{m.k}") for m in fitted.centroids if m.combo == "base"}
    main = f"cluster_base_k{MAIN_K}"
    return labelled.withColumns({**base, "cluster": F.col(main) if main in columns else F.lit(None).cast("int")})


# --- a single model with the library estimator -----------------------------------------------
def library_kmeans(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int) -> DataFrame:
    """One model with Spark's own estimator, for callers that want a single fit and no seeding control."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    scaled = standardise(rows, numeric)
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    # The indexer puts unknown labels last, and the last one has no indicator: all zeros.
    encoders = [OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v") for c in categorical]
    assembler = VectorAssembler(inputCols=[f"{c}_z" for c in numeric] + [f"{c}_v" for c in categorical], outputCol="features")
    estimator = KMeans(k=k, seed=SEED, maxIter=MAX_ITERATIONS, tol=TOLERANCE, predictionCol="cluster")
    model = Pipeline(stages=[*indexers, *encoders, assembler, estimator]).fit(scaled)
    return model.transform(scaled).drop("features", *[f"{c}_z" for c in numeric], *[f"{c}_{x}" for c in categorical for x in "iv"])
