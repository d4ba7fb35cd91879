"""Edge lists for flow diagrams. Every diagram is a small cube first: one pass over the
buildings, then links, nodes and views are made from the few rows of that cube."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions import bands as B
from parapet.functions import votes as V
from parapet.functions.numbers import WEIGHT, counted
from parapet.functions.text import UNCLASSIFIED, UNKNOWN
from parapet.operators.distribution import recode_rare
from parapet.operators.quantiles import stacked_quantiles
from parapet.staging import stage

# Names and limits of the hierarchy and flow reports.
ROOT = "All Buildings"
FULL_LEVELS = ("occ_cat", "area_cat", "height_cat", "year_cat", "drainage_cat")
SIMPLE_LEVELS = ("occ_cat", "year_cat", "drainage_cat")
TOP_CLASSES = 9
CLASS_MIN_ROWS = 100
FLOW_LEVELS = ("All Buildings", "Year", "Occupancy", "Material", "Foundation", "Soil")
YEAR_BAND = "year_band"
FLOW_COLUMNS = (YEAR_BAND, "occupancy", "material", "foundation", "soil")


@dataclass(frozen=True)
class Terciles:
    """The two inner edges of the area bands and of the height bands."""

    area: tuple[float, float]
    height: tuple[float, float]


def terciles(df: DataFrame, accuracy: int | None = None) -> Terciles | None:
    """Quantiles .33 and .67 of area and height, both found in the same passes; ``accuracy`` asks for a sketch."""
    found = stacked_quantiles(df, ("gfa", "height_used"), (0.33, 0.67), accuracy=accuracy)
    if any(not q.table for q in found.values()):
        return None
    return Terciles(*[(q.value(0.33), q.value(0.67)) for q in found.values()])


def with_bands(df: DataFrame, edges: Terciles) -> DataFrame:
    return df.withColumns({
        "area_cat": B.tercile_band(F.col("gfa"), *edges.area, B.AREA_LABELS),
        "height_cat": B.tercile_band(F.col("height_used"), *edges.height, B.HEIGHT_LABELS),
        "year_cat": B.year_band(F.col("year_built"), B.YEAR_LABELS_HIERARCHY),
        "drainage_cat": F.coalesce(F.col("drainagecl"), F.lit("Unknown Drainage")),
    })


def hierarchy_cube(df: DataFrame, edges: Terciles) -> DataFrame:
    """Count and area per class and band combination, with the class recoded to the top nine.

    The cube has a row per label combination and is read several times, so it is staged.
    """
    cube = stage(with_bands(df, edges).groupBy("occ_cls", *FULL_LEVELS[1:]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("gfa").alias("area")
    ), "hierarchy-cube")
    totals = cube.where("occ_cls IS NOT NULL").groupBy("occ_cls").agg(F.sum("n").alias("_n"))
    top = totals.orderBy(F.desc("_n"), "occ_cls").limit(TOP_CLASSES).select("occ_cls", F.lit(True).alias("_top"))
    named = cube.join(F.broadcast(top), "occ_cls", "left")
    return named.withColumn("occ_cat", F.when(F.col("_top"), F.col("occ_cls")).otherwise("Other")).drop("_top")


def _steps(levels: tuple[str, ...], root: Column, scope: Column, detail: str) -> list[Column]:
    """The adjacent level pairs of one view as structs; the root feeds the first level."""
    sources = [root, *[F.col(x) for x in levels[:-1]]]
    return [
        F.struct(
            scope.alias("scope"), F.lit(detail).alias("detail"), F.lit(i).alias("step"),
            source.alias("source"), F.col(level).alias("target"),
        )
        for i, (source, level) in enumerate(zip(sources, levels), 1)
    ]


def hierarchy_links(cube: DataFrame) -> DataFrame:
    """Links of all views: (scope, detail, metric, step, source, target, value).

    ``scope`` is ``all`` or a class with more than 100 rows, ``detail`` is full or
    simplified, ``metric`` is count or gfa. A step groups by its adjacent pair only, and a
    null at either end drops the row from that step.
    """
    size = F.sum("n").over(Window.partitionBy("occ_cls"))
    sized = cube.withColumn("_size", size)
    everything, root = F.lit("all"), F.lit(ROOT)
    mine = F.when(F.col("_size") > CLASS_MIN_ROWS, F.col("occ_cls"))
    steps = F.array(
        *_steps(FULL_LEVELS, root, everything, "full"),
        *_steps(SIMPLE_LEVELS, root, everything, "simplified"),
        *_steps(FULL_LEVELS[1:], mine, mine, "full"),
        *_steps(SIMPLE_LEVELS[1:], mine, mine, "simplified"),
    )
    spread = sized.select(F.inline(steps), "n", "area").dropna("any", subset=["scope", "source", "target"])
    summed = spread.groupBy("scope", "detail", "step", "source", "target").agg(
        F.sum("n").cast("double").alias("count"), F.sum("area").alias("gfa")
    )
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("count", "gfa")])
    return summed.select("scope", "detail", "step", "source", "target", F.inline(metrics))


def hierarchy_nodes(links: DataFrame) -> DataFrame:
    """Node names of each view with their level: the last level that has the name, the root 0."""
    ends = F.array(
        F.struct(F.col("source").alias("name"), (F.col("step") - 1).alias("level")),
        F.struct(F.col("target").alias("name"), F.col("step").alias("level")),
    )
    spread = links.select("scope", "detail", "metric", F.inline(ends))
    root = F.when(F.min("level") == 0, F.lit(0)).otherwise(F.max("level"))
    return spread.groupBy("scope", "detail", "metric", "name").agg(root.alias("level"))


def band_descriptions(df: DataFrame, edges: Terciles) -> DataFrame:
    """What each band means: (band, description)."""
    texts = B.band_texts(edges.area, edges.height)
    rows = F.array(*[F.struct(F.lit(k).alias("band"), v.alias("description")) for k, v in texts.items()])
    return df.sparkSession.range(1).select(F.inline(rows))


def labelled_flow(df: DataFrame, top_classes: int = 12, top_soils: int = 15, group_others: bool = False) -> DataFrame:
    """The five flow labels of each building; nulls become ``Unknown``.

    With ``group_others`` rare classes and soils are merged. A null class can then be one of
    the frequent values; it stays null and so drops out of the table.
    """
    weight = [WEIGHT] if WEIGHT in df.columns else []
    named = df.select(
        F.col(YEAR_BAND) if YEAR_BAND in df.columns else B.year_band(F.col("year_built"), B.YEAR_LABELS_FLOW).alias(YEAR_BAND),
        "occ_cls",
        F.coalesce("material_type", F.lit(UNKNOWN)).alias("material"),
        F.coalesce("foundation_type", F.lit(UNKNOWN)).alias("foundation"),
        F.coalesce("compname", F.lit(UNKNOWN)).alias("soil"),
        "gfa", *weight,
    )
    if not group_others:
        return named.withColumn("occupancy", F.coalesce("occ_cls", F.lit(UNKNOWN))).drop("occ_cls")
    # The recodes work on counts per label combination, far fewer rows than buildings.
    cube = stage(named.groupBy("year_band", "occ_cls", "material", "foundation", "soil").agg(
        counted(named).alias("n"), F.sum("gfa").alias("gfa")
    ), "flow-cube")
    classes = _weighted_recode(cube, "occ_cls", top_classes, "Other", "occupancy")
    return _weighted_recode(classes, "soil", top_soils, "Other Soils", "soil").drop("occ_cls")


def _weighted_recode(cube: DataFrame, column: str, k: int, other: str, into: str) -> DataFrame:
    """:func:`recode_rare` on rows that carry a count ``n``; a null is a countable value."""
    totals = cube.groupBy(F.col(column).alias("_top")).agg(F.sum("n").alias("_n"))
    top = totals.orderBy(F.desc("_n"), F.asc_nulls_last("_top")).limit(k).select("_top", F.lit(True).alias("_hit"))
    joined = cube.join(F.broadcast(top), F.col(column).eqNullSafe(F.col("_top")), "left")
    return joined.withColumn(into, F.when(F.col("_hit"), F.col(column)).otherwise(other)).drop("_top", "_hit")


def flow_table(df: DataFrame, top_classes: int = 12, top_soils: int = 15, group_others: bool = False) -> DataFrame:
    """Count and area per year band, class, material, foundation and soil, in one aggregate."""
    labelled = labelled_flow(df, top_classes, top_soils, group_others)
    size = F.sum("n") if group_others else counted(labelled)
    return labelled.dropna("any", subset=list(FLOW_COLUMNS)).groupBy(*FLOW_COLUMNS).agg(
        size.alias("count"), F.coalesce(F.sum("gfa"), F.lit(0.0)).alias("gfa")
    )


def flow_meta(df: DataFrame, top_classes: int = 12, top_soils: int = 15, group_others: bool = False) -> DataFrame:
    """One row that describes the flow table."""
    mode = (f"top_{top_classes}_plus_other", f"top_{top_soils}_plus_other") if group_others else ("raw", "raw")
    return df.agg(counted(df).alias("total_buildings")).select(
        "total_buildings",
        F.lit(" > ".join(FLOW_LEVELS)).alias("levels"),
        F.lit(" > ".join(B.YEAR_LABELS_FLOW)).alias("year_order"),
        F.lit(mode[0]).alias("occupancy_grouping"),
        F.lit(mode[1]).alias("soil_grouping"),
    )


def class_use_links(df: DataFrame) -> DataFrame:
    """Class to primary use: (occ_cls, prim_occ, source, target, value)."""
    both = F.col("occ_cls").isNotNull() & F.col("prim_occ").isNotNull()
    pairs = df.groupBy("occ_cls", "prim_occ").agg(counted(df, both).alias("value"))
    use = F.when(F.col("prim_occ") == UNCLASSIFIED, F.concat(F.lit("Unclassified (from "), "occ_cls", F.lit(")")))
    return pairs.where("value > 0").select(
        "occ_cls", "prim_occ",
        F.concat("occ_cls", F.lit(" (Class)")).alias("source"),
        use.otherwise(F.concat("prim_occ", F.lit(" (Type)"))).alias("target"),
        "value",
    )


def vote_links(df: DataFrame) -> DataFrame:
    """Class to vote type: (metric, occ_cls, vote_type, source, target, value).

    ``points`` adds up the votes, ``buildings`` counts buildings with at least one. A null
    class is reported as ``nan``.
    """
    pairs = df.select(
        F.coalesce("occ_cls", F.lit("nan")).alias("occ_cls"), F.inline(V.listed_if_text("occ_dict"))
    )
    summed = pairs.groupBy("occ_cls", F.col("type").alias("vote_type")).agg(
        F.sum("points").alias("points"), F.count_if(F.col("points") > 0).alias("buildings")
    )
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("points", "buildings")])
    spread = summed.select("occ_cls", "vote_type", F.inline(metrics)).where("value > 0")
    return spread.select(
        "metric", "occ_cls", "vote_type",
        F.concat("occ_cls", F.lit(" (Class)")).alias("source"),
        F.concat("vote_type", F.lit(" (from "), "occ_cls", F.lit(")")).alias("target"),
        "value",
    )


def node_index(links: DataFrame, diagram: str, first: str, second: str) -> DataFrame:
    """Unique node names of each diagram, numbered in order of first appearance.

    Sources come before targets; within a side the order is that of the sorted links. The
    window sees label names only, one row per node of a drawing.
    """
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("source").alias("name"), F.struct(first, F.lit("").alias("b")).alias("at")),
        F.struct(F.lit(1).alias("side"), F.col("target").alias("name"), F.struct(F.col(first), F.col(second).alias("b")).alias("at")),
    )
    seen = links.select(diagram, F.inline(sides)).groupBy(diagram, "name").agg(F.min(F.struct("side", "at")).alias("_at"))
    order = Window.partitionBy(diagram).orderBy("_at")
    return seen.select(diagram, "name", (F.row_number().over(order) - 1).alias("idx"))


def indexed_links(links: DataFrame, nodes: DataFrame, diagram: str) -> DataFrame:
    """Links with node numbers instead of names."""
    at = lambda end: nodes.select(diagram, F.col("name").alias(end), F.col("idx").alias(f"{end}_idx"))
    return links.join(at("source"), [diagram, "source"]).join(at("target"), [diagram, "target"]).select(
        diagram, "source_idx", "target_idx", "value"
    )


def grouped_classes(df: DataFrame, k: int = TOP_CLASSES) -> DataFrame:
    """Each building with its class recoded to the ``k`` most frequent and ``Other``."""
    return recode_rare(df, "occ_cls", k, "Other", "occ_cat")
