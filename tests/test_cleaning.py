from pyspark.sql import functions as F

from parapet.operators import cleaning, distribution, flows, soil
from parapet.sources import standin

SCHEMA = "build_id int, year_built double, gfa double, height string, pred_height double"


def test_funnel_and_filters_agree_with_the_published_counts(spark, data):
    raw = standin.buildings(spark, data, votes=False)
    funnel = cleaning.cleaning_funnel(raw).first()
    assert (funnel.initial_count, funnel.after_year_filter, funnel.after_missing_area) == (1500, 1422, 1369)
    assert funnel.after_missing_area - funnel.invalid_raw_height_count == 1321
    assert funnel.final_count == 1309 == cleaning.clean(raw).count()
    assert funnel.used_height + funnel.used_pred_height == 1309


def test_height_rules(spark):
    rows = [
        (1, 1950.0, 1.0, "n/a", 5.0), (2, 1950.0, 1.0, "0", 5.0), (3, 1950.0, 1.0, "-3.5", 5.0), (4, 1950.0, 1.0, None, None),
        (5, 1950.0, 1.0, None, 0.0), (6, 1950.0, 1.0, None, 5.0), (7, 1950.0, 1.0, "7", None),
        (8, None, 1.0, "7", 1.0), (9, 0.0, 1.0, "7", 1.0), (10, -1.0, 1.0, "7", 1.0), (11, 1950.0, None, "7", 1.0), (12, 1950.0, 0.0, "7", 1.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.build_id: r.height_used for r in cleaning.clean(df).collect()} == {1: 5.0, 6: 5.0, 7: 7.0}
    funnel = cleaning.cleaning_funnel(df).first()
    assert (funnel.invalid_year_count, funnel.year_negative_or_zero, funnel.year_missing) == (3, 2, 1)
    assert (funnel.missing_area_count, funnel.invalid_raw_height_count, funnel.invalid_assumed_height_count, funnel.final_count) == (2, 2, 2, 3)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    funnel = cleaning.cleaning_funnel(empty).first()
    assert funnel.initial_count == 0 and funnel.removal_percentage == 0.0 and funnel.area_outlier_threshold is None
    assert cleaning.drop_outliers(empty).count() == 0
    assert soil.water_table_stats(spark.createDataFrame([], "wtdepannmin double")).first().mean is None


def test_outlier_filter_is_strict(spark):
    assert cleaning.drop_outliers(spark.createDataFrame([(5.0,)] * 4, "gfa double")).count() == 0
    assert cleaning.drop_outliers(spark.createDataFrame([(1.0,), (2.0,)], "gfa double")).count() == 1


def test_single_row_spread_is_null(spark):
    row = soil.water_table_stats(spark.createDataFrame([(7.0,)], "wtdepannmin double")).first()
    assert row["std"] is None and row["median"] == 7.0 and row["q25"] == 7.0


def test_labels_without_rows_are_listed(spark):
    df = spark.createDataFrame([("Fair",), (None,)], "eng_class string")
    got = {r["value"]: r["n"] for r in distribution.value_shares(df, "eng_class", ("Favorable", "Fair")).collect()}
    assert got == {"Favorable": 0, "Fair": 1, "NaN (Missing)": 1}


def test_component_ties_at_the_last_rank(spark):
    df = spark.createDataFrame([(f"s{i:02}",) for i in range(25)] + [("s24",), (None,)], "compname string")
    rows = soil.component_ranking(df).collect()
    assert len(rows) == 21 and rows[0].total_unique == 26
    names = {r["value"] for r in rows}
    assert "s24" in names and "s18" in names and "s19" not in names and "NaN (Missing)" in names


def test_frequent_null_class_drops_out_of_the_grouped_flow(spark):
    rows = [(1950.0, None, "W", "Slab", "a", 1.0)] * 3 + [(1950.0, "X", "W", "Slab", "a", 1.0)] * 2 + [(1950.0, "Y", "W", "Slab", "b", 1.0)]
    df = spark.createDataFrame(rows, "year_built double, occ_cls string, material_type string, foundation_type string, compname string, gfa double")
    got = {(r.occupancy, r.soil): r["count"] for r in flows.flow_table(df, 2, 1, group_others=True).collect()}
    assert got == {("X", "a"): 2, ("Other", "Other Soils"): 1}
    plain = {(r.occupancy, r.soil): r["count"] for r in flows.flow_table(df).collect()}
    assert plain[("Unknown", "a")] == 3


def test_plan_reads_only_the_needed_columns(spark, data):
    counts = distribution.value_counts(cleaning.clean(standin.buildings(spark, data, votes=False)), "material_type")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "o_orderpriority" not in scan and plan.count("Exchange") == 1
    assert counts.agg(F.sum("n")).first()[0] > 0
