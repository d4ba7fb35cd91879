from parapet.functions import votes as V
from parapet.functions.text import has_text, is_unclassified
from parapet.operators import classes
from pyspark.sql import functions as F


def _texts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_tokens_add_up_repeats_anywhere_in_the_text(spark):
    df = _texts(spark, "RES: 1, com:2.9; COM: -1 XRES:4", "bad", "", None, "NaN", "RES :\t3")
    found = df.withColumn("f", V.tokens("t"))
    rows = found.select("i", F.size("f").alias("n"), V.votes_for("f", "RES").alias("res"), V.votes_for("f", "COM").alias("com")).orderBy("i").collect()
    assert (rows[0].n, rows[0].res, rows[0].com) == (4, 5, 1)
    assert [r.n for r in rows[1:3]] == [0, 0] and rows[3].res is None
    assert rows[5].res == 3


def test_list_reading_keeps_case_and_the_last_repeat(spark):
    df = _texts(spark, "{RES: 1, res: 2, RES: 3}", "A:x", "no colon", "A: 1; B:2.7 ;C:-1", "A:1_0,B:nan,C:1e2,D:", None, " {A:1} ", "A:1:2")
    rows = {r.i: {x["type"]: x["points"] for x in (r.l or [])} for r in df.select("i", V.listed("t").alias("l")).collect()}
    assert rows[0] == {"RES": 3, "res": 2}
    assert rows[1] == {"A": 0} and rows[2] == {}
    assert rows[3] == {"A": 1, "B": 2, "C": -1}
    assert rows[4] == {"A": 10, "B": 0, "C": 100, "D": 0}
    assert rows[5] == {} and rows[6] == {"A": 1} and rows[7] == {"A": 0}


def test_winner_tie_and_no_votes(spark):
    rows = [
        (1, "Unclassified", "RES: 1, COM: 1", "MIX_SC1"),
        (2, "Unclassified", "REL: 2", "MIX_SC1"),
        (3, "Unclassified", "RES: 0, COM: 0", "MIX_SC1"),
        (4, None, "RES: 2, REL: 1", "MIX_SC3"),
        (5, "unclassified ", "RES: 2, COM: 1", "MIX_SC3"),
        (6, "Unclassified", "RES: 2, XYZ: 2", None),
        (7, "Commercial", "RES: 9", "MIX_SC1"),
        (8, "Unclassified", " nan ", "MIX_SC1"),
        (9, "Unclassified", "XYZ: 3", "MIX_SC1"),
        (10, "Unclassified", "RES: -1, COM: -2, IND: -3, AGR: -4, GOV: -5, EDU: -6, REL: -7, XYZ: 1", None),
        (11, "Unclassified", "RES: 2, COM: 1, IND: 1", None),
    ]
    df = spark.createDataFrame(rows, "build_id int, occ_cls string, occ_dict string, mix_sc string")
    done = {r.build_id: r for r in classes.recalculate_mix(classes.resolve_classes(df)).collect()}
    assert done[1].tie == "C:1, R:1" and done[1].occ_cls == "Unclassified" and done[1].outcome == "tie"
    assert done[2].occ_cls == "Assembly" and done[2].mix_sc is None
    assert done[3].outcome == "none" and done[3].mix_sc == "MIX_SC1"
    assert done[4].occ_cls == "Residential" and done[4].mix_sc == "MIX_SC3", "a null original label is not recalculated"
    assert done[5].occ_cls == "Residential" and done[5].mix_sc == "MIX_SC3", "another spelling is not recalculated"
    assert done[6].mix_sc == "MIX_SC2", "an unknown code counts as a conflict"
    assert done[7].outcome is None and done[7].occ_cls == "Commercial"
    assert done[8].outcome == "none" and done[9].outcome == "none"
    assert done[10].occ_cls == "Residential" and done[10].mix_sc == "MIX_SC1"
    assert done[11].mix_sc == "MIX_SC2" and done[11].occ_cls_orig == "Unclassified"
    stats = classes.resolution_stats(classes.resolve_classes(df)).first()
    assert (stats.total_unclassified_before, stats.with_occdict, stats.changed, stats.unchanged) == (10, 9, 6, 4)


def test_mix_rules(spark):
    df = spark.createDataFrame(
        [("RES: 1",), ("COM: 1",), ("RES: 1, COM: 1",), ("COM: 1, IND: 2",), ("",)], "t string"
    ).withColumn("f", V.tokens("t")).withColumn("own", F.lit("RES"))
    got = [r[0] for r in df.select(V.mix_rule("f", "own")).collect()]
    assert got == ["same", "MIX_SC1", "MIX_SC2", "MIX_SC3", "keep"]


def test_text_predicates(spark):
    df = _texts(spark, None, "", " \t", "NaN", " x ", "UNCLASSIFIED\n", "Unclassified")
    rows = df.select(has_text(F.col("t")), is_unclassified(F.col("t"))).collect()
    assert [r[0] for r in rows] == [False, False, False, False, True, True, True]
    assert [r[1] for r in rows] == [True, False, False, False, False, True, True]


def test_mix_of_rows_that_an_earlier_run_repaired(spark):
    rows = [
        (1, "Residential", "Unclassified", "RES: 2, COM: 1", "MIX_SC3"), (2, "Residential", "Unclassified", "RES: 2", "MIX_SC3"),
        (3, "Residential", "Residential", "RES: 2, COM: 1", "MIX_SC3"), (4, "Residential", "Unclassified", None, "MIX_SC3"),
        (5, "Unclassified", "Unclassified", "COM: 1", "MIX_SC3"), (6, "Utility", "Unclassified", "COM: 1", "MIX_SC3"),
    ]
    df = spark.createDataFrame(rows, "build_id int, occ_cls string, occ_cls_orig string, occ_dict string, mix_sc string")
    done = {r.build_id: (r.occ_cls, r.mix_sc) for r in classes.recalculate_mix(classes.resolve_classes(df)).collect()}
    assert done == {
        1: ("Residential", "MIX_SC2"), 2: ("Residential", None), 3: ("Residential", "MIX_SC3"), 4: ("Residential", "MIX_SC3"),
        5: ("Commercial", None), 6: ("Utility", "MIX_SC3"),
    }
