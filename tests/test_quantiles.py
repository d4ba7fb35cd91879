import numpy as np
import pytest

from parapet.operators import quantiles

PROBS = (0.0, 0.25, 0.33, 0.5, 0.67, 0.99999, 1.0)


@pytest.mark.parametrize("buckets", [8192, 4])
def test_equal_to_numpy_on_awkward_values(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    values = np.concatenate([np.exp(rng.normal(0, 6, 400)), -np.exp(rng.normal(0, 3, 100)), np.full(250, 3.25)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    found = quantiles.exact_quantiles(df, "v", PROBS)
    for p in PROBS:
        assert found.value(p) == pytest.approx(np.quantile(values, p), rel=1e-12), p


def test_groups_nulls_and_single_rows(spark):
    rows = [("a", float(i)) for i in range(11)] + [("b", 7.0), (None, 1.0), ("c", None)]
    found = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", (0.5, 0.25), by="g")
    assert found.table == {"a": {0.5: 5.0, 0.25: 2.5}, "b": {0.5: 7.0, 0.25: 7.0}}


def test_no_rows(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "v double"), "v", (0.5,)).value(0.5) is None


def test_more_groups_than_one_pass_splits(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "RANGES", 3)
    rows = [(f"g{i % 10}", float((i * 37) % 101) + i % 10) for i in range(400)]
    found = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", (0.5, 0.9), by="g")
    for g in {g for g, _ in rows}:
        values = [v for x, v in rows if x == g]
        assert found.table[g] == pytest.approx({p: np.quantile(values, p) for p in (0.5, 0.9)})


def test_stacked_columns_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"g{i % 3}", float(rng.normal(5, 2)), float(rng.integers(0, 9)) if i % 4 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    passes, split = [], quantiles._split
    monkeypatch.setattr(quantiles, "_split", lambda values, ranges: passes.append(len(ranges)) or split(values, ranges))
    found = quantiles.stacked_quantiles(df, ("a", "b"), (0.25, 0.5), by="g")
    # Six groups in the first pass, and no more passes than the harder column needs alone.
    assert passes[0] == 6 and len(passes) <= 4
    for column, at in (("a", 1), ("b", 2)):
        for g in ("g0", "g1", "g2"):
            values = np.array([r[at] for r in rows if r[0] == g and r[at] is not None])
            m = found[column].moments[g]
            assert found[column].table[g] == pytest.approx({p: np.quantile(values, p) for p in (0.25, 0.5)})
            assert (m.n, m.low, m.high) == (len(values), values.min(), values.max())
            assert (m.mean, m.deviation) == (pytest.approx(values.mean()), pytest.approx(values.std(ddof=1)))


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_sketch_keeps_its_stated_error(spark, accuracy):
    """Ranks of the sketched values, merged from many partitions, are off by at most rows / accuracy."""
    rng = np.random.default_rng(7)
    values = np.round(np.exp(rng.normal(0, 3, 20_000)), 3)
    df = spark.createDataFrame([(float(v), "a" if i % 2 else "b") for i, v in enumerate(values)] + [(None, "a"), (float("nan"), "b")], "v double, g string").repartition(7)
    found = quantiles.exact_quantiles(df, "v", PROBS, accuracy=accuracy)
    ordered = np.sort(values)
    for p in PROBS:
        low, high = np.searchsorted(ordered, found.value(p), "left"), np.searchsorted(ordered, found.value(p), "right")
        allowed = len(values) / accuracy + 1
        assert low - allowed <= p * (len(values) - 1) <= high + allowed, p
    by = quantiles.exact_quantiles(df, "v", (0.5,), by="g", accuracy=accuracy)
    assert set(by.table) == {"a", "b"} and by.moments["a"].n == 10_000


def test_reports_take_the_sketch_only_when_asked(spark):
    from parapet.operators import cleaning, flows, soil

    rows = [(i, float(i % 997), float(i % 89), f"c{i % 2}", float(i % 500)) for i in range(4000)]
    df = spark.createDataFrame(rows, "build_id int, gfa double, height_used double, occ_cls string, wtdepannmin double")
    exact, near = soil.water_table_stats(df).first(), soil.water_table_stats(df, accuracy=200).first()
    assert exact.median == 249.5 and exact[:4] == near[:4] and abs(near.median - exact.median) <= 4
    assert {r.occ_cls: r.mean for r in soil.water_table_by_class(df, accuracy=200).collect()} == {r.occ_cls: r.mean for r in soil.water_table_by_class(df).collect()}
    a, b = flows.terciles(df), flows.terciles(df, accuracy=200)
    assert all(abs(x - y) <= 997 / 100 for x, y in zip((*a.area, *a.height), (*b.area, *b.height)))
    assert cleaning.outlier_threshold(df, accuracy=10_000_000) in (995.0, 996.0)
    assert soil.water_table_stats(df.limit(0)).first().mean is None and flows.terciles(df.limit(0)) is None
