import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parapet.operators import clustering as K


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(240):
        centre = rng.choice([0, 1, 2], p=[0.6, 0.3, 0.1])
        out.append((
            i, float(rng.normal(100 + 400 * centre, 30)), float(rng.normal(10 + 8 * centre, 2)), float(1900 + rng.integers(0, 120)),
            ["Residential", "Commercial", "Education"][centre], ["W", "S"][int(rng.integers(0, 2))], ["Slab", "Crawl"][int(rng.integers(0, 2))],
            float(rng.normal(500, 50)),
        ))
    return out


def _frame(spark, rows, parts=3):
    schema = "build_id bigint, sqmeters double, height_used double, year_built double, occ_cls string, material_type string, foundation_type string, gfa double"
    return spark.createDataFrame(rows, schema).repartition(parts)


def _by_hand(rows, k, categorical):
    """K-means in numpy with one-hot columns: hash-drawn k-means++ seeds, then Lloyd to the same tolerance."""
    ids = [r[0] for r in rows]
    x = np.array([r[1:4] for r in rows])
    x = np.round((x - x.mean(0)) / x.std(0) * K.UNITS) / K.UNITS
    for column in categorical:
        labels = sorted({r[column] for r in rows})
        x = np.hstack([x, np.array([[float(r[column] == v) for v in labels] for r in rows])])
    u = lambda i, step: (int(hashlib.md5(f"{i}#42#{step}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    chosen = [min(range(len(ids)), key=lambda j: u(ids[j], 0))]
    for step in range(1, k):
        d = ((x[:, None] - x[chosen][None]) ** 2).sum(2).min(1)
        chosen.append(min((j for j in range(len(ids)) if d[j] > 0), key=lambda j: -math.log(u(ids[j], step)) / d[j]))
    centres = x[chosen]
    while True:
        labels = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        fresh = np.array([x[labels == j].mean(0) for j in range(k)])
        moved, centres = ((fresh - centres) ** 2).sum(), fresh
        if moved <= K.TOLERANCE:
            break
    centres = np.array(sorted(map(tuple, centres)))
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    return dict(zip(ids, d.argmin(1))), d.min(1).sum()


def test_feature_models_equal_a_plain_computation(spark, rows):
    labels = K.feature_clusters(_frame(spark, rows), ks=(2, 3, 5)).labels()
    got = labels.where("grp = 'all'").collect()
    wcss = {(r.combo, r.k): r.wcss for r in K.wcss(labels).where("grp = 'all'").collect()}
    columns = {"base": (4,), "material": (4, 5), "foundation": (4, 6), "both": (4, 5, 6)}
    for combo, categorical in columns.items():
        for k in (2, 3, 5):
            expected, cost = _by_hand(rows, k, categorical)
            assert {r.pid: r.cluster for r in got if r.combo == combo and r.k == k} == expected, (combo, k)
            assert wcss[combo, k] == pytest.approx(cost, rel=1e-9)


def test_class_models_and_partitioning(spark, rows):
    some = [r for r in rows if r[4] == "Commercial"]
    expected, _ = _by_hand(some, 3, ())
    results = []
    for parts in (1, 5):
        fitted = K.plain_clusters(_frame(spark, rows, parts), ks=(3,))
        results.append(fitted.centroids)
        got = fitted.labels().where("grp = 'Commercial'").collect()
        assert {r.pid: r.cluster for r in got} == expected
    assert results[0] == results[1], "a fit does not depend on the partitioning"


def test_small_groups_are_left_out(spark, rows):
    few = [r for r in rows if r[4] == "Education"][:9] + [r for r in rows if r[4] == "Residential"][:30]
    groups = {m.group for m in K.plain_clusters(_frame(spark, few), ks=(2,)).centroids}
    assert groups == {"all", "Residential"}


def test_fewer_distinct_points_than_clusters(spark, rows):
    same = [(i, *rows[i % 2][1:]) for i in range(24)]
    labels = K.main_clusters(_frame(spark, same), k=5).labels()
    assert labels.select("cluster").distinct().count() == 2
    assert K.wcss(labels).first().wcss == 0.0


def test_statistics_and_shares(spark, rows):
    labels = K.main_clusters(_frame(spark, rows), k=3).labels()
    found = {r.cluster: r for r in K.cluster_stats(labels).collect()}
    assert sum(r.n for r in found.values()) == len(rows)
    assert sum(r.share for r in K.cluster_shares(labels).collect()) == pytest.approx(1.0)
    by_id = {r.pid: r.cluster for r in labels.collect()}
    mine = np.array([r[1] for r in rows if by_id[r[0]] == 0])
    assert found[0].avg_sqmeters == pytest.approx(mine.mean()) and found[0].std_sqmeters == pytest.approx(mine.std())
    analysis = {r.cluster: r for r in K.cluster_analysis(labels).collect()}
    areas = np.array([r[7] for r in rows if by_id[r[0]] == 0])
    assert analysis[0].area_median == pytest.approx(np.median(areas)) and analysis[0].area_std == pytest.approx(areas.std(ddof=1))


def test_sample_labels_skip_an_empty_feature_and_keep_rows_with_nulls(spark, rows):
    cut = [(*r[:5], None, r[6] if r[0] % 2 else None, r[7]) for r in rows]
    sample = _frame(spark, cut)
    fitted = K.sample_clusters(sample, ks=(2, 7))
    features = {m.combo: m.features for m in fitted.centroids}
    assert features["material"] == ("occ_cls",) and features["both"] == ("occ_cls", "foundation_type")
    wide = K.sample_label_columns(fitted, sample).collect()
    assert len(wide) == len(rows)
    assert all((r.cluster_foundation_k2 is None) == (r.foundation_type is None) for r in wide)
    assert all(r.cluster == r.cluster_base_k7 == r.cluster_k7 for r in wide)


def test_standardised_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 7.0, 1.0)], "g string, x double, c double")
    got = {(r.g, r.x): (r.x_z, r.c_z) for r in K.standardise(df, ("x", "c"), "g").collect()}
    assert got == {("a", 1.0): (-1.0, 0.0), ("a", 3.0): (1.0, 0.0), ("b", 7.0): (0.0, 0.0)}


def test_library_estimator_labels_every_row(spark, rows):
    labelled = K.library_kmeans(_frame(spark, rows), K.NUMERIC, ("occ_cls",), 3)
    assert labelled.count() == len(rows) and labelled.agg(F.countDistinct("cluster")).first()[0] == 3


def test_one_hot_of_unknown_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("z",)], "c string")
    rows = K.one_hot(df, (("c", ("a", "b")),)).collect()
    assert [(r["c=a"], r["c=b"]) for r in rows] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_models_beyond_the_centroid_budget_are_fitted_in_batches(spark, rows, monkeypatch):
    whole = K.plain_clusters(_frame(spark, rows), ks=(2, 3))
    monkeypatch.setattr(K, "CENTROID_BYTES", 1)
    split = K.plain_clusters(_frame(spark, rows), ks=(2, 3))
    assert len(K._batches(split.centroids, split.design)) == len(split.centroids) > 2
    assert split.centroids == whole.centroids
    key = lambda fitted: sorted((r.grp, r.k, r.pid, r.cluster) for r in fitted.labels().select("grp", "k", "pid", "cluster").collect())
    assert key(split) == key(whole)


def test_stats_carry_the_totals_of_their_model(spark, rows):
    labels = K.plain_clusters(_frame(spark, rows), ks=(2,)).staged_labels()
    stats = K.cluster_stats(labels, with_model=True).where("grp = 'all'").collect()
    model = K.wcss(labels).where("grp = 'all'").first()
    assert {r.total_buildings for r in stats} == {sum(r.n for r in stats)} == {model.n}
    assert stats[0].wcss == pytest.approx(model.wcss)


def test_a_fit_that_does_not_settle_says_so(spark, rows):
    with pytest.warns(UserWarning, match="did not settle"):
        K.main_clusters(_frame(spark, rows), k=4, max_iterations=1)


def test_statistics_of_one_pass_equal_those_of_labels(spark, rows):
    """The fused pass against labels written row by row, dominant labels and totals of the model included."""
    fitted = K.feature_clusters(_frame(spark, rows), ks=(2, 4))
    labels = fitted.staged_labels()
    key = ("grp", "combo", "k", "cluster")
    want = K.cluster_stats(labels, with_model=True).join(K.dominant_features(labels), list(key), "left")
    got = {tuple(r[c] for c in key): r for r in fitted.statistics(dominant=True).collect()}
    assert sorted(want.columns) == sorted(fitted.statistics(dominant=True).columns)
    found = want.collect()
    assert len(found) == len(got) > 30
    for r in found:
        mine = got[tuple(r[c] for c in key)]
        assert all(mine[c] == (pytest.approx(r[c], rel=1e-9, abs=1e-7) if isinstance(r[c], float) else r[c]) for c in want.columns)
    sizes = {(r.grp, r.combo, r.k): (r.n, r.wcss) for r in K.wcss(labels).collect()}
    assert {(r.grp, r.combo, r.k): (r.n, pytest.approx(r.wcss, abs=1e-7)) for r in fitted.wcss().collect()} == sizes
    shares = {tuple(r[c] for c in key): (r.n, r.share) for r in K.cluster_shares(labels).collect()}
    assert {tuple(r[c] for c in key): (r.n, r.share) for r in fitted.shares().collect()} == shares


def test_spread_far_from_the_mean_keeps_its_digits(spark, rows):
    """A tight cluster far from the others: the sums are taken about its own centre."""
    far = [(1000 + i, 1e9 + i / 64, 10.0, 1950.0, "Commercial", "W", "Slab", 500.0) for i in range(64)]
    near = [(*r[:2], 10.0, 1950.0, *r[4:]) for r in rows]
    fitted = K.plain_clusters(_frame(spark, [*near, *far]), ks=(2,))
    got = fitted.statistics(with_area=True).where("grp = 'all' AND n = 64").first()
    assert got.std_sqmeters == pytest.approx(np.std([r[1] for r in far]), rel=1e-6) and got.avg_sqmeters == pytest.approx(1e9 + 63 / 128, rel=1e-15)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_write_no_labelled_rows(spark, rows, monkeypatch):
    fitted = K.feature_clusters(_frame(spark, rows), ks=(2,))
    monkeypatch.setattr(K, "stage", None)
    for df in (fitted.statistics(dominant=True), fitted.wcss()):
        assert "Generate" not in _plan(df) and df.count() > 0


def test_wide_labels_equal_long_ones(spark, rows):
    """Labels side by side, from rows with nulls in optional features, without a shuffle."""
    cut = [(*r[:5], r[5] if r[0] % 3 else None, r[6] if r[0] % 2 else None, r[7]) for r in rows]
    sample = _frame(spark, cut)
    fitted = K.sample_clusters(sample, ks=(2, 3))
    wide = K.sample_label_columns(fitted, sample)
    added = _plan(wide).count("Exchange") - _plan(sample).count("Exchange")
    assert added == 0 and "Generate" not in _plan(wide) and "Pivot" not in _plan(wide)
    got = {r.build_id: r for r in wide.collect()}
    long = fitted.labels().collect()
    assert all(got[r.pid][f"cluster_{r.combo}_k{r.k}"] == r.cluster for r in long)
    labelled = sum(got[r[0]][f"cluster_{c}_k{k}"] is not None for r in cut for c in K.COMBINATIONS for k in (2, 3))
    assert labelled == len(long) and len(got) == len(cut)
    assert wide.columns[: len(sample.columns)] == sample.columns and {"cluster", "cluster_k2", "cluster_k3"} <= set(wide.columns)


def test_wide_labels_in_batches(spark, rows, monkeypatch):
    sample = _frame(spark, rows)
    fitted = K.sample_clusters(sample, ks=(2,))
    key = lambda df: sorted((r.build_id, r.cluster_base_k2, r.cluster_both_k2) for r in df.collect())
    whole = key(K.sample_label_columns(fitted, sample))
    monkeypatch.setattr(K, "CENTROID_BYTES", 1)
    assert key(K.sample_label_columns(fitted, sample)) == whole


def test_pass_on_close_and_equal_centroids():
    """Sums of a pass are those of :func:`kernels.nearest`, also on ties, repeated slots and rows in any order."""
    import numpy as np
    import pyarrow as pa

    from parapet.operators import kernels

    rng, n, size = np.random.default_rng(4), 6000, 2 + 5 + 1
    x = [rng.integers(-3, 4, n) * 500_000 for _ in range(2)]
    s = [rng.choice([2, 3, 7], n), rng.choice([4, 5, 6, 7], n)]
    vectors = np.zeros((5, size))
    vectors[:, 0], vectors[:, 1] = [0.0, 1.0, 1.0, -0.5, 0.5 + 1e-14], [0.0, 0.0, 0.0, 0.25, 0.0]
    vectors[:, 2:4], vectors[:, 4:7] = 0.5, 1 / 3
    models = {"a": [(0, vectors, (vectors[:, 2:] ** 2).sum(axis=1) + 2.0), (1, vectors[:2], np.array([2.5, 2.5]))], "b": [(2, vectors[3:], np.zeros(2))]}
    group = rng.choice(["a", "b", "c"], n)
    order = np.lexsort((*s, group))
    for rows in (np.arange(n), order):
        arrays = [pa.array(group[rows]), *[pa.array(c[rows]) for c in x], *[pa.array(c[rows]) for c in s]]
        batch = pa.RecordBatch.from_arrays(arrays, names=["grp", "x0", "x1", "s0", "s1"])
        found = {r[:2]: r[2:] for out in kernels.partial_sums(2, 2, size, 1e6, models)(iter([batch])) for r in zip(*[c.to_pylist() for c in out.columns])}
        expected = {}
        for name, mine in models.items():
            at = np.flatnonzero(group == name)
            for number, v, bias in mine:
                label, _ = kernels.nearest([c[at] / 1e6 for c in x], [c[at] for c in s], v, bias)
                for j in np.unique(label):
                    here = at[label == j]
                    slots = sum(np.bincount(c[here], minlength=size) for c in s)
                    expected[number, int(j)] = (len(here), *[int(c[here].sum()) for c in x], *slots[2:].tolist())
        assert found == expected


def test_staged_points_are_in_order(spark):
    """A file's rows stand in order of group and labels, so that a pass meets many of a kind."""
    from parapet.operators import clustering

    rows = spark.range(400).selectExpr("id AS build_id", "CAST(id%7 AS DOUBLE) AS v", "CAST(id%3 AS STRING) AS f", "CAST(id%2 AS STRING) AS grp")
    design = clustering.Design(("v",), (("f", ("0", "1", "2")),))
    table = clustering.points(rows, design, "ordered-points", clustering._groups(rows, ("v",)))
    for part in table.select("grp", "s0").rdd.glom().collect():
        runs = [tuple(r) for r in part]
        assert sum(a != b for a, b in zip(runs, runs[1:])) <= 6 * 8
