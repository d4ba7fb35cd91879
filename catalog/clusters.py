"""Entries for clustering. The SQL twins run the same seeding and iterations recursively."""

from functools import reduce

from pyspark.sql import functions as F

from catalog.registry import Inputs, add, define
from parapet.operators import cleaning, clustering, sampling

# The labels of the stand-in data, in order.
_CLASSES = ["Agriculture", "Assembly", "Commercial", "Education", "Government", "Industrial", "Residential", "Unclassified", "Utility"]
_LABELS = {"foundation_type": ["Basement", "Crawl", "Slab"], "material_type": ["M", "S", "W"], "occ_cls": _CLASSES}
_HOLES = ("sqmeters", "height_used", "year_built", "occ_cls", "material_type", "foundation_type", "gfa")
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _HOLES)


def _define_fit(name: str, rows: str, numeric: tuple[str, ...], features: tuple[str, ...], ks: tuple[int, ...], least: int, without: dict[str, str] | None = None) -> None:
    """Subqueries <name>_points, _seeds, _steps, _final and _labels for k-means over ``rows`` (with a column grp).

    A label is a slot of the list p, feature by feature in the order given; the last slot is 0
    and serves rows that do not use a feature. ``without`` has the condition of those rows.
    """
    dims, cats = range(len(numeric)), range(len(features))
    starts = [sum(len(_LABELS[f]) for f in features[:i]) for i in range(len(features) + 1)]
    size = starts[-1]
    z = [
        f"CASE WHEN STDDEV_POP({c}) OVER w > 0 THEN CAST(ROUND(({c}-AVG({c}) OVER w)/STDDEV_POP({c}) OVER w*1000000) AS BIGINT) ELSE 0 END AS x{i}"
        for i, c in enumerate(numeric)
    ]
    slots = [
        f"CASE WHEN {(without or {}).get(f, 'FALSE')} THEN {size + 1} ELSE COALESCE(list_position([{', '.join(repr(v) for v in _LABELS[f])}], {f}) + {starts[i]}, {size + 1}) END AS s{i}"
        for i, f in enumerate(features)
    ]
    raw = "occ_cls, material_type, foundation_type, gfa, sqmeters, height_used, year_built"
    define(f"{name}_points", f"SELECT grp, build_id AS pid, {raw}, {', '.join(z + slots)} FROM ({rows}) WINDOW w AS (PARTITION BY grp)")
    define(f"{name}_sizes", f"SELECT grp, COUNT(*) AS n FROM {name}_points GROUP BY grp")

    hash_of = lambda step: f"((CAST('0x' || substr(md5(pid || '#42#' || ({step})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"
    point = "{" + ", ".join([f"'x{i}': x{i}" for i in dims] + [f"'s{i}': s{i}" for i in cats] + ["'z': 0"]) + "}"
    gap = " + ".join(f"(x{i}/1000000.0-c.x{i}/1000000.0)*(x{i}/1000000.0-c.x{i}/1000000.0)" for i in dims)
    if features:
        gap += " + (" + " + ".join(f"CASE WHEN s{i}=c.s{i} THEN 0.0E0 ELSE 2.0E0 END" for i in cats) + ")"
    define(
        f"{name}_seeds",
        f"SELECT 0 AS step, grp, [arg_min({point}, {{'u': u, 'p': pid}})] AS cs FROM (SELECT *, {hash_of('0')} AS u FROM {name}_points) GROUP BY grp UNION ALL "
        f"SELECT step+1, grp, list_append(any_value(cs), arg_min({point}, {{'u': score, 'p': pid}})) FROM (SELECT *, -ln({hash_of('step+1')})/d AS score FROM ("
        f"SELECT s.step, s.cs, p.*, list_min(list_transform(s.cs, lambda c: {gap})) AS d FROM {name}_seeds s JOIN {name}_points p ON s.grp=p.grp "
        f"WHERE s.step < {max(ks) - 1}) WHERE d>0) GROUP BY step, grp",
    )

    slot_of = [i for i in cats for _ in _LABELS[features[i]]]
    share = "[" + ", ".join([f"CASE WHEN c.s{i}={j} THEN 1.0E0 ELSE 0.0E0 END" for j, i in enumerate(slot_of, 1)] + ["0.0E0"]) + "]"
    used = " + ".join(f"CASE WHEN c.s{i}<={size} THEN 1 ELSE 0 END" for i in cats) or "0"
    start = (
        "SELECT 0 AS it, grp, k, j, " + ", ".join(f"c.x{i}/1000000.0 AS c{i}" for i in dims)
        + f", CAST({used} AS DOUBLE) AS nf, 2.0E0*({used}) AS bias, {share} AS p, FALSE AS done FROM ("
        f"SELECT f.grp, k, UNNEST(range(least(k, len(cs)))) AS j, UNNEST(cs[1:k]) AS c FROM (SELECT * FROM {name}_seeds WHERE step={max(ks) - 1}) f, "
        f"(SELECT UNNEST([{', '.join(map(str, ks))}]) AS k) WHERE (SELECT MAX(n) FROM {name}_sizes z WHERE z.grp=f.grp) >= greatest(k, {least}))"
    )
    far = " + ".join(f"(x{i}/1000000.0-c{i})*(x{i}/1000000.0-c{i})" for i in dims)
    if features:
        far += " + (bias - 2.0*(" + " + ".join(f"l.p[s{i}]" for i in cats) + "))"
    kept = ", ".join([f"'c{i}': c{i}" for i in dims] + ["'j': j", "'p': l.p", "'nf': nf"])
    near = (
        "SELECT l.it, l.grp, l.k, q.pid, " + "".join(f"any_value(q.s{i}) AS s{i}, " for i in cats) + ", ".join(f"any_value(x{i}) AS x{i}" for i in dims)
        + f", arg_min({{{kept}}}, {{'d': {far}, 'j': j}}) AS b FROM {name}_steps l JOIN {name}_points q ON l.grp=q.grp WHERE NOT l.done GROUP BY l.it, l.grp, l.k, q.pid"
    )
    fresh = "[" + ", ".join([f"SUM(CASE WHEN s{i}={j} THEN 1 ELSE 0 END)/COUNT(*)" for j, i in enumerate(slot_of, 1)] + ["0.0E0"]) + "]"
    sums = (
        "SELECT it, grp, k, b.j AS j, " + ", ".join(f"CAST(SUM(x{i}) AS DOUBLE)/COUNT(*)/1000000 AS c{i}, any_value(b.c{i}) AS o{i}" for i in dims)
        + f", any_value(b.nf) AS nf, {fresh} AS p, any_value(b.p) AS op FROM ({near}) GROUP BY it, grp, k, b.j"
    )
    shift = " + ".join(f"(c{i}-o{i})*(c{i}-o{i})" for i in dims) + " + list_sum(list_transform(list_zip(p, op), lambda e: (e[1]-e[2])*(e[1]-e[2])))"
    define(
        f"{name}_steps",
        f"{start} UNION ALL SELECT it+1, grp, k, j, " + ", ".join(f"c{i}" for i in dims)
        + f", nf, nf + list_sum(list_transform(p, lambda e: e*e)), p, SUM({shift}) OVER (PARTITION BY grp, k) <= 0.0001 FROM ({sums}) WHERE it<300",
    )
    order = ", ".join(f"c{i}" for i in dims) + ", p"
    define(
        f"{name}_final",
        f"SELECT *, ROW_NUMBER() OVER (PARTITION BY grp, k ORDER BY {order})-1 AS cluster FROM {name}_steps s "
        f"WHERE it=(SELECT MAX(it) FROM {name}_steps m WHERE m.grp=s.grp AND m.k=s.k)",
    )
    carried = ", ".join(f"any_value(q.{c}) AS {c}" for c in raw.split(", "))
    define(
        f"{name}_labels",
        f"SELECT q.grp, l.k, q.pid, {carried}, arg_min(cluster, {{'d': {far}, 'j': cluster}}) AS cluster, MIN({far}) AS d2 "
        f"FROM {name}_final l JOIN {name}_points q ON l.grp=q.grp GROUP BY q.grp, l.k, q.pid",
    )


_ALL_AND_CLASS = f"SELECT *, UNNEST(['all', occ_cls]) AS grp FROM prepared WHERE {_COMPLETE}"
_define_fit("main_fit", "SELECT *, 'all' AS grp FROM cluster_rows", clustering.NUMERIC, ("occ_cls",), (clustering.MAIN_K,), 1)
_define_fit("elbow_fit", "SELECT *, 'all' AS grp FROM prepared WHERE occ_cls IS NOT NULL AND gfa IS NOT NULL AND year_built IS NOT NULL AND gfa < "
            "(SELECT quantile_cont(gfa, 0.99999) FROM prepared WHERE occ_cls IS NOT NULL AND year_built IS NOT NULL)",
            clustering.ELBOW_NUMERIC, ("occ_cls",), tuple(clustering.ELBOW_K), 1)
_define_fit("few_fit", _ALL_AND_CLASS, clustering.NUMERIC, (), (2, 3, 4), clustering.PLAIN_MIN_ROWS)
_define_fit("plain_fit", _ALL_AND_CLASS, clustering.NUMERIC, (), tuple(clustering.PLAIN_K), clustering.PLAIN_MIN_ROWS)

# Every combination of features is a group of its own; rows of the sample miss optional features and drop out of theirs.
_ALL_FEATURES = ("foundation_type", "material_type", "occ_cls")
_COMBOS = "SELECT UNNEST(['base', 'material', 'foundation', 'both']) AS combo"
_WITHOUT = {"foundation_type": "combo IN ('base', 'material')", "material_type": "combo IN ('base', 'foundation')"}
_define_fit("feature_fit", f"SELECT *, combo || '|' || part AS grp FROM (SELECT *, UNNEST(['all', occ_cls]) AS part FROM prepared WHERE {_COMPLETE}), ({_COMBOS})",
            clustering.NUMERIC, _ALL_FEATURES, tuple(clustering.FEATURE_K), clustering.FEATURE_MIN_ROWS, _WITHOUT)
for _name, _rows in (("balanced_fit", "balanced_rows"), ("random_fit", "random_rows")):
    _define_fit(_name, f"SELECT *, combo AS grp FROM {_rows}, ({_COMBOS}) WHERE (material_type IS NOT NULL OR {_WITHOUT['material_type']}) "
                f"AND (foundation_type IS NOT NULL OR {_WITHOUT['foundation_type']})", clustering.NUMERIC, _ALL_FEATURES, tuple(clustering.SAMPLE_K), 1, _WITHOUT)

add("m1_standardise", "build_id:n sqmeters_z:n height_used_z:n year_built_z:n", lambda c: clustering.standardise(cleaning.cluster_table(c.staged), clustering.NUMERIC),
    "SELECT build_id, " + ", ".join(f"({x}-AVG({x}) OVER ())/STDDEV_POP({x}) OVER () AS {x}_z" for x in clustering.NUMERIC) + " FROM cluster_rows")


def _one_hot(c: Inputs):
    rows = c.cleaned_plain
    labels = clustering.fit_labels(rows, ("material_type", "foundation_type"))
    hot = clustering.one_hot(rows, labels)
    pairs = F.array(*[F.struct(F.lit(f"{f}={x}").alias("label"), F.col(f"{f}={x}").alias("hot")) for f, found in labels for x in found])
    return hot.select("build_id", F.inline(pairs))


add("m2_one_hot", "build_id:n label:t hot:n", _one_hot, " UNION ALL ".join(
    f"SELECT build_id, '{f}={x}' AS label, CASE WHEN {f}='{x}' THEN 1 ELSE 0 END AS hot FROM cleaned"
    for f, found in (("material_type", "MSW"), ("foundation_type", ("Basement", "Crawl", "Slab"))) for x in found))


def _library(c: Inputs):
    labelled = clustering.library_kmeans(cleaning.cluster_table(c.staged), clustering.NUMERIC, ("occ_cls",), clustering.MAIN_K)
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("sqmeters").alias("avg_sqmeters"))


add("m3_library_kmeans", "cluster:n n:n avg_sqmeters:n", _library)
# The estimator's own seeds have no twin; its clusters must still be all there and add up to the table.
add("m3_library_totals", "clusters:n n:n sqmeters:n",
    lambda c: _library(c).agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("avg_sqmeters")).alias("sqmeters")),
    f"SELECT {clustering.MAIN_K} AS clusters, COUNT(*) AS n, SUM(sqmeters) AS sqmeters FROM cluster_rows")
add("m4_main_clusters", "pid:n cluster:n d2:n", lambda c: clustering.main_clusters(cleaning.cluster_table(c.staged)).labels(), "SELECT pid, cluster, d2 FROM main_fit_labels")


def _below_outliers(c: Inputs):
    rows = cleaning.complete_cases(c.staged.select("build_id", "occ_cls", "gfa", "year_built"))
    return cleaning.drop_outliers(rows)


add("m5_elbow", "k:n wcss:n n:n", lambda c: clustering.elbow_clusters(_below_outliers(c)).wcss(),
    "SELECT k, SUM(d2) AS wcss, COUNT(*) AS n FROM elbow_fit_labels GROUP BY k")

_STATS = ("COUNT(*) AS n, AVG(sqmeters) AS avg_sqmeters, STDDEV_POP(sqmeters) AS std_sqmeters, AVG(height_used) AS avg_height, STDDEV_POP(height_used) AS std_height, "
          "TRUNC(AVG(year_built)) AS avg_year, STDDEV_POP(year_built) AS std_year")
_AREA = ", AVG(gfa) AS avg_gfa, STDDEV_POP(gfa) AS std_gfa"
_STAT_COLUMNS = "n:n avg_sqmeters:n std_sqmeters:n avg_height:n std_height:n avg_year:n std_year:n"
add("m6_class_clusters", f"grp:t k:n cluster:n {_STAT_COLUMNS} avg_gfa:n std_gfa:n wcss:n total_buildings:n",
    lambda c: clustering.plain_clusters(c.staged).statistics(with_area=True),
    f"SELECT *, SUM(part) OVER (PARTITION BY grp, k) AS wcss, SUM(n) OVER (PARTITION BY grp, k) AS total_buildings FROM ("
    f"SELECT grp, k, cluster, {_STATS}{_AREA}, SUM(d2) AS part FROM plain_fit_labels GROUP BY grp, k, cluster)")


def _common(column: str, kind: str) -> str:
    """The most frequent label of each cluster of the combinations that use the feature."""
    return (
        f"SELECT grp, k, cluster, {column} AS dominant_{kind} FROM (SELECT grp, k, cluster, {column}, "
        f"ROW_NUMBER() OVER (PARTITION BY grp, k, cluster ORDER BY COUNT(*) DESC, {column}) AS r "
        f"FROM feature_fit_labels WHERE split_part(grp, '|', 1) IN ('both', '{kind}') GROUP BY grp, k, cluster, {column}) WHERE r=1"
    )


add("m7_feature_clusters", f"grp:t combo:t k:n cluster:n {_STAT_COLUMNS} dominant_material:t dominant_foundation:t wcss:n total_buildings:n",
    lambda c: clustering.feature_clusters(c.staged).statistics(dominant=True),
    f"SELECT split_part(s.grp, '|', 2) AS grp, split_part(s.grp, '|', 1) AS combo, s.* EXCLUDE (grp), dominant_material, dominant_foundation, "
    f"SUM(part) OVER (PARTITION BY s.grp, s.k) AS wcss, SUM(n) OVER (PARTITION BY s.grp, s.k) AS total_buildings FROM ("
    f"SELECT grp, k, cluster, {_STATS}, SUM(d2) AS part FROM feature_fit_labels GROUP BY grp, k, cluster) s "
    f"LEFT JOIN ({_common('material_type', 'material')}) m ON m.grp=s.grp AND m.k=s.k AND m.cluster=s.cluster "
    f"LEFT JOIN ({_common('foundation_type', 'foundation')}) f ON f.grp=s.grp AND f.k=s.k AND f.cluster=s.cluster")


def _sample_labels(c: Inputs):
    sample = sampling.stratified_sample(sampling.sample_base(c.staged))
    return clustering.sample_clusters(sample).labels()


add("m8_sample_labels", "pid:n combo:t k:n cluster:n", _sample_labels, "SELECT pid, grp AS combo, k, cluster FROM balanced_fit_labels")


def _fixed_labels(c: Inputs):
    """Labels that are a plain function of the id, to check the statistics alone."""
    rows = c.prepared.where(" AND ".join(f"{x} IS NOT NULL" for x in _HOLES))
    return rows.withColumns({
        "grp": F.lit("all"), "combo": F.when(F.col("build_id") % 2 == 0, "both").otherwise("material"),
        "k": F.lit(5), "cluster": F.col("build_id") % 5,
    })


_FIXED = f"SELECT *, 'all' AS grp, CASE WHEN build_id%2=0 THEN 'both' ELSE 'material' END AS combo, 5 AS k, build_id%5 AS cluster FROM prepared WHERE {_COMPLETE}"
add("m9_cluster_stats", f"combo:t k:n cluster:n {_STAT_COLUMNS} avg_gfa:n std_gfa:n", lambda c: clustering.cluster_stats(_fixed_labels(c), with_area=True),
    f"SELECT combo, k, cluster, {_STATS}{_AREA} FROM ({_FIXED}) GROUP BY combo, k, cluster")


def _mode(column: str, combos: str) -> str:
    return (f"SELECT combo, cluster, {column} FROM (SELECT combo, cluster, {column}, ROW_NUMBER() OVER (PARTITION BY combo, cluster ORDER BY COUNT(*) DESC, {column}) AS r "
            f"FROM ({_FIXED}) WHERE combo IN ({combos}) GROUP BY combo, cluster, {column}) WHERE r=1")


add("m9_dominant_features", "combo:t cluster:n dominant_material:t dominant_foundation:t", lambda c: clustering.dominant_features(_fixed_labels(c)),
    f"SELECT m.combo, m.cluster, m.material_type AS dominant_material, f.foundation_type AS dominant_foundation FROM ({_mode('material_type', chr(39) + 'both' + chr(39) + ', ' + chr(39) + 'material' + chr(39))}) m "
    f"LEFT JOIN ({_mode('foundation_type', chr(39) + 'both' + chr(39))}) f ON m.combo=f.combo AND m.cluster=f.cluster")
add("m10_batched_models", "grp:t k:n pid:n cluster:n d2:n", lambda c: clustering.plain_clusters(c.staged, (2, 3, 4)).labels(),
    "SELECT grp, k, pid, cluster, d2 FROM few_fit_labels")


def _feature_sets(c: Inputs):
    sets = {name: clustering.combination(name, c.prepared.columns) for name in clustering.COMBINATIONS}
    known = lambda features: reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in (*clustering.NUMERIC, *features)])
    counted = c.prepared.agg(*[F.count_if(known(features)).alias(name) for name, features in sets.items()])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("combo"), F.lit(",".join(features)).alias("features"), F.col(name).alias("n")) for name, features in sets.items()
    ])))


_NUM = "sqmeters IS NOT NULL AND height_used IS NOT NULL AND year_built IS NOT NULL AND occ_cls IS NOT NULL"
add("m11_feature_sets", "combo:t features:t n:n", _feature_sets, " UNION ALL ".join(
    f"SELECT '{name}' AS combo, '{','.join(f)}' AS features, COUNT(*) AS n FROM prepared WHERE {_NUM}" + "".join(f" AND {x} IS NOT NULL" for x in f[1:])
    for name, f in clustering.COMBINATIONS.items()))


def _aligned(c: Inputs):
    labels = c.cluster.select("build_id", (F.col("build_id") % 7).alias("cluster"))
    return clustering.align_labels(c.prepared.select("build_id", "occ_cls"), labels)


add("j2_align_labels", "build_id:n occ_cls:t cluster:n", _aligned,
    "SELECT p.build_id, p.occ_cls, CASE WHEN c.build_id IS NOT NULL THEN p.build_id%7 END AS cluster FROM prepared p LEFT JOIN cluster_rows c USING (build_id)")
add("a30_cluster_analysis", "cluster:n n:n most_common_occ:t area_mean:n area_median:n area_std:n year_mean:n year_median:n year_std:n",
    lambda c: clustering.cluster_analysis(clustering.main_clusters(cleaning.cluster_table(c.staged)).staged_labels()),
    "SELECT l.cluster, COUNT(*) AS n, any_value(m.occ_cls) AS most_common_occ, AVG(gfa) AS area_mean, quantile_cont(gfa,0.5) AS area_median, COALESCE(STDDEV_SAMP(gfa),0) AS area_std, "
    "TRUNC(AVG(year_built)) AS year_mean, TRUNC(quantile_cont(year_built,0.5)) AS year_median, COALESCE(STDDEV_SAMP(year_built),0) AS year_std FROM main_fit_labels l JOIN ("
    "SELECT cluster, occ_cls FROM (SELECT cluster, occ_cls, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY COUNT(*) DESC, occ_cls) AS r FROM main_fit_labels GROUP BY 1,2) WHERE r=1) m ON l.cluster=m.cluster GROUP BY l.cluster")
add("d17_cluster_shares", "cluster:n n:n share:n", lambda c: clustering.main_clusters(cleaning.cluster_table(c.staged)).shares(),
    "SELECT cluster, COUNT(*) AS n, COUNT(*)/SUM(COUNT(*)) OVER () AS share FROM main_fit_labels GROUP BY cluster")


def _enhanced_sample(c: Inputs):
    sample = sampling.random_sample(sampling.sample_base(c.staged))
    return clustering.sample_label_columns(clustering.sample_clusters(sample), sample)


_LABEL_COLUMNS = [f"cluster_{combo}_k{k}" for combo in clustering.COMBINATIONS for k in clustering.SAMPLE_K] + [f"cluster_k{k}" for k in clustering.SAMPLE_K]
_AT = lambda combo, k: f"MAX(cluster) FILTER (WHERE grp='{combo}' AND k={k})"
_WIDE = ", ".join(
    [f"{_AT(combo, k)} AS cluster_{combo}_k{k}" for combo in clustering.COMBINATIONS for k in clustering.SAMPLE_K]
    + [f"{_AT('base', k)} AS cluster_k{k}" for k in clustering.SAMPLE_K] + [f"{_AT('base', clustering.MAIN_K)} AS cluster"])
add("p3_enhanced_sample", "build_id:n occ_cls:t gfa:n cluster:n " + " ".join(f"{x}:n" for x in _LABEL_COLUMNS), _enhanced_sample,
    f"SELECT s.build_id, s.occ_cls, s.gfa, w.* EXCLUDE (pid) FROM random_rows s LEFT JOIN (SELECT pid, {_WIDE} FROM random_fit_labels GROUP BY pid) w ON w.pid=s.build_id")
