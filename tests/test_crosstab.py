from parapet.operators import crosstab


def test_matrix_fills_pairs_that_never_occur(spark):
    rows = [("M", "Slab", 2.0), ("M", "Slab", None), ("W", "Crawl", 3.0), (None, "Slab", 9.0), ("S", None, 9.0)]
    df = spark.createDataFrame(rows, "material string, foundation string, gfa double")
    got = {(r.material, r.foundation): (r.n, r.area) for r in crosstab.matrix(df, "material", "foundation").collect()}
    assert got == {("M", "Slab"): (2, 2.0), ("M", "Crawl"): (0, 0.0), ("W", "Slab"): (0, 0.0), ("W", "Crawl"): (1, 3.0)}
    assert crosstab.matrix(df.limit(0), "material", "foundation").count() == 0
