import pytest
from odd import CLASHES
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text, lang, source) rows, with extra columns of clashing names if asked for."""
    def make(rows, clashes=False):
        rows = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCUMENT)
        for name in CLASHES if clashes else ():
            df = df.withColumn(name, F.lit("x"))
        return df
    return make
