"""A training corpus in five stages: language ID, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
before the next one. All but the last return the columns of ``documents``, with ``n_chars`` kept
true to the text.

Defined results: documents without letters are rejected by language ID, also null texts; a
document that loses all its lines goes; of a group of near copies the smallest id stays, with
all rows of that id; an empty table gives empty stages; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm import language, line_dedup, mixing, near_dup, packing
from parapet.llm.queries import vocabulary
from parapet.staging import stage

#: All rows count once here: a second epoch would bring back copies that were just removed.
MIX_TOTAL, MIX_EPOCHS = 0.9, 1
#: Words of a shingle in the near-copy stage.
COPY_WORDS = 5
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = language.identify(docs, language.learn(docs))
    return docs.select("*", told.alias("__told")).where(F.col("__told.lang_pred") != language.UNKNOWN).drop("__told")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.col("text") != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_dup.near_duplicates(docs, words=COPY_WORDS).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    levels = {"__domain": mixing.domain_of(F.col("source")), "__lang": F.col("lang"), "__source": F.col("source")}
    mixed = mixing.mix(docs, levels, mixing.WEIGHTS, MIX_TOTAL, max_epochs=MIX_EPOCHS, cut=True)
    # The document in which a source's budget ends gives its first words; all others are whole.
    part = F.col("n_copies") == 0
    text = F.when(part, mixing.first_words(F.col("text"), F.col("n_part").cast("int"))).otherwise(F.col("text"))
    return mixed.select(*[(text if c == "text" else F.when(part, F.length(text).cast("long")).otherwise(F.col(c)) if c == "n_chars" else F.col(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(), ids=False)


STAGES = [
    ("language", identify_language), ("lines", drop_lines), ("near_copies", drop_copies), ("mixing", mix_sources), ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
