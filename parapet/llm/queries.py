"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm import html_text, language, line_dedup, manifest, mixing, near_dup, nearest, negatives, packing, quality, substrings, token_cache, url_filters
from parapet.llm.common import table
from parapet.staging import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return put


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A file of the public tokenizers; the path is a parameter of the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary(), ids=False)


@query("op3_line_dedup", line_dedup.SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op4_quality_rules", quality.SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.measure(table(spark, folder, "documents"))
    return out.withColumn("cleaned_md5", F.md5(F.col("cleaned").cast("binary"))).drop("cleaned")


@query("op6_mixing", mixing.SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    levels = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(docs, levels, mixing.WEIGHTS, mixing.TOTAL, max_epochs=mixing.EPOCHS, cut=True)
    return out.select("doc_id", "domain", F.coalesce("lang", F.lit("null")).alias("lang"), F.coalesce("source", F.lit("null")).alias("source"), "n_tokens", "n_copies", "n_part")


@query("op8_nearest")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_language")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    told = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), language.identify(docs, language.learn(docs)).alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score")


@query("op10_url_filters", url_filters.SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge(table(spark, folder, "pages"), url_filters.rule_table(spark))


@query("op2_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), words=2)


@query("op5_substrings")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, folder, "documents"))


@query("op7_html_text")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    text = html_text.extract(pages, html_text.learn(pages))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query("op13_manifest", manifest.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify(table(spark, folder, "documents"))


@query("op11_token_counts")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    # A cache of its own for every call, so that what a call does never depends on earlier ones.
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_cache.count_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), cache)


@query("op12_hard_negatives", negatives.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=negatives.moved_label())
