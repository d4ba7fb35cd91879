"""Repairing the occupancy class from votes, and the mix label that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.functions import votes as V
from parapet.functions.numbers import counted
from parapet.functions.text import UNCLASSIFIED, has_text, is_unclassified

#: Of a row without its vote text: whether it had one.
HAS_VOTES = "_has_votes"


def vote_outcome(df: DataFrame) -> DataFrame:
    """Add ``outcome`` (changed, tie, none), ``vote_class``, ``tie`` and ``mix_rule`` for unclassified rows.

    All are null on rows that already have a class; their vote text is not parsed. Only where an
    earlier run left ``occ_cls_orig``, ``mix_rule`` is also told for the rows that were repaired then.
    """
    is_open = is_unclassified(F.col("occ_cls"))
    judged = df.withColumn("_vote", F.when(is_open & has_text(F.col("occ_dict")), V.decide("occ_dict")))
    rule = F.col("_vote.rule")
    if "occ_cls_orig" in df.columns:
        earlier = (F.col("occ_cls_orig") == UNCLASSIFIED) & ~is_open & has_text(F.col("occ_dict"))
        rule = F.coalesce(rule, F.when(earlier, V.implied_mix_rule("occ_dict", "occ_cls")))
    return judged.withColumns({
        "outcome": F.when(is_open, F.coalesce(F.col("_vote.outcome"), F.lit("none"))),
        "vote_class": F.col("_vote.name"),
        "tie": F.col("_vote.tie"),
        "mix_rule": rule,
    }).drop("_vote")


def resolve_classes(df: DataFrame) -> DataFrame:
    """Replace the class of every row with a clear vote winner; the old label stays in ``occ_cls_orig``."""
    judged = vote_outcome(df)
    if "occ_cls_orig" not in df.columns:
        judged = judged.withColumn("occ_cls_orig", F.col("occ_cls"))
    return judged.withColumn("occ_cls", F.coalesce(F.col("vote_class"), F.col("occ_cls")))


def needs_mix(df: DataFrame) -> DataFrame:
    """Rows whose original label is exactly ``Unclassified`` and whose class is another one now."""
    return df.where((F.col("occ_cls_orig") == UNCLASSIFIED) & (F.col("occ_cls") != UNCLASSIFIED))


def recalculate_mix(resolved: DataFrame) -> DataFrame:
    """Renew ``mix_sc`` of the rows that :func:`needs_mix` selects, from the rule found with the votes.

    Those are the rows with that original label and a vote winner, now or in an earlier run, so
    the vote text need not be read again.
    """
    renewed = (F.col("occ_cls_orig") == UNCLASSIFIED) & F.col("mix_rule").isNotNull()
    return resolved.withColumn(
        "mix_sc", F.when(renewed, V.apply_mix(F.col("mix_rule"), F.col("mix_sc"))).otherwise(F.col("mix_sc"))
    )


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """One row: how many rows were open, had votes, changed or not, and had their mix renewed."""
    judged = F.col("outcome").isNotNull()
    votes = F.col(HAS_VOTES) if HAS_VOTES in resolved.columns else has_text(F.col("occ_dict"))
    return resolved.agg(
        counted(resolved, judged).alias("total_unclassified_before"),
        counted(resolved, judged & votes).alias("with_occdict"),
        counted(resolved, F.col("outcome") == "changed").alias("changed"),
        counted(resolved, judged & (F.col("outcome") != "changed")).alias("unchanged"),
        counted(resolved, (F.col("occ_cls_orig") == UNCLASSIFIED) & (F.col("occ_cls") != UNCLASSIFIED)).alias("mix_sc_recalculated"),
    )


def changed_to(resolved: DataFrame) -> DataFrame:
    """Rows per class that the votes decided."""
    changed = resolved.where(F.col("outcome") == "changed")
    return changed.groupBy(F.col("vote_class").alias("occ_cls")).agg(counted(resolved).alias("n"))


def tie_histogram(resolved: DataFrame) -> DataFrame:
    """How often each tie occurred, most frequent first."""
    ties = resolved.where(F.col("tie").isNotNull()).groupBy("tie").agg(counted(resolved).alias("n"))
    return ties.orderBy(F.desc("n"), "tie")


def reclass_map(resolved: DataFrame) -> DataFrame:
    """``build_id`` and new class code of every changed row: a data set, one row per building."""
    return resolved.where(F.col("outcome") == "changed").select(
        "build_id", V.class_to_code(F.col("vote_class")).alias("code")
    )
