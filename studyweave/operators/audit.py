"""Which predictors and which studies to use: one decision, tabulated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import lookup_join


def availability(frame: DataFrame, candidates: list[str]) -> DataFrame:
    """Share of a study's patients that have each candidate, and their number."""
    shares = [F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in candidates]
    return frame.groupBy("study_id").agg(*shares, F.count("*").alias("n"))


def variable_rank(avail: DataFrame, candidates: list[str]) -> DataFrame:
    """Candidates by patient-weighted coverage; equal ones in the order they are listed.

    There is one row per candidate column, so one ordered window is enough.
    """
    coverage = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in candidates]
    position = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("variable"))
    order = W.orderBy(F.round("patient_coverage", 9).desc(), position)
    return (
        avail.agg(*coverage)
        .unpivot([], candidates, "variable", "patient_coverage")
        .withColumn("k", F.row_number().over(order).cast("bigint"))
    )


def tradeoff(avail: DataFrame, ranked: DataFrame, candidates: list[str], bound: float = 0.5) -> DataFrame:
    """For the first k variables: studies that record all of them, their patients, and k x patients."""
    first_k = W.partitionBy("study_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    names = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    per_study = (
        avail.unpivot(["study_id", "n"], candidates, "variable", "share")
        .join(F.broadcast(ranked.select("variable", "k")), "variable")
        .withColumn("kept", F.min("share").over(first_k) >= bound)
    )
    retained = per_study.groupBy("k").agg(
        F.count_if("kept").alias("n_studies"),
        F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("n_patients"),
    )
    labels = ranked.select("k", F.array_join(F.collect_list("variable").over(names), ", ").alias("variables"))
    return retained.join(F.broadcast(labels), "k").select(
        F.col("k").alias("n_vars"),
        "variables",
        "n_studies",
        "n_patients",
        (F.col("k") * F.col("n_patients")).alias("information"),
    )


def best_tradeoff(table: DataFrame) -> DataFrame:
    """The row with the most information, the fewest variables among equals."""
    return table.orderBy(F.desc("information"), F.asc("n_vars")).limit(1)


def studies_meeting_all(avail: DataFrame, predictors: list[str], bound: float = 0.5) -> DataFrame:
    """Studies in which every predictor reaches the bound."""
    meets = reduce(lambda a, b: a & b, [F.col(p) >= bound for p in predictors])
    return avail.filter(meets).select("study_id", "n")


def of_kept_studies(frame: DataFrame, kept: DataFrame) -> DataFrame:
    return lookup_join(frame, kept.select("study_id"), ["study_id"], "left_semi")
