"""The tables behind the charts. Drawing is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import lookup_join
from .ordered import exact_quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_stats(frame: DataFrame, by: list[str], value: str, keep) -> DataFrame:
    """Quartiles, and whiskers to the last value within 1.5 interquartile ranges.

    `keep` writes the value counts once; both the quartiles and the whiskers are read from them.
    """
    held = {}

    def keep_counts(counts):
        held["counts"] = keep(counts)
        return held["counts"]

    quartiles = exact_quantiles(frame, by, value, QUARTILES, keep_counts)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        lookup_join(held["counts"], quartiles, by)
        .groupBy(*by)
        .agg(
            F.sum("_n").alias("n"),
            *[F.first(q).alias(q) for q in QUARTILES],
            F.min(F.when(inside, F.col("_value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_value"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"),
        )
    )


def histogram(frame: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """Counts in bins of equal width; `bin` is the lower edge."""
    edge = (F.floor(F.col(value) / width) * width).cast("double")
    return frame.filter(F.col(value).isNotNull()).groupBy(*by, edge.alias("bin")).agg(F.count("*").alias("n"))


def log_histogram(frame: DataFrame, by: list[str], value: str, bins_per_decade: int = 10) -> DataFrame:
    """Counts in bins of equal width on a log10 scale, of positive values."""
    place = F.floor(F.log10(value) * bins_per_decade)
    return (
        frame.filter(F.col(value) > 0)
        .groupBy(*by, (place / bins_per_decade).cast("double").alias("log10_bin"))
        .agg(F.count("*").alias("n"))
    )


def density(frame: DataFrame, by: list[str], value: str, keep, n_points: int = 64) -> DataFrame:
    """A Gaussian kernel density per group: n, width of the kernel, and the density at `n_points` places from the
    least to the greatest value, as a violin is drawn.

    The width is 0.9 times the smaller of standard deviation and interquartile range / 1.34, over the fifth root of the
    number of values; where that is zero the standard deviation, then the size of the least value, then 1. Each value
    is shared by the two places beside it, so that the kernel is laid over at most `n_points` sums of a group and never
    over its rows. Groups with fewer than two values have no density; one value many times has a single place. `keep`
    writes the value counts, which are read repeatedly.
    """
    held = {}

    def keep_counts(counts):
        held["counts"] = keep(counts)
        return held["counts"]

    quartiles = exact_quantiles(frame, by, value, {"q1": 0.25, "q3": 0.75}, keep_counts)
    present = frame.filter(F.col(value).isNotNull())
    spread = present.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.stddev(value).alias("_sd"),
        F.min(value).cast("double").alias("_least"),
        F.max(value).cast("double").alias("_most"),
    )
    sd, range_ = F.col("_sd"), (F.col("q3") - F.col("q1")) / 1.34
    low = F.least(sd, range_)
    low = F.when(low > 0, low).when(sd > 0, sd).when(F.col("_least") != 0, F.abs("_least")).otherwise(1.0)
    step = (F.col("_most") - F.col("_least")) / (n_points - 1)
    groups = lookup_join(spread.filter("n >= 2"), quartiles, by).select(
        *by, "n", "_least", step.alias("_step"), (0.9 * low * F.pow("n", F.lit(-0.2))).alias("width")
    )
    place = F.when(F.col("_step") > 0, (F.col("_value") - F.col("_least")) / F.col("_step")).otherwise(0.0)
    placed = lookup_join(held["counts"], groups.select(*by, "_least", "_step"), by).withColumn("_place", place)
    below = F.least(F.floor("_place"), F.lit(n_points - 1)).cast("int")
    part = F.col("_place") - below
    shares = F.array(
        F.struct(below.alias("bin"), (F.col("_n") * (1 - part)).alias("weight")),
        F.struct((below + 1).alias("bin"), (F.col("_n") * part).alias("weight")),
    )
    sums = placed.select(*by, F.inline(shares)).filter("weight > 0").groupBy(*by, "bin").agg(F.sum("weight").alias("weight"))
    # at most n_points sums of a group meet
    bins = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "weight"))).alias("_bins"))
    last = F.when(F.col("_step") > 0, n_points - 1).otherwise(0)
    points = lookup_join(groups, bins, by).withColumn("bin", F.explode(F.sequence(F.lit(0), last)))

    def kernel(total, one):
        away = (F.col("bin") - one["bin"]) * F.col("_step") / F.col("width")
        return total + one["weight"] * F.exp(-0.5 * away * away)

    height = F.aggregate("_bins", F.lit(0.0), kernel) / (F.col("n") * F.col("width") * math.sqrt(2 * math.pi))
    x = F.col("_least") + F.col("bin") * F.col("_step")
    return points.select(*by, "n", "width", "bin", x.alias("x"), height.alias("density"))


def event_share_by(frame: DataFrame, category: str) -> DataFrame:
    """Share of each event within a category; the window runs over the counts, not the rows."""
    counts = frame.filter(F.col(category).isNotNull()).groupBy(category, "os_event").agg(F.count("*").alias("n"))
    return counts.withColumn("prop", F.col("n") / F.sum("n").over(W.partitionBy(category)))


def cohort_shift(frame: DataFrame, keep) -> DataFrame:
    """Median sample measure, median follow-up and event rate per study: is the pool one cohort?"""
    rates = frame.groupBy("study_id").agg(
        F.count("*").alias("n"),
        F.avg((F.col("os_event") == "1").cast("int")).alias("event_rate"),
    )
    for column, name in (("mutation_count", "median_mutations"), ("os_months", "median_months")):
        medians = exact_quantiles(frame, ["study_id"], column, {name: 0.5}, keep)
        rates = rates.join(medians, "study_id", "left")
    return rates
