"""Ranks, running totals and exact quantiles without putting a whole group into one task.

The rows are cut into ordered buckets. Per bucket only a total is needed to know where the bucket
starts, so the windows below run within a bucket, and one more runs over the bucket totals.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import ROWS_PER_TASK, lookup_join


def _value_buckets(frame: DataFrame, order: str, n_buckets: int) -> DataFrame:
    """Add `_bucket`: position of `order` among n_buckets quantile bounds."""
    if n_buckets == 1:
        return frame.withColumn("_bucket", F.lit(0))
    shares = [i / n_buckets for i in range(1, n_buckets)]
    cuts = sorted(set(frame.approxQuantile(order, shares, 0.1 / n_buckets)))
    splits = [-math.inf, *(c for c in cuts if math.isfinite(c)), math.inf]
    if len(splits) < 3:
        return frame.withColumn("_bucket", F.lit(0))
    bucketizer = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket")
    return bucketizer.transform(frame).withColumn("_bucket", F.col("_bucket").cast("int"))


def _key_buckets(frame: DataFrame, order: str, n_buckets: int) -> DataFrame:
    """Add `_bucket` for a hexadecimal digest: its leading digits, uniform by construction."""
    digits = 0 if n_buckets == 1 else math.ceil(math.log(n_buckets, 16))
    bucket = F.conv(F.substring(order, 1, digits), 16, 10).cast("int") if digits else F.lit(0)
    return frame.withColumn("_bucket", bucket)


def _with_offsets(bucketed: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add `_before_<name>`: sum of each of `sums` over the group's earlier buckets."""
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*by, "_bucket")
        .agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
        .select(
            *by,
            "_bucket",
            *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums],
        )
    )
    return bucketed.join(offsets, [*by, "_bucket"])


def running_totals(
    frame: DataFrame,
    by: list[str],
    order: str,
    sums: list[str],
    n_rows: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add `cum_<c>` for each column c of `sums`: its total over rows of the group up to this one.

    `order` is numeric, non-null and distinct within a group, so aggregate by it first. The frame
    is read several times: pass a written table. NaN is not accepted.
    """
    n_buckets = _bucket_count(frame, n_rows, rows_per_task)
    bucketed = _value_buckets(frame, order, n_buckets)
    inside = W.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    if n_buckets == 1:
        totals = [F.sum(c).over(inside).alias(f"cum_{c}") for c in sums]
        return bucketed.select(*frame.columns, *totals)
    placed = _with_offsets(bucketed, by, {c: F.col(c) for c in sums})
    totals = [(F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums]
    return placed.select(*frame.columns, *totals)


def digest_rank(
    frame: DataFrame,
    by: list[str],
    digest: str,
    alias: str,
    n_rows: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add `alias`: position of the row within its group in the order of a hexadecimal digest.

    Digests of a unique key are uniform, so their leading digits cut every group evenly.
    """
    n_buckets = _bucket_count(frame, n_rows, rows_per_task)
    bucketed = _key_buckets(frame, digest, n_buckets)
    position = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(digest)).cast("bigint")
    if n_buckets == 1:
        return bucketed.withColumn(alias, position).drop("_bucket")
    placed = _with_offsets(bucketed, by, {"n": F.lit(1)})
    return placed.withColumn(alias, F.col("_before_n") + position).select(*frame.columns, alias)


def exact_quantiles(
    frame: DataFrame,
    by: list[str],
    value: str,
    shares: dict[str, float],
    keep=lambda counts: counts,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Interpolated quantiles of `value` per group, one column per entry of `shares`.

    Values are counted first; a quantile is read off at the positions its share falls between.
    `keep` may write the counts to a table, as they are read more than once.
    """
    counts = keep(
        frame.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_value"))
        .agg(F.count("*").alias("_n"))
    )
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = running_totals(counts, by, "_value", ["_n"], rows_per_task=rows_per_task)
    placed = _attach_totals(placed, totals, by)
    first, last = F.col("cum__n") - F.col("_n"), F.col("cum__n") - 1
    picks = []
    for name, share in shares.items():
        place = (F.col("_total") - 1) * F.lit(float(share))
        for suffix, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when(at.between(first, last), F.col("_value"))).alias(f"_{name}_{suffix}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    read = placed.groupBy(*by).agg(*picks)
    return read.select(
        *by,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n)
            for n in shares
        ],
    )


def _attach_totals(placed: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return placed.withColumn("_total", F.lit(totals.first()["_total"]))
    return lookup_join(placed, totals, by)


def _bucket_count(frame: DataFrame, n_rows: int | None, rows_per_task: int) -> int:
    n = frame.count() if n_rows is None else n_rows
    return max(1, math.ceil(n / rows_per_task))
