"""Model frame, and a split that is the same on every run and every cluster size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import ROWS_PER_TASK
from .ordered import digest_rank

KEY, LABEL = "patient_key", "os_event"


def model_frame(frame: DataFrame, predictors: list[str]) -> DataFrame:
    """Key, label and predictors: text NULL becomes a level of its own, then constants are dropped."""
    filled = frame.select(
        KEY,
        LABEL,
        *[
            F.coalesce(F.col(p), F.lit("Unknown")).alias(p)
            if isinstance(frame.schema[p].dataType, T.StringType)
            else F.col(p)
            for p in predictors
        ],
    )
    return drop_constant_columns(filled, keep=[KEY, LABEL])


def drop_constant_columns(frame: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Drop columns without two distinct values: minimum and maximum tell, in one pass."""
    names = [c for c in frame.columns if c not in keep]
    if not names:
        return frame
    varied = frame.agg(*[(F.min(c) < F.max(c)).alias(c) for c in names]).first().asDict()
    return frame.select(*[c for c in frame.columns if c in keep or varied[c]])


def shuffle_digest(key: Column, seed) -> Column:
    """Pseudo-random order of a unique key: the same in any engine that has md5."""
    return F.md5(F.concat(key, F.lit(f"|{seed}")))


def stratified_split(
    frame: DataFrame,
    train_share: float = 0.8,
    n_folds: int = 5,
    seed: int = 42,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add `split` (train, test) and `fold` (NULL for test), both balanced within each label.

    `frame` is read twice; pass a written table.
    """
    digests = frame.withColumn("_digest", shuffle_digest(F.col(KEY), seed))
    ranked = digest_rank(digests, [LABEL], "_digest", "_place", rows_per_task=rows_per_task)
    sizes = frame.groupBy(LABEL).agg(F.floor(F.count("*") * F.lit(train_share)).alias("_n_train"))
    in_train = F.col("_place") <= F.col("_n_train")
    return ranked.join(F.broadcast(sizes), LABEL).select(
        *frame.columns,
        F.when(in_train, "train").otherwise("test").alias("split"),
        F.when(in_train, (F.col("_place") - 1) % n_folds).cast("int").alias("fold"),
    )
