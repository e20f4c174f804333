"""Scores of a binary classifier, exact and without passing the rows through one task.

Rows are counted per score first; the running sums then work on distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import ROWS_PER_TASK
from .ordered import running_totals

SCORE = "score"


def score_counts(frame: DataFrame, score: Column, positive: Column, by: list[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, ordered by falling score (`drop`)."""
    return (
        frame.select(*by, score.cast("double").alias(SCORE), positive.cast("int").alias("y"))
        .filter(F.col(SCORE).isNotNull() & F.col("y").isNotNull())
        .groupBy(*by, SCORE)
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
        .withColumn("drop", -F.col(SCORE))
    )


def roc_points(counts: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """threshold, sensitivity, specificity for 'positive where score >= threshold'. Written counts.

    The curve starts where no row is positive: sensitivity 0, specificity 1, no threshold (NULL).
    """
    totals = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    placed = running_totals(counts, [], "drop", ["pos", "neg"], rows_per_task=rows_per_task)
    start = counts.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("sensitivity"), F.lit(1.0).alias("specificity")
    )
    return start.unionByName(
        placed.select(
            F.col(SCORE).alias("threshold"),
            (F.col("cum_pos") / F.lit(totals["pos"])).alias("sensitivity"),
            (1 - F.col("cum_neg") / F.lit(totals["neg"])).alias("specificity"),
        )
    )


def roc_auc(counts: DataFrame, by: list[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Area under the ROC curve: the share of (event, other) pairs that the score puts in the right
    order, equal scores counting half. Written counts."""
    by = list(by)
    placed = running_totals(counts, by, "drop", ["pos"], rows_per_task=rows_per_task)
    right = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return placed.groupBy(*by).agg((right / pairs).alias("auc"))


def accuracy(frame: DataFrame, label: str, predicted: Column) -> DataFrame:
    return frame.agg(F.avg((F.col(label) == predicted).cast("int")).alias("accuracy"))


def confusion(frame: DataFrame, label: str, predicted: Column, classes=("0", "1")) -> DataFrame:
    """One row per true class, one column per predicted class."""
    cells = [F.count_if(predicted == c).alias(f"predicted_{c}") for c in classes]
    return frame.groupBy(F.col(label).alias("truth")).agg(*cells)


def majority_share(frame: DataFrame, label: str) -> DataFrame:
    """Accuracy of always naming the most frequent class."""
    counts = frame.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority_share"))
