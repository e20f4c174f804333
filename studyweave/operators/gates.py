"""Checks between the steps of the build, as rows, so that a caller can report or refuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(measured: DataFrame, name: str, value: Column, bound: float, passed) -> DataFrame:
    """One row: gate, value, bound, passed. `passed` compares the value column with the bound."""
    return measured.agg(value.cast("double").alias("value")).select(
        F.lit(name).alias("gate"),
        F.col("value"),
        F.lit(float(bound)).alias("bound"),
        passed(F.col("value"), F.lit(float(bound))).alias("passed"),
    )


def quality_gates(
    listing: DataFrame,
    missing_at_start: DataFrame,
    missing_candidates: DataFrame,
    missing_records: DataFrame,
    missing_at_end: DataFrame,
    records: DataFrame,
    pairs: DataFrame,
    completeness: DataFrame,
    model_rows: DataFrame,
    n_predictors: int,
) -> DataFrame:
    """One row per check. `records` are those downloaded, before duplicates are resolved; `pairs` are the
    distinct (study, patient) of the final ones. The `missing_` frames list required cohorts that are absent
    from the listing, after the size bound, among the records, and after deduplication."""
    rows = F.count("*")
    copies = rows - F.count_distinct("patient_id")
    full = F.avg((F.col("completeness_pct") >= 99.999).cast("int"))
    return reduce(
        DataFrame.unionByName,
        [
            gate(listing, "listed studies", rows, 400, lambda v, b: v > b),
            gate(missing_at_start, "required cohorts missing from the listing", rows, 0, lambda v, b: v == b),
            gate(missing_candidates, "required cohorts missing after the size bound", rows, 0, lambda v, b: v == b),
            gate(records, "records", rows, 0, lambda v, b: v > b),
            gate(missing_records, "required cohorts missing among the records", rows, 0, lambda v, b: v == b),
            gate(missing_at_end, "required cohorts missing after deduplication", rows, 0, lambda v, b: v == b),
            gate(pairs, "further studies of a patient", copies, 0, lambda v, b: v == b),
            gate(completeness, "share of full cells", full, 0.9, lambda v, b: v < b),
            gate(model_rows, "predictors", F.lit(n_predictors) + 0 * rows, 2, lambda v, b: v >= b),
            gate(model_rows, "model rows", rows, 200, lambda v, b: v >= b),
        ],
    )


def require(gates: DataFrame) -> None:
    """Raise if any gate is closed. There is one row per gate."""
    closed = [row for row in gates.collect() if not row["passed"]]
    if closed:
        raise ValueError("; ".join(f"{r['gate']}: {r['value']} against {r['bound']}" for r in closed))
