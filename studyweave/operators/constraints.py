"""Keys and checks of the eight tables. Spark tables do not enforce them, so each is a query
that counts violations; a clean store has none."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Table:
    name: str
    primary_key: tuple[str, ...]
    required: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[tuple[str, str], ...] = ()


OF_STUDY = ForeignKey("study_id", "studies", "study_id")
OF_ATTRIBUTE = ForeignKey("attr_id", "clinical_attributes", "attr_id")
OF_PATIENT = ForeignKey("patient_key", "patients", "patient_key")
OF_SAMPLE = ForeignKey("sample_key", "samples", "sample_key")

# Parents come before their children.
TABLES = (
    Table(
        "studies",
        ("study_id",),
        ("study_id", "study_name", "cancer_type", "n_patients"),
        checks=(("n_patients", "n_patients >= 0"),),
    ),
    Table(
        "clinical_attributes",
        ("attr_id",),
        ("attr_id", "data_level", "datatype"),
        checks=(
            ("data_level", "data_level IN ('PATIENT', 'SAMPLE')"),
            ("datatype", "datatype IN ('NUMBER', 'STRING')"),
        ),
    ),
    Table(
        "study_attributes",
        ("study_id", "attr_id"),
        ("study_id", "attr_id", "harmonized_id"),
        (OF_STUDY, OF_ATTRIBUTE),
    ),
    Table(
        "patients",
        ("patient_key",),
        ("patient_key", "patient_id", "study_id"),
        (OF_STUDY,),
        unique=(("study_id", "patient_id"),),
    ),
    Table("samples", ("sample_key",), ("sample_key", "sample_id", "patient_key"), (OF_PATIENT,)),
    Table("patient_clinical", ("patient_key", "attr_id"), ("patient_key", "attr_id"), (OF_PATIENT, OF_ATTRIBUTE)),
    Table("sample_clinical", ("sample_key", "attr_id"), ("sample_key", "attr_id"), (OF_SAMPLE, OF_ATTRIBUTE)),
    Table("outcomes", ("patient_key",), ("patient_key",), (OF_PATIENT,)),
)


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _violations(table: str, rule: str, counted: DataFrame) -> DataFrame:
    return counted.select(
        F.lit(table).alias("tbl"),
        F.lit(rule).alias("rule"),
        F.coalesce(F.col("n").cast("bigint"), F.lit(0).cast("bigint")).alias("n_violations"),
    )


def _repeats(frame: DataFrame, key: tuple[str, ...], nulls: bool) -> DataFrame:
    """Rows beyond the first of each key; of keys with a NULL all rows if `nulls`, else none. Counts
    combine before the shuffle."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    bad = F.when(whole, F.col("n") - 1).otherwise(F.col("n") if nulls else F.lit(0))
    return frame.groupBy(*key).agg(F.count("*").alias("n")).agg(F.sum(bad).alias("n"))


def primary_key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Repeated keys, and keys with a NULL part, which not_null_violations reports as well."""
    return _stack(
        [_violations(t.name, ", ".join(t.primary_key), _repeats(tables[t.name], t.primary_key, True)) for t in TABLES]
    )


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack(
        [_violations(t.name, ", ".join(u), _repeats(tables[t.name], u, False)) for t in TABLES for u in t.unique]
    )


def _counted(table: Table, frame: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """One pass over a table for all its row rules: (name, condition that a bad row meets)."""
    names = [name for name, _ in rules]
    totals = frame.agg(*[F.count_if(F.expr(bad)).alias(name) for name, bad in rules])
    return totals.unpivot([], names, "rule", "n_violations").select(
        F.lit(table.name).alias("tbl"), "rule", "n_violations"
    )


def not_null_violations(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack(
        [_counted(t, tables[t.name], [(c, f"{c} IS NULL") for c in t.required]) for t in TABLES]
    )


def check_violations(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack(
        [_counted(t, tables[t.name], [(c, f"NOT ({ok})") for c, ok in t.checks]) for t in TABLES if t.checks]
    )


def foreign_key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Child rows without a parent, per declared edge. Children are counted per key first."""
    reports = []
    for table in TABLES:
        for fk in table.foreign_keys:
            children = (
                tables[table.name]
                .filter(F.col(fk.column).isNotNull())
                .groupBy(F.col(fk.column).alias("_key"))
                .agg(F.count("*").alias("n"))
            )
            parents = tables[fk.parent].select(F.col(fk.parent_column).alias("_key"))
            orphans = children.join(parents, "_key", "left_anti").agg(F.sum("n").alias("n"))
            reports.append(_violations(table.name, f"{fk.column} -> {fk.parent}({fk.parent_column})", orphans))
    return _stack(reports)


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    checks = {
        "primary key": primary_key_violations,
        "unique": unique_violations,
        "foreign key": foreign_key_violations,
    }
    keyed = [check(tables).withColumn("kind", F.lit(kind)) for kind, check in checks.items()]
    return _stack([*keyed, *[_row_violations(t, tables[t.name]) for t in TABLES]])


def _row_violations(table: Table, frame: DataFrame) -> DataFrame:
    """Both kinds of row rules of a table in one pass."""
    rules = [(f"not null:{c}", f"{c} IS NULL") for c in table.required]
    rules += [(f"check:{c}", f"NOT ({ok})") for c, ok in table.checks]
    kind, rule = (F.substring_index("rule", ":", n) for n in (1, -1))
    return _counted(table, frame, rules).select("tbl", rule.alias("rule"), "n_violations", kind.alias("kind"))


def reconcile(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Drop child rows whose parent is gone, down all edges: also what a cascading delete leaves."""
    kept: dict[str, DataFrame] = {}
    for table in TABLES:
        frame = tables[table.name]
        for fk in table.foreign_keys:
            parents = kept[fk.parent].select(F.col(fk.parent_column).alias(fk.column))
            frame = lookup_join(frame, parents, [fk.column], "left_semi", at_most=tables[fk.parent])
        kept[table.name] = frame.select(*tables[table.name].columns)
    return kept


def cascade_delete(tables: dict[str, DataFrame], table: str, condition) -> dict[str, DataFrame]:
    """Delete rows of one table and everything that hangs on them."""
    left = tables[table].filter(~F.coalesce(condition, F.lit(False)))
    return reconcile({**tables, table: left})


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack(
        [
            tables[t.name].agg(F.count("*").alias("n_rows")).select(F.lit(t.name).alias("tbl"), "n_rows")
            for t in TABLES
        ]
    )
