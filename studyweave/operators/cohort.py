"""Which studies, which records, and which study's copy of each patient."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as voc
from ..functions.clinical import cohort_of
from ..functions.text import is_recorded, trim_all
from .joins import LOOKUP_ROWS, ROWS_PER_TASK, fits_lookup, hashable, lookup_join, split_join

RECORD_COLUMNS = ("study_id", "patient_id", "sample_id", "attr_id", "value", "data_level")


def filter_studies(listing: DataFrame, tags=voc.STUDY_TAGS, word=voc.STUDY_WORD) -> DataFrame:
    """Studies tagged with the disease or naming it; a missing text counts as no match."""
    tag = F.lower(F.coalesce("cancerTypeId", F.lit("")))
    name = F.lower(F.coalesce("name", F.lit("")))
    return listing.filter(tag.isin(*tags) | name.contains(word))


def keep_one_row(frame: DataFrame, by: list[str]) -> DataFrame:
    """One whole row per key: the smallest, so that the choice does not hang on row order."""
    rest = [c for c in frame.columns if c not in by]
    row = F.min(F.struct(*rest)).alias("_row")
    return frame.groupBy(*by).agg(row).select(*by, "_row.*")


def fill_schema(frame: DataFrame, columns: dict[str, Column], renames: dict[str, str] | None = None) -> DataFrame:
    """Accept alternate column names and add absent columns with the given expression."""
    for old, new in (renames or {}).items():
        if new not in frame.columns and old in frame.columns:
            frame = frame.withColumnRenamed(old, new)
    for name, default in columns.items():
        if name not in frame.columns:
            frame = frame.withColumn(name, default)
    return frame


def clean_records(raw: DataFrame) -> DataFrame:
    """Trim values, upper-case levels and drop placeholders."""
    trimmed = raw.select(
        "study_id",
        "patient_id",
        "sample_id",
        "attr_id",
        trim_all(F.col("value")).alias("value"),
        F.upper("data_level").alias("data_level"),
    )
    return trimmed.filter(is_recorded(F.col("value")))


def patient_counts(roster: DataFrame) -> DataFrame:
    return roster.groupBy("study_id").agg(F.count("*").alias("n_patients"))


def study_table(studies: DataFrame, counts: DataFrame, min_patients: int) -> DataFrame:
    """study_id, study_name, n_patients of the studies with enough patients."""
    large = counts.filter(F.col("n_patients") >= min_patients)
    return studies.select("study_id", "study_name").join(large, "study_id")


def of_studies(frame: DataFrame, studies: DataFrame) -> DataFrame:
    return lookup_join(frame, studies.select("study_id"), ["study_id"], "left_semi")


def duplicate_audit(pairs: DataFrame) -> DataFrame:
    """Patients recorded under more than one study. `pairs` has one row per study and patient."""
    return pairs.groupBy("patient_id").agg(F.count("*").alias("n_studies")).filter("n_studies > 1")


def most_copies(audit: DataFrame) -> DataFrame:
    """In how many studies the most repeated patient is; 0 when none is in two."""
    return audit.agg(F.coalesce(F.max("n_studies"), F.lit(0)).alias("max_copies"), F.count("*").alias("n_patients"))


def study_richness(records: DataFrame) -> DataFrame:
    """How many patient-level attributes a study records at all."""
    return (
        records.filter("data_level = 'PATIENT'")
        .groupBy("study_id")
        .agg(F.count_distinct("attr_id").alias("n_attrs"))
    )


def study_rank(richness: DataFrame) -> DataFrame:
    """Studies in order of richness; one row per study, so one ordered window is enough."""
    order = W.orderBy(F.desc("n_attrs"), F.asc("study_id"))
    return richness.select(
        "study_id",
        "n_attrs",
        cohort_of(F.col("study_id")).alias("cohort"),
        F.row_number().over(order).cast("bigint").alias("rank"),
    )


def patient_weights(records: DataFrame) -> DataFrame:
    """Facts per study and patient: the distinct pairs, and the weight of each as a join key."""
    return records.groupBy("study_id", "patient_id").agg(F.count("*").alias("n_facts"))


#: A patient's facts in a study, and the rank of the study above them, share one whole number.
FACTS_BITS = 40


def primary_record(pairs: DataFrame, richness: DataFrame, identity: list[str] | None = None) -> DataFrame:
    """study_id, identity and n_facts of the pair kept per patient: the richest study, by name among
    equals, unranked studies last.

    The place of the study and the facts make one number, so the choice is a minimum of numbers: it
    needs no sort, and combines before the shuffle. There is one row per study to rank.
    """
    identity = identity or ["patient_id"]
    studies = pairs.select("study_id").distinct().join(richness, "study_id", "left")
    order = W.orderBy(F.col("n_attrs").isNull(), F.desc("n_attrs"), "study_id")
    places = studies.select("study_id", F.row_number().over(order).cast("bigint").alias("_place"))
    placed = lookup_join(pairs, places, ["study_id"])
    facts = F.coalesce("n_facts", F.lit(0)) if "n_facts" in pairs.columns else F.lit(0)
    code = F.shiftleft("_place", FACTS_BITS) + facts.cast("bigint")
    best = placed.groupBy(*identity).agg(F.min(code).alias("_best"))
    split = best.select(
        *identity,
        F.shiftright("_best", FACTS_BITS).alias("_place"),
        F.col("_best").bitwiseAND((1 << FACTS_BITS) - 1).alias("n_facts"),
    )
    kept = lookup_join(split, places, ["_place"]).select("study_id", *identity, "n_facts")
    return kept if "n_facts" in pairs.columns else kept.drop("n_facts")


def records_of(
    records: DataFrame, kept: DataFrame, limit: int = LOOKUP_ROWS, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Facts of the kept (study, patient) pairs, with the further columns of `kept`, a written table.

    `kept.n_facts` tells which patients are heavy, so the join costs no pass of its own to learn it.
    """
    on = ["study_id", "patient_id"]
    if fits_lookup(kept, limit):
        return records.join(F.broadcast(kept.drop("n_facts")), on)
    weights = kept.select(*on, F.col("n_facts").alias("_rows"))
    return split_join(records, kept.drop("n_facts"), on, weights, "inner", rows_per_task, hashable(kept))


def with_listing(kept: DataFrame, roster: DataFrame) -> DataFrame:
    """Mark the pairs that are on the roster. Both sides have one row per study and patient."""
    on = ["study_id", "patient_id"]
    listed = roster.select(*on, F.lit(True).alias("listed"))
    return kept.join(listed, on, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def retained_versions(studies: DataFrame, patterns=voc.COHORT_PATTERNS) -> DataFrame:
    """Which study stands for each labelled cohort."""
    labels = [label for _, label in patterns]
    return (
        studies.withColumn("cohort", cohort_of(F.col("study_id"), patterns))
        .filter(F.col("cohort").isin(*labels))
        .select("cohort", "study_id", "study_name", "n_patients")
    )


def missing_cohorts(studies: DataFrame, required, patterns=voc.COHORT_PATTERNS) -> DataFrame:
    """Required cohort labels that no study carries."""
    spark = studies.sparkSession
    wanted = spark.createDataFrame([(c,) for c in required], "cohort string")
    present = studies.select(cohort_of(F.col("study_id"), patterns).alias("cohort")).distinct()
    return wanted.join(present, "cohort", "left_anti")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Stack frames on column names; a column one of them lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
