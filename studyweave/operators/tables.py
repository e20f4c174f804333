"""The eight normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as voc
from ..functions.clinical import entity_key


def _patient_key():
    return entity_key(F.col("study_id"), F.col("patient_id")).alias("patient_key")


def _sample_key():
    return entity_key(F.col("study_id"), F.col("sample_id")).alias("sample_key")


def studies(study_table: DataFrame, cancer_type: str = voc.CANCER_TYPE) -> DataFrame:
    return study_table.select(
        "study_id",
        "study_name",
        F.lit(cancer_type).alias("cancer_type"),
        F.col("n_patients").cast("int").alias("n_patients"),
    )


def attribute_use(harmonised: DataFrame) -> DataFrame:
    """Records per study, attribute and level: how many, and how many with a normalised value.

    One pass over the records serves every question about attributes.
    """
    return harmonised.groupBy("study_id", "attr_id", "harmonized_id", "data_level").agg(
        F.count("*").alias("n_records"), F.count("norm_value").alias("n_values")
    )


def patient_summary(harmonised: DataFrame, attrs=voc.OUTCOME_ATTRS) -> DataFrame:
    """Patients with any normalised value, and their outcomes, recorded at whichever level."""
    return (
        harmonised.filter(F.col("norm_value").isNotNull())
        .groupBy("study_id", "patient_id")
        .agg(*[F.min(F.when(F.col("attr_id") == a, F.col("norm_value"))).alias(a.lower()) for a in attrs])
    )


def clinical_attributes(use: DataFrame, numeric=voc.NUMERIC_ATTRS) -> DataFrame:
    """One row per attribute. An id recorded at two levels takes the smaller; see level_mismatch."""
    datatype = F.when(F.col("attr_id").isin(*numeric), "NUMBER").otherwise("STRING")
    return (
        use.filter("n_values > 0")
        .groupBy("attr_id")
        .agg(F.min("data_level").alias("data_level"))
        .withColumn("datatype", datatype)
    )


def study_attributes(use: DataFrame, completeness: DataFrame) -> DataFrame:
    """Which study records which attribute, under which concept, how completely."""
    pct = completeness.select("study_id", "attr_id", "completeness_pct")
    return (
        use.filter("n_values > 0")
        .select("study_id", "attr_id", "harmonized_id")
        .distinct()
        .join(pct, ["study_id", "attr_id"], "left")
        .select(
            "study_id",
            "attr_id",
            "harmonized_id",
            F.round("completeness_pct", 2).alias("patient_completeness_pct"),
        )
    )


def patients(summary: DataFrame) -> DataFrame:
    return summary.select(_patient_key(), "patient_id", "study_id")


def _of_samples(records: DataFrame) -> DataFrame:
    return records.filter((F.col("data_level") == "SAMPLE") & F.col("sample_id").isNotNull())


def samples(records: DataFrame) -> DataFrame:
    return (
        _of_samples(records)
        .select("study_id", "patient_id", "sample_id")
        .distinct()
        .select(_sample_key(), "sample_id", _patient_key())
    )


def patient_clinical(patient_facts: DataFrame, outcomes=voc.OUTCOME_ATTRS) -> DataFrame:
    """Patient-level facts other than the outcomes, which have a table of their own."""
    return patient_facts.filter(F.col("value").isNotNull() & ~F.col("attr_id").isin(*outcomes)).select(
        _patient_key(), "attr_id", "value"
    )


def sample_clinical(records: DataFrame) -> DataFrame:
    return (
        _of_samples(records)
        .groupBy("study_id", "sample_id", "attr_id")
        .agg(F.min("value").alias("value"))
        .select(_sample_key(), "attr_id", "value")
    )


def outcomes(summary: DataFrame, attrs=voc.OUTCOME_ATTRS) -> DataFrame:
    """One row per patient with any of the outcomes."""
    names = [a.lower() for a in attrs]
    return summary.filter(F.coalesce(*names).isNotNull()).select(_patient_key(), *names)


def level_mismatch(use: DataFrame, by: str) -> DataFrame:
    """Attributes (or concepts) recorded for patients in one place and for samples in another.

    A study counts on both sides when it records both levels itself.
    """
    per_study = use.select(by, "study_id", "data_level").distinct()

    def studies_at(level):
        return F.count_if(F.col("data_level") == level)

    return (
        per_study.groupBy(by)
        .agg(
            F.count_distinct("data_level").alias("n_levels"),
            studies_at("PATIENT").alias("n_studies_patient"),
            studies_at("SAMPLE").alias("n_studies_sample"),
        )
        .filter("n_levels > 1")
        .drop("n_levels")
    )
