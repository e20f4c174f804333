"""One name and one vocabulary per clinical concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as voc
from ..functions.clinical import normalise_value, read_value
from ..functions.text import is_recorded, trim_all

STAGING = [name for name, _ in voc.CONCEPT_PATTERNS]
REWRITTEN = [*STAGING, *voc.RECEPTOR_CONCEPTS]


def harmonization_map(spark: SparkSession, pairs=voc.HARMONIZATION) -> DataFrame:
    return spark.createDataFrame(list(pairs), "raw_attr_id string, harmonized_id string")


def mapped_concept(attr_id: Column, pairs=voc.HARMONIZATION) -> Column:
    """Concept of an attribute, NULL where the map has none: the map as one literal lookup."""
    literal = F.create_map(*[F.lit(text) for pair in pairs for text in pair])
    return F.try_element_at(literal, attr_id)


def harmonise(records: DataFrame) -> DataFrame:
    """Add harmonized_id and norm_value. norm_value is NULL where normalisation leaves nothing.

    One column per step, so that no expression is evaluated twice for a row. A pattern that does
    not match gives the empty text here, which the last step drops with the other placeholders.
    """
    value = read_value(
        F.col("harmonized_id"), F.col("value"), F.col("_text"), lambda t, pattern: F.regexp_extract(t, pattern, 0)
    )
    return (
        records.withColumn("harmonized_id", F.coalesce(mapped_concept(F.col("attr_id")), F.col("attr_id")))
        .withColumn("_text", F.upper(trim_all(F.col("value"))))
        .withColumn("_read", value)
        .withColumn("norm_value", F.when(is_recorded(F.col("_read")), F.col("_read")))
        .drop("_text", "_read")
    )


def normalised(harmonised: DataFrame) -> DataFrame:
    """The records that survive normalisation, with the normalised value."""
    return harmonised.filter(F.col("norm_value").isNotNull()).select(
        "study_id",
        "patient_id",
        "sample_id",
        "attr_id",
        F.col("norm_value").alias("value"),
        "data_level",
        "harmonized_id",
    )


def concept_probe(records: DataFrame, pattern: str = voc.CONCEPT_PROBE) -> DataFrame:
    """Patient-level attribute ids that may carry a concept of interest, per study."""
    return (
        records.filter((F.col("data_level") == "PATIENT") & F.col("attr_id").rlike(pattern))
        .select("study_id", "attr_id")
        .distinct()
    )


def stage_probe(records: DataFrame) -> DataFrame:
    """Raw vocabulary of the staging concepts."""
    return (
        records.withColumn("harmonized_id", mapped_concept(F.col("attr_id")))
        .filter(F.col("harmonized_id").isin(*STAGING))
        .groupBy("study_id", "harmonized_id", "value")
        .agg(F.count("*").alias("n"))
    )


def mapping_probe(use: DataFrame, pattern: str = voc.MAPPING_PROBE) -> DataFrame:
    """Attributes that look like a concept, per study, and whether the map knows them. Filter on
    study_id for one study."""
    found = use.filter((F.col("data_level") == "PATIENT") & F.col("attr_id").rlike(pattern)).select(
        "study_id", "attr_id", F.col("n_records").alias("n_patients")
    )
    concept = mapped_concept(F.col("attr_id"))
    return found.select(
        "study_id",
        "attr_id",
        "n_patients",
        concept.alias("harmonized_id"),
        F.coalesce(concept, F.lit("NOT MAPPED")).alias("mapped"),
    )


def unmapped_first(probe: DataFrame) -> DataFrame:
    return probe.orderBy((F.col("mapped") == "NOT MAPPED").desc(), "attr_id", "study_id")


def vocabulary_probe(records: DataFrame, attrs=voc.VOCABULARY_ATTRS) -> DataFrame:
    """Value counts of chosen attributes, per study."""
    return (
        records.filter(F.col("attr_id").isin(*attrs))
        .groupBy("study_id", "attr_id", "value")
        .agg(F.count("*").alias("n"))
    )


def map_usage(use: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every entry of the map with the number of studies and records that use it."""
    used = use.groupBy("attr_id").agg(
        F.count_distinct("study_id").alias("n_studies"), F.sum("n_records").alias("n_records")
    )
    return mapping.join(used, mapping.raw_attr_id == used.attr_id, "left").select(
        "raw_attr_id",
        "harmonized_id",
        F.coalesce("n_studies", F.lit(0)).alias("n_studies"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
    )


def normalisation_check(records: DataFrame) -> DataFrame:
    """How many recorded values each rewriting rule keeps, per study and concept."""
    kept = normalise_value(F.col("harmonized_id"), F.col("value")).isNotNull().cast("int")
    return (
        records.withColumn("harmonized_id", mapped_concept(F.col("attr_id")))
        .filter(F.col("harmonized_id").isin(*REWRITTEN))
        .groupBy("study_id", "harmonized_id")
        .agg(
            F.count("*").alias("n_raw"),
            F.sum(kept).alias("n_kept"),
            F.round(100 * F.avg(kept), 1).alias("pct_kept"),
        )
    )
