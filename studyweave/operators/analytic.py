"""One row per patient out of the normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as voc
from ..functions.clinical import entity_key, os_event
from ..functions.text import number_or_null, prefix_real
from .joins import lookup_join


def pat_wide(tables: dict[str, DataFrame], concepts=voc.PREDICTOR_CONCEPTS, all_patients: bool = True) -> DataFrame:
    """One column per concept: the largest text a patient has for it.

    With `all_patients` a patient without any of the concepts keeps a row of NULLs. Without it
    only facts of the concepts are read, which is enough under an outer join.
    """
    facts = tables["patient_clinical"]
    bridge = tables["study_attributes"].select("study_id", "attr_id", "harmonized_id")
    if not all_patients:
        bridge = bridge.filter(F.col("harmonized_id").isin(*concepts))
        facts = lookup_join(facts, bridge.select("attr_id").distinct(), ["attr_id"], "left_semi")
    placed = facts.join(tables["patients"].select("patient_key", "study_id"), "patient_key")
    named = lookup_join(placed, bridge, ["study_id", "attr_id"])
    columns = [F.max(F.when(F.col("harmonized_id") == c, F.col("value"))).alias(c.lower()) for c in concepts]
    return named.groupBy("patient_key").agg(*columns)


def samp_agg(tables: dict[str, DataFrame], measures=voc.SAMPLE_MEASURES, all_patients: bool = True) -> DataFrame:
    """Mean of each sample measure over a patient's samples; reading rules as in pat_wide."""
    facts = tables["sample_clinical"]
    if not all_patients:
        facts = facts.filter(F.col("attr_id").isin(*[attr for attr, _ in measures]))
    owners = tables["samples"].select("sample_key", "patient_key")
    means = [
        F.avg(F.when(F.col("attr_id") == attr, prefix_real(F.col("value")))).alias(name)
        for attr, name in measures
    ]
    return facts.join(owners, "sample_key").groupBy("patient_key").agg(*means)


def wide_facts(patient_facts: DataFrame, concepts=voc.PREDICTOR_CONCEPTS) -> DataFrame:
    """The same as pat_wide without `all_patients`, from facts that still name study and concept: no join."""
    facts = patient_facts.filter(F.col("harmonized_id").isin(*concepts) & F.col("value").isNotNull())
    facts = facts.filter(~F.col("attr_id").isin(*voc.OUTCOME_ATTRS))
    columns = [F.max(F.when(F.col("harmonized_id") == c, F.col("value"))).alias(c.lower()) for c in concepts]
    key = entity_key(F.col("study_id"), F.col("patient_id")).alias("patient_key")
    return facts.groupBy(key).agg(*columns)


def analytic_view(
    tables: dict[str, DataFrame], concepts=voc.PREDICTOR_CONCEPTS, wide: DataFrame | None = None
) -> DataFrame:
    """Patients with a recorded outcome, their study, concepts, sample measures and follow-up.

    All the large joins are on patient_key, so one exchange per input serves the whole chain. `wide` is
    the pivot of the concepts where the caller has it; else it comes from the tables.
    """
    outcomes = tables["outcomes"].filter("os_status IS NOT NULL AND os_status <> ''")
    cancer = tables["studies"].select("study_id", "cancer_type")
    people = tables["patients"].select("patient_key", "study_id").join(outcomes, "patient_key")
    wide = pat_wide(tables, concepts, all_patients=False) if wide is None else wide
    people = people.join(wide, "patient_key", "left")
    people = people.join(samp_agg(tables, all_patients=False), "patient_key", "left")
    return lookup_join(people, cancer, ["study_id"]).select(
        "patient_key",
        "study_id",
        "cancer_type",
        *[c.lower() for c in concepts],
        *[name for _, name in voc.SAMPLE_MEASURES],
        "os_status",
        prefix_real(F.col("os_months")).alias("os_months"),
    )


def conversion_losses(frame: DataFrame) -> dict[str, float]:
    """Per text column, the share of rows that a conversion to number would lose. One pass.

    Columns without any value are left out: there is nothing to convert.
    """
    texts = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}

    def share_lost(name):
        value = F.col(name)
        lost = value.isNotNull() & number_or_null(value).isNull()
        return F.when(F.count(value) > 0, F.avg(lost.cast("int"))).alias(name)

    losses = frame.agg(*[share_lost(c) for c in texts]).first().asDict()
    return {name: loss for name, loss in losses.items() if loss is not None}


def numeric_if_safe(frame: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Turn text columns into numbers where fewer than `tolerance` of the rows are lost by it."""
    safe = {name for name, loss in conversion_losses(frame).items() if loss < tolerance}
    return frame.select(
        *[number_or_null(F.col(c)).alias(c) if c in safe else F.col(c) for c in frame.columns]
    )


def analytic_frame(view: DataFrame) -> DataFrame:
    """The view with numeric columns and the event label."""
    typed = numeric_if_safe(view)
    labelled = typed.withColumn("os_event", os_event(F.col("os_status").cast("string")))
    return labelled.filter(F.col("os_event").isNotNull())


def select_any_of(frame: DataFrame, names) -> DataFrame:
    """The named columns that exist, in the order of `names`."""
    return frame.select(*[c for c in names if c in frame.columns])


def missingness(frame: DataFrame) -> DataFrame:
    """Percent missing per column: variable, pct_missing, place by it. One pass; one row per column."""
    shares = [(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in frame.columns]
    place = F.row_number().over(W.orderBy(F.round("pct_missing", 9).desc(), "variable")).cast("bigint")
    return frame.agg(*shares).unpivot([], list(frame.columns), "variable", "pct_missing").withColumn("place", place)


def event_counts(frame: DataFrame) -> DataFrame:
    """Study by event cross table, a blank cell being NULL."""
    return (
        frame.groupBy("study_id")
        .pivot("os_event", ["0", "1"])
        .count()
        .withColumnsRenamed({"0": "n_alive", "1": "n_deceased"})
    )
