"""How complete each attribute is per study, measured in independent ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as voc
from .ordered import exact_quantiles

PAIR = ["study_id", "patient_id"]


def attr_facts(harmonised: DataFrame) -> DataFrame:
    """One row per patient, level and attribute, with the smallest normalised value (NULL where no value
    survived) and whether the patient is on the roster.

    One shuffle feeds completeness, the patient tables and the outcomes.
    """
    return harmonised.groupBy(*PAIR, "data_level", "attr_id", "harmonized_id").agg(
        F.min("norm_value").alias("value"), F.max("listed").alias("listed")
    )


def patient_facts(facts: DataFrame) -> DataFrame:
    """Patient-level facts, one row per patient and attribute, out of `attr_facts`."""
    return facts.filter("data_level = 'PATIENT'").drop("data_level")


def completeness_wide(facts: DataFrame, roster: DataFrame) -> DataFrame:
    """Patients of the roster that have the attribute, over the size of the roster.

    The count a patient-by-attribute table would give, taken from its long form.
    """
    sizes = roster.groupBy("study_id").agg(F.count("*").alias("n_patients"))
    counts = facts.groupBy("study_id", "attr_id").agg(F.count_if("listed").alias("n_nonmissing"))
    return counts.join(sizes, "study_id").select(
        "study_id", "attr_id", "n_nonmissing", "n_patients", percent("n_nonmissing", "n_patients")
    )


def completeness_long(facts: DataFrame, studies: DataFrame) -> DataFrame:
    """Distinct patients with the attribute, over the study size. `facts` is distinct already."""
    counts = facts.groupBy("study_id", "attr_id").agg(F.count("*").alias("n_nonmissing"))
    sizes = studies.select("study_id", "n_patients")
    return counts.join(sizes, "study_id", "left").select(
        "study_id", "attr_id", "n_nonmissing", "n_patients", percent("n_nonmissing", "n_patients")
    )


def completeness_stored(tables: dict[str, DataFrame]) -> DataFrame:
    """The same measure out of the stored tables, as SQL over them would give it.

    Facts are counted per study and attribute before the bridge table is joined, so there is no
    patients-times-attributes fan-out.
    """
    counts = (
        tables["patient_clinical"]
        .select("patient_key", "attr_id")
        .join(tables["patients"].select("patient_key", "study_id"), "patient_key")
        .groupBy("study_id", "attr_id")
        .agg(F.count("*").alias("n"))
    )
    peopled = tables["patients"].select("study_id").distinct()
    sizes = tables["studies"].select("study_id", "n_patients")
    bridge = tables["study_attributes"].select("study_id", "attr_id", "harmonized_id")
    bridge = bridge.join(sizes, "study_id").join(peopled, "study_id", "left_semi")
    found = F.coalesce("n", F.lit(0))
    return bridge.join(counts, ["study_id", "attr_id"], "left").select(
        "study_id",
        "attr_id",
        "harmonized_id",
        found.alias("n_nonmissing"),
        F.col("n_patients").cast("bigint").alias("n_patients"),
        F.round(100.0 * found / F.col("n_patients"), 1).alias("completeness_pct"),
    )


def percent(part: str, whole: str, alias: str = "completeness_pct") -> Column:
    return (F.lit(100.0) * F.col(part) / F.col(whole)).alias(alias)


def attr_coverage(completeness: DataFrame) -> DataFrame:
    """In how many studies an attribute occurs, and how complete it is there on average."""
    n_studies = completeness.agg(F.count_distinct("study_id")).first()[0]
    scope = (
        F.when(F.col("n_studies_present") == n_studies, "shared by all studies")
        .when(F.col("n_studies_present") > 1, "partially shared")
        .otherwise("study-specific")
    )
    return (
        completeness.groupBy("attr_id")
        .agg(F.count("*").alias("n_studies_present"), F.avg("completeness_pct").alias("mean_completeness"))
        .withColumn("scope", scope)
    )


def completeness_summary(completeness: DataFrame, keep) -> DataFrame:
    """Five numbers and the mean, and the share of cells that are full."""
    shares = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    quantiles = exact_quantiles(completeness, [], "completeness_pct", shares, keep)
    full = F.avg((F.col("completeness_pct") >= 99.999).cast("int"))
    rest = completeness.agg(F.avg("completeness_pct").alias("mean"), full.alias("share_full")).first()
    return quantiles.select(
        "*", F.lit(rest["mean"]).alias("mean"), F.lit(rest["share_full"]).alias("share_full")
    )


def outcome_completeness(completeness: DataFrame, names=voc.ALL_OUTCOME_ATTRS) -> DataFrame:
    """Completeness of outcome attributes, long."""
    return completeness.filter(F.col("attr_id").isin(*names)).select(
        "study_id", "attr_id", "completeness_pct"
    )


def outcome_table(completeness: DataFrame, names=voc.ALL_OUTCOME_ATTRS) -> DataFrame:
    """One row per study, one column per outcome; NULL where the study does not record it."""
    return (
        outcome_completeness(completeness, names)
        .groupBy("study_id")
        .pivot("attr_id", list(names))
        .agg(F.min("completeness_pct"))
    )


def top_with_ties(frame: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows with the largest `by`, and those equal to the last of them.

    A top-n and one comparison, so the whole frame never passes through one ordered window.
    """
    last = frame.select(by).orderBy(F.desc(by)).limit(n).agg(F.min(by)).first()[0]
    return frame.filter(F.col(by) >= F.lit(last))


def heatmap_cells(completeness: DataFrame, coverage: DataFrame, n: int = 25, min_studies: int = 2) -> DataFrame:
    """Cells of the completeness heatmap for the best covered attributes of several studies."""
    chosen = top_with_ties(coverage.filter(F.col("n_studies_present") >= min_studies), "mean_completeness", n)
    # one row per chosen attribute; the place orders the categories of the chart
    place = F.row_number().over(W.orderBy(F.desc("mean_completeness"), "attr_id")).cast("bigint")
    cells = completeness.join(F.broadcast(chosen.select("attr_id", place.alias("place"))), "attr_id")
    return cells.select(
        "study_id",
        "attr_id",
        "completeness_pct",
        F.round("completeness_pct").cast("bigint").alias("label"),
        "place",
    )


def scaffold(facts: DataFrame, roster: DataFrame, attrs) -> DataFrame:
    """One row per patient of the roster and one column per attribute, NULL where unrecorded."""
    wide = facts.filter(F.col("attr_id").isin(*attrs)).groupBy(*PAIR).agg(*_attr_columns(attrs))
    return roster.select(*PAIR).join(wide, PAIR, "left")


def wide_table(records: DataFrame, use: DataFrame, roster: DataFrame) -> DataFrame:
    """Patient-by-attribute table, columns from the attribute names that `use` lists.

    Filter all three frames on study_id for the table of one study. The names become columns, so the
    driver needs them; where there are very many, `wide_map` has the same cells in one column.
    """
    rows = use.filter("data_level = 'PATIENT'").select("attr_id").distinct().collect()
    chosen = records.filter("data_level = 'PATIENT'")
    return scaffold(chosen, roster, sorted(r.attr_id for r in rows))


def wide_map(facts: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per patient of the roster: `cells`, a map from attribute to value. `facts` has one row per
    patient and attribute."""
    cells = F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr_id", "value")))).alias("cells")
    return roster.select(*PAIR).join(facts.groupBy(*PAIR).agg(cells), PAIR, "left")


def _attr_columns(attrs) -> list[Column]:
    return [F.min(F.when(F.col("attr_id") == a, F.col("value"))).alias(a) for a in attrs]
