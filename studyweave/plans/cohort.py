"""The cohort build, stage by stage.

A stage is written to the shared folder the first time it is asked for and read from there after:
most are used by several later ones, and an unwritten chain would be recomputed at every use.
Frames of the size of the records are written twice (as delivered but clean, and kept and
harmonised); all others are aggregates. What is a mere projection of a stage is not written again.
"""

from __future__ import annotations

from functools import cached_property, wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as voc
from ..operators import analytic, audit, cohort, completeness, gates, harmonise, split, tables
from ..workspace import Workspace


def stage(build):
    """A method whose frame is written once."""

    @wraps(build)
    def table(self) -> DataFrame:
        return self.workspace.table(build.__name__, lambda: build(self))

    return table


class Cohort:
    """Inputs: records (six text columns), roster (study_id, patient_id), listing (studyId, name,
    cancerTypeId)."""

    def __init__(
        self,
        workspace: Workspace,
        records: DataFrame,
        roster: DataFrame,
        listing: DataFrame,
        min_patients: int = 50,
        bound: float = 0.5,
        required: tuple[str, ...] = voc.REQUIRED_COHORTS,
        patterns=voc.COHORT_PATTERNS,
    ):
        self.workspace = workspace
        self.spark = workspace.spark
        self.records_in, self.roster_in, self.listing_in = records, roster, listing
        self.min_patients, self.bound = min_patients, bound
        self.required, self.patterns = required, patterns

    @cached_property
    def candidates(self) -> list[str]:
        """The candidate predictors that the view has."""
        return [c.lower() for c in voc.PREDICTOR_CONCEPTS if c.lower() in self.v_analytic().columns]

    def gates(self) -> DataFrame:
        """The checks between the steps, as rows."""

        def missing(studies):
            return cohort.missing_cohorts(studies, self.required, self.patterns)

        return gates.quality_gates(
            self.listing_in,
            missing(self.studies()),
            missing(self.candidate_studies()),
            missing(self.study_patients().select("study_id").distinct()),
            missing(self.study_table()),
            self.clinical_long(),
            self.attr_facts().select("study_id", "patient_id").distinct(),
            self.completeness_wide(),
            self.analytic_kept(),
            len(self.predictors()),
        )

    def require(self) -> "Cohort":
        """Itself, if all checks pass; else an error that names those that don't."""
        gates.require(self.gates())
        return self

    # Studies and records before duplicates are resolved.

    @stage
    def studies(self):
        kept = cohort.filter_studies(self.listing_in)
        one = cohort.keep_one_row(kept, ["studyId"])
        return one.select(F.col("studyId").alias("study_id"), F.col("name").alias("study_name"), "cancerTypeId")

    @stage
    def listed_patients(self):
        return cohort.of_studies(self.roster_in, self.studies())

    @stage
    def patient_counts(self):
        return cohort.patient_counts(self.listed_patients())

    @stage
    def candidate_studies(self):
        return cohort.study_table(self.studies(), self.patient_counts(), self.min_patients)

    @stage
    def clinical_long(self):
        return cohort.of_studies(cohort.clean_records(self.records_in), self.candidate_studies())

    # One study's copy of each patient.

    @stage
    def study_patients(self):
        return cohort.patient_weights(self.clinical_long())

    @stage
    def study_richness(self):
        return cohort.study_richness(self.clinical_long())

    @stage
    def primary_record(self):
        return cohort.primary_record(self.study_patients(), self.study_richness())

    @stage
    def primary_roster(self):
        listed = cohort.of_studies(self.listed_patients(), self.candidate_studies())
        pairs = self.primary_record().select("study_id", "patient_id")
        return listed.join(pairs, ["study_id", "patient_id"], "left_semi")

    @stage
    def study_table(self):
        counts = cohort.patient_counts(self.primary_roster())
        return cohort.study_table(self.candidate_studies(), counts, self.min_patients)

    def roster(self):
        return cohort.of_studies(self.primary_roster(), self.study_table())

    @stage
    def kept_patients(self):
        kept = cohort.of_studies(self.primary_record(), self.study_table())
        return cohort.with_listing(kept, self.primary_roster())

    @stage
    def kept_records(self):
        """Records of the final cohort with concept and normalised value: the base of all below."""
        return harmonise.harmonise(cohort.records_of(self.clinical_long(), self.kept_patients()))

    def clinical_norm(self):
        return harmonise.normalised(self.kept_records())

    # Completeness.

    @stage
    def attr_facts(self):
        """One row per patient, level and attribute: the only shuffle of the records that follows."""
        return completeness.attr_facts(self.kept_records())

    def patient_facts(self):
        return completeness.patient_facts(self.attr_facts())

    @stage
    def completeness_wide(self):
        return completeness.completeness_wide(self.patient_facts(), self.roster())

    @stage
    def completeness_long(self):
        return completeness.completeness_long(self.patient_facts(), self.study_table())

    @stage
    def attr_coverage(self):
        return completeness.attr_coverage(self.completeness_wide())

    # The eight tables.

    @stage
    def attribute_use(self):
        return tables.attribute_use(self.kept_records())

    @stage
    def patient_summary(self):
        return tables.patient_summary(self.attr_facts().withColumnRenamed("value", "norm_value"))

    def tbl_studies(self):
        return tables.studies(self.study_table())

    def tbl_attributes(self):
        return tables.clinical_attributes(self.attribute_use())

    @stage
    def tbl_study_attributes(self):
        return tables.study_attributes(self.attribute_use(), self.completeness_long())

    def tbl_patients(self):
        return tables.patients(self.patient_summary())

    @stage
    def tbl_samples(self):
        return tables.samples(self.clinical_norm())

    def tbl_patient_clinical(self):
        return tables.patient_clinical(self.patient_facts())

    @stage
    def tbl_sample_clinical(self):
        return tables.sample_clinical(self.clinical_norm())

    def tbl_outcomes(self):
        return tables.outcomes(self.patient_summary())

    def tables(self) -> dict[str, DataFrame]:
        """Every child is derived from the same records as its parent, so none is an orphan."""
        return {
            "studies": self.tbl_studies(),
            "clinical_attributes": self.tbl_attributes(),
            "study_attributes": self.tbl_study_attributes(),
            "patients": self.tbl_patients(),
            "samples": self.tbl_samples(),
            "patient_clinical": self.tbl_patient_clinical(),
            "sample_clinical": self.tbl_sample_clinical(),
            "outcomes": self.tbl_outcomes(),
        }

    # Analysis.

    @stage
    def v_analytic(self):
        return analytic.analytic_view(self.tables(), wide=analytic.wide_facts(self.patient_facts()))

    def analytic_view(self) -> DataFrame:
        """The view under its name, for SQL users."""
        view = self.v_analytic()
        view.createOrReplaceTempView("v_analytic")
        return view

    @stage
    def analytic_frame(self):
        return analytic.analytic_frame(self.v_analytic())

    @stage
    def availability(self):
        return audit.availability(self.analytic_frame(), self.candidates)

    def variable_rank(self):
        return audit.variable_rank(self.availability(), self.candidates)

    @stage
    def tradeoff(self):
        return audit.tradeoff(self.availability(), self.variable_rank(), self.candidates, self.bound)

    def predictors(self) -> list[str]:
        """At most as many names as there are candidate concepts."""
        best = audit.best_tradeoff(self.tradeoff()).first()
        if best is None:
            raise ValueError("no study is left; lower min_patients")
        return best["variables"].split(", ")

    def kept_studies(self):
        return audit.studies_meeting_all(self.availability(), self.predictors(), self.bound)

    def analytic_kept(self):
        return audit.of_kept_studies(self.analytic_frame(), self.kept_studies())

    @stage
    def df_model(self):
        return split.model_frame(self.analytic_kept(), self.predictors())

    @stage
    def df_split(self):
        return split.stratified_split(self.df_model())

    def train(self):
        return self.df_split().filter("split = 'train'")

    def test(self):
        return self.df_split().filter("split = 'test'")
