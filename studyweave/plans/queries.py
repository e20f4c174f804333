"""Registered queries: each runs one operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as voc
from ..functions.clinical import cohort_of, normalise_value, os_event
from ..functions.text import prefix_real
from ..operators import (
    analytic,
    audit,
    charts,
    cohort,
    completeness,
    constraints,
    evaluate,
    forest,
    gates,
    harmonise,
    recipe,
    split,
    tables,
)
from ..sources import bridge, landed, store
from ..workspace import Workspace
from . import landing
from .cohort import Cohort

_builds: dict[tuple[str, str, int], Cohort] = {}
QUERIES: dict[str, Callable[[Cohort], DataFrame]] = {}

# Labels that exist among the derived studies, in place of the published cohorts.
LABELS = (("^st_1", "FIRST"), ("_p$", "PENDING"), ("^st_9", "NINTH"))


def build_for(spark: SparkSession, sf_dir: str, min_patients: int = 50) -> Cohort:
    """One build per session and input, as its stages serve many queries."""
    sf_dir = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, sf_dir, min_patients)
    if key not in _builds:
        _builds[key] = Cohort(
            Workspace(spark),
            bridge.records(spark, sf_dir),
            bridge.roster(spark, sf_dir),
            bridge.listing(spark, sf_dir),
            min_patients,
        )
        _builds[key].sf_dir = sf_dir
    return _builds[key]


def query(build: Callable[[Cohort], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run):
        return lambda spark, sf_dir: run(build_for(spark, sf_dir))

    return {name: bind(run) for name, run in QUERIES.items()}


def rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def _kept(c: Cohort, name: str):
    """Writes the counts an exact quantile is read from."""
    return lambda counts: c.workspace.table(name, lambda: counts)


def _write(c: Cohort):
    return lambda frame, name: c.workspace.table(name, lambda: frame)


# Sources and sinks.


@query
def src_studies(c):
    studies, _ = landed.read_listing(c.spark, landing.land_listing(c.workspace, c.listing_in))
    return studies


@query
def src_listing_quarantine(c):
    _, bad = landed.read_listing(c.spark, landing.land_listing(c.workspace, c.listing_in))
    return bad.select(F.col(landed.BAD).alias("line"))


@query
def src_flatten(c):
    events = c.spark.read.parquet(f"{c.sf_dir}/events.parquet")
    nested = events.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return landed.flatten(nested, "_")


@query
def src_roster(c):
    roster, _ = landed.read_roster(c.spark, landing.land_roster(c.workspace, c.roster_in))
    return roster


@query
def src_quarantine(c):
    _, bad = landed.read_roster(c.spark, landing.land_roster(c.workspace, c.roster_in))
    return bad.select(F.col("study").alias("study_id"), F.col(landed.BAD).alias("line"))


@query
def src_clinical_long(c):
    records, _ = landed.read_clinical(c.spark, landing.land_clinical(c.workspace, c.records_in))
    return cohort.clean_records(records)


PAGE_SIZE, LOST_PAGE, SHORT_PAGE = 25, 2, 1


@query
def src_listing_gaps(c):
    """Of the pages of a listing of which one never came and one lacks an entry."""
    folder = landing.land_pages(c.workspace, c.listing_in, PAGE_SIZE, LOST_PAGE, SHORT_PAGE)
    return landed.listing_pages(c.spark, folder, PAGE_SIZE)


# A study whose files break off, in the roster and in the records, and one that has nothing.
BROKEN_ROSTER, BROKEN_RECORDS, NOTHING = "st_2_o", "st_3_f", "st_0_x"


def _broken_roster(c: Cohort) -> str:
    return landing.land_broken(c.workspace, landing.roster_lines(c.roster_in), "broken_roster", BROKEN_ROSTER, NOTHING)


def _broken_records(c: Cohort) -> str:
    lines = landing.clinical_lines(c.records_in)
    return landing.land_broken(c.workspace, lines, "broken_records", BROKEN_RECORDS, NOTHING)


@query
def src_failed_studies(c):
    """The state of every study's folder, of both sources."""
    found = [
        landed.study_states(c.spark, folder).select(F.lit(source).alias("source"), F.col("study").alias("study_id"), "state")
        for source, folder in (("roster", _broken_roster(c)), ("records", _broken_records(c)))
    ]
    return cohort.union_by_name(found)


@query
def src_surviving_studies(c):
    """Patients and records of the studies that could be read, where another one's files break off."""
    roster, _ = landed.read_roster(c.spark, _broken_roster(c))
    records, _ = landed.read_clinical(c.spark, _broken_records(c))
    listed = roster.groupBy("study_id").agg(F.count("*").alias("n_patients"))
    return records.groupBy("study_id").agg(F.count("*").alias("n_records")).join(listed, "study_id", "full")


@query
def src_cached(c):
    """Built and read again, under study ids that look like numbers."""
    folder = c.workspace.fresh_path("cache")
    status = F.when(F.col("study_id").endswith("f"), "1").when(F.col("study_id").endswith("o"), "2").otherwise("3")
    digits = F.concat(F.lit("0"), F.substring("study_id", 4, 1), status)
    studies = c.study_table().withColumn("study_id", digits)
    for _ in range(2):
        cached = landed.cached_records(
            c.spark, folder, lambda: c.clinical_long().withColumn("study_id", digits), studies
        )
    return cached.groupBy("study_id", "attr_id", "data_level").agg(F.count("*").alias("n"))


@query
def src_harmonization_map(c):
    return harmonise.map_usage(c.attribute_use(), harmonise.harmonization_map(c.spark))


@query
def sink_roundtrip(c):
    folder = c.workspace.path("store")
    store.write_store(c.tables(), folder)
    return store.store_profile(store.read_store(c.spark, folder))


def _stored(c: Cohort) -> dict[str, DataFrame]:
    """The tables as read back from a store."""
    if not hasattr(c, "stored"):
        folder = c.workspace.path("store_with_keys")
        store.write_store(c.tables(), folder, check=False)
        c.stored = store.read_store(c.spark, folder)
    return c.stored


@query
def table_columns(c):
    return store.table_columns(_stored(c)).join(constraints.table_sizes(_stored(c)), "tbl")


@query
def key_summary(c):
    return store.key_summary(_stored(c)).join(constraints.table_sizes(_stored(c)), "tbl")


# Filters and projections.


@query
def filter_studies(c):
    return cohort.filter_studies(c.listing_in)


@query
def fill_schema(c):
    only_status = tables.outcomes(tables.patient_summary(c.kept_records(), ("OS_STATUS",)), ("OS_STATUS",))
    return cohort.fill_schema(only_status, {"os_months": F.lit(None).cast("string")})


@query
def filter_missing(c):
    return cohort.clean_records(c.records_in)


@query
def filter_outcome_attrs(c):
    found = c.clinical_norm().filter(F.col("attr_id").isin(*voc.OUTCOME_ATTRS))
    return found.select("study_id", "patient_id", "attr_id", "value")


@query
def outcome_attrs(c):
    return rounded(completeness.outcome_completeness(c.completeness_wide()), "completeness_pct")


@query
def concept_probe(c):
    return harmonise.concept_probe(c.kept_records())


@query
def candidate_studies(c):
    return c.candidate_studies()


@query
def study_table(c):
    return c.study_table()


@query
def studies_meeting_all(c):
    return c.kept_studies()


@query
def select_any_of(c):
    names = ["patient_key", "patient_key_1", "not_recorded", *c.candidates, "fga"]
    return rounded(analytic.select_any_of(c.v_analytic(), names), "fga")


@query
def drop_constant_cols(c):
    keys = ["patient_key", "os_event"]
    frame = c.analytic_frame().select(*keys, "cancer_type", *c.candidates)
    return split.drop_constant_columns(frame, keep=keys)


@query
def keep_studies(c):
    return c.kept_studies().select("study_id")


@query
def analytic_kept(c):
    return c.analytic_kept().select("patient_key", "study_id", "os_event")


@query
def retained_versions(c):
    return cohort.retained_versions(c.study_table(), LABELS)


# Joins.


@query
def semi_roster(c):
    large = c.workspace.table(
        "studies_of_600", lambda: cohort.study_table(c.studies(), c.patient_counts(), 600)
    )
    return cohort.of_studies(c.roster_in, large)


@query
def semi_primary(c):
    kept = cohort.records_of(c.clinical_long(), c.primary_record())
    return kept.groupBy("study_id", "attr_id", "data_level").agg(F.count("*").alias("n"))


@query
def scaffold_roster(c):
    return completeness.scaffold(c.patient_facts(), c.roster(), ["SEX", "PATH_T_STAGE", "ER_IHC"])


@query
def stage_probe(c):
    return harmonise.stage_probe(c.kept_records()).orderBy(F.desc("n"), "study_id", "harmonized_id", "value")


@query
def clinical_norm(c):
    return c.clinical_norm()


@query
def study_attributes(c):
    return c.tbl_study_attributes()


@query
def reconcile_children(c):
    parents_gone = {
        **c.tables(),
        "studies": c.tbl_studies().filter("study_id <> 'st_1_f'"),
        "clinical_attributes": c.tbl_attributes().filter("attr_id <> 'SEX'"),
    }
    return constraints.table_sizes(constraints.reconcile(parents_gone))


@query
def cascade_delete(c):
    left = constraints.cascade_delete(c.tables(), "patients", F.col("patient_id").endswith("7"))
    return store.store_profile(left)


@query
def v_analytic(c):
    view = c.analytic_view()
    return rounded(view, "mutation_count", "fga", "os_months")


@query
def completeness_sql(c):
    return completeness.completeness_stored(c.tables())


# Aggregations.


@query
def distinct_keep_row(c):
    return c.studies().withColumnRenamed("cancerTypeId", "cancer_tag")


@query
def tbl_studies(c):
    return c.tbl_studies()


@query
def tbl_patients(c):
    return c.tbl_patients()


@query
def tbl_samples(c):
    return c.tbl_samples()


@query
def tbl_attributes(c):
    return c.tbl_attributes()


@query
def tbl_patient_clinical(c):
    return c.tbl_patient_clinical()


@query
def tbl_sample_clinical(c):
    return c.tbl_sample_clinical()


@query
def tbl_outcomes(c):
    return c.tbl_outcomes()


@query
def patient_counts(c):
    return c.patient_counts()


@query
def vocab_probe(c):
    return harmonise.vocabulary_probe(c.kept_records())


@query
def mapping_probe(c):
    return harmonise.mapping_probe(c.attribute_use())


@query
def unmapped_attrs(c):
    return harmonise.unmapped_first(harmonise.mapping_probe(c.attribute_use(), "."))


@query
def duplicate_audit(c):
    return cohort.duplicate_audit(c.study_patients())


@query
def most_copies(c):
    return cohort.most_copies(cohort.duplicate_audit(c.study_patients()))


@query
def n_studies(c):
    return c.completeness_wide().agg(
        F.count_distinct("study_id").alias("n_studies"), F.count_distinct("attr_id").alias("n_attrs")
    )


@query
def completeness_wide(c):
    return rounded(c.completeness_wide(), "completeness_pct")


@query
def completeness_long(c):
    return rounded(c.completeness_long(), "completeness_pct")


@query
def attr_coverage(c):
    return rounded(c.attr_coverage(), "mean_completeness").orderBy(
        F.desc("n_studies_present"), F.desc("mean_completeness"), "attr_id"
    )


@query
def normalisation_check(c):
    return harmonise.normalisation_check(c.kept_records()).orderBy("pct_kept", "study_id", "harmonized_id")


@query
def pat_wide(c):
    return analytic.pat_wide(c.tables())


@query
def samp_agg(c):
    return rounded(analytic.samp_agg(c.tables()), "mutation_count", "fga")


@query
def missingness(c):
    frame = analytic.select_any_of(c.analytic_frame(), [*c.candidates, "mutation_count", "fga"])
    return rounded(analytic.missingness(frame), "pct_missing")


@query
def availability(c):
    return rounded(c.availability(), *c.candidates)


@query
def var_rank(c):
    return rounded(c.variable_rank(), "patient_coverage")


@query
def tradeoff(c):
    return c.tradeoff()


@query
def completeness_summary(c):
    summary = completeness.completeness_summary(c.completeness_wide(), _kept(c, "completeness_counts"))
    return rounded(summary, *summary.columns)


@query
def event_counts(c):
    return analytic.event_counts(c.analytic_frame())


@query
def cohort_shift(c):
    names = ["median_mutations", "median_months"]
    held = iter(names)
    shift = charts.cohort_shift(c.analytic_frame(), lambda counts: _kept(c, f"counts_{next(held)}")(counts))
    return rounded(shift, "event_rate", *names)


# Ranks, tops and reshaping.


@query
def study_rank(c):
    return cohort.study_rank(c.study_richness())


@query
def primary_record(c):
    return c.primary_record().select("study_id", "patient_id")


@query
def stage_event_prop(c):
    return rounded(charts.event_share_by(c.analytic_frame(), "tumor_stage"), "prop")


@query
def top_attrs(c):
    several = c.attr_coverage().filter("n_studies_present >= 2")
    top = completeness.top_with_ties(several, "mean_completeness", 25)
    return rounded(top.select("attr_id", "mean_completeness"), "mean_completeness")


@query
def best_tradeoff(c):
    return audit.best_tradeoff(c.tradeoff())


@query
def top_completeness(c):
    ordered = c.completeness_wide().orderBy(F.desc("completeness_pct"), "study_id", "attr_id")
    return rounded(ordered.limit(10), "completeness_pct")


@query
def union_by_name(c):
    return cohort.union_by_name([c.tbl_patient_clinical(), c.tbl_sample_clinical()])


@query
def must_have_missing(c):
    return cohort.missing_cohorts(c.study_table(), [label for _, label in LABELS], LABELS)


@query
def outcome_table(c):
    table = completeness.outcome_table(c.completeness_wide())
    return rounded(table, *voc.ALL_OUTCOME_ATTRS)


@query
def wide_by_study(c):
    return completeness.wide_table(c.kept_records(), c.attribute_use(), c.roster())


@query
def wide_map_sizes(c):
    """How many attributes each patient of the roster has, read off the map form of the wide table."""
    facts = c.patient_facts().filter("value IS NOT NULL")
    cells = completeness.wide_map(facts, c.roster())
    size = F.coalesce(F.size("cells"), F.lit(0))
    return cells.select("study_id", "patient_id", F.when(size < 0, 0).otherwise(size).cast("bigint").alias("n_attrs"))


# Scalar functions, over every text the records hold.


@query
def cohort_labels(c):
    published = F.concat(
        F.when(F.col("study_id").endswith("f"), "brca_tcga_").when(F.col("study_id").endswith("p"), "x_metabric_")
        .otherwise(""),
        F.col("study_id"),
    )
    labels = c.study_patients().select(published.alias("sid")).select("sid", cohort_of(F.col("sid")).alias("cohort"))
    return labels.groupBy("sid", "cohort").agg(F.count("*").alias("n"))


@query
def normalised_values(c):
    concept = F.coalesce(harmonise.mapped_concept(F.col("attr_id")), F.col("attr_id"))
    texts = c.clinical_long().groupBy(concept.alias("concept"), "value").agg(F.count("*").alias("n"))
    return texts.withColumn("normalised", normalise_value(F.col("concept"), F.col("value")))


@query
def cast_prefix_real(c):
    mixed = F.when(F.col("data_level") == "SAMPLE", F.concat("value", F.lit(" units"))).otherwise(F.col("value"))
    texts = c.clinical_long().groupBy(mixed.alias("text")).agg(F.count("*").alias("n"))
    return rounded(texts.withColumn("number", prefix_real(F.col("text"))), "number")


@query
def numeric_if_safe(c):
    frame = c.v_analytic().select("patient_key", "age", "t_stage", "er_status")
    return rounded(analytic.numeric_if_safe(frame), "age")


@query
def event_flags(c):
    return c.tbl_outcomes().select("patient_key", "os_status", os_event(F.col("os_status")).alias("os_event"))


# Constraints. The stored tables are clean, so rows that break each rule are derived from them.


@query
def pk_violations(c):
    return constraints.primary_key_violations({name: t.unionByName(t) for name, t in c.tables().items()})


@query
def unique_violations(c):
    held = c.tables()
    renamed = held["patients"].withColumn("patient_key", F.concat("patient_key", F.lit("*")))
    return constraints.unique_violations({**held, "patients": held["patients"].unionByName(renamed)})


@query
def not_null_violations(c):
    held = c.tables()
    holed = {}
    for t in constraints.TABLES:
        blank = held[t.name].withColumns({n: F.lit(None).cast(held[t.name].schema[n].dataType) for n in t.required})
        holed[t.name] = held[t.name].unionByName(blank)
    return constraints.not_null_violations(holed)


@query
def check_violations(c):
    held = c.tables()
    studies = held["studies"].withColumn("n_patients", F.when(F.col("n_patients") > 200, -1).otherwise(F.col("n_patients")))
    attributes = held["clinical_attributes"].select(
        "attr_id",
        F.when(F.col("attr_id").like("%STAGE%"), F.lower("data_level")).otherwise(F.col("data_level")).alias("data_level"),
        F.when(F.col("attr_id").like("AGE%"), "INTEGER").otherwise(F.col("datatype")).alias("datatype"),
    )
    return constraints.check_violations({**held, "studies": studies, "clinical_attributes": attributes})


@query
def fk_violations(c):
    held = c.tables()
    return constraints.foreign_key_violations(
        {
            **held,
            "studies": held["studies"].filter("study_id <> 'st_1_f'"),
            "clinical_attributes": held["clinical_attributes"].filter("attr_id <> 'SEX'"),
            "patients": held["patients"].filter("patient_id NOT LIKE '%7'"),
            "samples": held["samples"].filter("sample_id NOT LIKE '%3'"),
        }
    )


@query
def clean_store(c):
    return constraints.all_violations(c.tables())


@query
def level_mismatch(c):
    by_attr = tables.level_mismatch(c.attribute_use(), "attr_id").withColumnRenamed("attr_id", "id")
    by_concept = tables.level_mismatch(c.attribute_use(), "harmonized_id").withColumnRenamed("harmonized_id", "id")
    return by_attr.withColumn("kind", F.lit("attribute")).unionByName(by_concept.withColumn("kind", F.lit("concept")))


@query
def quality_gates(c):
    return rounded(c.gates(), "value")


@query
def cohort_gates_open(c):
    """The checks for cohorts that the derived studies do have, at each of the four steps."""
    wanted = ["FIRST", "PENDING"]
    steps = {
        "listing": c.studies(),
        "size bound": c.candidate_studies(),
        "records": c.study_patients().select("study_id").distinct(),
        "deduplication": c.study_table(),
    }
    found = [
        gates.gate(cohort.missing_cohorts(s, wanted, LABELS), name, F.count("*"), 0, lambda v, b: v == b)
        for name, s in steps.items()
    ]
    return cohort.union_by_name(found)


# Model.


@query
def df_model(c):
    return c.df_model()


@query
def split_sizes(c):
    return c.df_split().groupBy("split", "os_event").agg(F.count("*").alias("n"))


@query
def fold_sizes(c):
    return c.train().groupBy(F.col("fold").cast("bigint").alias("fold"), "os_event").agg(F.count("*").alias("n"))


@query
def impute_median(c):
    medians = recipe.train_medians(c.train(), ["age"], _write(c))
    return recipe.impute(c.df_split(), medians).select("patient_key", "split", "age")


def _nominal(c: Cohort) -> list[str]:
    return [name for name in ("sex", "er_status") if name in c.df_split().columns]


@query
def pool_rare_levels(c):
    kept, _ = recipe.frequent_levels(c.train(), _nominal(c))
    return recipe.pool_levels(c.df_split(), kept).select("patient_key", "split", *_nominal(c))


@query
def dummies(c):
    fitted = _recipe(c)
    encoded = fitted.encode(c.df_split())
    return encoded.select("patient_key", *[n for n in encoded.columns if n.startswith(("sex_", "er_status_"))])


def _recipe(c: Cohort):
    if not hasattr(c, "recipe"):
        c.recipe = recipe.Recipe().fit(c.train())
    return c.recipe


@query
def features(c):
    fitted = _recipe(c)
    return fitted.encode(c.df_split()).select("patient_key", "split", "os_event", *fitted.features)


@query
def auc_of_score(c):
    auc = evaluate.roc_auc(_age_counts(c))
    return rounded(auc, "auc")


@query
def roc_points(c):
    return rounded(evaluate.roc_points(_age_counts(c)), "threshold", "sensitivity", "specificity")


def _age_counts(c: Cohort) -> DataFrame:
    counts = lambda: evaluate.score_counts(c.analytic_frame(), F.col("age"), F.col("os_event") == "1")
    return c.workspace.table("age_score_counts", counts)


def _rule():
    return F.when(F.col("age") >= 50, "1").otherwise("0")


@query
def accuracy_of_rule(c):
    return rounded(evaluate.accuracy(c.analytic_frame(), "os_event", _rule()), "accuracy")


@query
def confusion(c):
    return evaluate.confusion(c.analytic_frame(), "os_event", _rule())


@query
def majority_baseline(c):
    return rounded(evaluate.majority_share(c.test(), "os_event"), "majority_share")


# The forest: 500 trees in the tuning, the final fit and the importance.


def _tuned(c: Cohort) -> list:
    if not hasattr(c, "tuned"):
        points = forest.grid(len(_recipe(c).features))
        c.tuned = forest.tune(c.train(), points, c.workspace.path("tuning"))
    return c.tuned


def _final(c: Cohort) -> forest.Forest:
    """The fitted forest, as read back from its folder."""
    if not hasattr(c, "final"):
        mtry, min_n = _tuned(c)[0][:2]
        c.final = forest.fit_final(c.train(), mtry, min_n, c.workspace.path("forest"))
    return c.final


@query
def rf_grid(c):
    points = forest.grid(len(_recipe(c).features))
    listed = F.array(*[F.struct(F.lit(m).alias("mtry"), F.lit(n).alias("min_n")) for m, n in points])
    return c.train().agg(F.count("*").alias("n_train")).select(F.inline(listed), "n_train")


@query
def rf_tune(c):
    return rounded(forest.tuning_table(c.spark, _tuned(c)), "mean_auc", "std_err")


@query
def rf_fit(c):
    return _final(c).score(c.train()).groupBy("os_event", "predicted").agg(F.count("*").alias("n"))


def _scored(c: Cohort) -> DataFrame:
    """The test rows, scored once."""
    return c.workspace.table("rf_scored", lambda: _final(c).score(c.test()))


def _scored_counts(c: Cohort) -> DataFrame:
    event = F.col("os_event") == "1"
    return c.workspace.table(
        "rf_score_counts", lambda: evaluate.score_counts(_scored(c), F.col("score"), event)
    )


@query
def rf_predictions(c):
    return rounded(_scored(c), "score")


@query
def rf_reloaded(c):
    """Test rows scored by a forest that is read from its folder once more, beside the first scores."""
    again = forest.Forest(c.spark, _final(c).folder).score(c.test()).select("patient_key", F.col("score").alias("again"))
    same = F.col("score") == F.col("again")
    return _scored(c).join(again, "patient_key", "full").groupBy(F.coalesce(same, F.lit(False)).alias("same")).agg(F.count("*").alias("n"))


@query
def rf_metrics(c):
    auc = evaluate.roc_auc(_scored_counts(c)).select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    hits = evaluate.accuracy(_scored(c), "os_event", F.col("predicted"))
    return auc.unionByName(hits.select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")))


@query
def rf_roc(c):
    """The curve of class 0, the first class, as the published one."""
    counts = evaluate.score_counts(_scored(c), 1 - F.col("score"), F.col("os_event") == "0")
    return evaluate.roc_points(c.workspace.table("rf_roc_counts", lambda: counts))


@query
def rf_confusion(c):
    return evaluate.confusion(_scored(c), "os_event", F.col("predicted"))


def _out_of_bag(c: Cohort) -> DataFrame:
    return c.workspace.table("rf_out_of_bag", lambda: forest.out_of_bag(_final(c), c.train()))


@query
def rf_out_of_bag(c):
    """How the forest does on train rows, each scored by the batches that did not draw it."""
    counts = evaluate.score_counts(_out_of_bag(c), F.col("score"), F.col("os_event") == "1")
    auc = evaluate.roc_auc(c.workspace.table("rf_out_of_bag_counts", lambda: counts)).withColumnRenamed("auc", "roc_auc")
    hits = evaluate.accuracy(_out_of_bag(c), "os_event", F.col("predicted"))
    rows = _out_of_bag(c).agg(F.count("*").cast("double").alias("n_rows"), F.min("n_batches").cast("double").alias("least_batches"))
    return cohort.union_by_name([f.unpivot([], f.columns, "metric", "value") for f in (auc, hits, rows)])


@query
def perm_importance(c):
    """On out-of-bag rows: the test rows are used once, for the metrics."""
    return forest.permutation_importance(_final(c), c.train())


# Chart data.


@query
def heatmap_cells(c):
    return rounded(completeness.heatmap_cells(c.completeness_wide(), c.attr_coverage()), "completeness_pct")


@query
def age_box(c):
    return charts.box_stats(c.analytic_frame(), ["study_id", "os_event"], "age", _kept(c, "age_box_counts"))


@query
def age_hist(c):
    return charts.histogram(c.analytic_frame(), ["study_id", "os_event"], "age", 5)


@query
def mutation_hist(c):
    return rounded(charts.log_histogram(c.analytic_frame(), ["os_event"], "mutation_count"), "log10_bin")


@query
def age_density(c):
    curve = charts.density(c.analytic_frame(), ["study_id", "os_event"], "age", _kept(c, "age_density_counts"))
    return rounded(curve, "x", "width", "density")


@query
def mutation_density(c):
    """On the log10 scale, of positive counts."""
    logs = c.analytic_frame().filter("mutation_count > 0").withColumn("log10_count", F.log10("mutation_count"))
    curve = charts.density(logs, ["os_event"], "log10_count", _kept(c, "mutation_density_counts"))
    return rounded(curve, "x", "width", "density")
