"""Registered queries against their SQL twins, and the golden counts of FIXTURES.md."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect, types
from studyweave.plans import oracles
from studyweave.plans import queries as registry

SF = "/root/testdata/sf0.01"
QUERIES, SQL = registry.callables(), oracles.sql_texts()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    assert compare(frame, duck, SQL[name]) is None
    assert types(frame, duck, SQL[name]) == {}


def test_queries_without_sql_are_the_model_ones():
    assert sorted(set(QUERIES) - set(SQL)) == [
        "perm_importance", "rf_confusion", "rf_fit", "rf_metrics", "rf_out_of_bag", "rf_predictions", "rf_reloaded", "rf_roc", "rf_tune",
    ]


def test_golden_counts(spark):
    build = registry.build_for(spark, SF)
    assert build.records_in.count() == 92_715
    assert build.clinical_long().count() == 89_758
    copies = [r.n_studies for r in QUERIES["duplicate_audit"](spark, SF).collect()]
    assert (len(copies), max(copies)) == (1_498, 14)
    sizes = {r.study_id: r.n_patients for r in build.study_table().collect()}
    assert sizes == {"st_1_f": 722, "st_1_o": 201, "st_2_f": 104, "st_3_f": 364}
    assert build.kept_records().count() == 12_904
    trade = {r.n_vars: (r.n_studies, r.n_patients, r.information) for r in build.tradeoff().collect()}
    assert [trade[k] for k in range(1, 6)] == [(4, 1308, 1308), (4, 1308, 2616), (4, 1308, 3924), (2, 1020, 4080), (2, 1020, 5100)]
    assert build.predictors() == ["sex", "er_status", "age", "t_stage", "tumor_stage"]


def test_the_two_completeness_measures_agree(spark):
    build = registry.build_for(spark, SF)
    assert build.completeness_wide().exceptAll(build.completeness_long().select(build.completeness_wide().columns)).count() == 0


def test_model_queries(spark):
    table = QUERIES["rf_tune"](spark, SF).collect()
    assert len(table) == 16 and all(0.4 < r.mean_auc < 1 for r in table)
    metrics = {r.metric: r.value for r in QUERIES["rf_metrics"](spark, SF).collect()}
    assert metrics["roc_auc"] > 0.7 and metrics["accuracy"] > 0.6
    importance = {r.feature: r.importance for r in QUERIES["perm_importance"](spark, SF).collect()}
    assert max(importance, key=importance.get) == "age"
    n_test, n_train = (frame.count() for frame in (registry.build_for(spark, SF).test(), registry.build_for(spark, SF).train()))
    assert QUERIES["rf_predictions"](spark, SF).count() == n_test
    assert [tuple(r) for r in QUERIES["rf_reloaded"](spark, SF).collect()] == [(True, n_test)]
    left_out = {r.metric: r.value for r in QUERIES["rf_out_of_bag"](spark, SF).collect()}
    assert left_out["n_rows"] == n_train and left_out["least_batches"] >= 1
    assert abs(left_out["roc_auc"] - metrics["roc_auc"]) < 0.1


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0
    assert frame.columns[:3] == ["patient_key", "study_id", "cancer_type"]
    assert spark.table("v_analytic").count() == frame.count()
