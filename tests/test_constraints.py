"""Keys and checks: planted violations are found, clean tables have none."""

import pytest
from pyspark.sql import functions as F

from studyweave.operators import constraints
from studyweave.sources import store

DDL = {
    "studies": "study_id string, study_name string, cancer_type string, n_patients int",
    "clinical_attributes": "attr_id string, data_level string, datatype string",
    "study_attributes": "study_id string, attr_id string, harmonized_id string, patient_completeness_pct double",
    "patients": "patient_key string, patient_id string, study_id string",
    "samples": "sample_key string, sample_id string, patient_key string",
    "patient_clinical": "patient_key string, attr_id string, value string",
    "sample_clinical": "sample_key string, attr_id string, value string",
    "outcomes": "patient_key string, os_status string, os_months string",
}
ROWS = {
    "studies": [("s1", "S1", "c", 2), ("s2", "S2", "c", 1)],
    "clinical_attributes": [("AGE", "PATIENT", "NUMBER"), ("SIZE", "SAMPLE", "STRING")],
    "study_attributes": [("s1", "AGE", "AGE", 50.0), ("s2", "SIZE", "SIZE", None)],
    "patients": [("s1:a", "a", "s1"), ("s1:b", "b", "s1"), ("s2:c", "c", "s2")],
    "samples": [("s1:x", "x", "s1:a"), ("s2:y", "y", "s2:c")],
    "patient_clinical": [("s1:a", "AGE", "40"), ("s1:b", "AGE", None)],
    "sample_clinical": [("s1:x", "SIZE", "3"), ("s2:y", "SIZE", "4")],
    "outcomes": [("s1:a", "0:LIVING", "3"), ("s2:c", None, "5")],
}


@pytest.fixture
def clean(spark):
    return {name: spark.createDataFrame(rows, DDL[name]) for name, rows in ROWS.items()}


def found(report):
    return {(r.tbl, r.rule): r.n_violations for r in report.collect() if r.n_violations}


def plus(tables, name, row):
    frame = tables[name]
    return {**tables, name: frame.unionByName(frame.sparkSession.createDataFrame([row], DDL[name]))}


def test_clean_tables_have_no_violation(clean):
    report = constraints.all_violations(clean)
    assert report.filter("n_violations > 0").count() == 0
    kinds = {r["kind"]: r["count"] for r in report.groupBy("kind").count().collect()}
    assert kinds == {"primary key": 8, "unique": 1, "not null": 21, "check": 3, "foreign key": 9}


def test_planted_violations_are_found(clean):
    doubled = plus(clean, "patient_clinical", ("s1:a", "AGE", "41"))
    assert found(constraints.primary_key_violations(doubled)) == {("patient_clinical", "patient_key, attr_id"): 1}
    twice = plus(clean, "patients", ("other", "a", "s1"))
    assert found(constraints.unique_violations(twice)) == {("patients", "study_id, patient_id"): 1}
    holed = plus(clean, "studies", ("s3", None, "c", 1))
    assert found(constraints.not_null_violations(holed)) == {("studies", "study_name"): 1}
    wrong = plus(plus(clean, "clinical_attributes", ("X", "patient", "DATE")), "studies", ("s3", "n", "c", -1))
    assert found(constraints.check_violations(wrong)) == {
        ("clinical_attributes", "data_level"): 1,
        ("clinical_attributes", "datatype"): 1,
        ("studies", "n_patients"): 1,
    }
    orphan = plus(plus(clean, "samples", ("s9:z", "z", "s9:q")), "sample_clinical", ("s1:x", "GONE", "1"))
    assert found(constraints.foreign_key_violations(orphan)) == {
        ("samples", "patient_key -> patients(patient_key)"): 1,
        ("sample_clinical", "attr_id -> clinical_attributes(attr_id)"): 1,
    }


def test_delete_cascades_to_grandchildren(clean):
    left = constraints.cascade_delete(clean, "studies", F.col("study_id") == "s2")
    sizes = {r.tbl: r.n_rows for r in constraints.table_sizes(left).collect()}
    assert sizes == {
        "studies": 1, "clinical_attributes": 2, "study_attributes": 1, "patients": 2,
        "samples": 1, "patient_clinical": 2, "sample_clinical": 1, "outcomes": 1,
    }
    assert constraints.foreign_key_violations(left).filter("n_violations > 0").count() == 0


def test_store_round_trip_and_refusal(spark, clean, tmp_path):
    folder = str(tmp_path / "store")
    store.write_store(clean, folder)
    back = store.read_store(spark, folder)
    for name in ROWS:
        assert sorted(map(str, back[name].collect())) == sorted(map(str, clean[name].collect()))
    columns = {(r.tbl, r.name): (r.type, r.required) for r in store.table_columns(back).collect()}
    assert columns[("studies", "n_patients")] == ("int", True)
    assert columns[("outcomes", "os_status")] == ("string", False)
    keys = {r.tbl: (r.primary_key, r.foreign_keys) for r in store.key_summary(back).collect()}
    assert keys["study_attributes"] == (
        "study_id, attr_id",
        "study_id -> studies(study_id); attr_id -> clinical_attributes(attr_id)",
    )
    assert keys["studies"] == ("study_id", "")
    bare = {name: spark.createDataFrame(frame.rdd, "`" + "` string, `".join(frame.columns) + "` string") if name == "samples" else frame for name, frame in back.items()}
    assert {r.tbl: r.primary_key for r in store.key_summary(bare).collect()}["samples"] == ""  # the files say so, not the library
    with pytest.raises(ValueError, match="patient_clinical"):
        store.write_store(plus(clean, "patient_clinical", ("nobody", "AGE", "1")), folder)
