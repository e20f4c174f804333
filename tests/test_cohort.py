"""Cohort steps on handwritten rows."""

import json

import pytest
from pyspark.sql import functions as F

from studyweave.operators import analytic, audit, charts, cohort, completeness, gates, harmonise, recipe, split, tables
from studyweave.sources import landed
from studyweave.workspace import Workspace, shared_folder


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_study_filter_survives_missing_texts(spark):
    listing = spark.createDataFrame(
        [("a", "Lung", "BRCA"), ("b", None, "luad"), ("c", "Male BREAST", None), ("d", None, None), ("e", "x", "breast")],
        "studyId string, name string, cancerTypeId string",
    )
    assert [r[0] for r in rows(cohort.filter_studies(listing))] == ["a", "c", "e"]


def test_keep_one_row_does_not_depend_on_order(spark):
    data = [("a", "2", "x"), ("a", "1", "y"), ("b", None, "z")]
    for order in (data, data[::-1]):
        frame = spark.createDataFrame(order, "k string, v string, w string")
        assert rows(cohort.keep_one_row(frame, ["k"])) == [("a", "1", "y"), ("b", None, "z")]


def test_primary_record_ties_and_unranked_studies(spark):
    pairs = spark.createDataFrame(
        [("s1", "p1", 1), ("s2", "p1", 1), ("s3", "p2", 1), ("s0", "p2", 1), ("s0", "p3", 1), ("s00", "p4", 1), ("s0", "p4", 1)],
        "study_id string, patient_id string, n_facts bigint",
    )
    richness = spark.createDataFrame([("s1", 4), ("s2", 4), ("s3", 1)], "study_id string, n_attrs bigint")
    got = {r.patient_id: r.study_id for r in cohort.primary_record(pairs, richness).collect()}
    assert got == {"p1": "s1", "p2": "s3", "p3": "s0", "p4": "s0"}


def test_patients_of_a_failing_study_are_dropped_not_reassigned(spark):
    pairs = spark.createDataFrame([("rich", "p1", 1), ("poor", "p1", 1), ("poor", "p2", 1)], "study_id string, patient_id string, n_facts bigint")
    richness = spark.createDataFrame([("rich", 9), ("poor", 1)], "study_id string, n_attrs bigint")
    primary = cohort.primary_record(pairs, richness)
    studies = spark.createDataFrame([("poor",)], "study_id string")
    assert [r.patient_id for r in cohort.of_studies(primary, studies).collect()] == ["p2"]


def test_patient_facts_keep_the_smallest_value(spark):
    data = [("s", "p", None, "SEX", v, "PATIENT", True) for v in ("b", "a")]
    records = spark.createDataFrame(
        data, "study_id string, patient_id string, sample_id string, attr_id string, value string, data_level string, listed boolean"
    )
    assert rows(completeness.patient_facts(completeness.attr_facts(harmonise.harmonise(records))).select("value")) == [("a",)]


def test_completeness_counts_rostered_patients_without_records(spark):
    facts = spark.createDataFrame(
        [("s", "p1", "A", "A", "x", True), ("s", "p2", "A", "A", None, True), ("s", "p9", "B", "B", "x", False)],
        "study_id string, patient_id string, attr_id string, harmonized_id string, value string, listed boolean",
    )
    roster = spark.createDataFrame([("s", f"p{i}") for i in range(1, 5)], "study_id string, patient_id string")
    got = {r.attr_id: (r.n_nonmissing, r.n_patients, r.completeness_pct) for r in completeness.completeness_wide(facts, roster).collect()}
    assert got == {"A": (2, 4, 50.0), "B": (0, 4, 0.0)}


def test_top_with_ties(spark):
    frame = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "k string, v double")
    assert [r.k for r in completeness.top_with_ties(frame, "v", 2).orderBy("k").collect()] == ["a", "b", "c"]


def test_text_maximum_in_the_view(spark):
    held = {
        "patient_clinical": spark.createDataFrame(
            [("s:p", "AGE", "9"), ("s:p", "AGE_AT_DIAGNOSIS", "80"), ("s:q", "OTHER", "x")],
            "patient_key string, attr_id string, value string",
        ),
        "patients": spark.createDataFrame([("s:p", "p", "s"), ("s:q", "q", "s")], "patient_key string, patient_id string, study_id string"),
        "study_attributes": spark.createDataFrame(
            [("s", "AGE", "AGE"), ("s", "AGE_AT_DIAGNOSIS", "AGE"), ("s", "OTHER", "OTHER")],
            "study_id string, attr_id string, harmonized_id string",
        ),
    }
    everyone = {r.patient_key: r.age for r in analytic.pat_wide(held).collect()}
    assert everyone == {"s:p": "9", "s:q": None}
    assert [r.patient_key for r in analytic.pat_wide(held, all_patients=False).collect()] == ["s:p"]


def test_numeric_if_safe(spark):
    data = [(str(i), "T2" if i == 0 else str(i), "x", None) for i in range(49)] + [("n/a", "3", "y", None)]
    frame = spark.createDataFrame(data, "almost string, mixed string, text string, nothing string")
    types = dict(analytic.numeric_if_safe(frame, 0.02).dtypes)
    assert types == {"almost": "string", "mixed": "string", "text": "string", "nothing": "string"}
    types = dict(analytic.numeric_if_safe(frame, 0.03).dtypes)
    assert types == {"almost": "double", "mixed": "double", "text": "string", "nothing": "string"}


def test_tradeoff(spark):
    avail = spark.createDataFrame(
        [("a", 1.0, 0.9, 0.0, 100), ("b", 1.0, 0.4, 0.8, 300)], "study_id string, u double, v double, w double, n bigint"
    )
    ranked = audit.variable_rank(avail, ["u", "v", "w"])
    table = audit.tradeoff(avail, ranked, ["u", "v", "w"])
    got = {r.n_vars: (r.variables, r.n_studies, r.n_patients, r.information) for r in table.collect()}
    assert got == {1: ("u", 2, 400, 400), 2: ("u, w", 1, 300, 600), 3: ("u, w, v", 0, 0, 0)}
    assert audit.best_tradeoff(table).first().n_vars == 2
    assert rows(audit.studies_meeting_all(avail, ["u", "w"])) == [("b", 300)]


def test_equal_information_takes_the_fewest_variables(spark):
    table = spark.createDataFrame([(1, 600), (2, 600), (3, 10)], "n_vars bigint, information bigint")
    assert audit.best_tradeoff(table).first().n_vars == 1


def test_model_frame_counts_unknown_as_a_level(spark):
    frame = spark.createDataFrame(
        [("k1", "0", "x", 1.0, None), ("k2", "1", None, 1.0, None)], "patient_key string, os_event string, t string, c double, e string"
    )
    model = split.model_frame(frame, ["t", "c", "e"])
    assert model.columns == ["patient_key", "os_event", "t"]
    assert rows(model.select("t")) == [("Unknown",), ("x",)]


def test_recipe_learns_from_train_only(spark):
    train = spark.createDataFrame(
        [(f"k{i}", "01"[i % 2], "a" if i < 60 else "b", float(i)) for i in range(99)] + [("k99", "0", "rare", None)],
        "patient_key string, os_event string, t string, x double",
    )
    test = spark.createDataFrame([("z1", "0", "new", None), ("z2", "1", "b", 5.0)], train.schema)
    model = recipe.Recipe().fit(train)
    assert model.medians == {"x": 49.0}
    assert model.kept == {"t": ["a", "b"]}
    assert model.features == ["x", "t_b", "t_other"]
    got = {r.patient_key: list(r.features.toArray()) for r in model.transform(test).collect()}
    assert got == {"z1": [49.0, 0.0, 1.0], "z2": [5.0, 1.0, 0.0]}


def test_box_stats(spark):
    frame = spark.createDataFrame([("g", float(x)) for x in [1, 2, 3, 4, 5, 100]], "g string, x double")
    box = charts.box_stats(frame, ["g"], "x", lambda counts: counts).first()
    assert (box.n, box.median, box.whisker_low, box.whisker_high, box.n_outliers) == (6, 3.5, 1.0, 5.0, 1)


def test_level_mismatch(spark):
    use = spark.createDataFrame(
        [("s1", "A", "PATIENT"), ("s2", "A", "SAMPLE"), ("s1", "B", "PATIENT"), ("s2", "A", "PATIENT")],
        "study_id string, attr_id string, data_level string",
    )
    assert rows(tables.level_mismatch(use, "attr_id")) == [("A", 2, 1)]


def test_gates_refuse(spark):
    frame = spark.range(5)
    closed = gates.gate(frame, "rows", F.count("*"), 10, lambda v, b: v > b)
    with pytest.raises(ValueError, match="rows"):
        gates.require(closed)
    gates.require(gates.gate(frame, "rows", F.count("*"), 4, lambda v, b: v > b))


# Landed files.


def test_flatten(spark):
    nested = spark.sql("SELECT 1 AS a, struct(2 AS b, struct('x' AS c) AS d) AS e")
    assert landed.flatten(nested).columns == ["a", "e.b", "e.d.c"]


def test_listing_pages(spark, tmp_path):
    (tmp_path / "p0.json").write_text(json.dumps([{"studyId": "a", "name": "A", "more": {"x": 1}}, {"studyId": "b"}]))
    (tmp_path / "p1.json").write_text("[]")
    expected = [("a", "A", None), ("b", None, None)]
    for multi_line in (True, False):
        studies, bad = landed.read_listing(spark, str(tmp_path), multi_line=multi_line)
        assert rows(studies) == expected
        assert bad.count() == 0


def test_truncated_listing_pages_are_set_aside(spark, tmp_path):
    (tmp_path / "p0.json").write_text(json.dumps([{"studyId": "a", "name": "A"}]))
    (tmp_path / "p1.json").write_text('[{"studyId": "b", "name"')
    for multi_line in (True, False):
        studies, bad = landed.read_listing(spark, str(tmp_path), multi_line=multi_line)
        assert rows(studies) == [("a", "A", None)]
        assert [r[0].strip() for r in bad.collect()] == ['[{"studyId": "b", "name"']


def test_unreadable_lines_are_set_aside(spark, tmp_path):
    folder = tmp_path / "study=s1"
    folder.mkdir()
    (folder / "r.json").write_text('{"patientId": "p1"}\n{"patientId": "p2", "studyId": "s9"}\n{"patientId": \n{"other": 1}\n')
    roster, bad = landed.read_roster(spark, str(tmp_path))
    assert rows(roster) == [("s1", "p1"), ("s9", "p2")]
    assert bad.count() == 2 and {r.study for r in bad.collect()} == {"s1"}


def test_clinical_variants(spark, tmp_path):
    for study, record in (
        ("s1", {"patientId": "p", "attrId": "AGE", "value": 50}),
        ("s2", {"patientId": "p", "sampleId": "x", "clinicalAttributeId": "GRADE", "value": " 2 ", "studyId": "s2"}),
        ("s3", {"patientId": "p", "sampleId": "x", "clinicalAttributeId": "SEX", "value": "NA", "dataLevel": "patient"}),
    ):
        (tmp_path / f"study={study}").mkdir()
        (tmp_path / f"study={study}" / "r.json").write_text(json.dumps(record))
    records, bad = landed.read_clinical(spark, str(tmp_path))
    assert rows(records) == [
        ("s1", "p", None, "AGE", "50", "PATIENT"),
        ("s2", "p", "x", "GRADE", " 2 ", "SAMPLE"),
        ("s3", "p", "x", "SEX", "NA", "patient"),
    ]
    assert rows(cohort.clean_records(records).select("study_id", "value")) == [("s1", "50"), ("s2", "2")]
    assert bad.count() == 0


def test_cache_is_built_once_and_filtered_to_current_studies(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("01", "p", "x"), ("02", "q", "y")], kind)

    kind = "study_id string, patient_id string, value string"
    studies = spark.createDataFrame([("01",)], "study_id string")
    folder = tmp_path / "cache"
    for _ in range(2):
        assert rows(landed.cached_records(spark, str(folder), build, studies, kind)) == [("01", "p", "x")]
    assert built == [1]
    (folder / "_SUCCESS").unlink()  # a write that was broken off
    assert rows(landed.cached_records(spark, str(folder), build, studies, kind)) == [("01", "p", "x")]
    assert built == [1, 1]


def test_recipe_is_a_pipeline_stage(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import RandomForestClassifier

    frame = lambda ages: spark.createDataFrame([(str(k), "01"[k % 2], a, "xy"[k % 2]) for k, a in enumerate(ages)], "patient_key string, os_event string, age double, sex string")
    train = frame([float(k % 9) for k in range(40)])
    steps = Pipeline(stages=[recipe.Recipe(threshold=0.1), RandomForestClassifier(numTrees=3, seed=1)])
    steps.write().save(str(tmp_path / "steps"))
    again = Pipeline.load(str(tmp_path / "steps"))
    assert again.getStages()[0].getOrDefault("threshold") == 0.1
    fitted = again.fit(train)
    fitted.write().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    one, two = ([(r.patient_key, list(r.features), r.prediction) for r in m.transform(train).collect()] for m in (fitted, loaded))
    assert one == two and len(one) == 40
    kept, model = loaded.stages[0], fitted.stages[0]
    assert (kept.medians, kept.levels, kept.features) == (model.medians, model.levels, model.features) and kept.features
    assert recipe.Recipe().fit(frame([100.0, 200.0, 300.0])).medians == {"age": 200.0}
    assert "label" not in kept.transform(train.drop("os_event")).columns


def _labelled(spark, sign, n=60):
    data = [(str(k), str(k % 2), float(sign * (k % 2) * (k % 7) + k % 5), "x", k // 2 % 2) for k in range(n)]
    return spark.createDataFrame(data, "patient_key string, os_event string, age double, sex string, fold int")


def test_each_tuning_scores_its_own_rows(spark, tmp_path):
    from studyweave.operators import forest

    means = [forest.tune(_labelled(spark, sign), [(1, 1)], str(tmp_path / str(sign)), n_trees=3, n_folds=2)[0][2] for sign in (1, -1)]
    assert means[0] != means[1]


def test_tuning_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    from studyweave.operators import forest

    train, points, grown = _labelled(spark, 1), [(1, 1), (1, 9)], []
    make = forest.classifier

    def counted(*given, **named):
        grown.append(given)
        return make(*given, **named)

    monkeypatch.setattr(forest, "classifier", counted)
    run = lambda folder: forest.tune(train, points, str(tmp_path / folder), n_trees=5, n_folds=2, batch=2)
    first = run("a")
    assert len(grown) == 2 * 2 * 3 and sorted({g[0] for g in grown}) == [1, 2]
    (tmp_path / "a/votes/fold=1/point=1_9/batch=2/_SUCCESS").unlink()  # a write that was broken off
    (tmp_path / "a/counts/_SUCCESS").unlink()
    assert run("a") == first
    assert len(grown) == 13
    assert run("b") == first  # and every run gives the same


def test_batches_grown_together_fill_the_cores_and_hold_bounded_rows(spark):
    from studyweave.operators import forest

    cores = spark.sparkContext.defaultParallelism
    assert forest.at_once(spark, 40_000, 250) == max(forest.PARALLELISM, min(2 * cores, forest.MOST)) > cores
    assert forest.at_once(spark, 400_000, 250) == forest.at_once(spark, 10**9, 250) == forest.PARALLELISM


def test_forest_of_batches_is_read_back_and_repeats(spark, tmp_path):
    from studyweave.operators import forest

    train, scores = _labelled(spark, 1, 200), []
    for folder in ("a", "b", "a"):
        model = forest.fit_final(train, 1, 5, str(tmp_path / folder), n_trees=23, batch=5)
        assert model.n_trees == 23 and len(model.models) == 5
        scores.append({r.patient_key: r.score for r in model.score(train).collect()})
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 200
    assert {r.patient_key: r.score for r in forest.Forest(spark, str(tmp_path / "a")).score(train).collect()} == scores[0]


def test_no_tree_is_wrapped_unless_asked_for(spark, tmp_path, monkeypatch):
    from pyspark.ml import classification

    from studyweave.operators import forest

    wrapped, make = [], classification.DecisionTreeClassificationModel

    def counted(tree):
        wrapped.append(tree)
        return make(tree)

    monkeypatch.setattr(classification, "DecisionTreeClassificationModel", counted)
    train = _labelled(spark, 1, 200)
    forest.tune(train, [(1, 1)], str(tmp_path / "t"), n_trees=4, n_folds=2, batch=2)
    model = forest.fit_final(train, 1, 5, str(tmp_path / "f"), n_trees=6, batch=3)
    forest.out_of_bag(model, train).count()
    forest.permutation_importance(model, train, n_repeats=2).count()
    assert wrapped == []
    assert [len(m.trees) for m in model.models] == [m.getNumTrees for m in model.models] == [3, 3]
    assert all(tree.numNodes >= 1 for m in model.models for tree in m.trees)


def test_draws_are_those_of_a_sample_with_replacement(spark):
    from studyweave.operators import forest

    counts = spark.range(20000).select(forest.draws(F.col("id").cast("string"), 42, 3).alias("n")).groupBy("n").count().collect()
    share = {r.n: r["count"] / 20000 for r in counts}
    assert abs(share[0] - 0.3679) < 0.015 and abs(share[1] - 0.3679) < 0.015 and abs(share[2] - 0.1839) < 0.015
    assert abs(sum(n * s for n, s in share.items()) - 1) < 0.03


def test_out_of_bag_rows_and_importance(spark, tmp_path):
    from studyweave.operators import forest

    train = _labelled(spark, 1, 200)
    model = forest.fit_final(train, 1, 2, str(tmp_path / "f"), n_trees=40, batch=2)
    left_out = {r.patient_key: r for r in forest.out_of_bag(model, train).collect()}
    assert len(left_out) == 200 and all(1 <= r.n_batches < 20 and 0 <= r.score <= 1 for r in left_out.values())
    drawn = {r.patient_key for r in train.filter(forest.draws(F.col("patient_key"), 42, 7) > 0).collect()}
    votes = spark.read.parquet(str(tmp_path / "f/out_of_bag/batch=7")).collect()
    assert drawn | {r.patient_key for r in votes} == set(left_out) and not drawn & {r.patient_key for r in votes}
    # against the same sums over rows collected here
    found = {r.feature: (r.importance, r.n_batches) for r in forest.permutation_importance(model, train, n_repeats=2).collect()}
    assert set(found) == set(model.recipe.features) and all(n == 20 for _, n in found.values())
    assert found["age"][0] > 0.05
    hits = spark.read.parquet(str(tmp_path / "f/importance/hits/batch=7")).filter("variant = -1").first().accuracy
    right = [(r.votes / r.trees > 0.5) == (r.os_event == "1") for r in votes]
    assert abs(hits - sum(right) / len(right)) < 1e-9


def test_closed_workspace_leaves_nothing(spark, tmp_path):
    work = Workspace(spark, str(tmp_path))
    work.table("t", lambda: spark.range(3))
    work.close()
    assert list(tmp_path.iterdir()) == []


def test_null_keys_break_a_primary_key_only(spark):
    from studyweave.operators import constraints

    frame = spark.createDataFrame([(None,), ("a",), ("a",), ("b",)], "k string")
    assert constraints._repeats(frame, ("k",), True).first().n == 2
    assert constraints._repeats(frame, ("k",), False).first().n == 1


def test_workspace_writes_a_stage_once(spark, tmp_path):
    work, built = Workspace(spark, str(tmp_path)), []

    def build():
        built.append(1)
        return spark.range(3)

    assert work.table("t", build).count() == 3 and work.table("t", build).count() == 3
    assert work.rows("t") == 3 and built == [1]


def test_shared_folder_follows_the_session(spark):
    set_folder = spark.conf.get("spark.checkpoint.dir", None)
    if set_folder:
        assert shared_folder(spark) == set_folder
    else:
        assert shared_folder(spark).startswith("file:/")
