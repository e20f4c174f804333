"""The paths taken for large or skewed input, forced on small input, against brute force."""

import random
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyweave.operators import cohort, evaluate, forest, joins, ordered, split


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def skewed(spark):
    """A third of the facts has one key; many of them are copies of one row."""
    data = [("hot", i % 7) for i in range(400)] + [(f"k{i % 300}", i) for i in range(800)] + [("lone", 1)]
    return spark.createDataFrame(data, "key string, value int").repartition(5)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(spark, skewed, how):
    names = [("hot", 1), *[(f"k{i}", i) for i in range(0, 300, 2)], ("absent", 9)]
    keyed = spark.createDataFrame(names, "key string, tag int")
    weights = skewed.groupBy("key").agg(F.count("*").alias("_rows"))
    for limit in (1, 50, 10**6):
        split_rows = joins.split_join(skewed, keyed, ["key"], weights, how, rows_per_task=limit)
        assert rows(split_rows) == rows(skewed.join(keyed, "key", how))
    lookup = joins.lookup_join(skewed, keyed, ["key"], how, limit=10, rows_per_task=50)
    assert rows(lookup) == rows(skewed.join(keyed, "key", how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_with_a_heavy_missing_key(spark, skewed, how):
    facts = skewed.withColumn("key", F.when(F.col("key") != "hot", F.col("key")))
    keyed = spark.createDataFrame([(None, 1), ("k1", 2), ("lone", 3)], "key string, tag int")
    weights = facts.groupBy("key").agg(F.count("*").alias("_rows"))
    assert rows_of(joins.split_join(facts, keyed, ["key"], weights, how, 50)) == rows_of(facts.join(keyed, "key", how))


def test_copies_of_one_fact_are_spread(spark):
    facts = spark.range(0, 4000, 1, 4).select(F.lit("hot").alias("key"), F.lit(1).alias("value"))
    keyed = spark.createDataFrame([("hot", 1)], "key string, tag int")
    weights = facts.groupBy("key").agg(F.count("*").alias("_rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.split_join(facts, keyed, ["key"], weights, rows_per_task=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 1500


@pytest.mark.parametrize("rows_per_task", [10**6, 40, 7])
def test_running_totals(spark, rows_per_task):
    random.seed(1)
    points = {(g, random.randint(0, 150)) for g in "aab" for _ in range(120)}
    data = [(g, float(x), random.randint(1, 9)) for g, x in points]
    frame = spark.createDataFrame(data, "g string, x double, n int")
    got = ordered.running_totals(frame, ["g"], "x", ["n"], rows_per_task=rows_per_task)
    want = frame.withColumn("cum_n", F.sum("n").over(W.partitionBy("g").orderBy("x")))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("rows_per_task", [10**6, 60, 9])
def test_digest_rank(spark, rows_per_task):
    frame = spark.range(400).select((F.col("id") % 3 == 0).alias("g"), F.md5(F.col("id").cast("string")).alias("d"))
    got = ordered.digest_rank(frame, ["g"], "d", "place", rows_per_task=rows_per_task)
    want = frame.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy("d")).cast("bigint"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("rows_per_task", [10**6, 11])
def test_exact_quantiles(spark, rows_per_task):
    random.seed(2)
    groups = {"a": [random.randint(0, 60) / 2 for _ in range(301)], "b": [1.0, 2.0, 3.0, 10.0], "c": [5.0]}
    data = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("d", None)]
    frame = spark.createDataFrame(data, "g string, x double")
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "high": 1.0}
    got = {r.g: r for r in ordered.exact_quantiles(frame, ["g"], "x", shares, rows_per_task=rows_per_task).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].mid == pytest.approx(statistics.median(xs))
        assert (got[g].low, got[g].high) == (min(xs), max(xs))
    q1 = statistics.quantiles(groups["a"], n=4, method="inclusive")[0]
    assert got["a"].q1 == pytest.approx(q1)
    assert got["b"].mid == 2.5


@pytest.mark.parametrize("rows_per_task", [10**6, 15])
def test_roc_and_auc(spark, rows_per_task):
    random.seed(3)
    data = [(random.randint(0, 80) / 100, random.random() < 0.4) for _ in range(500)]
    frame = spark.createDataFrame(data, "score double, hit boolean")
    counts = evaluate.score_counts(frame, F.col("score"), F.col("hit")).cache()
    pos = [s for s, h in data if h]
    neg = [s for s, h in data if not h]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert evaluate.roc_auc(counts, rows_per_task=rows_per_task).first().auc == pytest.approx(wins)
    points = evaluate.roc_points(counts, rows_per_task).collect()
    assert [(p.sensitivity, p.specificity) for p in points if p.threshold is None] == [(0.0, 1.0)]
    points = [p for p in points if p.threshold is not None]
    assert len(points) == len({s for s, _ in data})
    for p in points:
        assert p.sensitivity == pytest.approx(sum(s >= p.threshold for s in pos) / len(pos))
        assert p.specificity == pytest.approx(sum(s < p.threshold for s in neg) / len(neg))


@pytest.mark.parametrize("rows_per_task", [10**6, 30])
def test_split_is_stratified_and_stable(spark, rows_per_task):
    frame = spark.range(500).select(
        F.concat(F.lit("p"), "id").alias("patient_key"), F.when(F.col("id") % 3 == 0, "1").otherwise("0").alias("os_event")
    )
    one = split.stratified_split(frame, rows_per_task=rows_per_task)
    two = split.stratified_split(frame.repartition(7), rows_per_task=10**6)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    sizes = {(r.os_event, r.split): r["count"] for r in one.groupBy("os_event", "split").count().collect()}
    assert sizes == {("1", "train"): 133, ("1", "test"): 34, ("0", "train"): 266, ("0", "test"): 67}
    folds = [r["count"] for r in one.filter("split = 'train' and os_event = '1'").groupBy("fold").count().collect()]
    assert len(folds) == 5 and max(folds) - min(folds) <= 1
    other = split.stratified_split(frame, seed=43).filter("split = 'test'").select("patient_key")
    assert other.exceptAll(one.filter("split = 'test'").select("patient_key")).count() > 0


@pytest.mark.parametrize("rows_per_task", [10**6, 20])
def test_every_row_is_a_donor_once(spark, rows_per_task):
    frame = spark.range(200).select(F.concat(F.lit("p"), "id").alias("patient_key"), F.col("id").cast("double").alias("x"))
    got = forest.donors(frame, ["x"], 1, 200, rows_per_task).collect()
    assert sorted(r.donor.x for r in got) == sorted(r.x for r in got) == [float(i) for i in range(200)]
    assert sum(r.x != r.donor.x for r in got) > 150


def test_records_of_splits_a_heavy_patient(spark):
    data = [("s1", "p1", i % 3) for i in range(600)] + [("s2", f"p{i}", i) for i in range(1, 50)]
    records = spark.createDataFrame(data, "study_id string, patient_id string, n int").repartition(4)
    pairs = cohort.patient_weights(records)
    richness = spark.createDataFrame([("s1", 5), ("s2", 3)], "study_id string, n_attrs bigint")
    kept = cohort.primary_record(pairs, richness)
    split_rows = cohort.records_of(records, kept, limit=1, rows_per_task=100)
    assert rows(split_rows) == rows(cohort.records_of(records, kept))
    assert split_rows.count() == 600 + 48
