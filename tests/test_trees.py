"""Trees grown in a task, against plain recursion and against Spark's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from studyweave.operators import forest, trees


def _table(n, seed=1):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, 4))
    values[:, 2] = values[:, 2] > 0.3
    label = (values[:, 0] + values[:, 2] + rng.normal(size=n) > 0.5).astype(float)
    cuts = [trees.thresholds(*np.unique(values[:, k], return_counts=True)) for k in range(4)]
    return trees.binned(values, cuts), label, np.array([len(cut) + 1 for cut in cuts])


def _plain(rows, label, times, n_bins, min_n):
    """A function that answers for a row: one tree over all features, split by split."""
    n, events = times.sum(), (times * label).sum()
    found = (events * (n - events) / n - 1e-9, None)
    for k in range(rows.shape[1]):
        for cut in range(n_bins[k] - 1):
            sides = [times * side for side in (rows[:, k] <= cut, rows[:, k] > cut)]
            if min(side.sum() for side in sides) >= min_n:
                loss = sum((side * label).sum() * (side * (1 - label)).sum() / side.sum() for side in sides)
                found = min(found, (loss, (k, cut)), key=lambda x: x[0])
    share, split = events / n, found[1]
    if split is None:
        return (lambda row: share), int(share > 0.5)
    k, cut = split
    (low, one), (high, other) = (_plain(rows, label, times * side, n_bins, min_n) for side in (rows[:, k] <= cut, rows[:, k] > cut))
    if one == other and one is not None:  # sisters that predict the same are one leaf
        return (lambda row: share), one
    return (lambda row: low(row) if row[k] <= cut else high(row)), None


@pytest.mark.parametrize("min_n", [1, 4, 15])
def test_a_tree_is_that_of_plain_recursion(min_n):
    rows, label, n_bins = _table(120)
    for seed in [(3, k) for k in range(4)]:
        answer, _ = _plain(rows, label, np.random.default_rng(seed).poisson(1.0, len(rows)), n_bins, min_n)
        got = trees.votes(rows, label, rows, n_bins, [seed], 4, [min_n])[0]
        assert np.allclose(got, [answer(row) for row in rows])


def test_trees_grown_together_are_those_grown_alone(monkeypatch):
    rows, label, n_bins = _table(400)
    seeds, min_ns = [(5, k) for k in range(7)], [2, 9, 30]
    together = trees.votes(rows, label, rows, n_bins, seeds, 2, min_ns)
    monkeypatch.setattr(trees, "TOGETHER", 1)
    alone = [sum(trees.votes(rows, label, rows, n_bins, [seed], 2, [min_n])[0] for seed in seeds) for min_n in min_ns]
    assert np.allclose(together, alone) and not np.allclose(together[0], together[2])
    shallow = trees.votes(rows, label, rows, n_bins, seeds[:1], 4, [1], max_depth=1)[0]
    assert len(set(shallow)) <= 2


def test_thresholds_lie_between_values_or_part_the_rows_evenly():
    assert trees.thresholds(np.array([1.0, 2.0, 4.0]), np.array([5, 1, 1])) == [1.5, 3.0]
    assert trees.thresholds(np.array([7.0]), np.array([3])) == []
    even = trees.thresholds(np.arange(1000.0), np.ones(1000))
    assert len(even) == 31 and np.allclose(np.diff(even), 1000 / 32, atol=1.01)
    assert len(trees.thresholds(np.arange(100.0), np.r_[10_000, np.ones(99)])) <= 31
    assert trees.binned(np.array([[1.5], [1.6], [9.0]]), [[1.5, 3.0]]).ravel().tolist() == [0, 1, 2]


def _train(spark, n=1500):
    rng = np.random.default_rng(4)
    age, other, noise = rng.normal(60, 12, n), rng.normal(size=n), rng.normal(size=n)
    event = (age / 12 + other + noise > 5).astype(int)
    data = [(f"p{k:05d}", str(event[k]), float(age[k]), float(other[k]), "xyz"[k % 3], k % 3) for k in range(n)]
    return spark.createDataFrame(data, "patient_key string, os_event string, age double, other double, sex string, fold int")


def test_tuning_of_rows_that_a_task_can_hold_grows_whole_trees_in_tasks(spark, tmp_path, monkeypatch):
    train, points = _train(spark), [(1, 5), (1, 40), (2, 5), (2, 40)]
    monkeypatch.setattr(forest, "IN_A_TASK", 0)
    by_spark = forest.tune(train, points, str(tmp_path / "spark"), n_trees=60, n_folds=3, batch=30)

    def no_fit(*_):
        raise AssertionError("Spark's level by level passes over a few rows")

    monkeypatch.undo()
    monkeypatch.setattr(forest.TreeGrower, "fit", no_fit)
    in_tasks = forest.tune(train, points, str(tmp_path / "tasks"), n_trees=60, n_folds=3, batch=30)
    one, other = ({x[:2]: x[2] for x in found} for found in (by_spark, in_tasks))
    assert set(one) == set(other) == set(points) and all(abs(one[p] - other[p]) < 0.01 for p in points)
    votes = [spark.read.parquet(str(tmp_path / folder / "votes")).groupBy("point", "patient_key").agg(F.sum("votes").alias("n")) for folder in ("spark", "tasks")]
    both = votes[0].join(votes[1].withColumnRenamed("n", "m"), ["point", "patient_key"]).agg(F.corr("n", "m"), F.count("*"), F.max("m")).first()
    assert both[0] > 0.98 and both[1] == 4 * 1500 and both[2] <= 60


def test_final_fit_of_rows_that_a_task_can_hold_grows_whole_trees_in_tasks(spark, tmp_path, monkeypatch):
    train = _train(spark)
    scored = lambda model: {r.patient_key: r.score for r in model.score(train).collect()}
    left_out = lambda model: {r.patient_key: r.score for r in forest.out_of_bag(model, train).collect()}
    losses = lambda model: {r.feature: r.importance for r in forest.permutation_importance(model, train, n_repeats=2).collect()}
    monkeypatch.setattr(forest, "IN_A_TASK", 0)
    by_spark = forest.fit_final(train, 2, 10, str(tmp_path / "spark"), n_trees=60, batch=6)
    one = [get(by_spark) for get in (scored, left_out, losses)]
    monkeypatch.undo()
    monkeypatch.setattr(forest.TreeGrower, "fit", None)  # no passes of Spark's over a few rows
    in_tasks = forest.fit_final(train, 2, 10, str(tmp_path / "tasks"), n_trees=60, batch=6)
    assert [m.getNumTrees for m in in_tasks.models] == [len(m.trees) for m in in_tasks.models] == [6] * 10
    other = [get(in_tasks) for get in (scored, left_out, losses)]
    for a, b in zip(one[:2], other):
        assert set(a) == set(b) and np.corrcoef([a[k] for k in a], [b[k] for k in a])[0, 1] > 0.97
    assert set(one[2]) == set(other[2]) and all(abs(one[2][f] - other[2][f]) < 0.03 for f in one[2])
    # what broke off is grown again, and gives the same
    (tmp_path / "tasks/trees/batch=3/_SUCCESS").unlink()
    (tmp_path / "tasks/out_of_bag/batch=3/_SUCCESS").unlink()
    again = forest.fit_final(train, 2, 10, str(tmp_path / "tasks"), n_trees=60, batch=6)
    assert scored(again) == other[0] and left_out(again) == other[1]


def test_stored_trees_answer_as_those_in_growth():
    rows, label, n_bins = _table(300)
    cuts = [[c + 0.5 for c in range(n - 1)] for n in n_bins]  # a bin's number stands for its values
    seeds, times = [(8, k) for k in range(5)], np.random.default_rng(0).poisson(1.0, 300)
    nodes = trees.forest(rows, label, times, cuts, seeds, 2, 3)
    inner = nodes["feature"] >= 0
    assert (nodes["tree"][nodes["left"][inner]] == nodes["tree"][inner]).all() and nodes["tree"][:5].tolist() == [0, 1, 2, 3, 4]
    drawn = trees._grown(rows, label, [times] * 5, rows, n_bins, seeds, 2, [3], 30)
    assert np.allclose(trees.answers(nodes, 5, rows.astype(float)), trees._answers(drawn[0], drawn[1], drawn[3], 300)[0])
