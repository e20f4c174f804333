"""Random forests in batches: grid, cross-validated tuning, final fit, scores, permutation importance.

A forest is grown batch by batch, each with a seed of its own, and the votes of the batches add up. What a
batch gives is written at once, so a run that broke off goes on where it was if it gets the same folder again.
The folder belongs to one set of rows and parameters.

In the final forest a batch draws its rows by a hash of key and batch: a row is drawn 0, 1, 2 .. times, 1 on average,
as when rows are drawn with replacement. The rows that a batch did not draw are known for ever, as its out-of-bag
rows; over the batches each row is one of these many times.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from itertools import groupby
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import mark_whole, ship, written_whole
from . import trees as local
from .evaluate import roc_auc, score_counts
from .joins import ROWS_PER_TASK
from .ordered import digest_rank
from .recipe import Recipe, RecipeModel
from .split import KEY, LABEL, shuffle_digest

#: Batches that are grown at the same time: at least and at most. Each holds its own trees only.
PARALLELISM, MOST = 8, 24
#: Rows times trees that batches beyond the least number may hold together on the executors, at about 12 bytes each.
HELD = 500_000_000
#: Bytes of a fold's rows up to which a task of the tuning holds them all, at one for each bin and ROW_BYTES for the trees in growth.
IN_A_TASK, ROW_BYTES = 200_000_000, 160
#: Trees of one such task: few, so that no core waits long for the last.
TREES_PER_TASK = 125
OWN = -1  # the variant of a row with all values its own


def _levels(low: float, high: float, n: int) -> list[int]:
    """n whole numbers spread evenly over a range, repeats dropped."""
    return sorted({math.floor(low + (high - low) * i / (n - 1)) for i in range(n)})


def grid(n_features: int, levels: int = 4) -> list[tuple[int, int]]:
    """Regular grid of (mtry, min_n)."""
    widest = max(3, math.isqrt(n_features) + 3)
    return [(m, n) for m in _levels(2, widest, levels) for n in _levels(5, 40, levels)]


class GrownTrees(RandomForestClassificationModel):
    """Spark's model, which wraps its trees for Python only when they are asked for.

    A model looks through its own attributes for parameters. It passes over properties, but not over the cached one that its
    class has for `trees`; so each fit, load and copy would wrap every tree by hundreds of calls, longer than they take to grow.
    """

    @property
    def trees(self) -> list:
        return [DecisionTreeClassificationModel(tree) for tree in self._call_java("trees")]

    @classmethod
    def load(cls, path: str) -> GrownTrees:
        model = cls(RandomForestClassificationModel.read()._jread.load(path))
        model._transfer_params_from_java()
        return model


class TreeGrower(RandomForestClassifier):
    """Spark's classifier, which gives `GrownTrees`."""

    def _create_model(self, java_model) -> GrownTrees:
        return GrownTrees(java_model)


def classifier(
    n_trees: int, mtry: int, min_n: int, seed: int, bootstrap: bool = True, max_depth: int = 30
) -> TreeGrower:
    """Where each row stands in the trees is kept; else the trees are sent along with every step, and the time
    grows faster than their number."""
    return TreeGrower(
        numTrees=n_trees,
        featureSubsetStrategy=str(mtry),
        minInstancesPerNode=min_n,
        maxDepth=max_depth,
        seed=seed,
        bootstrap=bootstrap,
        maxMemoryInMB=1024,
        cacheNodeIds=True,
    )


class TreesOfTasks:
    """The trees of a batch that a task has grown."""

    def __init__(self, nodes: Broadcast, n_trees: int):
        self.nodes, self.getNumTrees = nodes, n_trees

    @property
    def trees(self) -> list[Tree]:
        return [Tree(int(n)) for n in np.bincount(self.nodes.value["tree"], minlength=self.getNumTrees)]


class Tree(NamedTuple):
    numNodes: int


def _ballot(models: list[TreesOfTasks], features: Column, batch: Column | None = None) -> Column:
    """The summed votes of all trees, or of a batch, for features in an array."""
    all_nodes, n_trees = [m.nodes for m in models], [m.getNumTrees for m in models]

    @F.arrow_udf("double")
    def votes(values: pa.Array, batch: pa.Array) -> pa.Array:
        plain, batch = values.flatten().to_numpy().reshape(len(values), -1), batch.to_numpy()
        out = np.zeros(len(plain))
        for k, nodes in enumerate(all_nodes):
            rows = np.flatnonzero((batch == k) | (batch < 0))
            out[rows] += local.answers(nodes.value, n_trees[k], plain[rows])
        return pa.array(out)

    return votes(features, F.lit(-1) if batch is None else batch)


def batches(n_trees: int, size: int) -> list[tuple[int, int]]:
    """(number, trees) of the batches of a forest."""
    return [(k, min(size, n_trees - k * size)) for k in range(math.ceil(n_trees / size))]


def draws(key: Column, seed: int, batch: Column | int) -> Column:
    """How often a batch draws a row: a Poisson number with mean 1, made from a hash."""
    batch = batch if isinstance(batch, Column) else F.lit(batch)
    share = F.pmod(F.xxhash64(key, F.lit(seed), batch), F.lit(1 << 40)) / F.lit(float(1 << 40))
    bounds, total = [], 0.0
    for k in range(12):  # beyond, the chance is under 1e-9
        total += math.exp(-1) / math.factorial(k)
        bounds.append(total)
    return reduce(lambda a, b: a + b, [(share >= bound).cast("int") for bound in bounds])


def at_once(spark: SparkSession, n_rows: int = 0, trees: int = 1) -> int:
    """How many batches of so many trees to grow together: two for each core, as a batch of few rows is one task at a time and
    the driver works between its steps."""
    room = HELD // max(1, n_rows * trees)
    return max(PARALLELISM, min(2 * spark.sparkContext.defaultParallelism, room, MOST))


def _at_once(spark: SparkSession, work, jobs: Iterable, parallelism: int) -> list:
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(spark)(work), list(jobs), 1)


def _written(spark: SparkSession, path: str, build) -> DataFrame:
    """The frame at a path, which is written unless it is there."""
    if not written_whole(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _score(votes: Column, trees: Column | int) -> Column:
    """The share of the votes. Sums differ by their order in the last digits, which would part equal scores."""
    return F.round(votes / trees, 9)


def _in_order(rows: DataFrame, n_rows: int, rows_per_task: int = 250_000) -> DataFrame:
    """The rows in partitions and an order that follow from their keys and number alone, as trees depend on both."""
    return rows.repartition(max(1, math.ceil(n_rows / rows_per_task)), KEY).sortWithinPartitions(KEY)


def _written_parts(spark: SparkSession, path: str, parts: list, build, at=lambda k: f"batch={k}", by=("batch",)) -> None:
    """Writes the parts of a folder that are not there, with one job."""
    missing = [part for part in parts if not written_whole(spark, f"{path}/{at(part)}")]
    if missing:
        only_these = build(missing).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        only_these.parquet(path)
        for part in missing:
            mark_whole(spark, f"{path}/{at(part)}")


def _votes(model: GrownTrees, rows: DataFrame, out: str = "votes") -> DataFrame:
    """Add the event's share of the model's trees, times their number."""
    columns = {model.rawPredictionCol: f"{out} of classes", model.probabilityCol: "", model.predictionCol: ""}
    voted = model.transform(rows, columns)
    return voted.withColumn(out, vector_to_array(f"{out} of classes")[1]).drop(f"{out} of classes")


def _fits_in_a_task(rows: DataFrame, n_rows: int) -> bool:
    return 0 < n_rows and n_rows * (rows.first()["features"].size + ROW_BYTES) <= IN_A_TASK


def _cuts(rows: DataFrame) -> list[list[float]]:
    """The thresholds of each feature."""

    def cut(found):
        found = found.sort_values("value")
        cuts = local.thresholds(found["value"].to_numpy(), found["n"].to_numpy())
        return pd.DataFrame({"feature": found["feature"].iloc[:1], "cuts": [cuts]})

    values = rows.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
    counted = values.groupBy("feature", "value").agg(F.count("*").alias("n"))
    found = counted.groupBy("feature").applyInPandas(cut, "feature int, cuts array<double>").collect()
    return [row.cuts for row in sorted(found)]


def _held(rows: DataFrame, cuts: list[list[float]], times: Column | None = None) -> tuple[np.ndarray, ...]:
    """Bins, label, key and how often each batch draws a row, in an order that follows from the rows alone, for tasks that hold all."""

    def to_bins(found):
        for some in (x for x in found if len(x)):
            plain = some.column("features").flatten().to_numpy().reshape(-1, len(cuts))
            drawn = some.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(some), -1)
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (local.binned(plain, cuts), drawn)]
            yield pa.RecordBatch.from_arrays([some.column(KEY), some.column("label"), *packed], [KEY, "label", "bins", "times"])

    times = F.array().cast("array<int>") if times is None else times
    plain = rows.select(KEY, "label", vector_to_array("features").alias("features"), times.alias("times"))
    table = plain.mapInArrow(to_bins, f"{KEY} string, label double, bins binary, times binary")
    table = table.orderBy(KEY, "label", "bins").toArrow()
    bins, drawn = (np.frombuffer(b"".join(table[x].to_pylist()), np.uint8) for x in ("bins", "times"))
    key, label = (table[x].combine_chunks() for x in (KEY, "label"))
    return bins.reshape(-1, len(cuts)), label, key, drawn.reshape(len(table), -1) if len(table) else drawn


def _labels(label: pa.Array) -> np.ndarray:
    label = label.to_numpy(zero_copy_only=False)
    if not np.isin(label, (0, 1)).all():
        raise ValueError("labels must be 0 or 1")
    return label


def _fold(fit_part: DataFrame, held_out: DataFrame) -> Broadcast:
    """A fold as the tasks of its tuning hold it."""
    cuts = _cuts(fit_part)
    (rows, label, *_), (asked, asked_label, asked_key, _) = _held(fit_part, cuts), _held(held_out, cuts)
    n_bins = np.array([len(cut) + 1 for cut in cuts])
    return fit_part.sparkSession.sparkContext.broadcast((rows, _labels(label), asked, n_bins, asked_key, asked_label))


def _tree_votes(held: Broadcast, growers: dict[str, TreeGrower], spark: SparkSession) -> DataFrame:
    """Key, label, point and votes, in parts that add up, of the growers of one batch. Growers that differ in `min_n` grow their trees in the
    same tasks."""
    tasks = []
    told = [(int(g.getFeatureSubsetStrategy()), g.getMinInstancesPerNode(), g.getSeed(), g.getNumTrees(), g.getMaxDepth(), name) for name, g in growers.items()]
    alike = lambda x: (x[0], x[2:5])
    for (mtry, (seed, n_trees, depth)), some in groupby(sorted(told, key=lambda x: (alike(x), x[1])), alike):
        _, min_ns, *_, names = zip(*some)
        seeds = [(seed, k) for k in range(n_trees)]
        tasks += [(seeds[k : k + TREES_PER_TASK], mtry, list(min_ns), depth, names) for k in range(0, n_trees, TREES_PER_TASK)]
    tasks.sort(key=lambda task: -task[1])  # long ones first

    def work(batches):
        rows, label, asked, n_bins, key, asked_label = held.value
        for number in (k for batch in batches for k in batch.column("id").to_pylist()):
            seeds, mtry, min_ns, depth, names = tasks[number]
            for name, votes in zip(names, local.votes(rows, label, asked, n_bins, seeds, mtry, min_ns, depth)):
                columns = [key, asked_label, pa.array(votes), pa.array([name] * len(votes), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [KEY, "label", "votes", "point"])

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(work, f"{KEY} string, label double, votes double, point string")


def tune(
    train: DataFrame,
    points: list[tuple[int, int]],
    folder: str,
    n_trees: int = 500,
    n_folds: int = 5,
    seed: int = 42,
    batch: int = 250,
    parallelism: int | None = None,
) -> list[tuple[int, int, float, float]]:
    """(mtry, min_n, mean AUC, standard error) per grid point, best first.

    The recipe is fitted once per fold, on the fold's own train rows, and serves all grid points. The votes of each
    batch on the held-out rows are written, and its trees let go. If a task can hold a fold's rows, it grows whole trees over
    them (see `trees`); else Spark grows them over the rows where they are, level by level.
    """
    spark, folder = train.sparkSession, folder.rstrip("/")

    def prepare(fold):
        here = f"{folder}/folds/{fold}"
        if not written_whole(spark, f"{here}/out"):
            rest, out = train.filter(F.col("fold") != fold), train.filter(F.col("fold") == fold)
            recipe = Recipe().fit(rest)
            for part, rows in (("fit", rest), ("out", out)):
                recipe.transform(rows).select(KEY, "label", "features").write.mode("overwrite").parquet(f"{here}/{part}")
        fit_part, held_out = (spark.read.parquet(f"{here}/{part}") for part in ("fit", "out"))
        n_rows = fit_part.count()
        wanted = any(job[0] == fold for job in missing) and _fits_in_a_task(fit_part, n_rows)
        held = _fold(fit_part, held_out) if wanted else None
        return _in_order(fit_part, n_rows), held_out, n_rows, held

    def grow(job):
        fold, (mtry, min_n), (number, trees) = job
        fit_part, held_out, *_ = folds[fold]

        def votes():
            model = classifier(trees, mtry, min_n, seed + number).fit(fit_part)
            return _votes(model, held_out).select(KEY, "label", "votes")

        _written(spark, at(job), votes)

    def grow_alike(jobs):
        """The points of one fold and batch."""
        fold, _, (number, trees) = jobs[0]

        def votes(jobs):
            growers = {f"{mtry}_{min_n}": classifier(trees, mtry, min_n, seed + number) for _, (mtry, min_n), _ in jobs}
            return _tree_votes(folds[fold][-1], growers, spark).withColumns({"fold": F.lit(fold), "batch": F.lit(number)})

        _written_parts(spark, f"{folder}/votes", jobs, votes, part, ("fold", "point", "batch"))

    def part(job):
        fold, (mtry, min_n), (number, _) = job
        return f"fold={fold}/point={mtry}_{min_n}/batch={number}"

    def at(job):
        return f"{folder}/votes/{part(job)}"

    jobs = [(fold, point, some) for some in batches(n_trees, batch) for fold in range(n_folds) for point in points]
    missing = [job for job in jobs if not written_whole(spark, at(job))]
    ship(spark)
    folds = _at_once(spark, prepare, range(n_folds), parallelism or PARALLELISM)
    alike = [list(some) for _, some in groupby(missing, lambda job: (job[2], job[0]))]
    _at_once(spark, grow_alike, [some for some in alike if folds[some[0][0]][-1]], parallelism or PARALLELISM)
    rest = [job for job in missing if not folds[job[0]][-1]]
    if rest:
        most = max(n_rows for _, _, n_rows, _ in folds)
        _at_once(spark, grow, rest, parallelism or at_once(spark, most, min(batch, n_trees)))
    for *_, held in folds:
        if held:
            held.destroy()
    kinds = f"{KEY} string, label double, votes double, fold int, point string, batch int"
    names = [f"{mtry}_{min_n}" for mtry, min_n in points]
    votes = spark.read.schema(kinds).parquet(f"{folder}/votes").filter(F.col("point").isin(names))
    scores = votes.groupBy("fold", "point", KEY, "label").agg(_score(F.sum("votes"), n_trees).alias("score"))
    counted = score_counts(scores, F.col("score"), F.col("label") == 1, ["fold", "point"])
    found = (
        roc_auc(_written(spark, f"{folder}/counts", lambda: counted), ["fold", "point"])
        .groupBy("point")
        .agg(F.avg("auc").alias("mean"), (F.stddev("auc") / F.sqrt(F.count("*"))).alias("std_err"))
    )
    by_point = {r["point"]: (r["mean"], r["std_err"]) for r in found.collect()}
    rows = [(*point, *by_point[name]) for point, name in zip(points, names)]
    return sorted(rows, key=lambda r: (-r[2], r[0], r[1]))


def tuning_table(spark: SparkSession, rows: list[tuple[int, int, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "mtry int, min_n int, mean_auc double, std_err double")


class Forest:
    """A recipe and the trees of all batches, read from the folder that `fit_final` wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.recipe = RecipeModel.load(f"{self.folder}/recipe")
        listed = spark.read.json(f"{self.folder}/forest").orderBy("batch").collect()  # one row per batch
        self.seed, self.n_trees = listed[0].seed, sum(row.trees for row in listed)
        self.in_tasks = getattr(listed[0], "in_tasks", False)
        if self.in_tasks:
            ship(spark)
            self.models = _read_trees(spark, self.folder, listed)
        else:
            load = lambda row: GrownTrees.load(f"{self.folder}/batch={row.batch}")
            self.models = _at_once(spark, load, listed, at_once(spark))

    def score(self, rows: DataFrame) -> DataFrame:
        """Key, label, probability of the event, predicted class."""
        voted = self.recipe.transform(rows)
        if self.in_tasks:
            votes = _ballot(self.models, vector_to_array("features"))
            return voted.select(KEY, LABEL, _score(votes, self.n_trees).alias("score")).withColumn("predicted", predicted())
        names = [f"votes {k}" for k in range(len(self.models))]
        for name, model in zip(names, self.models, strict=True):
            voted = _votes(model, voted, name)
        votes = reduce(lambda a, b: a + b, [F.col(name) for name in names])
        return voted.select(KEY, LABEL, _score(votes, self.n_trees).alias("score")).withColumn("predicted", predicted())


def predicted() -> Column:
    return F.when(F.col("score") > 0.5, "1").otherwise("0")


def fit_final(
    train: DataFrame,
    mtry: int,
    min_n: int,
    folder: str,
    n_trees: int = 500,
    seed: int = 42,
    batch: int = 10,
    parallelism: int | None = None,
) -> Forest:
    """Recipe and forest fitted on all train rows, written to the folder and read back from it. As in `tune`, tasks grow the trees if they
    can hold the rows."""
    spark, folder = train.sparkSession, folder.rstrip("/")
    if not written_whole(spark, f"{folder}/rows"):
        recipe = Recipe().fit(train)
        recipe.write().overwrite().save(f"{folder}/recipe")
        recipe.transform(train).select(KEY, "label", "features").write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    n_rows = rows.count()

    def grow(some):
        number, trees = some
        if not written_whole(spark, f"{folder}/grown/{number}"):
            drawn = rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), draws(F.col(KEY), seed, number)))).drop("_")
            model = classifier(trees, mtry, min_n, seed + number, bootstrap=False).fit(_in_order(drawn, n_rows))
            model.write().overwrite().save(f"{folder}/batch={number}")
            spark.range(1).write.mode("overwrite").parquet(f"{folder}/grown/{number}")  # says that the trees are whole

    listed = batches(n_trees, batch)
    in_tasks = _fits_in_a_task(rows, n_rows)
    if in_tasks:
        _grow_in_tasks(rows, listed, mtry, min_n, seed, folder)
    else:
        _at_once(spark, grow, listed, parallelism or at_once(spark, n_rows, min(batch, n_trees)))
    described = spark.createDataFrame([(k, n, seed, in_tasks) for k, n in listed], "batch int, trees int, seed int, in_tasks boolean")
    described.coalesce(1).write.mode("overwrite").json(f"{folder}/forest")
    return Forest(spark, folder)


NODES = "tree int, feature int, threshold double, left int, share double"


def _grow_in_tasks(rows: DataFrame, listed: list[tuple[int, int]], mtry: int, min_n: int, seed: int, folder: str) -> None:
    """Writes the nodes of all batches that are not there."""
    spark = rows.sparkSession
    ship(spark)
    trees_of = dict(listed)
    _written_parts(spark, f"{folder}/trees", [number for number, _ in listed], lambda numbers: _nodes(rows, {k: trees_of[k] for k in numbers}, mtry, min_n, seed))


def _nodes(rows: DataFrame, missing: dict[int, int], mtry: int, min_n: int, seed: int) -> DataFrame:
    """The nodes of batches, of which the number of trees is given."""
    spark = rows.sparkSession
    cuts, numbers = _cuts(rows), F.array(*map(F.lit, missing))
    bins, label, _, drawn = _held(rows, cuts, F.transform(numbers, lambda number: draws(F.col(KEY), seed, number)))
    held = spark.sparkContext.broadcast((bins, _labels(label), drawn))
    growers = [(number, classifier(trees, mtry, min_n, seed + number, bootstrap=False)) for number, trees in missing.items()]
    told = [(k, g.getSeed(), g.getNumTrees(), int(g.getFeatureSubsetStrategy()), g.getMinInstancesPerNode(), g.getMaxDepth()) for k, g in growers]

    def work(found):
        bins, label, drawn = held.value
        for place in (k for some in found for k in some.column("id").to_pylist()):
            number, seed, n_trees, *rules = told[place]
            nodes = local.forest(bins, label, drawn[:, place], cuts, [(seed, k) for k in range(n_trees)], *rules)
            columns = [pa.array(nodes[x], pa.float64() if x in ("threshold", "share") else pa.int32()) for x in nodes]
            ids = [pa.array(np.full(len(nodes["tree"]), number, np.int32)), pa.array(np.arange(len(nodes["tree"]), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(ids + columns, ["batch", "place", *nodes])

    return spark.range(0, len(told), 1, len(told)).mapInArrow(work, f"batch int, place int, {NODES}")


def _read_trees(spark: SparkSession, folder: str, listed: list) -> list[TreesOfTasks]:
    names = [kind.split()[0] for kind in NODES.split(", ")]
    kinds = f"batch int, place int, {NODES}"
    found = spark.read.schema(kinds).parquet(f"{folder}/trees").filter(F.col("batch").isin([row.batch for row in listed]))
    table = found.toArrow()
    batch, place = (table[x].to_numpy() for x in ("batch", "place"))
    order = np.lexsort((place, batch))
    columns, begins = {x: table[x].to_numpy()[order] for x in names}, np.searchsorted(batch[order], [row.batch for row in listed])
    ends = np.searchsorted(batch[order], [row.batch for row in listed], "right")
    parts = [{x: columns[x][begin:end] for x in names} for begin, end in zip(begins, ends)]
    return [TreesOfTasks(spark.sparkContext.broadcast(nodes), row.trees) for nodes, row in zip(parts, listed, strict=True)]


def _left_out(forest: Forest, rows: DataFrame, numbers: list[int]) -> DataFrame:
    """A row for each of the batches that did not draw it, with the number of its trees."""
    left_out = F.filter(F.array(*map(F.lit, numbers)), lambda number: draws(F.col(KEY), forest.seed, number) == 0)
    trees = F.array(*[F.lit(model.getNumTrees) for model in forest.models])
    return rows.withColumn("batch", F.explode(left_out)).withColumn("trees", trees[F.col("batch")])


def out_of_bag(forest: Forest, train: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Key, label, score and predicted class of the train rows, each by the batches that did not draw it, and the
    number of these batches."""
    spark, encoded = forest.spark, forest.recipe.transform(train).select(KEY, LABEL, "features")

    def votes_of(numbers):
        votes = _ballot(forest.models, vector_to_array("features"), F.col("batch"))
        return _left_out(forest, encoded, numbers).select(KEY, LABEL, votes.alias("votes"), "trees", "batch")

    def vote(job):
        number, model = job

        def votes():
            voted = _votes(model, encoded.filter(draws(F.col(KEY), forest.seed, number) == 0))
            return voted.select(KEY, LABEL, "votes", F.lit(model.getNumTrees).alias("trees"))

        _written(spark, f"{forest.folder}/out_of_bag/batch={number}", votes)

    if forest.in_tasks:
        _written_parts(spark, f"{forest.folder}/out_of_bag", list(range(len(forest.models))), votes_of)
    else:
        _at_once(spark, vote, enumerate(forest.models), parallelism or at_once(spark))
    votes = spark.read.parquet(f"{forest.folder}/out_of_bag")
    scored = votes.groupBy(KEY, LABEL).agg(
        _score(F.sum("votes"), F.sum("trees")).alias("score"), F.count("*").alias("n_batches")
    )
    return scored.withColumn("predicted", predicted())


def donors(
    frame: DataFrame, columns: list[str], seed, n_rows: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add `donor`, the given columns of another row, each row being a donor exactly once.

    Two pseudo-random orders of the rows are joined on the position.
    """
    left = frame.withColumn("_digest", shuffle_digest(F.col(KEY), f"{seed}|to"))
    right = frame.select(
        F.struct(*columns).alias("donor"), shuffle_digest(F.col(KEY), f"{seed}|from").alias("_digest")
    )
    to = digest_rank(left, [], "_digest", "_place", n_rows, rows_per_task)
    given = digest_rank(right, [], "_digest", "_place", n_rows, rows_per_task)
    return to.join(given.select("_place", "donor"), "_place").select(*frame.columns, "donor")


def permutation_importance(
    forest: Forest,
    train: DataFrame,
    n_repeats: int = 5,
    seed: int = 42,
    parallelism: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Loss of accuracy when one encoded feature is shuffled, on the rows that a batch did not draw: mean and standard
    deviation over the batches.

    A repeat shuffles all rows once, and batches take turns with the repeats; every feature in turn is then taken from
    the donor row, so the number of shuffles grows neither with the features nor with the batches.
    """
    spark, folder, names = forest.spark, forest.folder, forest.recipe.features
    own = F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("own")
    rows = _written(spark, f"{folder}/importance/rows", lambda: forest.recipe.encode(train).select(KEY, LABEL, own))
    n_rows = rows.count()

    def shuffled(repeat):
        given = lambda: donors(rows, ["own"], f"{seed}|{repeat}", n_rows, rows_per_task)
        return _written(spark, f"{folder}/importance/shuffled/{repeat}", given)

    # a row for each feature, with this one feature of the donor, and one as it is
    variant = F.explode(F.sequence(F.lit(OWN), F.lit(len(names) - 1)))
    mixed = F.transform("own", lambda x, i: F.when(i == F.col("variant"), F.col("donor.own")[i]).otherwise(x))

    def hits_of(repeat):
        def hits(numbers):
            variants = _left_out(forest, shuffles[repeat], numbers).withColumn("variant", variant)
            voted = variants.withColumn("votes", _ballot(forest.models, mixed, F.col("batch")))
            right = (F.col("votes") / F.col("trees") > 0.5) == (F.col(LABEL).cast("int") == 1)
            return voted.groupBy("batch", "variant").agg(F.avg(right.cast("int")).alias("accuracy"))

        _written_parts(spark, f"{folder}/importance/hits", list(range(repeat, len(forest.models), n_repeats)), hits)

    def hit(job):
        number, model = job
        left_out = shuffles[number % n_repeats].filter(draws(F.col(KEY), forest.seed, number) == 0)
        variants = left_out.withColumn("variant", variant)

        def hits():
            voted = _votes(model, variants.withColumn("features", array_to_vector(mixed)))
            right = (F.col("votes") / model.getNumTrees > 0.5) == (F.col(LABEL).cast("int") == 1)
            return voted.groupBy("variant").agg(F.avg(right.cast("int")).alias("accuracy"))

        _written(spark, f"{folder}/importance/hits/batch={number}", hits)

    parallelism = parallelism or at_once(spark)
    shuffles = _at_once(spark, shuffled, range(n_repeats), parallelism)
    if forest.in_tasks:
        _at_once(spark, hits_of, range(n_repeats), parallelism)
    else:
        _at_once(spark, hit, enumerate(forest.models), parallelism)
    hits = spark.read.parquet(f"{folder}/importance/hits")  # features x batches
    whole = hits.filter(F.col("variant") == OWN).select("batch", F.col("accuracy").alias("whole"))
    losses = hits.filter(F.col("variant") != OWN).join(whole, "batch")
    feature = F.element_at(F.array(*map(F.lit, names)), F.col("variant") + 1)
    loss = F.col("whole") - F.col("accuracy")
    return losses.groupBy(feature.alias("feature")).agg(
        F.avg(loss).alias("importance"), F.stddev(loss).alias("std_dev"), F.count("*").alias("n_batches")
    )
