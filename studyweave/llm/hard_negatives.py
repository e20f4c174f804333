"""Hard negatives by vertical scans: dimensions are read one group after the other, for candidates still open.

For each anchor the rows of the same label with the highest scores are its positives; its hard negatives are rows
of other labels whose score lies in a window below that of a positive. A score is the integer inner product of
vectors whose components were scaled and rounded down.

Rows are dealt to blocks, anchors to groups, by a hash of the id; a task holds one block and one group at a time,
whatever the input. A block keeps its vectors by dimension. An anchor reads the dimensions in the order of its own
magnitudes, the largest first, as these say most. After each step a row's score is known up to what the dimensions
left can add: at least and at most the sums of what the block's smallest and largest components give. The bitmap of
open rows loses those that surely rank behind enough others, or that lie outside all windows; what stays open
to the last dimension has its exact score. First the positives of all anchors are found so, then the windows.

Rows with a null id, label, vector or component, or a component that is not finite, take no part. Of rows with one
id, the one with the smallest label, then vector counts; a shorter vector counts as filled up with zeros. Equal
scores go by smaller id. An anchor without positives, or whose windows hold nothing, has no row; a negative score
has an empty window. Empty tables give no rows. Components times `scale` should stay under 2 ** 31; scores past 64
bits are an error. Other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import stored

#: Dimensions read between two looks at the bitmap.
STEP = 8
#: Rows of a block and anchors of a group, on average.
BLOCK, GROUP = 8192, 4096


def rounded(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, label and vector of the rows that take part, one row for each id."""
    x = F.col(vector_col)
    wrong = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    some = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~wrong)
    some = some.select(F.col(id_col).alias("id"), F.struct(F.col(label_col).alias("label"), whole.alias("vector")).alias("row"))
    return some.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows; short ones are filled up with zeros."""
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    first = np.cumsum(size) - size
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(first, size)] = flat
    return out


def width_of(*tables: pa.Table) -> int:
    return max((size for t in tables for size in t.column("vector").combine_chunks().value_lengths().to_pylist()), default=0)


class Block:
    """Vectors by dimension, in numbers that hold every sum exactly."""

    def __init__(self, vectors: np.ndarray, anchors: np.ndarray):
        most = max(1, *(int(max(x.max(), -x.min())) if x.size else 0 for x in (vectors, anchors)))
        kind = np.float64 if vectors.shape[1] * most * most < 1 << 52 else object
        self.columns = np.ascontiguousarray(vectors.T.astype(kind))
        self.anchors = anchors.astype(kind)
        self.low, self.high = (f(1) if vectors.size else self.columns.sum(1) for f in (self.columns.min, self.columns.max))

    def scan(self, k: int, open_: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the rows of the bitmap that `keep`, given the least and the most that each score
        can be, leaves open to the end."""
        anchor, at = self.anchors[k], np.flatnonzero(open_)
        order = np.argsort(-np.abs(anchor), kind="stable")
        least, most = (f(anchor * self.low, anchor * self.high)[order] for f in (np.minimum, np.maximum))
        scores = np.zeros(len(at), self.columns.dtype)
        for first in range(0, len(order), STEP):
            dims = order[first : first + STEP]
            scores = scores + anchor[dims] @ (self.columns[dims] if len(at) == len(open_) else self.columns[np.ix_(dims, at)])
            left = slice(first + STEP, None)
            stay = keep(scores + least[left].sum(), scores + most[left].sum())
            if not stay.all():
                at, scores = at[stay], scores[stay]
            if not len(at):
                break
        return at, scores


def highest(scores: np.ndarray, n: int):
    """The n-th highest of at least n scores."""
    return np.partition(scores, len(scores) - n)[len(scores) - n]


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The first n, the highest score and then the smallest id first."""
    if len(scores) > n:
        some = scores >= highest(scores, n)
        ids, scores = ids[some], scores[some]
    return sorted(zip(ids.tolist(), map(int, scores.tolist()), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def labels_of(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The labels as numbers, equal where the labels are."""
    both = pa.chunked_array([*rows.column("label").chunks, *anchors.column("label").chunks], rows.schema.field("label").type)
    codes = both.combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    numbers = codes.indices.to_numpy(zero_copy_only=False)
    return numbers[: rows.num_rows], numbers[rows.num_rows :]


_POSITIVES = "anchor_id long, positive_id long, positive_score long"
_NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _table(names: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split()[0] for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=fields)


def _nearest(n: int, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The n rows of an anchor's label in this block with the highest scores."""
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        width = width_of(rows, anchors)
        block = Block(matrix(rows.column("vector"), width), matrix(anchors.column("vector"), width))
        ids, (labels, own) = rows.column("id").to_numpy(), labels_of(rows, anchors)
        for k, anchor in enumerate(anchors.column("id").to_pylist()):

            def keep(least, most):
                return most >= highest(least, n) if len(least) > n else np.ones(len(least), bool)

            at, scores = block.scan(k, (labels == own[k]) & (ids != anchor), keep)
            out += [(anchor, *found) for found in best(ids[at], scores, n)]
    return _table(_POSITIVES, out)


def _windowed(n: int, low: int, high: int, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """By positive, the n rows of other labels in this block with the highest scores in its window."""
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        width = width_of(rows, anchors)
        block = Block(matrix(rows.column("vector"), width), matrix(anchors.column("vector"), width))
        ids, (labels, own) = rows.column("id").to_numpy(), labels_of(rows, anchors)
        for k, (anchor, windows) in enumerate(zip(anchors.column("id").to_pylist(), anchors.column("windows").to_pylist(), strict=True)):
            # 100 * score between low * positive and high * positive
            spans = [(-(-low * w["score"] // 100), high * w["score"] // 100, w) for w in windows]
            spans = [s for s in spans if s[0] <= s[1]]
            if not spans:
                continue

            def keep(least, most):
                stay = np.zeros(len(least), bool)
                for first, last, _ in spans:
                    sure = least[most <= last]
                    if len(sure) >= n:
                        first = max(first, highest(sure, n))
                    stay |= (most >= first) & (least <= last)
                return stay

            at, scores = block.scan(k, labels != own[k], keep)
            for first, last, w in spans:
                some = (scores >= first) & (scores <= last)
                out += [(anchor, w["id"], w["score"], *found) for found in best(ids[at[some]], scores[some], n)]
    return _table(_NEGATIVES, out)


def _met(spark: SparkSession, rows: DataFrame, anchors: DataFrame, work, schema: str, tiles: tuple[int, int], tasks: int) -> DataFrame:
    """Each block of rows with each group of anchors. What is sent grows with rows x groups + anchors x blocks."""
    blocks, groups = tiles
    name = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", name(blocks)).withColumn("group", every(groups))
    right = anchors.withColumn("group", name(groups)).withColumn("block", every(blocks))
    left, right = (x.repartition(tasks, "block", "group").groupBy("block", "group") for x in (left, right))
    return left.cogroup(right).applyInArrow(work, schema)


def _first(found: DataFrame, by: list[str], score: str, id_col: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(
    spark: SparkSession,
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: the condition on `id` that makes a row an anchor. low, high: the window in percent of a positive's score.
    """
    rows = stored(spark, rounded(rows, id_col, label_col, vector_col, scale), "rows")
    anchors = rows.filter(anchor).select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own, as both sides meet below
    tiles = tuple(max(1, math.ceil(x.count() / n)) for x, n in ((rows, block), (anchors, group)))
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = min(tiles[0] * tiles[1], least)
    near = _met(spark, rows, anchors, partial(_nearest, positives), _POSITIVES, tiles, tasks)
    near = stored(spark, _first(near, ["anchor_id"], "positive_score", "positive_id", positives), "positives")
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("windows"))
    hard = _met(spark, rows, anchors.join(windows, "id"), partial(_windowed, negatives, low, high), _NEGATIVES, tiles, tasks)
    hard = _first(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
