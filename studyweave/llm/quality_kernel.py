"""Quality scores by kernel ridge regression on document statistics.

Statistics of a text are standardised and mapped to random Fourier features, whose products approximate a
Gaussian kernel. Ridge regression on them needs sums of products only: each partition adds up its own, Spark
sums them, and the driver solves one small system whose size is set by the number of features. The raw scores
of labelled rows left out of the sums are calibrated by isotonic regression over `bins` equal steps.

Labels are learned from at most `sample` labelled rows, those with the smallest hash of the id. A tenth of a
percent of a score follows the raw score, so that rows of one isotonic level keep their order.

Null and empty texts have statistics like any other. Rows are scored one by one. Without labels of both kinds
every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import statistics
from .rows import added, others, quoted, stored, utf8
from .toxicity import sampled

#: Of the labelled rows, one in so many calibrates.
LEFT_OUT = 4


def describe(texts: list[bytes]) -> np.ndarray:
    """A row of statistics per text."""
    line, total = statistics.count(texts)
    chars, words, lines = (np.maximum(total[x], 1) for x in ("chars", "words", "lines"))
    return np.stack(
        [
            np.log1p(total["words"]),
            np.log1p(total["lines"]),
            chars / words,
            np.sqrt(total["symbols"] / chars),
            np.sqrt(total["bangs"] / chars),
            total["upper"] / np.maximum(total["upper"] + total["lower"], 1),
            np.sqrt(total["again"] / words),
            np.sqrt(total["run_words"] / words),
            np.sqrt(total["single"] / words),
            np.sqrt(total["digits"] / chars),
            total["dup"] / lines,
            total["open"] / lines,
            total["short"] / words,
            total["distinct"] / words,
            total["lead"] / chars,
        ],
        1,
    )


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated scores at the steps

    def mapped(self, rows: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        z = np.clip((rows - self.mean) / self.spread, -8, 8) @ self.waves + self.shifts
        return np.concatenate([np.cos(z) * np.sqrt(2 / len(self.shifts)), np.ones((len(rows), 1))], 1)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.mapped(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = self.raw(rows)
        return 0.999 * np.interp(raw, self.steps, self.levels) + 0.001 / (1 + np.exp(-4 * (raw - 0.5)))


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to `value` in weighted squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for w, v in zip(weight.tolist(), value.tolist(), strict=True):
        pools.append([w, v, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, v2, n2 = pools.pop()
            w1, v1, n1 = pools.pop()
            pools.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), v) for _, v, n in pools]) if pools else np.zeros(0)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows text, label."""
    for got in batches:
        texts = got.column(0).to_pylist()
        rows = [describe(some) for some in statistics.slabs(texts)]
        flat = np.concatenate(rows) if rows else np.zeros((0, 1))
        held = [int(x) for x in np.array([zlib.crc32(t) for t in texts], np.int64) % LEFT_OUT == 0] if texts else []
        yield pa.RecordBatch.from_pydict({"x": pa.array(flat.tolist(), pa.list_(pa.float64())), "label": pa.array(got.column(1).to_pylist(), pa.int32()), "held": pa.array(held, pa.int32())})


def _summed(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows x, label: the sums of products of a partition, a row per feature (with the label last)."""
    sums = np.zeros((len(model.shifts) + 1, len(model.shifts) + 2))
    for got in batches:
        if got.num_rows:
            z = model.mapped(_rows(got))
            sums += z.T @ np.concatenate([z, got.column(1).to_numpy()[:, None]], 1)
    feature, other = np.divmod(np.arange(sums.size), sums.shape[1])
    yield pa.RecordBatch.from_pydict({"feature": pa.array(feature, pa.int32()), "other": pa.array(other, pa.int32()), "value": pa.array(sums.ravel(), pa.float64())})


def _rows(got: pa.RecordBatch) -> np.ndarray:
    return got.column(0).values.to_numpy().reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 1))


def _binned(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        if got.num_rows:
            raw = model.raw(_rows(got))
            at = np.clip(np.searchsorted(model.steps, raw), 0, len(model.steps) - 1)
            yield pa.RecordBatch.from_pydict({"step": pa.array(at, pa.int32()), "label": got.column(1).cast(pa.int32())})


def fit(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = 20_000, size: int = 200, ridge: float = 1e-3, bins: int = 400, width: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that `learn` (a condition on `id`) picks."""
    rows = sampled(documents, labels, "quality", learn, sample, id_col, text_col)
    rows = stored(documents.sparkSession, rows.mapInArrow(_described, "x array<double>, label int, held int"), "described")
    count = len(describe([b""])[0])
    stats = rows.agg(*[f(F.col("x")[k]) for k in range(count) for f in (F.avg, F.stddev_pop)], F.min("label"), F.max("label")).first()
    rng = np.random.default_rng(seed)
    waves, shifts = rng.normal(size=(count, size)) / width, rng.uniform(0, 2 * np.pi, size)
    steps = np.linspace(-1, 2, bins)
    mean, spread = (np.array([v or 0.0 for v in stats[k : 2 * count : 2]]) for k in (0, 1))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), waves, shifts, np.zeros(size + 1), steps, np.full(bins, 0.5))
    if stats[-2] == stats[-1]:
        return model
    sums = rows.filter("held = 0").select("x", "label").mapInArrow(partial(_summed, model), "feature int, other int, value double")
    table = sums.groupBy("feature", "other").agg(F.sum("value").alias("value")).toPandas()
    products = np.zeros((size + 1, size + 2))
    products[table.feature, table.other] = table.value
    n = max(1.0, products[-1, size])
    model.weights = np.linalg.solve(products[:, :-1] + ridge * n * np.eye(size + 1), products[:, -1])
    binned = rows.filter("held = 1").select("x", "label").mapInArrow(partial(_binned, model), "step int, label int")
    found = binned.groupBy("step").agg(F.count("*").alias("n"), F.avg("label").alias("share")).orderBy("step").toPandas()
    if len(found):
        model.steps, model.levels = steps[found.step.to_numpy()], isotonic(found.n.to_numpy(), found.share.to_numpy())
    return model


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes a score."""
    for got in batches:
        scores = [model.score(describe(texts)) for texts in statistics.slabs(got.column(got.num_columns - 1).to_pylist())]
        column = pa.array(np.concatenate(scores) if scores else [], pa.float64())
        yield pa.RecordBatch.from_arrays([*got.columns[:-1], column], names=got.schema.names)


def score(documents: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of `documents`, and `out` (in place of a column of that name, in any case)."""
    kept = documents.select(*others(documents, out))
    given = documents.select(*others(documents, out), utf8(text_col).alias(out))
    return given.mapInArrow(partial(_scored, model), added(kept, f"{quoted(out)} double"))
