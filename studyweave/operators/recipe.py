"""Preprocessing as one fitted unit: what it learns comes from the rows it is fitted on only.

`Recipe` and `RecipeModel` are pipeline stages with parameters, written and read as others are.
"""

from __future__ import annotations

import re

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace
from .ordered import exact_quantiles

UNKNOWN, OTHER = "unknown", "other"


def train_medians(
    train: DataFrame, columns: list[str], keep=lambda frame, name: frame
) -> dict[str, float]:
    """Exact median per numeric column. `keep` writes the value counts, which are read repeatedly."""
    medians = {}
    for column in columns:
        quantiles = exact_quantiles(
            train, [], column, {"median": 0.5}, lambda counts, column=column: keep(counts, f"{column}_counts")
        )
        row = quantiles.first()
        medians[column] = None if row is None else row["median"]
    return medians


def impute(frame: DataFrame, medians: dict[str, float]) -> DataFrame:
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()}
    return frame.withColumns(filled) if filled else frame


def level_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(UNKNOWN))


def frequent_levels(
    train: DataFrame, columns: list[str], threshold: float = 0.02
) -> tuple[dict[str, list[str]], set[str]]:
    """Per column the levels with at least `threshold` of the train rows, at most 1 / threshold of
    them; and the columns that have rarer ones, too."""
    n_rows = train.count()
    kept, with_rare = {}, set()
    for column in columns:
        frequent = (
            train.groupBy(level_of(F.col(column)).alias("level"))
            .agg(F.count("*").alias("n"))
            .filter(F.col("n") >= threshold * n_rows)
            .collect()
        )
        kept[column] = sorted(r.level for r in frequent)
        if sum(r.n for r in frequent) < n_rows:
            with_rare.add(column)
    return kept, with_rare


def pool_levels(frame: DataFrame, kept: dict[str, list[str]]) -> DataFrame:
    """Levels that were rare in train, or not there at all, become one level."""
    pooled = {
        c: F.when(level_of(F.col(c)).isin(*levels), level_of(F.col(c))).otherwise(F.lit(OTHER))
        for c, levels in kept.items()
        if levels
    }
    return frame.withColumns(pooled) if pooled else frame


def dummies(frame: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """0/1 columns for all levels but the first, which is the reference."""
    indicators = {}
    for column, names in levels.items():
        for level in names[1:]:
            name = f"{column}_" + re.sub(r"\W", "_", level)
            while name in indicators:
                name += "_"
            indicators[name] = (F.col(column) == level).cast("double")
    return frame.withColumns(indicators).drop(*levels) if levels else frame


class _Columns(Params):
    """Parameters of the recipe and of what it learned."""

    ids = Param(Params._dummy(), "ids", "columns that are no predictors", TypeConverters.toListString)
    outcome = Param(Params._dummy(), "outcome", "column with 0 or 1, as text or number", TypeConverters.toString)
    label = Param(Params._dummy(), "label", "the outcome as a number, for a classifier", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "column of the assembled features", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(
            ids=["patient_key", "os_event", "split", "fold"], outcome="os_event", label="label", output="features"
        )


class Recipe(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Median, unknown level, pooled rare levels, dummies, constants dropped, features assembled.

    While it is fitted, value counts are written to the shared folder; they are removed after.
    """

    threshold = Param(Params._dummy(), "threshold", "least share of a level of its own", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, ids=None, threshold=None, outcome=None, label=None, output=None):
        super().__init__()
        self._setDefault(threshold=0.02)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "RecipeModel":
        ids, output = self.getOrDefault("ids"), self.getOrDefault("output")
        fields = [f for f in dataset.schema.fields if f.name not in ids]
        nominal = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
        numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
        workspace = Workspace(dataset.sparkSession)
        try:
            medians = train_medians(dataset, numeric, lambda counts, name: workspace.table(name, lambda: counts))
        finally:
            workspace.close()
        kept, with_rare = frequent_levels(dataset, nominal, self.getOrDefault("threshold"))
        levels = {c: kept[c] + ([OTHER] if c in with_rare and OTHER not in kept[c] else []) for c in nominal}
        encoded = dummies(pool_levels(impute(dataset.limit(0), medians), kept), levels)
        features = [c for c in encoded.columns if c not in ids]
        # A dummy has both values in train by the choice of its level; a number may be constant.
        varied = impute(dataset, medians).agg(
            F.lit(True).alias("_"), *[(F.min(c) < F.max(c)).alias(c) for c in numeric]
        )
        constant = {c for c, varies in varied.first().asDict().items() if not varies}
        learned = RecipeModel(medians, kept, levels, [c for c in features if c not in constant])
        return self._copyValues(learned._set(output=output))


class RecipeModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """What a recipe learned, as parameters."""

    learned = Param(Params._dummy(), "learned", "medians, kept levels, levels of the dummies, and feature names")

    def __init__(self, medians=None, kept=None, levels=None, features=None):
        super().__init__()
        self._set(learned={"medians": medians or {}, "kept": kept or {}, "levels": levels or {}, "features": features or []})

    @property
    def medians(self) -> dict[str, float]:
        return self.getOrDefault(self.learned)["medians"]

    @property
    def kept(self) -> dict[str, list[str]]:
        return self.getOrDefault(self.learned)["kept"]

    @property
    def levels(self) -> dict[str, list[str]]:
        return self.getOrDefault(self.learned)["levels"]

    @property
    def features(self) -> list[str]:
        return self.getOrDefault(self.learned)["features"]

    def encode(self, frame: DataFrame) -> DataFrame:
        """Scalar feature columns."""
        return dummies(pool_levels(impute(frame, self.medians), self.kept), self.levels)

    def assemble(self, encoded: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol=self.getOrDefault("output")).transform(encoded)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Assembled features, and the label where the outcome is known."""
        assembled, outcome = self.assemble(self.encode(dataset)), self.getOrDefault("outcome")
        if outcome not in dataset.columns:
            return assembled
        return assembled.withColumn(self.getOrDefault("label"), F.col(outcome).cast("double"))
