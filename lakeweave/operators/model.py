"""Boosted trees over pair features, and a cascade of a cheap and a full model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A flag for each feature that is missing: trees here do not branch on null themselves."""
    return df.withColumns({f"{c}_na": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in columns} | {c: F.col(c).cast("double") for c in columns})


def train(df: DataFrame, columns: Sequence[str], label: str, iterations: int = 20, depth: int = 5, validation: str | None = None, seed: int = 7) -> PipelineModel:
    """validation names a boolean column; its rows stop the boosting early."""
    filled = [f"{c}_f" for c in columns]
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    stages = [Imputer(inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=[*filled, *(f"{c}_na" for c in columns)], outputCol="features"), gbt]
    return Pipeline(stages=stages).fit(with_missing(df, columns).withColumn(label, F.col(label).cast("double")))


def score(model: PipelineModel, df: DataFrame, columns: Sequence[str], into: str = "prob") -> DataFrame:
    out = model.transform(with_missing(df, columns))
    return out.withColumn(into, vector_to_array("probability")[1]).select(*df.columns, into)


def importance(model: PipelineModel, columns: Sequence[str]) -> list[tuple[str, float]]:
    names = [*columns, *(f"{c}_na" for c in columns)]
    return sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def cascade(cheap: PipelineModel, full: PipelineModel, df: DataFrame, cheap_columns: Sequence[str], columns: Sequence[str], least: float = 0.001) -> DataFrame:
    """The full model's score where the cheap one's reaches `least`, else 0."""
    first = score(cheap, df, cheap_columns, "cheap")
    kept = score(full, first.filter(F.col("cheap") >= least), columns)
    return kept.unionByName(first.filter(F.col("cheap") < least).withColumn("prob", F.lit(0.0))).drop("cheap")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
