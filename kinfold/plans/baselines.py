"""Flat baselines to compare with: one row of joined features per sample, and a stock classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.schema import Database, LogicalType


def flat_features(db: Database, target: str) -> DataFrame:
    """The target table with the features of the tables that its foreign keys name, as <table>_<column>; rows without a match have nulls."""
    t = db.get_table(target)
    out = t.df
    for fk in t.fks:
        dim = db.get_table(fk.target)
        columns = [c for c, k in dim.types.items() if k is not LogicalType.TEXT and c != dim.pk]
        side = dim.df.dropDuplicates([dim.pk]).select(F.col(dim.pk).alias(f"_{fk.column}"), *(F.col(c).alias(f"{fk.target}_{c}") for c in columns))
        out = out.join(side, out[fk.column] == side[f"_{fk.column}"], "left").drop(f"_{fk.column}")
    return out


def fit(train: DataFrame, numeric: list[str], categorical: list[str], label: str, kind: str = "mlp", classes: int = 2, hidden: int = 64, seed: int = 42) -> PipelineModel:
    """kind: mlp, gbt or logistic. Nulls become 0 or a category of their own; numbers are scaled."""
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    inputs = [*numeric, *(f"{c}_i" for c in categorical)]
    stages = [*indexers, VectorAssembler(inputCols=inputs, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    if kind == "mlp":
        model = MultilayerPerceptronClassifier(labelCol=label, layers=[len(inputs), hidden, classes], maxIter=50, seed=seed)
    elif kind == "gbt":
        model = GBTClassifier(labelCol=label, maxIter=20, seed=seed)
    else:
        model = LogisticRegression(labelCol=label)
    return Pipeline(stages=[*stages, model]).fit(train.fillna(0.0, numeric))


def scores(model: PipelineModel, rows: DataFrame, numeric: list[str]) -> DataFrame:
    """rows with the probability of class 1 and the predicted class."""
    out = model.transform(rows.fillna(0.0, numeric))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("_raw", "features", "rawPrediction", "probability", *[c for c in out.columns if c.endswith("_i") and c not in rows.columns])
