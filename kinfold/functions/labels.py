"""Label transforms and their inverse."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.encoders import FLAT


@dataclass(frozen=True)
class LabelTransform:
    """kind: threshold (>= or >), identity, normalize (mean and std of the training rows), buckets (sorted bounds)."""

    kind: str = "identity"
    threshold: float = 0.0
    inclusive: bool = True
    bounds: tuple[float, ...] = ()
    mean: float = 0.0
    std: float = 1.0

    def apply(self, v: Column) -> Column:
        v = v.cast("double")
        if self.kind == "threshold":
            return F.when(v >= self.threshold if self.inclusive else v > self.threshold, 1.0).otherwise(0.0)
        if self.kind == "normalize":
            return (v - self.mean) / self.std
        if self.kind == "buckets":
            # Bounds count until the first that is not reached.
            out = F.lit(float(len(self.bounds)))
            for i, b in reversed(list(enumerate(self.bounds))):
                out = F.when(v >= b, out).otherwise(float(i))
            return out
        return v

    def inverse(self, v: Column) -> Column:
        return v * self.std + self.mean if self.kind == "normalize" else v

    def back(self, v):
        """inverse() for numbers and arrays."""
        return v * self.std + self.mean if self.kind == "normalize" else v

    def fitted(self, train: DataFrame, column: str) -> LabelTransform:
        if self.kind != "normalize":
            return self
        m, s = train.agg(F.avg(F.col(column).cast("double")), F.stddev_pop(F.col(column).cast("double"))).first()
        return replace(self, mean=m or 0.0, std=s if s and s * s > FLAT else 1.0)

    @property
    def output_dim(self) -> int:
        return len(self.bounds) + 1 if self.kind == "buckets" else 1


def class_balance(labels: DataFrame, label: str = "label") -> DataFrame:
    """(n_pos, n_neg, pos_weight): negatives per positive, 1 unless there are both."""
    sums = labels.agg(F.coalesce(F.sum((F.col(label) > 0.5).cast("long")), F.lit(0)).alias("n_pos"), F.coalesce(F.sum((F.col(label) <= 0.5).cast("long")), F.lit(0)).alias("n_neg"))
    return sums.withColumn("pos_weight", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("n_neg") / F.col("n_pos")).otherwise(1.0))


def class_weights(labels: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """(class, n, weight): rows per class over the class's rows, 1 for a class without rows."""
    counts = labels.groupBy(F.col(label).cast("int").alias("class")).agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("total"))
    every = labels.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    out = every.join(counts, "class", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select("class", n.cast("long").alias("n"), F.when(n > 0, F.col("total") / classes / n).otherwise(1.0).alias("weight"))


def sqrt_inverse_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """(class, weight): square roots of inverse shares, scaled to mean 1 over the classes."""
    counts = labels.groupBy(F.col(label).cast("int").alias("class")).agg(F.count("*").alias("n"))
    raw = counts.withColumn("w", 1.0 / F.sqrt("n"))
    mean = raw.agg(F.avg("w").alias("m"))
    return raw.crossJoin(F.broadcast(mean)).select("class", (F.col("w") / F.col("m")).alias("weight"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
