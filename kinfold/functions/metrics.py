"""Evaluation metrics and losses as aggregations over (score, label) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.graph import with_ranges


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def argmax(scores: Column) -> Column:
    """Position of the first greatest element, from 0."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def binary(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """accuracy and f1 of score >= threshold against label > 0.5."""
    p, y = F.col(score) >= threshold, F.col(label) > 0.5
    n = lambda cond: F.coalesce(F.sum(cond.cast("double")), F.lit(0.0))
    sums = df.agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return sums.select("tp", "fp", "fn", "tn", _ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def _before(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with n0 and p0: the sums of n and p over the rows before each, in the order of some columns, which are numbered in ranges of about `size` rows.

    A range is a function of a row's values, those that tie in one column being told apart by the others, so equal scores fill many ranges.
    """
    ranged = with_ranges(rows, order, size)
    inner = Window.partitionBy("_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    starts = sums.select("_range", *(F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(c) for c in ("_n", "_p")))
    own = ranged.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"{c}0") for c in ("n", "p")))
    return own.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("n0") + F.col("_n")).alias("n0"), (F.col("p0") + F.col("_p")).alias("p0"))


def ranking(df: DataFrame, score: str, label: str, key: str, ties: bool = False, rows_in_range: int = 100_000) -> DataFrame:
    """auc (trapezoids along rows by falling score, then key) and average precision; auc_ties groups equal scores.

    Running sums go over ranges of (score, key) and then between the ranges, so that no task holds all rows, not even those of one score, as a model of constant output
    gives. With `ties`, scores are counted first, and the sums go over the distinct ones.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select((F.lit(0.0) - F.col(score).cast("double")).alias("s"), F.lit(1).cast("long").alias("n"), (F.col(label) > 0.5).cast("long").alias("p"), F.col(key).alias("k"))
    placed = _before(rows, ["s", "k"], rows_in_range)
    # A negative adds a column as high as the positives before it; a positive adds to the precisions.
    area, prec = F.when(F.col("p") == 0, F.col("p0")), F.when(F.col("p") == 1, (F.col("p0") + 1) / (F.col("n0") + 1))
    sums = placed.agg(F.sum(area).cast("double").alias("area"), F.sum("p").cast("double").alias("pos"), F.sum(1 - F.col("p")).cast("double").alias("neg"), F.sum(prec).alias("prec"))
    both = F.col("pos") * F.col("neg")
    out = sums.select("*", F.when(both > 0, F.col("area") / both).otherwise(0.5).alias("auc"), F.when(F.col("pos") > 0, F.col("prec") / F.col("pos")).otherwise(0.0).alias("average_precision"))
    if not ties:
        return out.select("auc", "average_precision")
    by_score = _before(rows.groupBy("s").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), ["s"], rows_in_range)
    tied = by_score.agg(F.sum((F.col("n") - F.col("p")) * (F.col("p0") + F.col("p") / 2.0)).alias("tied"))
    return out.crossJoin(F.broadcast(tied)).select("auc", F.when(both > 0, F.col("tied") / both).otherwise(0.5).alias("auc_ties"), "average_precision")


def regression(df: DataFrame, score: str, label: str) -> DataFrame:
    """rmse, mae and r2; r2 is 0 for constant labels, all are 0 without rows."""
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    e = s - y
    sums = df.agg(F.count(e).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), F.sum(y * y).alias("yy"), F.avg(y).alias("m"))
    n, tot = F.col("n"), F.col("yy") - F.col("n") * F.col("m") * F.col("m")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = F.nullif(n, F.lit(0))
    return sums.select(zero(F.sqrt(F.col("sse") / some)).alias("rmse"), zero(F.col("sae") / some).alias("mae"), zero(F.when(tot > 1e-12, 1 - F.col("sse") / tot)).alias("r2"))


def multiclass(df: DataFrame, predicted: str, label: str, classes: int) -> DataFrame:
    """accuracy and macro_f1 over all `classes`, those without rows counting 0."""
    cells = df.groupBy(F.col(predicted).cast("int").alias("p"), F.col(label).cast("int").alias("y")).agg(F.count("*").cast("double").alias("n"))
    per = cells.select("p", "y", "n", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("c"))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0.0))
    p, y = F.col("p") == F.col("c"), F.col("y") == F.col("c")
    per = per.groupBy("c").agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), F.sum("n").alias("all"))
    return per.agg(_ratio(F.sum("tp"), F.max("all")).alias("accuracy"), (F.sum(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))) / classes).alias("macro_f1"))


def bce(logit: Column, label: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross-entropy of one row, in the form that doesn't overflow; its mean is the loss."""
    w = F.when(label > 0.5, float(pos_weight)).otherwise(1.0)
    return w * (-label * logit + F.log(1 + F.exp(-F.abs(logit))) + F.greatest(logit, F.lit(0.0)))


def mse(score: Column, label: Column) -> Column:
    return (score - label) * (score - label)


def cross_entropy(logits: Column, label: Column, weights: Column | None = None) -> Column:
    """Weighted cross-entropy of one row; the mean over rows (not over weights) is the loss."""
    top = F.array_max(logits)
    log_sum = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    row = log_sum - F.element_at(logits, label.cast("int") + 1)
    return row if weights is None else F.element_at(weights, label.cast("int") + 1) * row
