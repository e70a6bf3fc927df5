"""Feature expressions: z-scores, one-hot vectors, cyclic times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spread below which a column counts as constant; year statistics of a column without values.
FLAT, YEAR_MEAN, YEAR_STD = 1e-8, 2000.0, 20.0


def numeric_stats(c: Column, name: str = "") -> list[Column]:
    """Aggregates mean and (population) std, of doubles; a constant column has std 1, one without values (0, 1)."""
    c = c.cast("double")
    std = F.stddev_pop(c)
    return [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{name}mean"), F.when(std.isNull() | (std < FLAT), 1.0).otherwise(std).alias(f"{name}std")]


def year_stats(c: Column, name: str = "") -> list[Column]:
    year = F.year(c).cast("double")
    var = F.var_pop(year)
    std = F.when(F.count(c) == 0, YEAR_STD).when(var <= FLAT, 1.0).otherwise(F.sqrt(var))
    return [F.coalesce(F.avg(year), F.lit(YEAR_MEAN)).alias(f"{name}mean"), std.alias(f"{name}std")]


def zscore(c: Column, mean: Column | float, std: Column | float) -> Column:
    """Null takes the mean, so it gives 0."""
    mean, std = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mean, std))
    return (F.coalesce(c.cast("double"), mean) - mean) / std


def vocabulary(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(value, index): distinct non-null values in byte order, from 0; of at most the first `most`, which the sort cuts off before they meet.

    Without `most` they are numbered in ranges, so no task and no driver holds them all.
    """
    from kinfold.operators.graph import NODE, with_node_ids

    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    if most is None:
        return with_node_ids(values, ["value"]).select("value", F.col(NODE).cast("int").alias("index"))
    values = values.orderBy("value").limit(most).agg(F.array_sort(F.collect_list("value")).alias("v"))
    return values.select(F.posexplode("v").alias("index", "value")).select("value", "index")


def one_hot(c: Column, vocab: list[str]) -> Column:
    """Unseen and null values give zeros. The values are one literal of the plan, whatever their number."""
    known = F.array(*map(F.lit, vocab)) if vocab else F.array().cast("array<string>")
    return F.transform(known, lambda v: F.when(c.cast("string") == v, 1.0).otherwise(0.0))


def time_parts(c: Column, mean: Column | float, std: Column | float) -> Column:
    """sin and cos of month and day, and the year's z-score (UTC); null gives five zeros."""
    mean, std = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mean, std))
    month, day = (f(c) * F.lit(2 * math.pi) / n for f, n in ((F.month, 12.0), (F.dayofmonth, 31.0)))
    parts = [F.sin(month), F.cos(month), F.sin(day), F.cos(day), (F.year(c) - mean) / std]
    return F.array(*(F.coalesce(p, F.lit(0.0)) for p in parts))


def day_number(c: Column) -> Column:
    """Days since 1970-01-01 of a date, a time, or text that starts with a date; null for what is none."""
    return F.datediff(F.substring(c.cast("string"), 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date"))


def multi_hot(c: Column, labels: list[str], sep: str = "|") -> Column:
    """Whether each label is among the separated ones of the cell."""
    found = F.split(F.coalesce(c, F.lit("")), f"[{sep}]")
    return F.array(*(F.array_contains(found, x).cast("double") for x in labels))
