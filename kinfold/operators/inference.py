"""Filters over scored rows, and what is made of the rows that pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.labels import all_of

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


@dataclass(frozen=True)
class InferenceFilter:
    column: str
    op: str
    value: str


def condition(df: DataFrame, f: InferenceFilter) -> Column | None:
    """None for an unknown column. Null cells fail. Strings know = and != only: other operators let all through, as unknown ones do."""
    if f.column not in df.columns:
        return None
    c, kind = F.col(f.column), dict(df.dtypes)[f.column]
    if kind.startswith(_NUMERIC):
        value: Column = F.lit(float(f.value))
        c = c.cast("double")
    elif kind.startswith(("timestamp", "date")):
        value = F.lit(f.value).try_cast("timestamp")
        c = c.cast("timestamp")
    else:
        value = F.lit(f.value)
        if f.op not in ("=", "!="):
            return c.isNotNull()
    known = {"=": c == value, "!=": c != value, ">=": c >= value, ">": c > value, "<=": c <= value, "<": c < value}
    return known.get(f.op, c.isNotNull())


def filtered(df: DataFrame, filters: list[InferenceFilter]) -> DataFrame:
    """Rows that pass all filters; comparisons stay on raw columns, so that they reach the scan."""
    return df.where(all_of([c for f in filters if (c := condition(df, f)) is not None]))


def aggregated(df: DataFrame, mode: str, prediction: str = "prediction") -> DataFrame:
    """mode mean, fraction or count (of predictions of 0.5 or more); null without rows."""
    hit = (F.col(prediction) >= 0.5).cast("double")
    value = {"mean": F.avg(prediction), "fraction": F.avg(hit), "count": F.sum(hit)}[mode]
    return df.agg(value.alias("value"), F.count("*").alias("n_rows"))


def apply_inference(df: DataFrame, filters: list[InferenceFilter], mode: str = "none") -> DataFrame:
    rows = filtered(df, filters)
    return rows if mode == "none" else aggregated(rows, mode)


def prediction_distribution(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """(class, n, percent)."""
    counts = df.groupBy(F.col(prediction).cast("int").alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("class", "n", (F.col("n") * 100.0 / F.col("t")).alias("percent"))


def entity_row(df: DataFrame, pk: str, value, order: str) -> DataFrame:
    """The first row of the key, by order."""
    return df.where(F.col(pk) == value).orderBy(order).limit(1)


def mean_pool(rows: list[DataFrame], columns: list[str]) -> DataFrame:
    """Means over single-row frames, as embeddings of what is asked about; no rows raise when collected by the caller."""
    out = rows[0].select(*columns)
    for r in rows[1:]:
        out = out.unionByName(r.select(*columns))
    return out.agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n_found"))
