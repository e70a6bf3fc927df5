"""Null tokens, cell parsing, and logical types from the values of string columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.schema import LogicalType

# Tokens that stand for null, and the shapes of numbers and dates.
NULL_TOKENS = ("", "\\N", "NA", "nan", "None", "NULL")
INTEGER = r"^-?\d+$"
FLOAT = r"^-?\d*\.?\d+([eE][+-]?\d+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"
#: Share of distinct values up to which a string column is categorical, and where counting them stops for files.
RATIO, CAP = 0.05, 1001


def cell(c: Column) -> Column:
    """The string, or null for a null token (which are case-sensitive)."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def is_numeric(c: Column) -> Column:
    return c.rlike(INTEGER) | c.rlike(FLOAT)


def is_date(c: Column) -> Column:
    return c.rlike(DATE)


def _number(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)


def parse_number(c: Column, kind: str = "double") -> Column:
    """The number that the string starts with, after blanks, in the type; null if there is none."""
    return _number(c).try_cast(kind)


#: Digits of a number that a double always tells from others of as many.
DOUBLE_DIGITS = 15


def number_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The type that holds the numbers of each string column exactly, in one aggregation: bigint, decimal(38, s), or double where no more digits than its own are
    needed, where there are exponents, and where 38 digits don't do."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        text = _number(cell(F.col(c)))
        digits = F.regexp_replace(text, "^[+-]?0*", "")
        behind = F.length(F.regexp_extract(text, r"\.(\d*)", 1))
        aggs += [
            F.max(text.rlike("[eE]")).alias(f"e{i}"), F.max(F.when(text != "", text.try_cast("bigint").isNull())).alias(f"wide{i}"),
            F.max(F.length(F.regexp_replace(digits, r"\.\d*$", ""))).alias(f"before{i}"), F.max(behind).alias(f"behind{i}"), F.max(text.contains(".")).alias(f"point{i}"),
        ]
    row, out = df.agg(*aggs).first(), {}
    for i, c in enumerate(columns):
        exponent, wide, before, behind, point = (row[f"{k}{i}"] for k in ("e", "wide", "before", "behind", "point"))
        digits = (before or 0) + (behind or 0)
        if exponent or before is None:
            out[c] = "double"
        elif not point:
            out[c] = "bigint" if not wide else "decimal(38,0)" if digits <= 38 else "double"
        else:
            out[c] = f"decimal(38,{behind})" if DOUBLE_DIGITS < digits <= 38 else "double"
    return out


def parse_timestamp(c: Column) -> Column:
    """Date and time, or else the date in the first ten characters; null if neither is one."""
    whole = F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(whole, F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))


def parse(c: Column, kind: LogicalType, number: str = "double") -> Column:
    if kind is LogicalType.NUMERICAL:
        return parse_number(cell(c), number)
    if kind is LogicalType.TIMESTAMP:
        return parse_timestamp(cell(c))
    return cell(c)


def column_stats(df: DataFrame) -> DataFrame:
    """(column, n_valid, n_numeric, n_date, n_distinct) of each string column, in one pass.

    Values are counted per column and value first, so the second step gets distinct values only.
    """
    names = df.columns
    long = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), cell(F.col(n)).alias("value")) for n in names))).alias("c")).select("c.*")
    values = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    valid, total = F.col("value").isNotNull(), lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return values.groupBy("column").agg(
        total(valid).alias("n_valid"), total(is_numeric(F.col("value"))).alias("n_numeric"), total(is_date(F.col("value"))).alias("n_date"), F.count("value").alias("n_distinct")
    )


def classified(stats: DataFrame, cap: int | None = CAP) -> DataFrame:
    """column_stats with the logical type. cap bounds the distinct count (None: not)."""
    distinct = F.least(F.col("n_distinct"), F.lit(cap)) if cap else F.col("n_distinct")
    kind = (
        F.when(F.col("n_valid") == 0, "TEXT").when(F.col("n_numeric") == F.col("n_valid"), "NUMERICAL").when(F.col("n_date") == F.col("n_valid"), "TIMESTAMP")
        .when(distinct / F.col("n_valid") <= RATIO, "CATEGORICAL").otherwise("TEXT")
    )
    return stats.withColumn("type", kind)


def capped_distinct(df: DataFrame, cap: int = CAP) -> dict[str, int]:
    """How many different non-null strings each column has, at most `cap`: tasks keep so many values of a column and look no further; below it the count is exact."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, set] = {}
        for batch in batches:
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                own = found.setdefault(name, set())
                if len(own) < cap:
                    own.update(pc.unique(column.drop_null()).slice(0, cap).to_pylist())
        for name, own in found.items():
            yield pa.RecordBatch.from_pydict({"column": [name] * min(cap, len(own)), "value": list(own)[:cap]}, pa.schema([("column", pa.string()), ("value", pa.string())]))

    rows = df.mapInArrow(kept, "column string, value string").distinct().groupBy("column").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    return dict.fromkeys(df.columns, 0) | {r["column"]: r["n"] for r in rows.collect()}


def bounded_types(df: DataFrame, cap: int = CAP) -> dict[str, tuple[LogicalType, int | None]]:
    """(logical type, number of different values, at most cap, or None where it doesn't matter) of string columns, by two passes without a row for each cell:
    shapes are counted for all columns at once, and different values of the columns alone that shapes don't decide."""
    if not df.columns:
        return {}
    shape = lambda test, c: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    cells = [cell(F.col(c)) for c in df.columns]
    row = df.agg(*(a.alias(f"{k}{i}") for i, c in enumerate(cells) for k, a in (("v", F.count(c)), ("n", shape(is_numeric(c), c)), ("d", shape(is_date(c), c))))).first()
    out, open_ = {}, []
    for i, c in enumerate(df.columns):
        valid, numeric, date = row[f"v{i}"], row[f"n{i}"], row[f"d{i}"]
        out[c] = (LogicalType.TEXT if not valid else LogicalType.NUMERICAL if numeric == valid else LogicalType.TIMESTAMP, None)
        if valid and numeric < valid and date < valid:
            open_.append((c, valid, cells[i]))
    if open_:
        found = capped_distinct(df.select(*(x.alias(c) for c, _, x in open_)), cap)
        out |= {c: (LogicalType.CATEGORICAL if found[c] / valid <= RATIO else LogicalType.TEXT, found[c]) for c, valid, _ in open_}
    return out


def infer_types(df: DataFrame, overrides: dict[str, LogicalType] | None = None, cap: int | None = CAP) -> dict[str, LogicalType]:
    """Logical types of string columns by name; explicit ones win, and only the others are looked at. Without a cap, different values are all counted."""
    overrides = overrides or {}
    rest = df.select(*(c for c in df.columns if c not in overrides))
    if cap:
        found = {c: t for c, (t, _) in bounded_types(rest, cap).items()}
    else:
        found = {r["column"]: LogicalType(r["type"]) for r in classified(column_stats(rest), None).collect()} if rest.columns else {}
    return {c: overrides.get(c) or found.get(c, LogicalType.TEXT) for c in df.columns}


def categorical(df: DataFrame, ratio: float = RATIO) -> set[str]:
    """The string columns whose non-null values are at most `ratio` distinct, counted per column and value in one shuffle; no cap."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in df.columns))).alias("c")).select("c.*").where("value is not null")
    values = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    found = values.groupBy("column").agg((F.count("*") / F.sum("n")).alias("share"))
    return {r["column"] for r in found.where(F.col("share") <= ratio).collect()}


def is_categorical(c: Column) -> Column:
    """Aggregate: whether the non-null strings are at most RATIO distinct; false if there are none. No cap."""
    return F.coalesce(F.count_distinct(c) / F.nullif(F.count(c), F.lit(0)) <= RATIO, F.lit(False))
