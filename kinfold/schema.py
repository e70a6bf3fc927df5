"""Tables with logical column types, keys and a time column."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class LogicalType(StrEnum):
    NUMERICAL = "NUMERICAL"
    CATEGORICAL = "CATEGORICAL"
    TIMESTAMP = "TIMESTAMP"
    TEXT = "TEXT"


@dataclass(frozen=True)
class ForeignKey:
    column: str
    target: str


@dataclass(frozen=True)
class Table:
    """A DataFrame and what is known of its columns. Roles are kept apart from physical types: hide() only changes what is encoded."""

    name: str
    df: DataFrame
    types: dict[str, LogicalType]
    pk: str | None = None
    time_col: str | None = None
    fks: tuple[ForeignKey, ...] = ()

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    def has_column(self, name: str) -> bool:
        return name in self.types

    def column(self, name: str):
        if name not in self.types:
            raise KeyError(f"table {self.name} has no column {name}")
        return self.df[name]

    def num_rows(self) -> int:
        return self.df.count()

    def with_column(self, name: str, value, kind: LogicalType) -> Table:
        return replace(self, df=self.df.withColumn(name, value), types=self.types | {name: kind})

    def retype(self, name: str, kind: LogicalType) -> Table:
        """Another role for a column, e.g. TEXT to keep it out of the features; its values stay."""
        self.column(name)
        return replace(self, types=self.types | {name: kind})

    def hide(self, *names: str) -> Table:
        out = self
        for name in names:
            out = out.retype(name, LogicalType.TEXT)
        return out

    def head(self, n: int = 5) -> DataFrame:
        return self.df.limit(n)

    def describe(self, spark: SparkSession) -> DataFrame:
        """(table, position, column, type, role): role is pk, fk, time or feature."""
        fks = {fk.column: fk.target for fk in self.fks}
        rows = [(self.name, i, c, t.value, "pk" if c == self.pk else f"fk:{fks[c]}" if c in fks else "time" if c == self.time_col else "feature") for i, (c, t) in enumerate(self.types.items())]
        return spark.createDataFrame(rows, "table string, position int, column string, type string, role string")


@dataclass
class Database:
    tables: dict[str, Table] = field(default_factory=dict)

    def add_table(self, table: Table) -> None:
        """The first table of a name stays."""
        self.tables.setdefault(table.name, table)

    def put(self, table: Table) -> None:
        self.tables[table.name] = table

    def has_table(self, name: str) -> bool:
        return name in self.tables

    def get_table(self, name: str) -> Table:
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        return self.tables[name]

    def table_names(self) -> list[str]:
        return list(self.tables)

    def describe(self, spark: SparkSession) -> DataFrame:
        frames = [t.describe(spark) for t in self.tables.values()]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def logical_type_of(dtype: str) -> LogicalType | None:
    """The logical type of a SQL type name; None for strings, whose values decide. Intervals have none and are refused."""
    name = dtype.lower()
    if name.startswith("interval"):
        raise TypeError(f"intervals are not supported: {dtype}")
    if name in ("tinyint", "smallint", "int", "bigint", "float", "double") or name.startswith("decimal"):
        return LogicalType.NUMERICAL
    if name in ("date", "timestamp", "timestamp_ntz"):
        return LogicalType.TIMESTAMP
    if name == "boolean":
        return LogicalType.CATEGORICAL
    if name == "string" or name.startswith(("varchar", "char")):
        return None
    return LogicalType.TEXT


#: Types whose values are exact; numbers of any other numeric type are doubles.
EXACT = ("tinyint", "smallint", "int", "bigint")


def exact(dtype: str) -> bool:
    return dtype in EXACT or dtype.startswith("decimal")


def typed(df: DataFrame, types: dict[str, LogicalType]) -> DataFrame:
    """Columns in the types that they are kept in: integers and decimals as they are, so that keys stay exact, other numbers as doubles, times, strings.

    Only encoders, labels and metrics make doubles of exact numbers.
    """
    to = {LogicalType.NUMERICAL: "double", LogicalType.TIMESTAMP: "timestamp", LogicalType.CATEGORICAL: "string", LogicalType.TEXT: None}
    physical = dict(df.dtypes)
    plain = lambda c, t: to[t] is None or t is LogicalType.NUMERICAL and exact(physical[c])
    return df.select(*(F.col(c) if plain(c, t) else F.col(c).cast(to[t]).alias(c) for c, t in types.items()))


def _scale(dtype: str) -> int:
    return int(dtype.rstrip(")").partition(",")[2] or 0) if dtype.startswith("decimal") else 0


def aligned(a: Column, a_type: str, b: Column, b_type: str) -> tuple[Column, Column]:
    """Two key columns in one type in which values are equal if and only if the values given are; a value that the other type can't hold becomes null.

    Integers and decimals are compared exactly. A double is an integer's key if it is whole (keys with gaps are often read as doubles); doubles and decimals with
    fractions are compared as doubles.
    """
    if a_type == b_type:
        return a, b
    sides = (a, a_type), (b, b_type)
    if all(t in EXACT for _, t in sides):
        return a.cast("bigint"), b.cast("bigint")
    if all(exact(t) for _, t in sides):
        kind = f"decimal(38,{max(_scale(a_type), _scale(b_type))})"
        return a.try_cast(kind), b.try_cast(kind)
    floating = ("double", "float")
    if a_type in floating or b_type in floating:
        if all(t in floating or t in EXACT or t.startswith("decimal") and not _scale(t) for _, t in sides) and not all(t in floating for _, t in sides):
            whole = lambda c, t: F.when(F.floor(c) == c, c.cast("double").try_cast("decimal(38,0)")) if t in floating else c.cast("decimal(38,0)")
            return whole(*sides[0]), whole(*sides[1])
        return tuple(c.cast("double") if t in floating or exact(t) else c.try_cast("double") for c, t in sides)
    return a.cast("string"), b.cast("string")
