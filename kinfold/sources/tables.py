"""Reading tables: CSV files with inferred types, SQL results, and the task tables and splits that go with them."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.infer import categorical, infer_types, number_types, parse, parse_number
from kinfold.operators.keys import detect_pk, detect_time_col
from kinfold.schema import Database, ForeignKey, LogicalType, Table, exact, logical_type_of, typed
from kinfold.sources.shared import exists


log = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str, name: str, overrides: dict[str, LogicalType] | None = None, pk: str | None = None, time_col: str | None = None, fks: tuple[ForeignKey, ...] = (), raw_columns: Sequence[str] = ()) -> Table:
    """A table from a CSV file with a header: quotes doubled within quotes, no trimming, short rows padded with null.

    The file is read as strings; explicit types win, the others follow from all values. Cells that don't parse are null. Numbers are integers or decimals
    where a double would mix them up (number_types), so that keys of any length stay apart. raw_columns
    are also kept as they stand in the file, as <column>_raw, which is TEXT.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", None).option("emptyValue", "").csv(path)
    types = infer_types(raw, overrides)
    kept = {f"{c}_raw": c for c in raw_columns}
    numbers = number_types(raw, [c for c, t in types.items() if t is LogicalType.NUMERICAL])
    df = raw.select(*(parse(F.col(c), t, numbers.get(c, "double")).alias(c) for c, t in types.items()), *(F.col(c).alias(n) for n, c in kept.items()))
    return Table(name, df, types | dict.fromkeys(kept, LogicalType.TEXT), pk, time_col, fks)


def side_file(spark: SparkSession, path: str, numbers: Mapping[str, str]) -> DataFrame | None:
    """Columns of a CSV file that may not be there (None then): {name: its name in the header}, whose blanks are trimmed.

    Cells are numbers; blanks, what is none, and columns that the file lacks are 0.
    """
    if not exists(spark, path):
        log.info("%s is not there: skipped", path)
        return None
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    zero = lambda c: F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0)) if c in raw.columns else F.lit(0.0)
    return raw.select(*(zero(source).alias(name) for name, source in numbers.items()))


def _held(values: Sequence) -> tuple[str, type]:
    """The type that holds Python's numbers: integers of 64 bits, decimals where some are or integers are longer, else doubles."""
    some = [v for v in values if v is not None]
    if some and all(isinstance(v, int) for v in some) and all(-(1 << 63) <= v < 1 << 63 for v in some):
        return "bigint", int
    if some and all(isinstance(v, (int, Decimal)) for v in some):
        behind = max(max(0, -Decimal(v).as_tuple().exponent) for v in some)
        return f"decimal(38,{behind})", Decimal
    return "double", float


def from_columns(spark: SparkSession, tables: Mapping[str, Mapping]) -> Database:
    """A database from {table: {"columns": [{"name", "type", "values"}], "pkey_col", "time_col", "foreign_keys": [{"column", "references"}]}}.

    type: numerical, categorical, timestamp (text or seconds since 1970) or text. Lists must be equally long.
    """
    db = Database()
    for name, spec in tables.items():
        columns = spec["columns"]
        types = {c["name"]: LogicalType(c["type"].upper()) for c in columns}
        if len({len(c["values"]) for c in columns}) > 1:
            raise ValueError(f"the columns of {name} are not equally long")
        kinds = {c["name"]: _held(c["values"]) if types[c["name"]] is LogicalType.NUMERICAL else ("string", str) for c in columns}
        rows = list(zip(*([None if v is None else kinds[c["name"]][1](v) for v in c["values"]] for c in columns), strict=True))
        df = spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds[c][0]}" for c in types))
        times = [c for c, t in types.items() if t is LogicalType.TIMESTAMP]
        df = df.withColumns({c: F.coalesce(F.timestamp_seconds(F.col(c).try_cast("double")), F.col(c).try_cast("timestamp")) for c in times})
        db.add_table(Table(name, df, types, spec.get("pkey_col"), spec.get("time_col"), tuple(ForeignKey(k["column"], k["references"]) for k in spec.get("foreign_keys") or ())))
    return db


def read_csv_database(spark: SparkSession, folder: str, schemas: dict[str, dict] | None = None) -> Database:
    """Every *.csv of a folder, in any store that Spark reads; the table's name is the file's. schemas: arguments of read_csv by table."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    db = Database()
    for file in sorted(str(s.getPath()) for s in found):
        if file.endswith(".csv"):
            name = file.rsplit("/", 1)[-1][:-4]
            db.add_table(read_csv(spark, file, name, **(schemas or {}).get(name, {})))
    return db


def from_dataframe(name: str, df: DataFrame, pk: str | None = None, time_col: str | None = None, fks: tuple[ForeignKey, ...] = (), overrides: dict[str, LogicalType] | None = None, detect: bool = True) -> Table:
    """A table from typed columns: string columns are categorical if at most 5 % of their values differ (exactly counted).

    Integers and decimals are kept exactly; strings that are numbers by `overrides` are parsed as those of a file are.
    """
    types = {c: (overrides or {}).get(c) or logical_type_of(t) for c, t in df.dtypes}
    if texts := [c for c, t in types.items() if t is None]:
        row = categorical(df.select(*texts))
        types |= {c: LogicalType.CATEGORICAL if c in row else LogicalType.TEXT for c in texts}
    if detect:
        pk, time_col = pk or detect_pk(name, df), time_col or detect_time_col(df)
    if time_col:
        types[time_col] = LogicalType.TIMESTAMP
    physical = dict(df.dtypes)
    for c, kind in number_types(df, [c for c, t in types.items() if t is LogicalType.NUMERICAL and physical[c] == "string"]).items():
        df = df.withColumn(c, parse_number(F.col(c), kind))
    return Table(name, typed(df, types), types, pk, time_col, fks)


def task_table(spark: SparkSession, name: str, query: str, **kwargs) -> Table:
    """The result of a SQL query as a table of its name, written to the warehouse: its rows stay the same however often they are read."""
    spark.sql(query).write.mode("overwrite").saveAsTable(name)
    return from_dataframe(name, spark.table(name), **kwargs)


def catalog(spark: SparkSession, names: list[str] | None = None, fks: Mapping[str, tuple[ForeignKey, ...]] | None = None) -> Database:
    """The session's tables and views, or those named, with keys and times detected; fks: declared foreign keys by table."""
    db = Database()
    for name in names or [t.name for t in spark.catalog.listTables()]:
        db.add_table(from_dataframe(name, spark.table(name), fks=(fks or {}).get(name, ())))
    return db


def load_task(spark: SparkSession, path: str, table: DataFrame, pk: str, node: str = "_nid") -> DataFrame:
    """(node, label, split) from a CSV of (pk, label, split); of a repeated key the last row of the table counts.

    Keys that are not in the table are left out, and their number is logged. Numbers are compared as numbers ("7" is 7.0), exactly where the table's are exact.
    """
    rows = spark.read.option("header", True).csv(path).toDF("_key", "label", "split")
    kind = table.schema[pk].dataType.simpleString()
    if exact(kind):
        # Ten places more than the table's are room for fractions, so that 7.5 is no 7, as far as its integers leave any.
        digits, scale = map(int, kind[8:-1].split(",")) if kind.startswith("decimal") else (19, 0)
        kind = f"decimal(38,{min(scale + 10, 38 - digits + scale)})"
        rows = rows.withColumn("_key", F.col("_key").try_cast(kind))
    elif kind in ("double", "float"):
        kind = "double"
        rows = rows.withColumn("_key", F.col("_key").try_cast(kind))
    else:
        kind = "string"
    nodes = table.groupBy(F.col(pk).cast(kind).alias("_key")).agg(F.max(node).alias(node))
    found = rows.join(nodes, "_key", "left")
    if missing := found.where(F.col(node).isNull()).count():
        log.warning("%d rows of %s have no row in the table", missing, path)
    return found.where(F.col(node).isNotNull()).select(node, F.col("label").try_cast("double").alias("label"), "split")


def save_task(samples: DataFrame, table: DataFrame, pk: str, path: str, node: str = "_nid") -> None:
    """Writes pk, label and split as CSV; labels as integers."""
    samples.join(table.select(node, F.col(pk)), node).select(pk, F.col("label").cast("long").alias("label"), "split").write.option("header", True).mode("overwrite").csv(path)


def write_csv(db: Database, folder: str) -> None:
    """A folder of CSV for each table, as read_csv reads it: quotes are doubled."""
    for t in db.tables.values():
        t.df.write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(f"{folder}/{t.name}")
