"""Primary and foreign keys: detection by names, types and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.schema import Database, ForeignKey, LogicalType, Table, aligned

#: Share of a column's values that must be found among the keys of its target.
COVERAGE = 0.99
# Names of columns that hold the time of a row.
TIME_NAMES = ("timestamp", "date", "datetime", "created_at", "updated_at", "t_dat", "event_time", "event_date")
_STRINGS = (LogicalType.CATEGORICAL, LogicalType.TEXT)


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_distinct, is_unique) by counting values first: one shuffle for all columns, no Expand."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("c")).select("c.*")
    values = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    out = values.groupBy("column").agg(F.sum("n").cast("long").alias("n_rows"), F.count("value").cast("long").alias("n_distinct"))
    return out.withColumn("is_unique", F.col("n_rows") == F.col("n_distinct"))


# How a table's primary key is spelt.
def pk_candidates(table: str, columns: list[str]) -> list[str]:
    """Columns named as a primary key would be, in order of preference; their own spelling."""
    one = table.rstrip("s")
    wanted = [x.lower() for x in ("id", f"{table}Id", f"{table}_id", f"{one}Id", f"{one}_id")]
    by_name = {c.lower(): c for c in columns}
    return [by_name[w] for w in dict.fromkeys(wanted) if w in by_name]


def detect_pk(name: str, df: DataFrame) -> str | None:
    """The first candidate whose values are all different and not null."""
    found = pk_candidates(name, df.columns)
    if not found:
        return None
    unique = {r["column"] for r in uniqueness(df, found).where("is_unique").collect()}
    return next((c for c in found if c in unique), None)


def detect_time_col(df: DataFrame) -> str | None:
    """The first column of a time type or of a well-known name."""
    for field in df.schema.fields:
        if field.dataType.simpleString().startswith(("timestamp", "date")) or field.name.lower() in TIME_NAMES:
            return field.name
    return None


def name_matches_pk(column: str, pk: str, target: str) -> bool:
    """The same name, or the target's singular with Id."""
    one = target[:-1] if target.endswith("s") else target
    return column == pk or column.lower() == f"{one}Id".lower()


def compatible(a: LogicalType, b: LogicalType) -> bool:
    return (a is LogicalType.NUMERICAL and b is LogicalType.NUMERICAL) or (a in _STRINGS and b in _STRINGS)


def fk_coverage(src: DataFrame, column: str, dst: DataFrame, pk: str) -> DataFrame:
    """(n_values, n_found, coverage) of the non-null values; 0 without any.

    Values are counted before the join, so a hot value is one row in it.
    """
    own, its = aligned(F.col(column), dict(src.dtypes)[column], F.col(pk), dict(dst.dtypes)[pk])
    values = src.where(F.col(column).isNotNull()).groupBy(own.alias("_k")).agg(F.count("*").alias("n"))
    keys = dst.select(its.alias("_k"), F.lit(1).alias("hit")).where("_k is not null").distinct()
    sums = values.join(keys, "_k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_values"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).cast("long").alias("n_found"))
    return sums.withColumn("coverage", F.when(F.col("n_values") > 0, F.col("n_found") / F.col("n_values")).otherwise(0.0))


def fk_candidates(db: Database) -> list[tuple[str, str, str]]:
    """(table, column, target) by name and type; values are looked at later. A column may have several targets."""
    out = []
    for t in db.tables.values():
        declared = {fk.column for fk in t.fks}
        for c, kind in t.types.items():
            if c == t.pk or c in declared or kind is LogicalType.TIMESTAMP:
                continue
            for other in db.tables.values():
                if other.name != t.name and other.pk and name_matches_pk(c, other.pk, other.name) and compatible(kind, other.types[other.pk]):
                    out.append((t.name, c, other.name))
    return out


def detect_fks(db: Database, least: float = COVERAGE) -> DataFrame | None:
    """(table, column, target, n_values, n_found, coverage) of the candidates covered well enough; None without candidates.

    All candidates go through one count of (candidate, value), each table being read once, and one join with the keys of all targets; Spark may put a runtime filter of
    the keys before it. Values are compared as text in the type that aligned() finds for the pair, in which equal values read the same.
    """
    found = fk_candidates(db)
    if not found:
        return None
    sides, targets = {}, {}
    for i, (name, column, target) in enumerate(found):
        src, dst = db.get_table(name), db.get_table(target)
        own, its = aligned(F.col(column), dict(src.df.dtypes)[column], F.col(dst.pk), dict(dst.df.dtypes)[dst.pk])
        form = (target, src.df.select(own.alias("k")).dtypes[0][1])
        to = targets.setdefault(form, (len(targets), its))[0]
        sides.setdefault(name, []).append(F.struct(F.lit(i).alias("i"), F.lit(to).alias("to"), _text(own, form[1]).alias("v"), F.col(column).isNotNull().alias("is")))
    spark = next(iter(db.tables.values())).df.sparkSession
    rows = reduce(DataFrame.unionByName, [db.get_table(n).df.select(F.explode(F.array(*s)).alias("c")).select("c.*").where("is") for n, s in sides.items()])
    values = rows.groupBy("i", "to", "v").agg(F.count("*").alias("n"))
    keys = reduce(DataFrame.unionByName, [db.get_table(t).df.select(F.lit(to).alias("to"), _text(its, kind).alias("v")).where("v is not null") for (t, kind), (to, its) in targets.items()])
    hits = values.join(keys.distinct().withColumn("hit", F.lit(True)), ["to", "v"], "left")
    sums = hits.groupBy("i").agg(F.sum("n").alias("n_values"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("n_found"))
    names = spark.createDataFrame([(i, *c) for i, c in enumerate(found)], "i int, table string, column string, target string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = names.join(sums, "i", "left").select("table", "column", "target", zero("n_values"), zero("n_found"))
    return out.withColumn("coverage", F.when(F.col("n_values") > 0, F.col("n_found") / F.col("n_values")).otherwise(0.0)).where(F.col("coverage") >= least)


def _text(key: Column, kind: str) -> Column:
    """A key as text; the two zeros of doubles are one."""
    return (key + F.lit(0.0) if kind in ("double", "float") else key).cast("string")


def with_detected_fks(db: Database, least: float = COVERAGE) -> Database:
    found = detect_fks(db, least)
    out = Database(dict(db.tables))
    for r in found.collect() if found is not None else []:
        t = out.get_table(r["table"])
        out.put(Table(t.name, t.df, t.types, t.pk, t.time_col, (*t.fks, ForeignKey(r["column"], r["target"]))))
    return out
