"""Train, validation and test rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.graph import NODE, RANGE, with_node_ids, with_ranges

#: The node numbers of rows that are split.
OWN = "_own"


def _name(position: Column, n: Column, train: int, val: int) -> Column:
    # In long: 85 times 26 million rows is beyond an int.
    n = n.cast("long")
    a, b = F.floor(n * train / 100), F.floor(n * (train + val) / 100)
    return F.when(position < a, "train").when(position < b, "val").otherwise("test")


def by_position(df: DataFrame, order: list[str], train: int = 70, val: int = 15, rows: int = RANGE) -> DataFrame:
    """df with split, by the rows' places in the order: shares in per cent, rounded down.

    Rows are dealt into ranges of about `rows` by their values. A split ends within one range, so only the rows of these ranges, two at most, are numbered; those of all others
    stay where they are. Node numbers are left out, but for those in a column OWN, which tells no ties apart.
    """
    kept = [c for c in df.columns if c != NODE]
    tie = [c for c, t in df.dtypes if c not in (NODE, OWN) and "map<" not in t and t != "variant"]
    ranged = with_ranges(df, order, rows, tie)
    sizes = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect())
    n, starts, at = sum(size for _, size in sizes), {}, 0
    cuts = n * train // 100, n * (train + val) // 100
    for number, size in sizes:
        starts[number], at = at, at + size
    cut = {number: starts[number] for number, size in sizes if any(starts[number] < c < starts[number] + size for c in cuts)}
    few = F.broadcast(df.sparkSession.createDataFrame(list(cut.items()), "_range int, _start long"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy("_order")) - 1
    numbered = ranged.join(few, "_range").withColumn("split", _name(place, F.lit(n), train, val)).select(*kept, "split")
    if len(sizes) == 1 and cut:
        return numbered
    # A range in which no split ends has one split, from a table and not by a condition on _range: a filter of split then reads that table, where a condition would be moved below the steps that make _range.
    names = [(number, ("train", "val", "test")[sum(start >= c for c in cuts)]) for number, start in starts.items() if number not in cut]
    whole = F.broadcast(df.sparkSession.createDataFrame(names, "_range int, split string"))
    return ranged.join(whole, "_range").select(*kept, "split").unionByName(numbered)


def temporal(df: DataFrame, time_col: str, key: str, train: int = 70, val: int = 15) -> DataFrame:
    """Earlier rows train, later ones test; ties by key. Rows without a time are in no split."""
    return by_position(df.where(F.col(time_col).isNotNull()), [time_col, key], train, val)


def by_hash(df: DataFrame, key: str, seed: int = 42, train: int = 70, val: int = 15) -> DataFrame:
    """Random split: places in the order of a digest of the key."""
    hashed = df.withColumn("_m", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return by_position(hashed, ["_m", key], train, val).drop("_m")


#: Fixed value: where the generator of shuffled splits starts.
SHUFFLE_SEED = 0x9E3779B97F4A7C15


def permutation(n: int, seed: int = SHUFFLE_SEED) -> list[int]:
    """0..n-1 in the order of a Fisher-Yates shuffle with an xorshift64* generator.

    For tables small enough for the driver, where the order must be that of the fixed generator: by_permutation() splits by it. by_hash() is for all others.
    """
    word = (1 << 64) - 1
    order, x = list(range(n)), seed
    for last in reversed(range(1, n)):
        x ^= x >> 12
        x = (x ^ x << 25) & word
        x ^= x >> 27
        pick = (x * 0x2545F4914F6CDD1D & word) % (last + 1)
        order[last], order[pick] = order[pick], order[last]
    return order


#: Rows whose order by the fixed generator is worked out at the driver, at some 100 bytes each.
SHUFFLED = 2_000_000


def by_permutation(df: DataFrame, order: list[str], seed: int = SHUFFLE_SEED, train: int = 70, val: int = 15, most: int = SHUFFLED) -> DataFrame:
    """Random split of the fixed generator: rows are numbered by `order`, and the permutation's first places train, the next ones validate.

    The generator is a sequence, so the table (row number, place) is made at the driver and joined by row number; tables of over `most` rows are refused, and by_hash() is for them.
    """
    placed = with_node_ids(df.drop(NODE), order).withColumnRenamed(NODE, "_row")
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are over the {most} whose fixed order can be worked out: split by hash, or raise the limit")
    place = np.empty(n, np.int64)
    place[np.array(permutation(n, seed), np.int64)] = np.arange(n)
    table = df.sparkSession.createDataFrame(pa.table({"_row": np.arange(n), "_pos": place}))
    return placed.join(table, "_row").withColumn("split", _name(F.col("_pos"), F.lit(n), train, val)).drop("_row", "_pos")


def stats(df: DataFrame, label: str = "label", time_col: str | None = None) -> DataFrame:
    """(split, n, n_pos, n_neg, pos_rate[, first, last])."""
    pos = F.sum((F.col(label) > 0.5).cast("long"))
    aggs = [F.count("*").alias("n"), pos.alias("n_pos"), (F.count("*") - pos).alias("n_neg"), (pos / F.count("*")).alias("pos_rate")]
    if time_col:
        aggs += [F.min(time_col).alias("first"), F.max(time_col).alias("last")]
    return df.groupBy("split").agg(*aggs)
