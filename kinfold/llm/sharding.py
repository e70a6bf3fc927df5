"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(numbers: np.ndarray, size: int, seed: int, rounds: int = 4) -> np.ndarray:
    """Where a keyed bijection of 0..size-1 takes each number.

    A balanced network permutes the smallest even power of two that holds size; a number that leaves
    0..size-1 walks on along its cycle until it is back, which ends since the start lies inside.
    """
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = _mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for key in keys:
            left, right = right, left ^ (_mixed(right + key) & low)
        return (left << half) | right

    out = once(np.asarray(numbers, dtype=np.uint64))
    while len(walking := np.flatnonzero(out >= np.uint64(size))):
        out[walking] = once(out[walking])
    return out.astype(np.int64)


def permuted(number: Column, size: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def apply(rows: pd.Series) -> pd.Series:
        return pd.Series(feistel(rows.to_numpy(), size, seed))

    return apply(number)


def numbered(rows: DataFrame, name: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """Gapless numbers 0..n-1 that depend on the rows' values alone, whatever their partitions.

    Rows are ordered by a hash of all columns. Equal rows are counted before the shuffle and spread
    out again afterwards, so no key gathers more than its distinct rows. A histogram of the hash's
    leading bits (at most `buckets` rows, up to 2**24, so it may be broadcast) gives each bucket its first number.
    """
    columns = rows.columns
    keyed = rows.withColumn("_h", F.xxhash64(*columns))
    keyed = keyed.withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(buckets)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    distinct = keyed.groupBy("_b", "_h", *columns).agg(F.count("*").alias("_n"))
    within = Window.partitionBy("_b").orderBy("_h", *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(F.broadcast(starts), "_b")
    first = F.col("_start") + F.col("_at")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(name))


def shards(docs: DataFrame, count: int, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 8), text_crc32, shard and slot.

    The permuted number p of a row gives shard p % count and slot p // count: shard sizes differ by one
    row at most, slots are gapless, and either can be computed from the number alone.
    Null text has size 8 and checksum 0, as empty text has; null ids are numbered like any other value;
    repeated rows get places of their own; an empty table gives an empty one; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = docs.count()
    # About 100,000 rows a bucket, as far as the table of their first numbers can be broadcast (2**20 rows).
    at = numbered(rows, "_row", max(BUCKETS, min(1 << 20, 1 << (n // 100_000).bit_length()))).withColumn("_p", permuted(F.col("_row"), n, seed))
    return at.select(id_col, "size", "text_crc32", F.pmod(F.col("_p"), F.lit(count)).cast("int").alias("shard"), F.floor(F.col("_p") / F.lit(count)).cast("long").alias("slot"))
