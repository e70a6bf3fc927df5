"""Rows as nodes, foreign keys as typed edges, and message passing along them."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.keys import compatible
from kinfold.schema import Database, Table, aligned

log = logging.getLogger(__name__)
NODE = "_nid"
#: Rows of a range that one task numbers, and ranges at most.
RANGE, RANGES = 250_000, 1 << 14


@dataclass(frozen=True)
class EdgeType:
    src: str
    fk: str
    dst: str

    @property
    def name(self) -> str:
        return f"{self.src}__{self.fk}__{self.dst}"

    @property
    def reverse(self) -> EdgeType:
        return EdgeType(self.dst, f"rev_{self.fk}", self.src)


@dataclass
class Graph:
    """Node tables with ids, and one table (src, dst) of each edge type in either direction."""

    nodes: dict[str, DataFrame]
    edges: dict[EdgeType, DataFrame]

    def summary(self) -> DataFrame:
        """(kind, name, n) of node and edge types, and all edges."""
        frames = [df.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit(n).alias("name"), "n") for n, df in self.nodes.items()]
        frames += [df.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit(e.name).alias("name"), "n") for e, df in self.edges.items()]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        total = out.where("kind = 'edge'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit("edges").alias("name"), "n")
        return out.unionByName(total)


def _spread(rows: list, parts: int) -> list:
    """parts - 1 of the sorted rows, evenly spaced, without repeats."""
    picked = [rows[len(rows) * i // parts] for i in range(1, parts)] if rows else []
    return [x for i, x in enumerate(picked) if i == 0 or x != picked[i - 1]]


def with_ranges(df: DataFrame, order: list[str], rows: int = RANGE, tie: list[str] | None = None) -> DataFrame:
    """df with _order, a struct that orders the rows, and _range, which of the ranges of that order a row is in, from 0.

    A range is a function of a row's values alone: its bounds come once from a sample that the values choose (16 rows a
    range, at most 2**18 rows of the order's columns) and are literals of the plan, so every branch that reads the result sees the same ranges,
    however Spark partitions it. Rows that tie are told apart by a hash of all columns, or of those named.
    Rows of some ranges are to be found by joining these: a filter of _range is moved below the steps that make it, and doubles with each.
    """
    hashable = tie or [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    keyed = df.withColumn("_order", F.struct(*order, F.xxhash64(*hashable).alias("_tie")))
    n = df.count()
    ranges = max(1, min(RANGES, -(-n // rows)))
    if ranges == 1:
        return keyed.withColumn("_range", F.lit(0))
    every = max(1, n // (16 * ranges))
    sample = keyed.where(F.pmod(F.xxhash64("_order"), F.lit(every)) == 0).select("_order").sort("_order").collect()
    bounds = _spread([r["_order"] for r in sample], ranges)
    kind = keyed.schema["_order"].dataType.simpleString()
    # The bounds are one value of the plan, not a column that each row carries; a row's range, the number of bounds below it, takes as many steps as that number has bits.
    known = df.sparkSession.createDataFrame([(bounds,)], f"_bounds array<{kind}>").scalar()
    placed = keyed.withColumn("_range", F.lit(0))
    for i in reversed(range(len(bounds).bit_length())):
        placed = placed.withColumn("_range", F.col("_range") + F.when(F.get(known, F.col("_range") + (1 << i) - 1) < F.col("_order"), 1 << i).otherwise(0))
    return placed


def with_node_ids(df: DataFrame, order: list[str], rows: int = RANGE) -> DataFrame:
    """Dense ids from 0 in the order of the columns, ties by a hash of all columns.

    Rows are dealt into ranges of about `rows` by their values; ranges get their first id from a table of one row per range
    (small enough to be broadcast) and number their own rows. Rows equal in all columns are interchangeable. Nulls come first.
    """
    ranged = with_ranges(df, order, rows)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    own = Window.partitionBy("_range").orderBy("_order")
    out = ranged.withColumn("_r", F.row_number().over(own)).join(F.broadcast(starts), "_range")
    return out.withColumn(NODE, (F.col("_s") + F.col("_r") - 1).cast("long")).drop("_range", "_s", "_r", "_order")


def pk_index(df: DataFrame, pk: Column | str, node: str = NODE) -> DataFrame:
    """(key, node), one row per key: the last row of a repeated key stands."""
    key = F.col(pk) if isinstance(pk, str) else pk
    return df.where(key.isNotNull()).groupBy(key.alias("_key")).agg(F.max(node).alias("dst"))


def fk_edges(src: DataFrame, fk: str, dst: DataFrame, pk: str, src_node: str = NODE, dst_node: str = NODE) -> DataFrame:
    """(src, dst) node ids of each row whose key is found; null and dangling keys give no edge. Keys of different types are compared as aligned() says, exactly."""
    own, its = aligned(F.col(fk), dict(src.dtypes)[fk], F.col(pk), dict(dst.dtypes)[pk])
    left = src.select(F.col(src_node).alias("src"), own.alias("_key")).where("_key is not null")
    return left.join(pk_index(dst, its, dst_node), "_key").select("src", "dst")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _usable(db: Database, table: Table, column: str, target: str) -> bool:
    if not db.has_table(target):
        log.warning("%s.%s refers to %s, which is not there: skipped", table.name, column, target)
        return False
    dst = db.get_table(target)
    if not dst.pk:
        log.warning("%s has no primary key: %s.%s is skipped", target, table.name, column)
        return False
    if not compatible(table.types[column], dst.types[dst.pk]):
        log.warning("%s.%s and %s.%s have different types: skipped", table.name, column, target, dst.pk)
        return False
    return True


def build_graph(db: Database) -> Graph:
    """Edges of each usable foreign key, and the same ones reversed. Tables need node ids in the column _nid."""
    edges: dict[EdgeType, DataFrame] = {}
    for t in db.tables.values():
        for fk in t.fks:
            if _usable(db, t, fk.column, fk.target):
                dst = db.get_table(fk.target)
                kind = EdgeType(t.name, fk.column, fk.target)
                edges[kind] = fk_edges(t.df, fk.column, dst.df, dst.pk)
                edges[kind.reverse] = reversed_edges(edges[kind])
    return Graph({t.name: t.df for t in db.tables.values()}, edges)


def neighbor_mean(edges: DataFrame, features: DataFrame, columns: list[str], node: str = "node") -> DataFrame:
    """(node, columns): per destination the mean of its neighbours' features. Nodes without neighbours are not in it."""
    joined = edges.join(features.withColumnRenamed(node, "src"), "src")
    return joined.groupBy(F.col("dst").alias(node)).agg(*(F.avg(c).alias(c) for c in columns))


def with_zeros(nodes: DataFrame, means: DataFrame, columns: list[str], node: str = "node") -> DataFrame:
    """Means of all nodes; those without neighbours have zeros."""
    return nodes.select(node).join(means, node, "left").select(node, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("degree"))


def neighbor_mean_backward(edges: DataFrame, grads: DataFrame, columns: list[str], node: str = "node") -> DataFrame:
    """(node, columns): a source gets the sum of its destinations' gradients, each divided by the destination's degree."""
    shared = grads.join(degrees(edges).withColumnRenamed("dst", node), node).select(F.col(node).alias("dst"), *((F.col(c) / F.col("degree")).alias(c) for c in columns))
    return edges.join(shared, "dst").groupBy(F.col("src").alias(node)).agg(*(F.sum(c).alias(c) for c in columns))
