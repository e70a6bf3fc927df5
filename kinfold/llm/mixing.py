"""Mix sources to target weights with nested hash thresholds: no sort, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Levels of the nested histograms, and hexadecimal digits (4 bits) that each adds.
LEVELS, DIGITS = 4, 3


def words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """From (source, source_size), one row per source, to (source, source_size, target).

    Weights go round over the sources by code point, null last. All sizes together are shared by weight;
    no source gets over `most` times its size, and what that leaves goes to the others by weight again.
    That ends at one level: target = min(most * size, level * weight). Sources stand in the order in which
    they reach it, so running sums give the level. The table has one row per source, and one task sorts it: that bounds sources to
    what a task can sort, some hundred million, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size").cast("double") * most)
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    earlier, rest = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(rest)
    # The levels fall along that order until the first that its own source does not reach: the lowest that fits.
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.row_number().over(by_need).alias("at"), F.col("_level").alias("level")))
    final = ranked.withColumn("_level", level).withColumn("_fits", fits).withColumn("_l", F.min("_fits").over(everything)["level"])
    return final.select("source", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_l") * F.col("_w")), F.col("_cap")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies and taken = size * copies.

    A source with a target of r times its size takes all its documents floor(r) times, and once more
    those whose hash lies below a threshold, so that the words taken come near the target from below.
    The threshold is found in nested histograms of the hash: per source and bucket sizes are summed
    (partial sums first, so a hot source or key is spread), buckets below the budget are taken, and
    only the boundary bucket is looked at with more bits. After LEVELS * DIGITS * 4 = 48 bits the
    boundary holds one id; it is left out.
    Null or empty text has size 0; null sources are a source of their own; rows that repeat an id and a
    text share a hash and are taken or left together; an empty table gives an empty one. Other columns are ignored, whatever their names; those in
    `carry` go along, and must have names that the result doesn't use (a struct holds any columns).
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    read = docs.select(F.col(id_col), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.substring(key, 1, LEVELS * DIGITS).alias("_key"), *carry)
    rows = cut(read.drop(*carry))
    goal = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("_times", whole).withColumn("_need", F.col("target") - F.col("_times") * F.col("source_size"))
    edge = goal.select("source", "_need", F.lit("").alias("_edge"))
    for level in range(1, LEVELS + 1):
        bucket = F.substring("_key", 1, level * DIGITS)
        b = edge.select(F.col("source").alias("_s"), "_need", "_edge")
        inside = rows.join(b, rows.source.eqNullSafe(b["_s"]) & F.col("_key").startswith(F.col("_edge")))
        sums = inside.groupBy("source", bucket.alias("_bucket"), "_need").agg(F.sum("size").alias("_sum"))
        by_hash = Window.partitionBy("source").orderBy("_bucket")
        sums = sums.withColumn("_upto", F.sum("_sum").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
        over = F.col("_upto") > F.col("_need")
        edge = cut(sums.where(over).groupBy("source").agg(F.min_by(F.struct("_bucket", (F.col("_need") - (F.col("_upto") - F.col("_sum"))).alias("_need")), "_bucket").alias("_e")).select("source", F.col("_e._need").alias("_need"), F.col("_e._bucket").alias("_edge")))
    # The keys below a source's last boundary are exactly those in buckets that fit at some level.
    last = edge.select(F.col("source").alias("_s2"), F.col("_edge").alias("_until"))
    goal = goal.join(last, goal.source.eqNullSafe(last["_s2"]), "left").drop("_s2")
    goal = goal.withColumnRenamed("source", "_s")
    if not carry:
        read = rows
    out = read.join(goal, read.source.eqNullSafe(goal["_s"]))
    more = (F.col("_need") > 0) & (F.col("_until").isNull() | (F.col("_key") < F.col("_until")))
    copies = F.col("_times") + more.cast("long")
    return out.select(id_col, "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *carry)
