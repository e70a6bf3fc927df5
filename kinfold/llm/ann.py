"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

log = logging.getLogger(__name__)
#: Tables; rows of a bucket in one task at most, on average; rows that a bucket should hold; most probes tried.
TABLES, PART, ROWS, PROBES = 8, 1 << 16, 1 << 12, 2048
#: Rows and queries that the number of probes is fitted on, and the recall that it must reach there.
SAMPLE, ASKED, RECALL = 4096, 256, 0.95


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """A pseudo-rotation: three times, random signs and a Hadamard transform."""
    rng = np.random.default_rng((seed, table))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def axes(x: np.ndarray, most: int) -> np.ndarray:
    """The `most` nearest signed axes of each row, nearest first: 2 i for +e_i, 2 i + 1 for -e_i."""
    signed = np.stack([x, -x], axis=2).reshape(len(x), -1)
    most = min(most, signed.shape[1])
    near = np.argpartition(-signed, most - 1, axis=1)[:, :most]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(signed, near, axis=1), axis=1, kind="stable"), axis=1)


def _unit(vectors: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Unit vectors whose cosine orders as the inner product: rows get a coordinate that fills them up to the largest norm."""
    width = 1 << int(vectors.shape[1]).bit_length()  # one coordinate more at least
    out = np.zeros((len(vectors), width))
    if query:
        out[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    else:
        out[:, : vectors.shape[1]] = vectors / norm
        out[:, -1] = np.sqrt(np.maximum(0, 1 - (out * out).sum(axis=1)))
    return out


def polytopes(n: int, width: int, rows: int = ROWS) -> int:
    """Polytopes hashed together in a table, so that a bucket's share of n rows stays about the same."""
    return max(1, round(np.log(max(1, n) / rows) / np.log(2 * width)))


def hashed(unit: np.ndarray, table: int, count: int, most: int, seed: int) -> np.ndarray:
    """The `most` nearest buckets of a table, nearest first: one axis of each polytope, by the sum of the coordinates.

    The best sums of two lists need only the best of either, so polytopes are added one by one.
    """
    base = 2 * unit.shape[1]
    code, total = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for j in range(count):
        x = rotated(unit, table * count + j, seed)
        near = axes(x, most)
        value = np.take_along_axis(np.stack([x, -x], axis=2).reshape(len(x), -1), near, axis=1)
        sums = (total[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        codes = (code[:, :, None] * base + near[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-sums, axis=1, kind="stable")[:, :most]
        code, total = np.take_along_axis(codes, best, axis=1), np.take_along_axis(sums, best, axis=1)
    return code


def fitted_probes(sample: np.ndarray, norm: float, flat: bool, k: int, tables: int, count: int, seed: int, tried: int = PROBES) -> tuple[int | None, float]:
    """(the fewest probes a table with which the sample's first rows find RECALL of their k nearest in the sample, the recall there).

    Neighbours in a sample are farther than in the whole, so the whole needs no more probes. None if `tried` probes, or all buckets, don't do:
    a neighbour that none of them reaches is missed.
    """
    if len(sample) < 2:
        return 1, 1.0
    asked = sample[:ASKED]
    plain = flat and sample.shape[1] & (sample.shape[1] - 1) == 0
    rows, queries = (sample, asked) if plain else (_unit(sample, norm, False), _unit(asked, norm, True))
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, len(sample) - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    most = min((2 * rows.shape[1]) ** count, tried)
    needed = np.full(near.shape, np.inf)
    for t in range(tables):
        own, order = hashed(rows, t, count, 1, seed)[:, 0], hashed(queries, t, count, most, seed)
        for q in range(len(asked)):
            same = order[q][:, None] == own[near[q]][None]
            needed[q] = np.minimum(needed[q], np.where(same.any(axis=0), same.argmax(axis=0) + 1, np.inf))
    probes = np.quantile(needed, RECALL, method="higher")
    return (int(probes), float((needed <= probes).mean())) if np.isfinite(probes) else (None, float(np.isfinite(needed).mean()))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _packed(vectors: np.ndarray, kind: str) -> pa.Array:
    """The bytes of each row: Spark moves them as they are, and lists number by number."""
    data = np.ascontiguousarray(vectors.astype(kind))
    width = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1).astype(np.float64)


def _hash(tables: int, count: int, probes: int, seed: int, norm: float, flat: bool, parts: int, kind: str):
    """Rows (bucket, part, query, key, vector): an index row for its bucket in each table, a query for each bucket it probes."""
    schema = pa.schema([("bucket", pa.int64()), ("part", pa.int32()), ("query", pa.int8()), ("key", pa.int64()), ("v", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, vectors = batch.column(0), _vectors(batch.column(1))
            packed = _packed(vectors, kind)
            own_part = batch.column(2).to_numpy().astype(np.int32)
            for query, rows in ((0, np.arange(len(vectors))), (1, np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False)))):
                if not len(rows):
                    continue
                x = vectors[rows] if not flat else vectors[rows] / np.linalg.norm(vectors[rows], axis=1, keepdims=True)
                unit = x if flat and x.shape[1] & (x.shape[1] - 1) == 0 else _unit(vectors[rows], norm, bool(query))
                for t in range(tables):
                    bucket = hashed(unit, t, count, probes if query else 1, seed) * tables + t
                    n = bucket.shape[1]
                    for part in range(parts if query else 1):
                        at = pa.array(np.repeat(rows, n))
                        where = np.full(len(rows) * n, part, np.int32) if query else own_part[rows]
                        yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1)), pa.array(where), pa.array(np.full(len(rows) * n, query, np.int8)), key.take(at), packed.take(at)], schema=schema)

    return apply


def _nearest(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of lists of (ids, scores), each id once; ties to the smaller id."""
    ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
    scores = np.concatenate([p[1] for p in parts])[at]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _best(found: dict[int, list], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each query: its best k so far, as lists."""
    if found:
        lists = [_nearest(parts, k) for parts in found.values()]
        offsets = pa.array(np.cumsum([0, *(len(x[0]) for x in lists)]), pa.int32())
        ids, scores = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[i] for x in lists]))) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), ids, scores], names=["q", "ids", "scores"])


def _merged(k: int):
    """From each query's lists to a row for each of its best k."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(q, *_nearest([(np.array(p["ids"], np.int64), np.array(p["scores"])) for p in parts], k)) for q, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                q = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.concatenate([r[2] for r in rows]))], names=["q", "near", "score"])

    return apply


def _rerank(k: int, kind: str, kept: int = 4000):
    """Rows come sorted by (bucket, part, query): a bucket's vectors, then its queries, scored in blocks; the best k of each."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[int, int] | None = None
        keys: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        found: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, part, query, key = (batch.column(i).to_numpy() for i in range(4))
            vectors = _unpacked(batch.column(4), kind)
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, len(key)], strict=True):
                if group != (bucket[a], part[a]):
                    group, keys, rows = (bucket[a], part[a]), [], []
                if not query[a]:
                    keys.append(key[a:b]), rows.append(vectors[a:b])
                    continue
                if not keys:
                    continue
                ids, index = np.concatenate(keys), np.concatenate(rows)
                keys, rows = [ids], [index]
                for i in range(a, b, 256):
                    asked = vectors[i : min(b, i + 256)]
                    take = min(k + 8, len(ids))
                    near = np.argpartition(-(asked @ index.T), take - 1, axis=1)[:, :take]
                    # Summed pair by pair, so that a score doesn't depend on what it was computed with.
                    scores = (index[near] * asked[:, None]).sum(axis=2)
                    for q, own, score in zip(key[i : i + len(asked)].tolist(), ids[near], scores, strict=True):
                        found.setdefault(q, []).append((own, score))
            if len(found) > kept:
                yield from _best(found, k)
                found = {}
        yield from _best(found, k)

    return apply


def search(table: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, probes: int | None = None, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", rows_in_bucket: int = ROWS, tried: int = PROBES) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every`, the k rows found of largest inner product.

    Ties go to the smaller id, a query is no neighbour of itself, scores are double precision on the original
    vectors. Null, zero and non-finite vectors, and null ids, take no part; vectors must be of one width.
    Equal vectors are searched as one, under their k + 1 smallest ids (no query can need more), so a vector that many rows
    hold is one row of the index; extra columns are ignored; repeated rows count once.
    The recall reached on the sample is logged. Where the most probes tried don't reach RECALL there, every query is compared with every
    row, in blocks.
    """
    v = F.col(vector_col)
    number, kind = ("float", "<f4") if table.schema[vector_col].dataType.simpleString() == "array<float>" else ("double", "<f8")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.where(ok).select(F.col(id_col).cast("long").alias("id"), v.cast(f"array<{number}>").alias("v"))
    # -0.0 equals 0.0 as a score; one form of it makes equal vectors equal keys.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(number))).dropDuplicates(["id", "v"])
    salted = Window.partitionBy("_h", "v", "_salt").orderBy("id")
    by_vector = Window.partitionBy("_h", "v").orderBy("id")
    keyed = rows.withColumn("_h", F.xxhash64("v"))
    first = keyed.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k + 1)
    first = first.withColumn("_r", F.row_number().over(by_vector)).where(F.col("_r") <= k + 1).groupBy("_h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = keyed.where(F.col("id") % every == 0).groupBy("_h", "v").agg(F.lit(True).alias("_asked"))
    distinct = cut(first.join(asked, ["_h", "v"], "left").withColumn("key", F.col("ids")[0]).withColumn("asked", F.coalesce("_asked", F.lit(False))))
    facts = distinct.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("n")).agg(F.max("n"), F.min("n"), F.count("*")).first()
    largest, least, n = (facts[0] or 1.0) ** 0.5, (facts[1] or 1.0) ** 0.5, facts[2]
    flat, size = least > 0.999999 * largest, len(distinct.select("v").first()["v"]) if n else 1
    width = size if flat and size & (size - 1) == 0 else 1 << size.bit_length()
    count = polytopes(n, width, rows_in_bucket)
    if probes is None:
        share = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 20)) < max(1, int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)))
        sample = np.array([r["v"] for r in distinct.where(share).orderBy("key").select("v").limit(2 * SAMPLE).collect()])
        probes, recall = fitted_probes(sample, largest, flat, k, tables, count, seed, tried)
        log.info("%d polytopes a table: %s probes reach a recall of %.3f in the sample", count, probes, recall)
        if probes is None:
            # No polytope: one bucket holds all, in parts that every query visits.
            tables, count, probes = 1, 0, 1
    parts = max(1, -(-n // (PART * (2 * width) ** count)))
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    dealt = distinct.select("key", "v", part.alias("part"), "asked").mapInArrow(_hash(tables, count, probes, seed, largest, flat, parts, kind), "bucket long, part int, query byte, key long, v binary")
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "query")
    lists = dealt.mapInArrow(_rerank(k + 1, kind), "q long, ids array<long>, scores array<double>")
    # A query has a list of k + 1 for each task that holds buckets it probes, tables * probes * parts at most.
    together = lists.groupBy("q").agg(F.collect_list(F.struct("ids", "scores")).alias("lists"))
    near = cut(together.mapInArrow(_merged(k + 1), "q long, near long, score double"))
    # From distinct vectors to rows: the neighbours' ids, and every query that has the vector.
    ids = distinct.select(F.col("key").alias("near"), "ids")
    names = near.join(ids, "near").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    queries = keyed.where(F.col("id") % every == 0).join(distinct.select("_h", "v", F.col("key").alias("q")), ["_h", "v"]).select("q", F.col("id").alias("query_id"))
    spread = queries.join(names, "q").select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", F.explode("f.ids").alias("near")).where("near <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "near")
    out = spread.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("near").alias(id_col), "score")
