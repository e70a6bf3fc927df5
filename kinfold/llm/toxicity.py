"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learned with FTRL-proximal."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LETTERS = re.compile(r"[^\W\d_]+")
#: Bits of a feature's hash; labelled rows that a model is fitted on, at most about so many.
BITS, ROWS = 22, 16_000
#: Rate, its damping, the penalties, passes over the rows, and rows that a feature must be in to be learned.
ALPHA, BETA, L1, L2, EPOCHS, SEEN = 2.0, 1.0, 12.0, 0.1, 8, 5


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashes of a text's words, word pairs, and pairs with one word skipped, repeats included."""
    found = _LETTERS.findall((text or "").lower())
    ids = np.fromiter(map(zlib.crc32, map(str.encode, found)), np.uint64, len(found))
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    one = (ids + np.uint64(1)) * a
    pair = (one[:-1] ^ (ids[1:] * b + np.uint64(7))) * a
    skip = (one[:-2] ^ (ids[2:] * b + np.uint64(13))) * a
    return (np.concatenate([one, pair, skip]) >> np.uint64(64 - bits)).astype(np.uint32)


def ftrl(rows: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not 0; the bias is the last, at index 2**bits.

    Rows are (label, distinct features). Each coordinate has its own rate; what L1 holds at zero stays there. Features of
    fewer than SEEN rows are left out, so that a row can't be learned by heart.
    """
    rows_with = np.zeros(1 << bits, np.int32)
    for _, found in rows:
        rows_with[found] += 1
    rows = [(y, found[rows_with[found] >= SEEN]) for y, found in rows]
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == 1 << bits, 0.0, L1)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    positive = sum(y for y, _ in rows)
    balance = (1.0, min(8.0, max(1.0, (len(rows) - positive) / max(1, positive))))
    for _ in range(epochs):
        for y, found in rows:
            at = np.append(found.astype(np.int64), 1 << bits)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * balance[y]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    at = np.union1d(at, [1 << bits])
    return at, weights(at)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from at most about `rows` labelled documents, chosen by the hash of their ids.

    The labels chosen are few enough to be broadcast, so texts are not shuffled but for those learned from; one
    task learns. Ids with two labels count as toxic; null ids and labels are left out; no labels, or no documents, give the bias 0. Rows that
    repeat an id are learned from as often as they come; texts of any length are read whole; other columns are ignored.
    """
    of = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    n = of.count()
    share = min(1.0, rows / max(1, n))
    key = F.pmod(F.xxhash64("_id", F.lit("ftrl")), F.lit(1 << 20))
    chosen = of.where(key < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    learned = texts.join(F.broadcast(chosen), "_id").select("_id", "text", "y")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(x.as_py())).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(found, pa.binary())], names=["id", "y", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(y.as_py(), np.frombuffer(f.as_py(), np.uint32)) for batch in batches for y, f in zip(batch.column(1), batch.column(2), strict=True)]
        at, w = ftrl(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["at", "w"])

    hashed = learned.mapInArrow(gathered, "id string, y int, f binary").withColumn("_k", F.xxhash64("id", "f"))
    model = hashed.repartition(1).sortWithinPartitions("_k", "id", "f").drop("_k").mapInArrow(learn, "at long, w double").toPandas()
    if model.empty:
        return np.array([1 << BITS]), np.zeros(1)
    return model["at"].to_numpy(), model["w"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability of label 1, from each distinct feature of the whole text; null counts as empty text, and has that of the bias.

    Repeated rows are scored alike; an empty table gives an empty one; other columns stay, one named as `into` is replaced. The weights travel sparse, in a broadcast of at most 2**BITS pairs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w = sent.value
        weights = np.zeros((1 << BITS) + 1, np.float32)
        weights[at] = w
        bias = float(weights[-1])
        for texts in batches:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                found = features(text)
                hits = np.unique(found[weights[found] != 0])
                out[i] = bias + float(weights[hits].sum(dtype=np.float64))
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(into, apply(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id"):
    """Whether a row's label may only be used to judge: crc32 of the id as text, mod 5, is 0 (null ids: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """docs with score; learned from the labels that are not held out. Repeated rows get equal scores."""
    return score(docs, fit(docs, labels.where(~held_out()), rows))
