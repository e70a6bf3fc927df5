"""Near duplicates by similarity of word shingles: bit-sliced comparison of SimHash fingerprints in MinHash bands, confirmed on the shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected
from .store import cut

#: Two texts of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS: 0.99995 at 0.8.
BANDS, ROWS = 25, 5
#: Members of a band key that are compared with all others first, one or two; members, and bytes of their texts, that are compared in one task.
HUBS, GROUP, GROUP_BYTES = 2, 2048, 1 << 26
#: Bytes of the shingle sets that a worker keeps while it compares.
CACHED = 1 << 27
#: Bits in which fingerprints of similar texts differ at most. Of equally large sets of similarity 0.8, 8/9 of each is common: a bit differs with
#: probability acos(8/9) / pi, so 9.7 bits do on average, with a spread of 2.9; 26 is beyond five and a half spreads.
RADIUS = 26
#: A set's marks are a byte of each of its least values. Those of sets at the least similarity agree in a share that is binomial; what is this many spreads below is not compared further.
SPREADS = 6

_seeds = np.random.default_rng(20240229)
_XOR = _seeds.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None]
_ODD = _seeds.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of `size` words as sorted 64-bit hashes; one of all words if there are fewer, none without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_hashes(text, size)]))


def sketch(of: np.ndarray, block: int = 4096) -> tuple[np.ndarray, bytes]:
    """A key for each band, a hash of its number and of the least values of its ROWS hash functions, and the marks: a byte of each least value."""
    least = np.full(BANDS * ROWS, _NONE)
    for i in range(0, len(of), block):
        least = np.minimum(least, ((of[None, i : i + block] ^ _XOR) * _ODD).min(axis=1))
    keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)
    return keys, (least >> np.uint64(24)).astype(np.uint8).tobytes()


def bands(of: np.ndarray) -> np.ndarray:
    return sketch(of)[0]


def least_marks(percent: int) -> int:
    """In how many marks sets of that similarity agree at least."""
    p, n = min(1.0, percent / 100), BANDS * ROWS
    return max(0, int(p * n - SPREADS * (p * (1 - p) * n) ** 0.5))


class _Sets:
    """Shingle sets by a key, made when they are asked for; the oldest go once they take more than CACHED bytes together."""

    def __init__(self, size: int) -> None:
        self.size, self.bytes, self.kept = size, 0, {}

    def of(self, key: int, text: str) -> np.ndarray:
        found = self.kept.get(key)
        if found is None:
            found = self.kept[key] = shingles(text, self.size)
            self.bytes += found.nbytes
            while self.bytes > CACHED and len(self.kept) > 1:
                self.bytes -= self.kept.pop(next(iter(self.kept))).nbytes
        return found


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets is at least percent / 100, in whole numbers."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * 100 >= percent * (len(a) + len(b) - common)


def _sketched(size: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingles(x, size) for x in batch.column(1).to_pylist()]
                prints = pa.array([simhash.majority([s]) for s in sets], pa.int64())
                nodes = pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
                keys, marks = zip(*map(sketch, sets), strict=True)
                columns = [batch.column(0), batch.column(1), nodes, prints, pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "node", "fp", "bands", "marks"])

    return apply


def _confirmed(size: int, percent: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Sets(size).of
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            found = [similar(of(a[i].as_py(), x[i].as_py()), of(b[i].as_py(), y[i].as_py()), percent) for i in range(batch.num_rows)]
            mask = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return apply


class _Near:
    """Which of some members of a block may be similar to one of them: fingerprints are compared bit-sliced, 64 at a time, and marks of those within RADIUS."""

    def __init__(self, prints: list[int], marks: list[bytes], percent: int) -> None:
        self.prints = np.array(prints, np.int64).view(np.uint64)
        self.marks = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1)
        self.sliced, self.least = simhash.planes(self.prints), least_marks(percent)

    def after(self, q: int, labels: np.ndarray) -> np.ndarray:
        """Those that come after q and have another label."""
        near = simhash.within(np.repeat(self.prints[q : q + 1], len(self.sliced)), self.sliced, RADIUS)
        lanes = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(labels)])
        lanes = lanes[(lanes > q) & (labels[lanes] != labels[q])]
        return lanes[(self.marks[lanes] == self.marks[q]).sum(axis=1) >= self.least] if len(lanes) else lanes


def hopeful(near: _Near, labels: np.ndarray) -> np.ndarray:
    """Whether each member may be similar to one of another label."""
    out = np.zeros(len(labels), bool)
    for q in range(len(labels)):
        found = near.after(q, labels)
        out[found] = True
        out[q] |= len(found) > 0
    return out


def linked(texts: list[str], near: _Near, labels: np.ndarray, size: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that connect all similar texts with different labels, no more than texts; the shingles decide."""
    of, labels, out = _Sets(size).of, labels.copy(), []
    for q in range(len(texts)):
        if (labels == labels[q]).all():
            break
        for i in near.after(q, labels):
            if labels[i] != labels[q] and similar(of(q, texts[q]), of(int(i), texts[i]), percent):
                out.append((q, int(i)))
                labels[labels == labels[i]] = labels[q]
    return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(block, columns of its rows) of rows that come sorted by block; a block is held until its last row has come."""
    block, rows = None, []
    for batch in batches:
        for at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != block:
                if rows:
                    yield block, list(zip(*rows, strict=True))
                block, rows = at, []
            rows.append(row)
    if rows:
        yield block, list(zip(*rows, strict=True))


def _screened(percent: int, batch: int = 1 << 14):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (block, node, root, fp, marks), the rows (block, node, root) that may have a link in their block."""
        out: list[tuple[int, int, int]] = []

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["block", "node", "root"])

        for block, (nodes, roots, prints, marks) in _by_block(batches):
            keep = hopeful(_Near(prints, marks, percent), np.array(roots, np.int64))
            out += [(block, nodes[i], roots[i]) for i in np.flatnonzero(keep)]
            if len(out) >= batch:
                yield found()
                out.clear()
        yield found()

    return apply


def _grouped(size: int, percent: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (block, node, root, fp, marks, text), links (a, b)."""
        for _, (nodes, roots, prints, marks, texts) in _by_block(batches):
            found = linked(texts, _Near(prints, marks, percent), np.array(roots, np.int64), size, percent)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return apply


def _parted(members: DataFrame) -> DataFrame:
    """Members (key, node, root, bytes) of the keys that still hold nodes of different components, each with the key's count, bytes and hubs.

    Keys are described by partial aggregates; members of a hot key meet in none, and in a join of two shuffled tables, which is split where it is skewed.
    """
    # The same order for all keys: keys of one group of copies mostly choose the same hubs, and pairs repeat.
    order = F.struct(F.xxhash64("node").alias("h"), "node")
    of = members.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("n"), F.sum("bytes").alias("all"), F.min(order).alias("_h"), F.max(order).alias("_g"))
    open_ = cut(of.where("_a <> _b").select("key", "n", "all", F.col("_h.node").alias("hub"), F.col("_g.node").alias("other")))
    return cut(members.select("key", "node", "root", "bytes").join(open_, "key"))


def _merged(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, _up): what the components that links (a, b) of nodes join are called from now on."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    joined = connected(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return joined.select(F.col("node").alias("root"), F.col("root").alias("_up"))


def components(sketches: DataFrame, size: int, percent: int, hubs: int = HUBS, group: int = GROUP) -> DataFrame:
    """(node, root) for the nodes that share a band with another, linked by pairs whose similarity is confirmed.

    First some members of each key are compared with all others, which completes small keys and connects dense ones.
    What is left of a key with several components is compared within one task, bit-sliced. A key of over `group` members, or of more than GROUP_BYTES of text, is
    split into tiles, and each pair of tiles is a group of its own: each pair of a key is compared, at any skew. Fingerprints and marks go through the tiles;
    texts come only to the members that may have a link there, and only links that connect come out, so that rows stay in proportion to members.
    """
    up_to = lambda df, up: df.join(up, "root", "left").withColumn("root", F.coalesce("_up", "root")).drop("_up")
    # Of a node's rows, which may be very many copies, one brings the text: the others don't meet.
    key = F.struct(F.col("id").isNull().alias("none"), "id")
    distinct = cut(sketches.groupBy("node").agg(F.first("bands").alias("bands"), F.min(key).alias("key"), F.max(F.octet_length("text")).cast("long").alias("bytes")))
    members = _parted(distinct.select(F.explode("bands").alias("key"), "node", F.col("node").alias("root"), "bytes"))
    open_ = distinct.select("node", "key").join(members.select("node").distinct(), "node")
    texts = sketches.select("node", key.alias("key"), "fp", "marks", "text").join(open_, ["node", "key"])
    texts = cut(texts.groupBy("node").agg(F.first("fp").alias("fp"), F.first("marks").alias("marks"), F.first("text").alias("text")))
    roots = texts.select("node", F.col("node").alias("root"))
    first = F.array("hub", "other") if hubs > 1 else F.array("hub")
    pairs = members.select("node", F.explode(first).alias("hub")).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    side = lambda end, name, to: texts.select(F.col("node").alias(end), F.col(name).alias(f"{to}{end}"))
    pairs = pairs.join(side("b", "fp", "f"), "b").join(side("a", "fp", "f"), "a").where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= RADIUS)
    pairs = cut(pairs.select("a", "b")).join(side("b", "text", "t"), "b").join(side("a", "text", "t"), "a")
    up = _merged(cut(pairs.select("a", "b", "ta", "tb").mapInArrow(_confirmed(size, percent), "a long, b long")), roots)
    roots = cut(up_to(roots, up).select("node", "root"))
    rest = members.where(~F.array_contains(first, F.col("node"))).select("key", "node", "root", "bytes")
    rest = _parted(up_to(rest, up))
    tiles = F.when((F.col("n") > group) | (F.col("all") > GROUP_BYTES), F.ceil(F.greatest(F.col("n") / group, F.col("all") / GROUP_BYTES) * 2).cast("int")).otherwise(1)
    rest = rest.withColumn("_tiles", tiles)
    rest = rest.withColumn("_own", F.pmod(F.xxhash64("node"), "_tiles").cast("int")).withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    block = F.xxhash64("key", F.least("_own", "_u"), F.greatest("_own", "_u"))
    rest = rest.select(block.alias("block"), "node", "root").join(texts.select("node", "fp", "marks"), "node")
    by_block = lambda df: df.repartition("block").sortWithinPartitions("block", "node")
    hope = cut(by_block(rest.select("block", "node", "root", "fp", "marks")).mapInArrow(_screened(percent), "block long, node long, root long"))
    rest = hope.join(texts, "node").select("block", "node", "root", "fp", "marks", "text")
    links = cut(by_block(rest).mapInArrow(_grouped(size, percent), "a long, b long").distinct())
    return up_to(roots, _merged(links, roots)).select("node", "root")


def sketched(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, node, fp, bands, marks): texts with the same set of shingles are one node; fp is the SimHash of the set."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return cut(rows.mapInArrow(_sketched(size), f"id {rows.schema['id'].dataType.simpleString()}, text string, node long, fp long, bands array<long>, marks binary"))


def classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hubs: int = HUBS, group: int = GROUP) -> DataFrame:
    """(id, component_id) for each row; component_id is the smallest id reachable over pairs of similar texts, its own included.

    Operator 9 for a similarity instead of a radius. At 0.8, fingerprints differ in about ten bits and sometimes twenty, and no part of 64 bits is left to
    agree on, so blocks are MinHash bands; in them fingerprints are compared bit-sliced, and what is within RADIUS bits, and agrees in as many marks as such sets do, is confirmed on the shingles.
    Two texts are similar if their sets of shingles of `size` words have a Jaccard similarity of at least `percent` / 100.
    Words are those of simhash.classes; null, empty and blank texts have no shingle and are equal. Null ids count for nothing.
    """
    rows = sketched(docs, size, id_col, text_col)
    of = rows.select("id", "node").join(components(rows, size, percent, hubs, group), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("id").alias("component_id"))
    return of.join(least, "root").select(F.col("id").alias(id_col), "component_id")
