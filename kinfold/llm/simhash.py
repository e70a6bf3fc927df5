"""Near duplicates by 64-bit SimHash: pigeonhole blocks, compared bit-sliced with carry-save counters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .store import cut

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)
#: Lanes in a word, items (a query against one word of lanes) compared at a time, rows a group may hold in one task.
LANES, ITEMS, GROUP = 64, 1 << 14, 1 << 18


def shingle_hashes(text: str | None, size: int, block: int = 1 << 15) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of `size` words in turn, repeats included; one of all words if there are fewer, none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    line, n = b" ".join(found), max(1, len(found) - size + 1)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts[-n:] + lengths[-n:]
    hashed = xxhash.xxh64_intdigest
    for i in range(0, n, block):
        yield np.array([hashed(line[a:b], 42) for a, b in zip(starts[i : min(n, i + block)].tolist(), ends[i : i + block].tolist(), strict=True)], np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The number whose bits are set in over half the hashes, as a signed 64-bit number; 0 without hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for h in blocks:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, size: int) -> int:
    """SimHash of the shingles of `size` words, repeats included."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), size) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of values: row w, column j holds bit j of the 64 values from 64 * w on, one a lane."""
    words = -(-len(values) // LANES)
    padded = np.zeros(words * LANES, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(words, LANES, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter, the planes of which come lowest bit first, is above the radius, or has overflown."""
    far, same = over.copy(), _ONES
    for d in reversed(range(len(counters))):
        if radius >> d & 1:
            same = same & counters[d]
        else:
            far |= same & counters[d]
            same = same & ~counters[d]
    return far


def within(queries: np.ndarray, words: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """For item i, the lanes of words[i] (64 bit planes) at most radius < 64 bits away from queries[i], as a mask.

    Vertical counters hold the distances of 64 lanes: each plane is added with carries to as many counter
    planes as the radius has bits, an overflow stays. Items all of whose lanes are beyond the radius are abandoned.
    """
    out = np.zeros(len(queries), np.uint64)
    at = np.arange(len(queries))
    counters = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(at), np.uint64)
    far = over
    for j in range(64):
        carry = words[:, j] ^ (_ONES * ((queries >> np.uint64(j)) & _ONE))
        for c in counters:
            more = c & carry
            c ^= carry
            carry = more
        over |= carry
        if j % step == step - 1:
            far = _beyond(counters, over, radius)
            if j < 63 and len(left := np.flatnonzero(far != _ONES)) < 0.7 * len(at):
                at, queries, words, far, over = at[left], queries[left], words[left], far[left], over[left]
                counters = [c[left] for c in counters]
            if not len(at):
                return out
    out[at] = ~far
    return out


#: Keys of over a group's rows that may be broadcast: 24 bytes each.
HOT_KEYS = 1 << 18


class _Sets:
    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        labels = np.unique(self.of[members])
        if len(labels) > 1:
            self.of[np.isin(self.of, labels)] = labels[0]


def linked(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct values, the index of the first value of its component; any number of values.

    Values are taken as queries tile by tile against those that can still tell something new: not taken
    yet, and outside the tile's component if it has but one. A dense group is so connected by its
    first tile and left, and the cost stays near that of its links, not of its pairs.
    """
    n, sets = len(values), _Sets(len(values))
    todo = np.ones(n, bool)
    while todo.any():
        rest = np.flatnonzero(todo)
        labels, sizes = np.unique(sets.of[rest], return_counts=True)
        if sizes.max() > 1:
            own = labels[sizes.argmax()]
            lanes = rest[sets.of[rest] != own]
            tile = rest[sets.of[rest] == own]
        else:
            lanes, tile = rest, rest
        if len(lanes) == 0:
            todo[tile] = False
            continue
        sliced = planes(values[lanes])
        tile = tile[: max(16, ITEMS // len(sliced))]
        todo[tile] = False
        q, w = np.repeat(np.arange(len(tile)), len(sliced)), np.tile(np.arange(len(sliced)), len(tile))
        hits = within(values[tile][q], sliced[w], radius).reshape(len(tile), len(sliced))
        for i in np.flatnonzero(hits.any(axis=1)):
            found = np.flatnonzero(np.unpackbits(hits[i].view(np.uint8), bitorder="little")[: len(lanes)])
            sets.join(np.r_[tile[i], lanes[found]])
    return sets.of


def linked_small(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of at most 64 values each, many groups at a time; group numbers are dense and sorted."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lane = np.arange(len(values)) - starts[group]
    padded = np.zeros((len(starts), LANES), np.uint64)
    padded[group, lane] = values
    sliced = planes(padded.reshape(-1))
    counts = np.diff(np.r_[starts, len(values)]).astype(np.uint64)
    used = np.where(counts >= 64, _ONES, (_ONE << (counts % np.uint64(64))) - _ONE)
    after = ~(((_ONE << lane.astype(np.uint64)) - _ONE) | (_ONE << lane.astype(np.uint64)))
    a, b = [], []
    for i in range(0, len(values), ITEMS):
        part = slice(i, i + ITEMS)
        hits = within(values[part], sliced[group[part]], radius) & used[group[part]] & after[part]
        if len(rows := np.flatnonzero(hits)):
            bits = np.unpackbits(hits[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(bits)
            a.append(values[i + rows[r]])
            b.append(values[starts[group[i + rows[r]]] + c])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def star(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = linked(values, radius)
        own = np.flatnonzero(of != np.arange(len(of)))
        return values[of[own]], values[own]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (block, fp); a group is held until its last row has come."""
        kept_block, kept = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(block: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(block):
                return
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            counts = np.diff(np.r_[starts, len(block)])
            number = np.repeat(np.arange(len(starts)), counts)
            small = (counts[number] <= LANES) & (counts[number] > 1)
            if small.any():
                _, dense = np.unique(number[small], return_inverse=True)
                found = [linked_small(values[small], dense, radius)]
            else:
                found = []
            found += [star(values[starts[g] : starts[g] + counts[g]]) for g in np.flatnonzero(counts > LANES)]
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        for batch in batches:
            block, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            block, values = np.r_[kept_block, block], np.r_[kept, values]
            last = np.searchsorted(block, block[-1]) if len(block) else 0
            kept_block, kept = block[last:], values[last:]
            yield from links(block[:last], values[:last])
        yield from links(kept_block, kept)

    return apply


def links(distinct: DataFrame, radius: int = 4, count: int | None = None, group: int = GROUP) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all that lie within the radius, no more than rows x tables.

    The 64 bits are cut into parts; two fingerprints within the radius agree on all but `radius` of them,
    so on every part of at least one choice of (parts - radius). Each choice is a table keyed by these bits.
    More rows get more parts, so that a key gathers about as many unrelated rows at any size.
    A key with over `group` rows is split into tiles, and each pair of tiles is a group of its own: exact, at any skew.
    """
    n = distinct.count() if count is None else count
    parts = radius + 1
    while parts < 2 * radius and n > 1500 << (64 * (parts - radius) // parts):
        parts += 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    keys = []
    for t, choice in enumerate(combinations(range(parts), parts - radius)):
        key, used = F.lit(0).cast("long"), 0
        for i in choice:
            width = cuts[i + 1] - cuts[i]
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << width) - 1)), used))
            used += width
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    # At most tables * n / group rows, and next to none where fingerprints are spread; only so few are broadcast.
    hot = cut(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > group))
    rows = rows.join(F.broadcast(hot) if hot.count() <= HOT_KEYS else hot.hint("merge"), ["t", "key"], "left")
    tiles = F.ceil(F.col("n") * 2 / group).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    other = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), tiles - 1)))
    rows = rows.withColumn("_u", other).withColumn("_own", F.coalesce(own, F.lit(0)))
    block = F.xxhash64("t", "key", F.least("_own", "_u"), F.greatest("_own", "_u"))
    rows = rows.select(block.alias("block"), "fp").repartition("block").sortWithinPartitions("block", "fp")
    return rows.mapInArrow(_links(radius), "a long, b long")


def classes(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, fp, component_id) for each row; component_id is the smallest id reachable over links, its own included.

    Fingerprints within `radius` bits are linked, and equal ones always. Texts are lower-cased in A-Z only
    and split at the six ASCII blanks; one of fewer words than a shingle is one shingle; null, empty and
    blank texts have fingerprint 0 and are linked like any other. Null ids count for nothing in a minimum
    (a component of null ids has null); repeated rows are returned as often as they come.
    """
    fps = cut(fingerprints(docs, size, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected(cut(links(distinct.select("fp"), radius, group=group).distinct()))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
