"""Node rows in blocks: how they are stored, what blocks send each other, and how a worker sees both."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.graph import NODE
from kinfold.plans import kernels as K

#: What inputs are made of: slot 0 has a node's own features, i the part of their mean over an edge type that some edges give.
ROWS = f"{NODE} long, slot int, v array<double>"
#: A node's row, in the block `part`. v: features, then the means of its neighbours'. ties: the neighbour (-1: none) and its block by each foreign key that the
#: table holds. degrees, routes: by each foreign key that refers to the table, the number of neighbours, and number of the key << 32 | block for the blocks that they are in.
STORED = f"part int, {NODE} long, v array<double>, label double, split int, scale double, ties array<long>, degrees array<double>, routes array<long>"
#: Vectors for the nodes of the block `part` of the table numbered `to`: of a node in it (sums add up), or of a neighbour of nodes in it. And, with to = -1, results.
SENT = f"to int, part int, {NODE} long, slot int, v array<double>, label double, sums binary"
GRADIENT, SCORE, SUMS, OWN = -1, -2, -3, -4
#: From here on: gradients by vectors that went to the nodes of a foreign key's table, for those that hold the key.
PULLED = 1000
#: Nodes of a block; neighbours up to which the nodes that refer to one stand in its block, so that one vector and one sum go between them. Those of more are spread.
BLOCK, HUB = 8192, 1024


def matrix(column: pa.Array, width: int) -> np.ndarray | K.Wide:
    """Lists as rows; null ones are zeros. What goes on after `width` values is the number and value of each sparse feature."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    there = np.arange(len(column)) if not column.null_count else np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(flat) == len(there) * width:
        if len(there) == len(column):
            return flat.reshape(len(column), width)
        out = np.zeros((len(column), width))
        out[there] = flat.reshape(-1, width)
        return out
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)[there].astype(np.int64)
    starts, out = np.cumsum(lengths) - lengths, np.zeros((len(column), width))
    out[there] = flat[starts[:, None] + np.arange(width)]
    count = (lengths - width) // 2
    at = np.repeat(starts + width - 2 * (np.cumsum(count) - count), count) + 2 * np.arange(count.sum())
    return K.Wide(out, np.repeat(there, count), flat[at].astype(np.int64), flat[at + 1])


def lists(m: np.ndarray | K.Wide) -> pa.Array:
    if isinstance(m, np.ndarray):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1), pa.float64()))
    width, count = m.dense.shape[1], np.bincount(m.row, minlength=len(m))
    ends = np.cumsum(width + 2 * count)
    starts, flat = ends - width - 2 * count, np.zeros(ends[-1] if len(ends) else 0)
    flat[(starts[:, None] + np.arange(width)).reshape(-1)] = m.dense.reshape(-1)
    at = (starts + width - 2 * (np.cumsum(count) - count))[m.row] + 2 * np.arange(len(m.row))
    flat[at], flat[at + 1] = m.column, m.value
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.float64()))


def halves(m: np.ndarray | K.Wide) -> tuple[np.ndarray, K.Wide | None]:
    return (m.dense, m) if isinstance(m, K.Wide) else (m, None)


def summed(m: np.ndarray | K.Wide, at: np.ndarray, n: int) -> np.ndarray | K.Wide:
    """n rows, the sums of those of m that belong to each; `at`, which does not fall, says to which."""
    dense, few = halves(m)
    out = np.zeros((n, dense.shape[1]))
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    if len(starts):
        out[at[starts]] = np.add.reduceat(dense, starts)
    if few is None:
        return out
    row = at[few.row]
    order = np.lexsort((few.column, row))
    row, column, value = row[order], few.column[order], few.value[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (column[1:] != column[:-1])][: len(row)])
    return K.Wide(out, row[new], column[new], np.add.reduceat(value, new) if len(new) else value)


def scaled(m: np.ndarray | K.Wide, by: np.ndarray) -> np.ndarray | K.Wide:
    return K.Wide(m.dense * by[:, None], m.row, m.column, m.value * by[m.row]) if isinstance(m, K.Wide) else m * by[:, None]


def _made(node: np.ndarray, slot: int, v: np.ndarray | K.Wide) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.full(len(node), slot), pa.int32()), lists(v)], names=[NODE, "slot", "v"])


def carried(edges: DataFrame, rows: DataFrame, slot: int, width: int) -> DataFrame:
    """Features of nodes sent along edges (src, dst, w), times w: sums per node that gets them, one a batch of edges, for assembled() to add up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node = batch.column(0).to_numpy()
                order = np.argsort(node, kind="stable")
                node, v = node[order], matrix(batch.column(2), width)[order]
                new = np.r_[True, node[1:] != node[:-1]]
                yield _made(node[new], slot, summed(scaled(v, batch.column(1).to_numpy()[order]), np.cumsum(new) - 1, int(new.sum())))

    sent = edges.join(rows.select(F.col(NODE).alias("src"), "v"), "src").select(F.col("dst").alias(NODE), "w", "v")
    return sent.mapInArrow(partial, ROWS)


def assembled(parts: list[DataFrame], join, widths: dict[int, int]) -> DataFrame:
    """(node, v) from rows of ROWS: join(sums by slot, which nodes got any) of each node that has a row of slot 0."""

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        own, v, there = node[slot == 0], {}, {}
        for k, width in widths.items():
            rows = np.flatnonzero(slot == k)
            at = np.searchsorted(own, node[rows])
            good = at < len(own)
            good[good] = own[at[good]] == node[rows[good]]
            rows, at = rows[good], at[good]
            there[k] = np.zeros(len(own))
            v[k] = summed(matrix(batch.column(2).take(pa.array(rows, pa.int64())), width), at, len(own))
            there[k][at] = 1.0
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), lists(join(v, there))], names=[NODE, "v"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            last = int(np.searchsorted(node, node[-1]))
            if last or (kept and kept[-1].column(0)[-1].as_py() != node[0]):
                yield joined(pa.concat_batches([*kept, batch.slice(0, last)]) if kept or last else batch)
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield joined(pa.concat_batches(kept))

    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.repartition(NODE).sortWithinPartitions(NODE, "slot").mapInArrow(apply, f"{NODE} long, v array<double>")


@dataclass
class Nodes:
    """Some nodes of one block or several, by number: their stored vectors and what came for them by slot, and what is known of them as samples."""

    node: np.ndarray
    v: dict[int, np.ndarray | K.Wide]
    label: np.ndarray = field(default_factory=lambda: np.zeros(0))
    split: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    part: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ties: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    degrees: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    #: (row, key << 32 | block)
    routes: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))

    @classmethod
    def stored(cls, rows: pa.RecordBatch | pa.Table, width: int) -> Nodes:
        rows = rows.combine_chunks() if isinstance(rows, pa.Table) else rows
        rows = rows.take(pc.sort_indices(rows.column(NODE)))
        one = lambda n: rows.column(n).combine_chunks() if isinstance(rows.column(n), pa.ChunkedArray) else rows.column(n)
        number = lambda n: one(n).to_numpy(zero_copy_only=False)
        flat = lambda n, kind: (x := one(n).flatten().to_numpy(zero_copy_only=False).astype(kind)).reshape(rows.num_rows, len(x) // max(1, rows.num_rows))
        routes = one("routes")
        of = np.repeat(np.arange(rows.num_rows), pc.list_value_length(routes).to_numpy(zero_copy_only=False).astype(np.int64))
        return cls(number(NODE), {0: matrix(one("v"), width)}, number("label"), number("split"), number("scale"), number("part"), flat("ties", np.int64), flat("degrees", float), (of, routes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))

    def take(self, rows: np.ndarray) -> Nodes:
        place = np.full(len(self.node), -1)
        place[rows] = np.arange(len(rows))
        of, route = self.routes
        kept = place[of] >= 0
        return Nodes(self.node[rows], {k: v[rows] for k, v in self.v.items()}, self.label[rows], self.split[rows], self.scale[rows], self.part[rows], self.ties[rows], self.degrees[rows], (place[of[kept]], route[kept]))

    def receive(self, rows: pa.Table, slots: dict[int, tuple[int | None, int]]) -> None:
        """Vectors by slot, zeros where none came. slots: {slot: (None, width) of nodes themselves, (number of a held key, width) of their neighbours by it}."""
        rows = rows.combine_chunks()
        slot, node, v = (rows.column(n).combine_chunks() if isinstance(rows.column(n), pa.ChunkedArray) else rows.column(n) for n in ("slot", NODE, "v"))
        slot, node = slot.to_numpy(zero_copy_only=False), node.to_numpy(zero_copy_only=False)
        for k, (tie, width) in slots.items():
            own = np.flatnonzero(slot == k)
            own = own[np.argsort(node[own], kind="stable")]
            got, ids = matrix(v.take(pa.array(own, pa.int64())), width), node[own]
            if tie is None:
                self.v[k] = summed(got, np.searchsorted(self.node, ids), len(self.node))
                continue
            asked, out = self.ties[:, 2 * tie], np.zeros((len(self.node), width))
            at = np.minimum(np.searchsorted(ids, asked), max(0, len(ids) - 1))
            good = np.flatnonzero((asked >= 0) & (ids[at] == asked)) if len(ids) else np.zeros(0, np.int64)
            out[good] = got[at[good]]
            self.v[k] = out

    def to_holders(self, key: int, to: int, slot: int, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A vector to each block that has nodes which refer to a node by the key."""
        of, route = self.routes
        own = np.flatnonzero(route >> 32 == key)
        if len(own):
            yield sent(to, route[own] & 0xFFFFFFFF, self.node[of[own]], slot, v[of[own]])

    def to_owners(self, key: int, to: int, slot: int, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sums of vectors, one for each node that the key of some refers to."""
        rows = np.flatnonzero(self.ties[:, 2 * key] >= 0)
        if len(rows):
            rows = rows[np.argsort(self.ties[rows, 2 * key], kind="stable")]
            ids = self.ties[rows, 2 * key]
            new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            yield sent(to, self.ties[rows[new], 2 * key + 1], ids[new], slot, np.add.reduceat(v[rows], new))


def sent(to: int, part: np.ndarray, node: np.ndarray, slot: int, v: np.ndarray, label=None, sums: bytes | None = None) -> pa.RecordBatch:
    n = len(node)
    numbers = [pa.array(np.full(n, to), pa.int32()), pa.array(part, pa.int32()), pa.array(node, pa.int64()), pa.array(np.full(n, slot), pa.int32()), lists(v)]
    some = pa.nulls(n, pa.float64()) if label is None else pa.array(label, pa.float64(), from_pandas=True)
    return pa.RecordBatch.from_arrays([*numbers, some, pa.array([sums] * n, pa.binary()) if sums else pa.nulls(n, pa.binary())], names=["to", "part", NODE, "slot", "v", "label", "sums"])


def result(node: np.ndarray, slot: int, v: np.ndarray, label=None, sums: bytes | None = None) -> pa.RecordBatch:
    return sent(-1, np.zeros(len(node), np.int64), node, slot, v, label, sums)


def names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def over(rows: DataFrame, messages: list[DataFrame], to: int, slots: dict[int, tuple[int | None, int]], run, width: int) -> DataFrame:
    """Rows of SENT that run() makes of a table's nodes and of what was sent to them. Stored blocks stay where they are: messages alone are shuffled, by block."""
    if not slots:

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(Nodes.stored(b, width) for b in batches if b.num_rows)

        return rows.mapInArrow(plain, SENT)

    def block(own: pa.Table, came: pa.Table) -> pa.Table:
        x = Nodes.stored(own, width)
        x.receive(came, slots)
        made = list(run(iter([x] if len(x.node) else [])))
        return pa.Table.from_batches(made, schema=result(np.zeros(0, np.int64), 0, np.zeros((0, 0))).schema)

    came = messages[0]
    for m in messages[1:]:
        came = came.unionByName(m)
    came = came.where(F.col("to") == to).select("part", NODE, "slot", "v")
    return rows.groupBy("part").cogroup(came.groupBy("part")).applyInArrow(block, SENT)
