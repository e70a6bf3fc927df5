"""Repeated byte strings across and within documents, found by prefix doubling on the positions that can repeat."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

U = np.uint64
#: Bytes of the first names and of the longest; a window of the threshold holds threshold - FIRST + 1 of the first, one of which is its anchor.
FIRST, TOP = 32, 64
#: Bytes hashed at a time, so that the arrays stay in a core's cache; low bits of a sort key that hold a position.
BLOCK, PLACE = 1 << 16, 28
#: A rank is task << 43 | number of the group in it << 7 | cell of the anchor's place in the window; those of hot anchors are negative.
TASK, OFFSET = 43, 7
#: Places of the anchor that a cell holds in the sort before the last; at that size rows carry the names of their windows, before it their bytes.
SMALL = 6
#: Rows of the first sort hold first window << 17 | number of the hot name, from 1, << 7 | further windows.
PLACED, HOT = 17, 7
_long = lambda *names: pa.schema([(n, pa.int64()) for n in names])
ROW = _long("k", "s", "doc", "alt", "at")
EVENT = _long("doc", "alt", "kind", "start", "end", "rank")
#: Some windows of an anchor, `n` from `at` on; the anchor stands at - the first one's place + o. Repeats have at = -1 - start, n = end.
NODE = _long("rank", "c", "s", "doc", "alt", "at", "n", "o").append(pa.field("data", pa.binary()))
CUT = ("doc", "alt", "start", "end")
#: The document key of rows without an id: after all others; alt tells them from an id of that value, and by their texts from each other.
_LAST, _NO_ID = (1 << 63) - 1, 1 << 62


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


class Mix:
    """Names of pairs of names, by two odd multipliers that are drawn for each run: who writes a text can't aim at equal names."""

    def __init__(self, key: bytes) -> None:
        self.a, self.b = (np.frombuffer(key, np.uint64) | U(1))[:2]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * self.a
        x ^= x >> U(29)
        x += b
        x *= self.b
        x ^= x >> U(32)
        return x


class Names:
    """Names of the strings of 8, 16, 32 and 64 bytes that start at each position: a name pairs two of the step before."""

    def __init__(self, data: bytes, mix: Mix) -> None:
        padded = np.frombuffer(data + bytes(8), np.uint8)
        self.mix, self.by = mix, {8: np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))}
        size = 8
        while size < TOP:
            x = self.by[size]
            self.by[size * 2] = mix.pair(x[:-size], x[size:]) if len(x) > size else x[:0]
            size *= 2

    def full(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Of `length` bytes, TOP to twice that: the longest names from the start and up to the end, which meet or overlap."""
        return self.mix.pair(self.by[TOP][at], self.by[TOP][at + length - TOP])


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int, mix: Mix) -> tuple[np.ndarray, ...]:
    """(name of FIRST bytes at the anchor, its place, name of the span, first window, last window) of each anchor.

    A window of `length` bytes has its anchor where its least name of FIRST bytes stands, the leftmost of several.
    Equal windows have equal anchors at equal places; consecutive windows share one, and their span is named
    by its first window, its last and their distance.
    """
    empty = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < length:
        return empty
    names = Names(data, mix)
    first, low = names.by[FIRST], U((1 << PLACE) - 1)
    least = (first & ~low) | np.arange(len(first), dtype=U)
    width, w = length - FIRST + 1, 1
    while w * 2 <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < width:
        least = np.minimum(least[: len(least) - (width - w)], least[width - w :])
    change = np.zeros(len(least) + 1, np.int32)
    room = ends - length + 1 > starts
    np.add.at(change, starts[room], 1)
    np.add.at(change, np.minimum(ends[room] - length + 1, len(least)), -1)
    windows = np.flatnonzero(np.cumsum(change[:-1]))
    if not len(windows):
        return empty
    anchor = (least[windows] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    one, last = windows[new], windows[np.r_[new[1:] - 1, len(windows) - 1]]
    span = mix.pair(mix.pair(names.full(one, length), names.full(last, length)), (last - one).astype(U))
    return first[anchor[new]], anchor[new], span, one, last


def _blocks(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ids, starts, ends) of some documents at a time."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        ends = np.cumsum([len(x) for x in texts[i:j]])
        yield b"".join(texts[i:j]), ids[i:j], ends - np.array([len(x) for x in texts[i:j]]), ends
        i = j


def _sections(text: bytes, length: int, most: int = 1 << (PLACE - 1)) -> list[tuple[int, bytes]]:
    """A text too long for one block in sections that share length - 1 bytes, so that each window lies in one."""
    return [(i, text[i : i + most]) for i in range(0, max(1, len(text) - length + 1), most - length + 1)]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """A task's memory follows the texts that it looks at together."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _firsts(keys: list[np.ndarray], doc: np.ndarray, alt: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by keys, document and place; which of them are not at their keys' first place."""
    order = np.lexsort((at, alt, doc, *reversed(keys)))
    head = np.maximum.accumulate(np.where(_changes(*(k[order] for k in keys)), np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    for c in (doc, alt, at):
        later |= c[order] != c[order][head]
    return order, later


def _later(new: np.ndarray, place: tuple[np.ndarray, ...], head: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows of sorted groups stand elsewhere than their group's first row, and the first row of the last group.

    Groups begin where `new` says; the first goes on with `head` if it doesn't begin here. Rows that repeat the first row's place are no repeats of it.
    """
    of = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
    out = np.zeros(len(new), bool)
    for i, c in enumerate(place):
        out |= c != np.where(of < 0, 0 if head is None else head[i], c[of])
    return out, tuple(c[of[-1]] for c in place) if of[-1] >= 0 else head


def _intervals(doc: np.ndarray, alt: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same bytes in as few intervals as can be; ends must grow with starts within a document."""
    if not len(doc):
        return doc, alt, start, end
    order = np.lexsort((start, alt, doc))
    doc, alt, start, end = doc[order], alt[order], start[order], end[order]
    new = _changes(doc, alt)
    new[1:] |= start[1:] > end[:-1]
    return doc[new], alt[new], start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]]


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    made = [pa.array(c.view(np.int64) if c.dtype == U else c, pa.int64()) if isinstance(c, np.ndarray) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _name_anchors(length: int, heavy: np.ndarray, key: bytes):
    """Rows (k, s, doc, alt, at) for the first sort; at holds the first window, which hot name it is (0: none), and how many windows follow.

    What repeats within a batch is known at once: its later places go on as intervals (at = -1 - start, s = end), spread by
    document, so that common content doesn't meet in one task. Hot anchors are dealt by their spans.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = Mix(key)
        for batch in _sliced(batches):
            ids, alts, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            cuts = [(i, a, x) for i, text in enumerate(_bytes(batch.column(2))) if len(text) >= length for a, x in _sections(text, length)]
            row_of, base = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
            for data, own, starts, ends in _blocks(np.arange(len(cuts)), [c[2] for c in cuts]):
                name, _, span, one, last = anchors(data, starts, ends, length, mix)
                i = np.searchsorted(ends, one, side="right")
                parts.append((name, span, row_of[own[i]], one - starts[i] + base[own[i]], last - one))
            if not parts:
                continue
            name, span, row, place, more = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, alt = ids[row], alts[row]
            hot = np.searchsorted(heavy, name)
            hot = np.where(np.r_[heavy, U(0)][hot] == name, hot + 1, 0) * (len(heavy) > 0)
            hot[hot > len(heavy)] = 0
            k = np.where(hot > 0, mix.pair(name, span), name)
            order, later = _firsts([k, span], doc, alt, place)
            keep = order[~later]
            yield _batch(ROW, k[keep], span[keep], doc[keep], alt[keep], place[keep] << PLACED | hot[keep] << HOT | more[keep])
            gone = order[later]
            d, e, a, b = _intervals(doc[gone], alt[gone], place[gone], place[gone] + more[gone] + length)
            if len(d):
                yield _batch(ROW, mix.pair(d.view(U) ^ e.view(U), a.astype(U)), b, d, e, -1 - a)

    return apply


class _Ranks:
    """Numbers of groups in the order in which a task meets them, apart from those of all other tasks."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << (TASK - OFFSET)

    def take(self, n: int) -> np.ndarray:
        out = np.arange(self.next, self.next + n, dtype=np.int64)
        self.next += n
        return out << OFFSET


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], span: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, new, later, open, rank) of rows that come by (keys, span, document, place), some at a time; `new` says which rows were not in the batch before.

    Equal keys get one new rank. Rows whose span was met before in the group, elsewhere, are `later`. The first rows of spans are open once
    their group has several. No group is held: of the one that a batch ends in, its rank goes on, and its first row while it has one span.
    """
    ranks, pending, state = _Ranks(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if pending:
            batch = pa.concat_batches([pending, batch])
        key, by, place = ([batch.column(n).to_numpy() for n in names] for names in (keys, [span], ["doc", "alt", "at"]))
        first, new_span = _changes(*key), _changes(*key, *by)
        last_key, last_span, head, rank = state or (None,) * 4
        goes_on = state is not None and not pending and last_key == [k[0] for k in key]
        if goes_on:
            first[0], new_span[0] = False, by[0][0] != last_span
        number = np.cumsum(first) - 1 + goes_on
        known = [rank] if goes_on or pending else []
        rank_of = np.r_[np.array(known, np.int64), ranks.take(int(number[-1]) + 1 - len(known))]
        spans = np.bincount(number, new_span, minlength=len(rank_of))
        spans[0] += 2 * goes_on
        later, head = _later(new_span, tuple(place), head if goes_on else None)
        new = np.arange(len(number)) >= (1 if pending else 0)
        yield batch, new, later, new_span & (spans[number] > 1), rank_of[number]
        state = [k[-1] for k in key], by[0][-1], head, rank_of[-1]
        pending = batch.slice(int(np.flatnonzero(first)[-1]), 1) if spans[-1] == 1 else None


def _rank_anchors(length: int):
    """First sort. Rows come by (k, s, document, place). A span met before is repeated whole; a name with several spans goes on with its rank."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided: list[pa.RecordBatch] = []

        def others() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = batch.column("at").to_numpy() < 0
                if done.any():
                    k, s, doc, alt, at = (c.to_numpy()[done] for c in batch.columns)
                    decided.append(_batch(EVENT, doc, alt, np.zeros_like(k), -1 - at, s, np.zeros_like(k)))
                    batch = batch.filter(pa.array(~done))
                yield batch

        for batch, new, later, open_, rank in _groups(others(), ["k"], "s"):
            k, s, doc, alt, at = (c.to_numpy() for c in batch.columns)
            start, hot = at >> PLACED, (at >> HOT) & ((1 << PLACED - HOT) - 1)
            end = start + (at & ((1 << HOT) - 1)) + length
            rank = np.where(hot > 0, -hot << OFFSET, rank)
            for kind, rows in ((0, later & new), (1, np.where(hot > 0, _changes(k, s) & new & ~later, open_))):
                if rows.any():
                    yield _batch(EVENT, doc[rows], alt[rows], np.full(rows.sum(), kind, np.int64), start[rows], end[rows], rank[rows])
            while decided:
                yield decided.pop()
        yield from decided

    return apply


def _anchors_of(names: Names, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Where the anchors of spans stand: the least name of FIRST bytes, the leftmost of several, of those that all windows of the span hold."""
    first, low = names.by[FIRST], U((1 << PLACE) - 1)
    a, counts = ends - length, starts + length - FIRST + 1 - (ends - length)
    at = np.repeat(a - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    least = np.minimum.reduceat((first[at] & ~low) | at.astype(U), np.cumsum(counts) - counts)
    return (least & low).astype(np.int64)


def widths(length: int) -> list[int]:
    """How many places of the anchor a cell holds, sort by sort. The bytes that all windows of a cell share are length + 1 - width, from TOP on."""
    first = min((length - FIRST + 2) // 2, length + 1 - TOP)
    return [first, *([SMALL] if first > SMALL else []), *([1] if first > 1 else [])]


def _split(length: int, width: int, mix: Mix, rank: np.ndarray, doc: np.ndarray, alt: np.ndarray, at: np.ndarray, n: np.ndarray, o: np.ndarray | None, data: list[bytes], named: bool) -> Iterator[pa.RecordBatch]:
    """Rows of NODE for the cells of some windows: what is alike about all windows of a cell (c), and about those of the row (s).

    data: the bytes of the windows, or, `named`, the names of each. What repeats within the batch is decided.
    """
    parts = []
    for block, own, starts, ends in [(b"".join(data), np.arange(len(data)), np.cumsum(n) - n, np.cumsum(n))] if named else _blocks(np.arange(len(data)), data):
        i = np.repeat(np.arange(len(own)), n[own])
        step = np.arange(len(i)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        x = starts[i] + step
        if named:
            full, place = np.frombuffer(block, U), o
        else:
            names = Names(block, mix)
            full = names.full(np.arange(max(0, len(block) - length + 1)), length)
            place = o[own] if o is not None else _anchors_of(names, starts, ends, length) - starts
        cell = (place[i] - step) // width
        new = np.flatnonzero(_changes(i, cell))
        count = np.diff(np.r_[new, len(i)])
        j, first, last = i[new], x[new], x[new] + count - 1
        s = full[first]
        if width > 1:
            s = mix.pair(mix.pair(s, full[last]), count.astype(U))
            top = np.minimum((cell[new] + 1) * width - 1, length - FIRST)
            c = names.full(starts[j] + place[j] - cell[new] * width, cell[new] * width + length - top)
            kept = [full[a : b + 1].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)] if width <= SMALL else [block[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        else:
            c, kept = s, [None] * len(new)
        row = own[j]
        parts.append((rank[row] + cell[new], c, s, doc[row], alt[row], at[row] + first - starts[j], count, place[j] - (first - starts[j]), kept))
    if not parts:
        return
    columns = [np.concatenate([p[i] for p in parts]) for i in range(8)]
    kept = [x for p in parts for x in p[8]]
    order, later = _firsts(columns[:3], *columns[3:6])
    keep, gone = order[~later], order[later]
    yield _batch(NODE, *(c[keep] for c in columns), [kept[k] for k in keep.tolist()])
    yield from _decided(*(c[gone] for c in columns[3:7]), length)


def _decided(doc: np.ndarray, alt: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    d, e, a, b = _intervals(doc, alt, at, at + n - 1 + length)
    if len(d):
        none = np.zeros(len(d), np.int64)
        yield _batch(NODE, none, none, none, d, e, -1 - a, b, none, [None] * len(d))


def _cells(length: int, key: bytes):
    """Rows of NODE of the open spans: in cells of the first width, and those of hot anchors in windows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = Mix(key)
        for batch in _sliced(batches):
            parts = [(text[p["start"] : p["end"]], d, e, p["start"], p["end"] - p["start"] - length + 1, p["rank"]) for d, e, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True) for p in own]
            if not parts:
                continue
            doc, alt, at, n, rank = (np.array([p[i] for p in parts], np.int64) for i in range(1, 6))
            for rows, width in ((rank >= 0, widths(length)[0]), (rank < 0, 1)):
                if rows.any():
                    yield from _split(length, width, mix, rank[rows], doc[rows], alt[rows], at[rows], n[rows], None, [p[0] for p, r in zip(parts, rows.tolist(), strict=True) if r], False)

    return apply


def _rank_pairs(length: int, width: int | None, key: bytes, named: bool):
    """One more sort. Rows come by (rank, c, s, document, place): pairs of a rank and what the windows of a cell share. Equal pairs get a new rank.

    Those that are alone leave, rows equal in s to an earlier one are repeats, and the others go on in cells of the next width, if there is one.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = Mix(key)
        for batch, new, later, open_, rank in _groups(batches, ["rank", "c"], "s"):
            _, _, _, doc, alt, at, n, o = (c.to_numpy() for c in batch.columns[:8])
            rows = later & new
            yield from _decided(doc[rows], alt[rows], at[rows], n[rows], length)
            if width and open_.any():
                data = batch.column("data").filter(pa.array(open_)).to_pylist()
                yield from _split(length, width, mix, rank[open_], doc[open_], alt[open_], at[open_], n[open_], o[open_], data, named)

    return apply


def _kept(with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, parts in zip(_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for a, b in sorted((p["start"], p["end"]) for p in parts or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                at, kept = 0, []
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(left))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left)
            if not with_text:
                del out["kept"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(v, pa.int64() if k[0] == "n" else pa.binary() if k == "kept" else pa.string()) for k, v in out.items())], names=["doc", "alt", *out])

    return apply


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, heavy_least: int = 100, sample: int = 64) -> DataFrame:
    """Remove each byte that a string of `length` bytes covers which also starts earlier: in a smaller id, or further left.

    Returns id, n_bytes, n_removed, n_spans, kept_sha256[, kept]. Texts are UTF-8 bytes; strings don't cross documents and are
    judged on the input. Null text is empty. Null ids come after all others. Rows of one id, or without one, that differ in
    text are documents of their own, in the order of a digest of their texts; rows that repeat an id and text get equal results. Other
    columns are ignored, whatever their names; an empty table gives an empty one.

    Prefix doubling over the positions that can repeat. The first sort ranks strings of 32 bytes, at anchors only: every window of
    `length` bytes holds one, which depends on its bytes alone. Further sorts pair a rank with the name of more bytes around it: windows are told apart by the place of
    the anchor in them, in cells of half of all places, then of SMALL, then of one, and what all windows of a cell share grows to 66, 95 and all of 100 bytes. After
    each sort equal pairs get a new rank; those that are alone leave; rows all of whose windows stand earlier in their group are decided as repeats; the
    others go on in smaller cells. Names are hashes under multipliers drawn for each run; ranks and pairs are compared exactly.

    Rows are read in the order of the sorts, and no group is held in memory. What repeats within a batch is decided before the shuffle. Names
    that over a thousandth of a sample hold (one document in `sample`; at least `heavy_least` rows) are dealt out by span, so there are 1000 at most.
    """
    if not 2 * FIRST <= length <= 2 * TOP:
        raise ValueError(f"length must be from {2 * FIRST} to {2 * TOP}")
    key = os.urandom(16)
    text, number = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    source = docs.select(number.alias("doc"), text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 2).alias("digest"))
    # Digests make rows larger, so they come in only where an id doesn't name one text.
    texts = source.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    several = texts.where("doc is null or a <> b").limit(1).count()
    alt = F.when(F.col("doc").isNull(), F.col("digest") + F.lit(_NO_ID)).otherwise(F.col("digest") if several else F.lit(0)).cast("long")
    source = source.select(F.coalesce("doc", F.lit(_LAST)).alias("doc"), alt.alias("alt"), "text")
    ids = ["doc", "alt"]

    few = source.where(F.pmod(F.xxhash64(*ids), F.lit(sample)) == 0).mapInArrow(_name_anchors(length, np.zeros(0, U), key), _ddl(ROW)).where("at >= 0")
    counts = cut(few.groupBy("k").agg(F.count("*").alias("n")))
    least = max(heavy_least, (counts.agg(F.sum("n")).first()[0] or 0) // 1000 + 1)
    heavy = np.sort(np.array([r["k"] for r in counts.where(F.col("n") >= least).select("k").collect()], np.int64).view(U))

    named = source.mapInArrow(_name_anchors(length, heavy, key), _ddl(ROW)).repartition("k").sortWithinPartitions("k", "s", *ids, "at")
    events = cut(named.mapInArrow(_rank_anchors(length), _ddl(EVENT)))
    open_ = events.where("kind = 1").groupBy(*ids).agg(F.collect_list(F.struct("start", "end", "rank")).alias("parts"))
    sizes = widths(length)
    rows = cut(source.join(open_, ids).select(*ids, "text", "parts").mapInArrow(_cells(length, key), _ddl(NODE)))
    hot, done = rows.where("rank < 0"), [rows]
    for i, width in enumerate(sizes):
        rows = rows.where("at >= 0 and rank >= 0")
        if i + 1 == len(sizes):
            rows = rows.unionByName(hot)
        after = sizes[i + 1] if i + 1 < len(sizes) else None
        rows = rows.repartition("rank", "c").sortWithinPartitions("rank", "c", "s", *ids, "at").mapInArrow(_rank_pairs(length, after, key, width <= SMALL), _ddl(NODE))
        rows = cut(rows)
        done.append(rows)
    gone = events.where("kind = 0").select(*CUT)
    for rows in done:
        gone = gone.unionByName(rows.where("at < 0").select(*ids, (F.lit(-1) - F.col("at")).alias("start"), F.col("n").alias("end")))
    gone = gone.groupBy(*ids).agg(F.collect_list(F.struct("start", "end")).alias("parts"))
    names = _ddl(_long(*ids)) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = source.join(gone, ids, "left").select(*ids, "text", "parts").mapInArrow(_kept(with_text), names)
    return out.select(F.when(F.col("alt") < _NO_ID, F.col("doc")).alias(id_col), *out.columns[2:])
