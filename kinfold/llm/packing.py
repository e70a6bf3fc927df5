"""Pack tokenized documents into sequences by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import json
import logging
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

log = logging.getLogger(__name__)
#: Pieces of one length that a task numbers, and how many more such cells there may be than lengths at most.
CELL, CELLS = 512, 1 << 20
#: Limits of the branch and bound: nodes, steps of the enumeration at a node, fillings that a node branches on.
NODES, STEPS, FILLINGS = 100, 1000, 32

_engines: dict[str, Engine] = {}


#: Fixed value: how byte-level BPE of this kind cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of characters below this are cut alike by all engines, but for the two blanks among them; others are left to the tokenizers library.
PLAIN, ODD = "\u0250", ("\x85", "\xa0")
#: Longer runs of blanks are beyond the fast engine's stack.
BLANKS = 100_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast_engine(path: str):
    """The file's BPE as a tiktoken encoding, or None unless both must give the same ids.

    The library merges in the order of the file's merges, tiktoken by the ids of what a merge gives: the same if those ids grow.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
        return None
    letters = _byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Engine:
    """Little-endian ids of a text, as tokenizers gives them. Texts for which tiktoken must give the same go to it, which takes a fifth of the time."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _fast_engine(path)

    def plain(self, text: str) -> bool:
        if not self.fast or (text and max(text) >= PLAIN) or any(x in text for x in (*ODD, *self.added)):
            return False
        return len(text) < BLANKS or not re.search(rf"\s{{{BLANKS}}}", text)

    def ids(self, text: str) -> bytes:
        found = self.fast.encode_ordinary(text) if self.plain(text) else self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", found).tobytes()


def pieces(docs: DataFrame, tokenizer: str, size: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids and a closing 0, cut into `size` tokens if longer.

    The remainder comes first, so all pieces after it are full.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engines.get(tokenizer) or _engines.setdefault(tokenizer, Engine(tokenizer))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    data = engine.ids(text or "") + b"\0\0\0\0"
                    n = len(data) // 4
                    a = 0
                    for k in range(-(-n // size)):
                        b = a + ((n - 1) % size + 1 if k == 0 else size)
                        part = data[4 * a : 4 * b]
                        row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                        a = b
                out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(apply, schema + (", ids array<int>" if with_ids else ""))


@dataclass
class Bins:
    """Patterns: (times used, {length: pieces of it in each bin}). No packing has fewer bins than `bound`."""

    patterns: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    bound: int = 0
    #: Whether no packing has fewer bins: the bound is met, or the search went through all cases.
    proven: bool = False

    @property
    def count(self) -> int:
        return sum(n for n, _ in self.patterns)


def lower_bound(counts: dict[int, int], size: int) -> int:
    """No packing has fewer bins.

    For any k up to half a bin: pieces over size - k need a bin each, so do the others over half, and pieces from
    k to half fill what those others leave before they need bins of their own.
    """
    number, total = np.zeros(size + 2, np.int64), np.zeros(size + 2, np.int64)
    for x, n in counts.items():
        number[x + 1], total[x + 1] = n, n * x
    number, total = number.cumsum(), total.cumsum()  # of the pieces under x
    half = size // 2
    k = np.arange(half + 1)
    large = number[size + 1] - number[half + 1]
    middle, middle_total = number[size - k + 1] - number[half + 1], total[size - k + 1] - total[half + 1]
    small = total[half + 1] - total[k]
    more = -((size * middle - middle_total - small) // size)
    return int(max(-(-total[size + 1] // size), (large + np.maximum(0, more)).max()))


def best_fit(counts: dict[int, int], size: int) -> Bins:
    """Best fit decreasing on the histogram: each filling takes, again and again, the longest piece that still fits."""
    left, lengths, bins = dict(counts), sorted(counts), Bins()
    while left:
        pattern: dict[int, int] = {}
        room, top = size, len(lengths)
        while top := bisect_right(lengths, room, 0, top):
            x = lengths[top - 1]
            n = min(left[x], room // x)
            pattern[x] = n
            room -= n * x
            top -= 1
        for x in _use(left, pattern, bins):
            del lengths[bisect_left(lengths, x)]
    return bins


def _use(left: dict[int, int], pattern: dict[int, int], bins: Bins, most: int | None = None) -> list[int]:
    """As many bins of this pattern as the pieces allow, or `most`; the lengths of which none is left."""
    times = min(left[x] // n for x, n in pattern.items())
    times = times if most is None else min(times, most)
    bins.patterns.append((times, pattern))
    for x, n in pattern.items():
        left[x] -= n * times
    gone = [x for x in pattern if not left[x]]
    for x in gone:
        del left[x]
    return gone


def fillings(left: dict[int, int], size: int, most: int = FILLINGS, steps: int = STEPS) -> tuple[list[dict[int, int]], bool]:
    """(fillings around the longest piece that no other dominates, fullest first; whether these are all).

    Only fillings to which no piece can be added count. One is dominated if another holds its pieces, some replaced one by
    one with longer ones or several with one longer: the other wastes no more and leaves no harder pieces.
    """
    longest = max(left)
    lengths = sorted(left)
    least = lengths[0]
    found: list[tuple[int, dict[int, int]]] = []

    def grown(top: int, room: int, pattern: dict[int, int]) -> Iterator[tuple[int, dict[int, int]]]:
        """Fillings that add pieces of lengths[:top] only, the longest and the most of them first; with each step of the search, None."""
        top = bisect_right(lengths, room, 0, top)
        for i in reversed(range(top)):
            x = lengths[i]
            for n in range(min(left[x] - pattern.get(x, 0), room // x), 0, -1):
                yield from grown(i, room - n * x, {**pattern, x: pattern.get(x, 0) + n})
        full = room < least or not any(left[x] > pattern.get(x, 0) for x in lengths[: bisect_right(lengths, room)])
        yield (room, pattern) if full else None

    # A bin holds at most 63 different lengths of 2048, which is how deep this goes.
    for filling in grown(len(lengths), size - longest, {longest: 1}):
        if steps == 0:
            break
        steps -= 1
        found += [filling] if filling else []
    else:
        steps = max(1, steps)
    undominated: list[dict[int, int]] = []
    for _, pattern in sorted(found, key=lambda f: (f[0], sum(f[1].values()))):
        if len(undominated) > most:
            break
        if not any(_dominates(other, pattern) for other in undominated):
            undominated.append(pattern)
    return undominated[:most], steps > 0 and len(undominated) <= most


def _dominates(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether b's pieces can be laid, in order of length, each into a piece of a that is as long at least (several into one)."""
    rooms = sorted((x for x, n in a.items() for _ in range(n)), reverse=True)
    for x in sorted((x for x, n in b.items() for _ in range(n)), reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= x]
        if not fit:
            return False
        rooms[min(fit, key=lambda i: rooms[i])] -= x
    return True


def bin_completion(counts: dict[int, int], size: int, nodes: int = NODES) -> Bins:
    """Branch and bound over fillings of the bin that holds the longest piece left.

    Best fit gives the incumbent. A node branches on the undominated fillings, each used as often as its pieces allow, and
    once; best fit of what is left may give a better incumbent. A node is pruned if the waste so far, or the bound of
    what is left, leaves nothing below the incumbent, and if its pieces were met before with no more bins used. The search ends at the lower bound of
    all pieces, when all cases are done, or after `nodes` nodes with the best found; `proven` tells which, and `bound` how far it may
    be from the least. Its size depends on the number of different lengths, `size` at most, not on the number of pieces.
    """
    counts = {int(x): int(n) for x, n in counts.items() if n}
    if not counts:
        return Bins(proven=True)
    best, bound, total = best_fit(counts, size), lower_bound(counts, size), sum(x * n for x, n in counts.items())
    whole, met = True, {}

    def children(left: dict[int, int], bins: Bins, waste: int, patterns: list[dict[int, int]]) -> Iterator[tuple[dict[int, int], Bins, int]]:
        for pattern in patterns:
            for times in dict.fromkeys((min(left[x] // n for x, n in pattern.items()), 1)):
                after, more = dict(left), Bins(list(bins.patterns))
                _use(after, pattern, more, times)
                yield after, more, waste + times * (size - sum(x * n for x, n in pattern.items()))

    stack = [iter([(counts, Bins(), 0)])]
    while stack and best.count > bound:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        left, bins, waste = node
        if not left:
            best = min(best, bins, key=lambda b: b.count)
            continue
        key = hash(frozenset(left.items()))
        if total + waste > (best.count - 1) * size or bins.count + lower_bound(left, size) >= best.count or met.get(key, best.count) <= bins.count:
            continue
        if nodes == 0:
            whole = False
            break
        nodes -= 1
        met[key] = bins.count
        rest = best_fit(left, size)
        if bins.count + rest.count < best.count:
            best = Bins(bins.patterns + rest.patterns)
        patterns, all_of_them = fillings(left, size)
        whole &= all_of_them
        stack.append(children(left, bins, waste, patterns))
    return Bins(best.patterns, bound, whole or best.count <= bound)


def places(bins: Bins) -> pd.DataFrame:
    """Where the pieces of a length go: those numbered from `first` on take `each` places from `offset` in sequence `sequence`, then on."""
    taken, sequence, rows = {}, 0, []
    for times, pattern in bins.patterns:
        offset = 0
        for x, each in sorted(pattern.items(), reverse=True):
            first = taken.get(x, 0)
            rows.append((x, first, each, sequence, offset))
            taken[x] = first + each * times
            offset += x * each
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cell: int = CELL) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id and offset.

    Only the histogram of lengths, `size` rows at most, comes to the driver. The pieces of each length get
    numbers (a length of many pieces in cells of about `cell`, so that it is no single task) and go to the places that the patterns name.
    Special tokens in a text have their own ids, as the tokenizer has it.
    Null and empty texts are the closing id alone; null ids and repeated rows are packed like any other
    row; an empty table gives no pieces; other columns, of whatever name, are ignored.
    """
    made = cut(pieces(docs, tokenizer, size, id_col, text_col, with_ids))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = bin_completion(counts, size)
    log.info("%d sequences, at least %d are needed%s", found.count, found.bound, "" if found.proven else ", the search stopped at its limit")
    where = places(found)
    columns = [where[c].to_numpy(np.int64) for c in where.columns]
    # Cells are at most CELLS more than lengths, so their first numbers can be broadcast.
    cell = max(cell, -(-sum(counts.values()) // CELLS))
    cells = made.sparkSession.createDataFrame([(x, -(-n // cell)) for x, n in counts.items()], "length long, _cells long")
    bucket = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("_cells"))
    keyed = made.join(F.broadcast(cells), "length").withColumn("_b", bucket).drop("_cells")
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n")).select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_b").orderBy("id", "piece", "ids_crc32")
    number = (F.row_number().over(within) - 1 + F.col("_start")).cast("long")
    ranked = keyed.join(F.broadcast(starts), ["length", "_b"]).withColumn("_k", number)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, k: pd.Series) -> pd.DataFrame:
        lengths, first, each, sequence, offset = columns
        at = np.zeros(len(k), np.int64)
        for x in np.unique(length):
            own = np.flatnonzero(length.to_numpy() == x)
            low, high = np.searchsorted(lengths, x), np.searchsorted(lengths, x, side="right")
            at[own] = low + np.searchsorted(first[low:high], k.to_numpy()[own], side="right") - 1
        turn = k.to_numpy() - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + turn // each[at], "offset": offset[at] + turn % each[at] * lengths[at]})

    out = ranked.withColumn("_at", placed("length", "_k"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "_at.sequence_id", "_at.offset")
