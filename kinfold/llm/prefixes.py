"""The trie of conversations by shared first turns: sorted runs that carry common prefixes, merged by loser trees, nodes finished from the open path."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

#: A turn is 16 bytes of a digest of its role and text, then the code points of its text in 4 bytes, so that paths compare as bytes.
TURN = 20
#: Turns of a range that a task merges (more beyond RANGES ranges), of a run, and of the sample that chooses the ranges' bounds.
TURNS, RANGES, RUN, SAMPLE = 1 << 15, 1 << 16, 1 << 17, 1 << 19
#: Nodes that lie across ranges up to which they are broadcast to their children.
SENT = 1 << 18
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame, moduli: tuple[int, int] | None = None) -> DataFrame:
    """(conv_id, path): each conversation's turns in order, TURN bytes each.

    moduli (m, k): a conversation c is rebuilt first. The first h turns of conversation c - c % m (all if there are fewer), h = checksum of c's decimals % k, take
    the place of its own first h. A conversation is one row, of 20 bytes a turn, whatever its texts take.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    turn = F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn.alias("own")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["own"]).alias("turns"))
    joined = F.unhex(F.array_join("turns", ""))
    if not moduli:
        return cut(own.select("conv_id", joined.alias("path")))
    own, (m, k) = cut(own), moduli
    h = (F.crc32(F.col("conv_id").cast("string")) % k).cast("int")
    leads = own.where(F.col("conv_id") % m == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, k - 1).alias("lead"))
    found = own.select("*", (F.col("conv_id") - F.col("conv_id") % m).alias("base"), h.alias("h")).join(leads, "base", "left")
    lead = F.slice(F.coalesce("lead", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rebuilt = F.concat(lead, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return cut(found.select("conv_id", rebuilt.alias("turns")).select("conv_id", joined.alias("path")))


def _common(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share, of which `known` are known."""
    n, most = known, min(len(a), len(b)) // TURN
    while n < most and a[n * TURN : (n + 1) * TURN] == b[n * TURN : (n + 1) * TURN]:
        n += 1
    return n


_RUNS = "range int, ids array<long>, common array<int>, rests array<binary>"


def _sorted_runs(bounds, run: int):
    """Sorted runs, cut at the bounds: of each path what the one before it in the run doesn't share, and how many turns it does."""

    def made(rows: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        rows.sort()
        starts = sorted({0, len(rows), *(bisect_left(rows, b) for b in bounds.value)})
        for a, b in pairwise(starts):
            own = rows[a:b]
            common = [0, *(_common(x[0], y[0]) for x, y in pairwise(own))]
            at = bisect_left(bounds.value, own[0])
            if at < len(bounds.value) and bounds.value[at] == own[0]:
                at += 1
            yield pa.RecordBatch.from_pydict({
                "range": pa.array([at], pa.int32()), "ids": pa.array([[r[1] for r in own]], pa.list_(pa.int64())), "common": pa.array([common], pa.list_(pa.int32())),
                "rests": pa.array([[r[0][n * TURN :] for r, n in zip(own, common, strict=True)]], pa.list_(pa.binary())),
            })

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((path, i))
                size += len(path) // TURN + 1
                if size >= run:
                    yield from made(rows)
                    rows, size = [], 0
        if rows:
            yield from made(rows)

    return apply


def merged(runs: list[Iterator[tuple[int, bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Runs of (turns shared with the one before, path, id) in one order, as one.

    A loser tree whose entries know how many turns they share with the path that came out last: of two, the one that shares more is the smaller,
    and only those that share as many are compared, from there on.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    head: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = _common(x[1], y[1], shared[a])
        p, q = x[1][n * TURN : (n + 1) * TURN], y[1][n * TURN : (n + 1) * TURN]
        first, second = (a, b) if (p, x[2]) <= (q, y[2]) else (b, a)
        shared[second] = n
        return first, second

    losers = [0] * size
    winners = list(range(size))
    while len(winners) > 1:
        level = len(winners) // 2
        played = [play(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        winners = [w for w, _ in played]
        losers[level : 2 * level] = [x for _, x in played]
    w = winners[0]
    while head[w] is not None:
        yield shared[w], head[w][1], head[w][2]
        head[w] = next(runs[w], None)
        if head[w] is not None:
            shared[w] = head[w][0]
        at = (w + size) // 2
        while at:
            w, losers[at] = play(w, losers[at])
            at //= 2


#: kind: a finished node (0), one whose parent lies across ranges (1), part of a node that does (2), ids that end there (3).
CLOSED, UNDER, ACROSS, ENDS = range(4)
_OUT = pa.schema(
    [("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("range", pa.int32()), ("first", pa.int32())]
    + [(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "tokens")]
    + [("ends", pa.string())]
)
_DDL = ", ".join(f"{f.name} { {pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'}[f.type]}" for f in _OUT)
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [x.split()[0] for x in _NODE.split(", ")]


class _Open:
    """A node on the open path. left, right: whether a bound of the range begins with it, so that it may lie across ranges."""

    __slots__ = ("children", "ends", "key", "least", "leaves", "left", "n", "right", "saved", "tokens", "waiting")

    def __init__(self, key: bytes, tokens: int, left: bool, right: bool) -> None:
        self.key, self.tokens, self.left, self.right = key, tokens, left, right
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[tuple] = []


def finished(stream: Iterator[tuple[int, bytes, int]], at: int, low: bytes | None, high: bytes | None) -> Iterator[tuple]:
    """Rows of _OUT from a range's conversations in order. low, high: the paths of its bounds, None at the ends.

    A node is finished when a path comes that doesn't begin with it, unless a bound does: such nodes are given in parts, which add up.
    Of a finished node only its children wait for it, as they name its smallest member.
    """
    path: list[_Open] = []

    def close() -> Iterator[tuple]:
        x, depth = path.pop(), len(path)
        up = path[-1] if path else None
        if up:
            up.n += x.n
            up.least = x.least if up.least is None else min(up.least, x.least)
        if x.left or x.right:
            yield ACROSS, x.key, up.key if up else None, at, at if x.left else at + 1, x.least, depth, None, x.n, x.children, x.leaves, x.saved, x.tokens, None
            if x.ends:
                yield ENDS, x.key, None, at, None, None, depth, *[None] * 6, ",".join(map(str, x.ends))
            return
        leaves, saved = x.leaves or 1, x.saved + (x.n - 1) * x.tokens
        ends = hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest() if x.ends else _NO_ENDS
        yield from ((CLOSED, None, None, at, None, *row[:2], x.least, *row[2:]) for row in x.waiting)
        own = x.least, depth, x.n, x.children, leaves, saved, None, ends
        if up is None:
            yield CLOSED, None, None, at, None, *own[:2], None, *own[2:]
            return
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        if up.left or up.right:
            yield UNDER, None, up.key, at, None, *own[:2], None, *own[2:]
        else:
            up.waiting.append(own)

    for shared, turns, i in stream:
        if not path:
            path.append(_Open(b"", 0, low is not None, high is not None))
        while len(path) > shared + 1:
            yield from close()
        for d in range(len(path) - 1, len(turns) // TURN):
            turn, up = turns[d * TURN : (d + 1) * TURN], path[-1]
            left, right = (flag and bound[d * TURN : (d + 1) * TURN] == turn for flag, bound in ((up.left, low), (up.right, high)))
            key = hashlib.blake2b(up.key + turn, digest_size=16).digest() if left or right else b""
            path.append(_Open(key, int.from_bytes(turn[16:], "big"), left, right))
        top = path[-1]
        top.n += 1
        top.least = i if top.least is None else min(top.least, i)
        top.ends.append(i)
    while path:
        yield from close()


def _merge(bounds):
    """The runs of each range, merged."""

    def decoded(ids: list[int], common: list[int], rests: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
        path = b""
        for i, n, rest in zip(ids, common, rests, strict=True):
            path = path[: n * TURN] + rest
            yield n, path, i

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    def of(at: int, runs: list[tuple]) -> Iterator[tuple]:
        low, high = (bounds.value[j][0] if 0 <= j < len(bounds.value) else None for j in (at - 1, at))
        yield from finished(merged([decoded(*r) for r in runs]), at, low, high)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, runs = None, []
        for b in batches:
            for at, *run in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != last and runs:
                    yield from of(last, runs)
                    runs = []
                last = at
                runs.append(tuple(run))
        if runs:
            yield from of(last, runs)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows(batches):
            held.append(row)
            if len(held) == 8192:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return apply


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that lie across ranges, in the order of a walk down their tree, with what is below them; a stack holds the open path."""
    stack: list[dict] = []
    names = [x for x in _COLUMNS if x != "ends_sha256"]

    def close() -> dict:
        x = stack.pop()
        up = stack[-1] if stack else None
        x["n_leaves"] = x["n_leaves"] if x["n_children"] else 1
        x["saved_tokens"] += (x["n_convs"] - 1) * x["tokens"]
        if up:
            x["parent_conv_id"] = up["conv_id"]
            up["n_children"] += 1
            up["n_leaves"] += x["n_leaves"]
            up["saved_tokens"] += x["saved_tokens"]
        return x

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], pa.binary()), *(pa.array([r[n] for r in rows], pa.int64()) for n in names)], names=["key", *names])

    for b in batches:
        done = []
        for row in b.to_pylist():
            while len(stack) > row["depth"]:
                done.append(close())
            stack.append(row | {"parent_conv_id": None})
        if done:
            yield batch(done)
    if stack:
        yield batch([close() for _ in range(len(stack))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of ids that come in parts, in order."""
    last, h = None, None
    result = lambda: pa.RecordBatch.from_pydict({"key": pa.array([last], pa.binary()), "ends_sha256": pa.array([h.hexdigest()], pa.string())})
    for b in batches:
        for key, ends in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if key != last:
                if h:
                    yield result()
                last, h = key, hashlib.sha256(ends.encode())
            else:
                h.update(b"," + ends.encode())
    if h:
        yield result()


def trie(sequences: DataFrame, turns: int = TURNS, run: int = RUN) -> DataFrame:
    """The nodes of the trie of (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    An external mergesort. Tasks write sorted runs, cut at bounds that a sample gives; of each path only what the one before it doesn't share is sent. Bounds are
    paths with ids, so that copies of one conversation are dealt out too, and a range has about `turns` turns, whatever is shared. A task merges the runs of a
    range and finishes all nodes that no bound begins with. Of the others, which lie across ranges, parts add up; they are as many as the bounds are deep, and one
    task walks down their tree. The ids that end in such a node come to the task that hashes them, which is a sequence by definition, as one string for each range.
    """
    spark = sequences.sparkSession
    weight = F.octet_length("path") / TURN + 1
    total = int(sequences.agg(F.sum(weight)).first()[0] or 0)
    ranges, every = max(1, min(RANGES, -(-total // turns))), max(1, total // SAMPLE)
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in sequences.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("path", "conv_id").collect()) if ranges > 1 else []
    chosen, seen, each = [], 0, sum(len(p) // TURN + 1 for p, _ in sample) / ranges
    for x in sample:
        if seen >= each * (len(chosen) + 1):
            chosen.append(x)
        seen += len(x[0]) // TURN + 1
    bounds = spark.sparkContext.broadcast(chosen)
    runs = sequences.select("conv_id", "path").mapInArrow(_sorted_runs(bounds, run), _RUNS).repartition(ranges, "range").sortWithinPartitions("range")
    found = cut(runs.mapInArrow(_merge(bounds), _DDL))
    bounds.destroy()

    parts = found.where(F.col("kind") == ACROSS).groupBy("key").agg(
        F.min("first").alias("first"), F.min("depth").alias("depth"), F.min("tokens").alias("tokens"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    across = cut(parts.coalesce(1).sortWithinPartitions("first", "depth").mapInArrow(_added_up, "key binary, " + _NODE.rpartition(",")[0]))
    ends = found.where(F.col("kind") == ENDS).select("key", "range", "ends").repartition("key").sortWithinPartitions("key", "range").mapInArrow(_hashed, "key binary, ends_sha256 string")
    top = across.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    parents = across.select(F.col("key").alias("parent"), F.col("conv_id").alias("_up"))
    if across.count() <= SENT:
        parents = F.broadcast(parents)
    plain = [c for c in _COLUMNS if c not in ("parent_conv_id", "ends_sha256")]
    closed = found.where(F.col("kind") == CLOSED).select(*plain, "parent_conv_id", F.col("ends").alias("ends_sha256"))
    under = found.where(F.col("kind") == UNDER).join(parents, "parent").select(*plain, F.col("_up").alias("parent_conv_id"), F.col("ends").alias("ends_sha256"))
    return closed.unionByName(under).unionByName(top.drop("key")).select(*_COLUMNS)


def shared(conversations: DataFrame, moduli: tuple[int, int] | None = None) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), a row for each distinct sequence of first turns, the empty one included.

    conv_id: the smallest member's; depth; parent_conv_id (null at the root); n_convs: members; n_children; n_leaves: childless nodes below it or itself; saved_tokens: what a cache of
    prefixes saves there and below, (n_convs - 1) times the code points of the last text of each node; ends_sha256: of the ids of the members that end there, ascending, comma-joined.
    moduli: see paths().

    Turns are ordered by turn, null first; turns that tie, by a digest of role and text, and repeated rows are turns of their own. Null roles and texts are empty. Rows without a conv_id belong
    to no conversation. A conversation without turns (rebuilt ones can be) ends at the root. Turns are told apart by 128 bits of SHA-256.
    An empty table gives an empty one; other columns are ignored, whatever their names.
    """
    return trie(paths(conversations, moduli))
