"""Words grouped with their misspellings: every word's distance-one automaton against a trie of all words, in broadcast shards."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.graph import with_ranges

from .store import cut

#: Words of a range, and ranges of a shard; words and characters of a block.
RANGE, RANGES, BLOCK, CHARS = 1 << 14, 16, 1 << 15, 1 << 22
#: Bytes of shards that are broadcast at a time; further shards have rounds of their own.
ROUND = 32 << 20
#: Different words that a task counts together before it hands them on.
HELD = 1 << 18
_COUNTED = "word string, n long"


def _count(least: int, typos: int):
    """Counts of words by task, from (id, text)."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def batch(counts: Counter) -> pa.RecordBatch:
        found = {w: n for w, n in counts.items() if n}
        return pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for rows in batches:
            for i, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = runs.findall((text or b"").lower().decode())
                counts.update(words)
                if typos:
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for w in [w for w in words if not zlib.crc32(w.encode(), start) % typos]:
                        at = zlib.crc32(w.encode(), start) % len(w)
                        counts[w] -= 1
                        if len(w) > least:
                            counts[w[:at] + w[at + 1 :]] += 1
                if len(counts) > HELD:
                    yield batch(counts)
                    counts = Counter()
        yield batch(counts)

    return apply


def vocabulary(docs: DataFrame, least: int = 7, least_n: int = 2, typos: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of `[A-Za-z\\u00C0-\\u00FF]` with A-Z in lower case, of at least `least` code points and `least_n` occurrences.

    typos: where this number divides the checksum h of `<id>:<run>`, the run loses its code point h % length first. A null id is written as nothing.
    """
    counted = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_count(least, typos), _COUNTED)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Words:
    """Some words as code points, none above 255; two zeros follow each."""

    def __init__(self, words: list[bytes]) -> None:
        self.len = np.fromiter(map(len, words), np.int32, len(words))
        self.off = np.cumsum(self.len + 2, dtype=np.int64) - self.len - 2
        self.flat = np.frombuffer(b"\0\0".join([*words, b""]), np.uint8)

    def at(self, row: np.ndarray, pos: np.ndarray | int) -> np.ndarray:
        return self.flat[self.off[row] + pos]

    def spelt(self, row: int) -> str:
        return self.flat[self.off[row] : self.off[row] + self.len[row]].tobytes().decode("latin-1")


class Shard:
    """A compact trie of sorted words: nodes for what several words share, and a leaf where a word is alone, whose rest is not spelt in nodes.

    Nodes are numbered by depth and order, so that the children of one stand together; `keys` has parent << 8 | label of each but the root.
    """

    def __init__(self, words: list[bytes], n: list[int]) -> None:
        self.n, self.words = np.array(n, np.int64), Words(words)
        self.first, self.last = words[0], words[-1]
        count = len(words)
        lcp = np.zeros(count + 1, np.int32)
        lcp[1:count] = [_lcp(a, b) for a, b in zip(words, words[1:])]
        deep = np.maximum(lcp[:-1], lcp[1:])
        keys, only, term, at, base = [], [np.full(1, -1, np.int32)], [np.full(1, -1, np.int32)], np.zeros(count, np.int64), 1
        alive = np.arange(count)
        for d in range(1, int(self.words.len.max()) + 1):
            alive = alive[(self.words.len[alive] >= d) & (deep[alive] >= d - 1)]
            if not len(alive):
                break
            new = lcp[alive] < d
            new[0] = True
            own = alive[new]
            keys.append(at[own] << 8 | self.words.at(own, d - 1))
            at[alive] = base + np.cumsum(new) - 1
            leaf = deep[own] < d
            only.append(np.where(leaf, own, -1).astype(np.int32))
            term.append(np.full(len(own), -1, np.int32))
            ends = alive[(self.words.len[alive] == d) & (deep[alive] >= d)]
            term[-1][at[ends] - base] = ends
            base += len(own)
        self.keys, self.only, self.term = np.concatenate(keys), np.concatenate(only), np.concatenate(term)
        self.child = np.searchsorted(self.keys, np.arange(base + 1, dtype=np.int64) << 8).astype(np.int32) + 1

    def step(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The children by these labels; 0: none."""
        key = node.astype(np.int64) << 8 | label
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, i + 1, 0)

    def reachable(self, words: Words) -> np.ndarray:
        """Words that may be near one of the shard, by the first two code points (the edit may make or move either) and the length."""
        a, b, c = (words.at(np.arange(len(words.len)), i).astype(np.int32) for i in (0, 1, 2))
        low, high = (int.from_bytes(w[:2].ljust(2, b"\0"), "big") for w in (self.first, self.last))
        within = lambda x: (x >= low) & (x <= high)
        behind = lambda x: (high - x) // 256 * 256 + x >= low
        good = within(a << 8 | b) | within(a << 8 | c) | within(b << 8 | c) | behind(a) | behind(b) | ((a >= low >> 8) & (a <= high >> 8))
        own = self.words.len
        return np.flatnonzero(good & (words.len >= own.min() - 1) & (words.len <= own.max() + 1))


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 8:
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    return next(i for i in range(low, n) if a[i] != b[i])


def _same_rest(w: Words, word: np.ndarray, pos, s: Words, other: np.ndarray, depth) -> np.ndarray:
    """Which words from pos on equal which others from depth on."""
    pos, depth = np.broadcast_to(pos, word.shape), np.broadcast_to(depth, word.shape)
    left = w.len[word] - pos
    out = (left == s.len[other] - depth) & (left >= 0)
    open_, k = np.flatnonzero(out), 0
    while len(open_):
        open_ = open_[left[open_] > k]
        equal = w.at(word[open_], pos[open_] + k) == s.at(other[open_], depth[open_] + k)
        out[open_[~equal]] = False
        open_, k = open_[equal], k + 1
    return out


def near(shard: Shard, words: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word of the shard) for each pair that one inserted, deleted or replaced code point tells apart.

    The automata of all rows walk down the trie together. Where they stand without an edit, every edit is tried and its walk, which has no choice
    left, is followed to its end first. Edits are made where the two words first differ alone, so a pair is found once.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    s = shard.words

    def walk(node: np.ndarray, word: np.ndarray, pos: int, depth: int) -> None:
        while len(node):
            only = shard.only[node]
            leaf = only >= 0
            if leaf.any():
                w, o = word[leaf], only[leaf]
                good = _same_rest(words, w, pos, s, o, depth)
                found.append((w[good], o[good]))
                node, word = node[~leaf], word[~leaf]
            end = (words.len[word] == pos) & (shard.term[node] >= 0)
            if end.any():
                found.append((word[end], shard.term[node[end]]))
            node = shard.step(node, words.at(word, pos))
            word, node = word[node > 0], node[node > 0]
            pos, depth = pos + 1, depth + 1

    word, node, d = rows, np.zeros(len(rows), np.int64), 0
    while len(word):
        only = shard.only[node]
        leaf = only >= 0
        if leaf.any():
            w, o = word[leaf], only[leaf]
            close = np.abs(words.len[w] - s.len[o]) <= 1
            w, o = w[close], o[close]
            p, open_ = np.full(len(w), d), np.arange(len(w))
            while len(open_):
                a, b = words.at(w[open_], p[open_]), s.at(o[open_], p[open_])
                open_ = open_[(a == b) & (a > 0)]
                p[open_] += 1
            more = words.len[w] - s.len[o]
            inside = (p < words.len[w]) | (p < s.len[o])
            good = inside & _same_rest(words, w, p + (more >= 0), s, o, p + (more <= 0))
            found.append((w[good], o[good]))
            node, word = node[~leaf], word[~leaf]
        c, after = words.at(word, d), words.at(word, d + 1)
        inside = d < words.len[word]
        skip = inside & (after != c)
        walk(node[skip], word[skip], d + 1, d)
        count = shard.child[node + 1] - shard.child[node]
        i = np.repeat(np.arange(len(node)), count)
        child = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + shard.child[node][i]
        other = (shard.keys[child - 1] & 255) != c[i]
        i, child = i[other], child[other]
        walk(child, word[i], d, d + 1)
        walk(child[inside[i]], word[i[inside[i]]], d + 1, d + 1)
        node = shard.step(node, c)
        word, node = word[node > 0], node[node > 0]
        d += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _blocks(words: list[bytes], most: int) -> Iterator[slice]:
    """Consecutive words, at most so many and of at most CHARS code points together, one at least."""
    start, size = 0, 0
    for i, w in enumerate(words):
        if i > start and (i - start == most or size + len(w) > CHARS):
            yield slice(start, i)
            start, size = i, 0
        size += len(w)
    if words:
        yield slice(start, len(words))


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards from rows (range, word, n) in order: (range, part, bytes, data)."""

    def made(at: int, words: list[bytes], n: list[int]) -> Iterator[pa.RecordBatch]:
        for part, own in enumerate(_blocks(words, RANGE * RANGES)):
            data = pickle.dumps(Shard(words[own], n[own]), 5)
            yield pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "part": pa.array([part], pa.int32()), "bytes": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

    at, words, n = None, [], []
    for batch in batches:
        ranges = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]][: len(ranges)]).tolist()
        for a, b in zip(starts, [*starts[1:], len(ranges)], strict=True):
            if at is not None and at != ranges[a]:
                yield from made(at, words, n)
                words, n = [], []
            at = int(ranges[a])
            words += _latin(batch.column(1).slice(a, b - a))
            n += batch.column(2).slice(a, b - a).to_pylist()
    if at is not None:
        yield from made(at, words, n)


_NEAR = "word string, n_near long, best_n long, best string"


def _searched(shards):
    """(word, n_near, best_n, best) of the words that have near ones in these shards."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [pickle.loads(x) for x in shards.value]
        for batch in batches:
            every = _latin(batch.column(0))
            for own in _blocks(every, BLOCK):
                words, parts, base, of = Words(every[own]), [], 0, []
                for shard in tries:
                    rows = shard.reachable(words)
                    if len(rows):
                        row, other = near(shard, words, rows)
                        parts.append((row, shard.n[other], other + base))
                    of.append(base)
                    base += len(shard.n)
                if not parts:
                    continue
                row, n, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((rank, -n, row))
                row, n, rank = row[order], n[order], rank[order]
                head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
                at = np.searchsorted(of, rank[head], side="right") - 1
                best = [tries[i].words.spelt(r - of[i]) for i, r in zip(at.tolist(), rank[head].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([every[own][r].decode("latin-1") for r in row[head].tolist()], pa.string()),
                    "n_near": pa.array(np.diff(np.r_[head, len(row)]), pa.int64()), "best_n": pa.array(n[head], pa.int64()), "best": pa.array(best, pa.string()),
                })

    return apply


def neighbours(vocab: DataFrame, most: int = ROUND, rows: int = RANGE) -> DataFrame:
    """(word, n_near, best_n, best) of the words of vocab (word, n) that have near ones; best is the near word of largest n, the smallest of several.

    Words are dealt into ranges of about `rows` by their order, and some ranges together become a compact trie, or several where words are long. Shards of at most `most`
    bytes together (or one) are broadcast at a time, and all words pass by them in their order; what the rounds find is added up. The sizes are known before anything is collected.
    """
    spark = vocab.sparkSession
    ranged = with_ranges(vocab, ["word"], rows).select("_range", "word", "n")
    tasks = min(4096, ranged.agg(F.max("_range")).first()[0] or 0) + 1
    words = cut(ranged.repartition(tasks, "_range").sortWithinPartitions("_range", "word"))
    dealt = words.select(F.floor(F.col("_range") / RANGES).cast("int").alias("range"), "word", "n").repartition("range").sortWithinPartitions("range", "word")
    shards = cut(dealt.mapInArrow(_built, "range int, part int, bytes long, data binary"))
    sizes = shards.select("range", "part", "bytes").orderBy("range", "part").collect()
    parts, at = [], 0
    while at < len(sizes) or not parts:
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end]["bytes"] <= most):
            total += sizes[end]["bytes"]
            end += 1
        own = []
        if sizes:
            low, high = (F.struct(F.lit(s["range"]).alias("range"), F.lit(s["part"]).alias("part")) for s in (sizes[at], sizes[end - 1]))
            own = shards.where(F.struct("range", "part").between(low, high)).orderBy("range", "part").select("data").collect()
        sent = spark.sparkContext.broadcast([bytes(r["data"]) for r in own])
        parts.append(cut(words.select("word").mapInArrow(_searched(sent), _NEAR)))
        sent.destroy()
        at = max(end, 1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where forms lead in the end. Forms must not go round in a circle; chains shorten by half in each step."""
    links = cut(links.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, least: int = 7, least_n: int = 2, ratio: int = 10, typos: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are those of vocabulary(). Two are near if exactly one inserted, deleted or replaced code point tells them apart. A word's form is the near word of
    largest n (of several, the smallest in code-point order), if that is at least `ratio` times its own; form_n is its n. root: where forms lead in the end,
    the word itself without a form. ratio must be over 1, so that forms can't go round in a circle.

    Null and empty texts have no words; null ids are written as nothing; repeated rows count as often as they come; words of any length are
    taken whole; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    vocab = cut(vocabulary(docs, least, least_n, typos, id_col, text_col))
    good = F.col("best_n") >= F.col("n") * ratio
    words = vocab.join(neighbours(vocab), "word", "left")
    words = cut(words.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    end = roots(words.where("form is not null"))
    return words.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
