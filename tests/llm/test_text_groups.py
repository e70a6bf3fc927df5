"""Spelling variants, benchmark overlap and the prefix trie against brute force, with odd rows and small limits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.llm import overlap, prefixes, spelling

low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- spelling variants ---


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def near_words(words):
    letters = {c for w in words for c in w}
    return {w: {x for x in edits(w, letters) if x != w and x in words} for w in words}


def test_automata_find_each_pair_once():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(3000)} | {"a" * 300, "a" * 301, "a" * 299 + "b", "x"})
    plain = [w.encode("latin-1") for w in words]
    every, found = spelling.Words(plain), []
    for i in range(0, len(words), 400):
        shard = spelling.Shard(plain[i : i + 400], [1] * len(plain[i : i + 400]))
        row, other = spelling.near(shard, every, shard.reachable(every))
        found += [(words[r], words[o + i]) for r, o in zip(row.tolist(), other.tolist(), strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == {(w, x) for w, own in near_words(set(words)).items() for x in own}


def brute_variants(rows, least, typos, ratio=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near, form = near_words(words), {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def spelt():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(1, 150)]) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(7, "ccccc " * 400), (8, "cccc " * 30 + "ccc ccc Éa"), (6, "ccccc " * 300), (None, None), (None, "ABé aBÉ x×÷ a-b"), (9, ""), (10, "z" * 5000 + " " + "z" * 5000), (11, "z" * 4999 + " " + "z" * 4999)]
    return [*rows, rows[3], rows[3]]


@pytest.mark.parametrize("typos", [0, 3])
def test_variants(spark, spelt, typos):
    df = spark.createDataFrame(spelt, "doc_id long, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("word", "n", "_range", "form")})
    got = spelling.variants(df, least=2, typos=typos)
    expected = brute_variants(spelt, 2, typos)
    assert rows_of(got) == expected and any(r[1] for r in expected)
    assert typos or any(r[1] != r[2] for r in expected if r[1])
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(df.where("doc_id < -1")).count() == 0


def test_rounds_of_shards(spark, spelt):
    vocab = spelling.vocabulary(spark.createDataFrame(spelt, "doc_id long, text string"), 2, 1)
    assert rows_of(spelling.neighbours(vocab, most=1, rows=3)) == rows_of(spelling.neighbours(vocab))


def test_forms_must_grow(spark):
    with pytest.raises(ValueError, match="over 1"):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)


# --- benchmark overlap ---


def brute_overlap(docs, items, size=10):
    windows = defaultdict(set)
    for i, text in items:
        w = ITEM_WORDS.findall(low(text))
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[s : s + size])].add(i)
    lengths, out = {len(k) for k in windows}, []
    for d, text in docs:
        w, hit, its = ITEM_WORDS.findall(low(text)), set(), set()
        for s in range(len(w)):
            for n in lengths:
                if len(w[s : s + n]) == n and tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    its |= {str(i) for i in windows[tuple(w[s : s + n])] if i is not None}
        out.append((d, len(w), len(hit), sorted(its), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    words = ["Alpha", "bé", "cee", "D3", "éñ", "ÀB", "x", "y", "z"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([3, 10, 12, 25]))) for i in range(30)] + [(40, None), (41, ""), (42, "..."), (None, text(12)), (1, text(11)), (50, text(1)), (51, "zz yy"), (52, "same " * 12)]
    docs = [(i, text(rng.randint(0, 40)) + (f" , {rng.choice(items)[1]} {text(5)}" if i % 3 == 0 else "")) for i in range(120)]
    docs += [(200, None), (201, ""), (None, items[0][1]), (None, items[2][1]), (5, docs[3][1]), (7, docs[7][1]), (7, docs[7][1]), (300, "same " * 60), (301, " ".join(text(9) for _ in range(800)))]
    return docs, items


@pytest.mark.parametrize("short", [True, False])
@pytest.mark.parametrize("most", [overlap.SENT, 3])
def test_overlap(spark, passages, short, most):
    docs, items = passages
    items = [x for x in items if short or len(ITEM_WORDS.findall(low(x[1]))) >= 10]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({c: F.lit("clash") for c in ("_k", "own", "at", "window", "item", "n")})
    its = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_overlap(docs, items)
    got = overlap.contaminated(df, its, most=most)
    assert rows_of(got) == expected and any(r[4] for r in expected) and not all(r[4] for r in expected)
    assert got.columns == ["doc_id", "n_words", "n_hit", "items", "contaminated"]


def test_overlap_of_nothing(spark, passages):
    df = spark.createDataFrame(passages[0], "doc_id long, text string")
    its = spark.createDataFrame(passages[1], "item_id long, text string")
    assert overlap.contaminated(df.where("doc_id < -1"), its).count() == 0
    assert rows_of(overlap.contaminated(df, its.where("item_id < -1"))) == brute_overlap(passages[0], [])


def test_overlap_runs_no_python(spark, passages):
    df = spark.createDataFrame(passages[0], "doc_id long, text string")
    plan = overlap.contaminated(df, df.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- prefix trie ---


def brute_trie(rows, m=100, k=6):
    found = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            found[c].append(((t is not None, t or 0), role or "", text or ""))
    conv = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in found.items()}
    built = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % k
        built[c] = tuple(conv.get(c - c % m, [])[:h] + own[h:])
    nodes, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children.update(s[:-1] for s in nodes if s)
    for s, members in nodes.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(members) - 1) * (len(s[-1][1]) if s else 0)
            leaves[s[:d]] += not children[s]
    ends = lambda s, members: hashlib.sha256(",".join(map(str, sorted(c for c in members if built[c] == s))).encode()).hexdigest()
    return sorted(((min(v), len(s), min(nodes[s[:-1]]) if s else None, len(v), children[s], leaves[s], saved[s], ends(s, v)) for s, v in nodes.items()), key=str)


def talks(seed):
    rng, rows = random.Random(seed), []
    for c in range(300):
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
            rows.append((c, t, rng.choice(["u", "a", None]) if t > 1 else "u", rng.choice(["hi", "x", None, "é" * rng.randint(1, 2)])))
    rows += [(500 + i, t, "u", "same") for i in range(60) for t in range(3)]
    rows += [(c, t, "u", f"long{t % 3}") for c, n in ((700, 50), (701, 52)) for t in range(n)]
    rows += [(None, 1, "u", "x"), (800, None, "u", "first"), (800, 1, "a", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "turns", "run"), [(0, prefixes.TURNS, prefixes.RUN), (0, 40, 100), (1, 7, 60), (2, 3, 9)])
def test_trie(spark, seed, turns, run):
    rows = talks(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("path", "range", "key", "t")})
    got = prefixes.trie(prefixes.paths(df, (100, 6)), turns, run)
    assert rows_of(got) == brute_trie(rows)


def test_repeated_turns_and_empty_tables(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r["depth"], r["n_convs"]) for r in prefixes.shared(df).orderBy("depth").collect()] == [(0, 2), (1, 2), (2, 1)]
    assert prefixes.shared(df.where("conv_id < 0")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_merge_is_a_sort(n):
    rng = random.Random(n)
    rows = [(b"".join(bytes([rng.randint(0, 1)]) * prefixes.TURN for _ in range(rng.randint(0, 5))), i) for i in range(200)]
    runs = [sorted(rows[i::n]) for i in range(n)]
    common = lambda run: [0, *(prefixes._common(a[0], b[0]) for a, b in zip(run, run[1:], strict=False))]
    out = list(prefixes.merged([iter([(c, *r) for c, r in zip(common(run), run, strict=True)]) for run in runs]))
    assert [(p, i) for _, p, i in out] == sorted(rows)
    assert [c for c, _, _ in out] == common(sorted(rows))
