"""Near copies by confirmed similarity against brute-force Jaccard, in the operator and in the pipeline's stage."""

import random
import re

import pytest

import corpus_pipeline
from kinfold.llm import shingles

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out = []
    for base in range(40):
        text = [word() for _ in range(rng.choice((40, 90, 300)))]
        out.append(text)
        for share in (0.005, 0.015, 0.02, 0.025, 0.03, 0.05):
            out.append([word() if rng.random() < share else x for x in text])
    hub = [word() for _ in range(200)]
    out += [hub] + [[word() if i % 40 == k % 40 else x for i, x in enumerate(hub)] for k in range(80)]
    texts = [" ".join(x) for x in out]
    texts += [texts[5].upper().replace(" ", "\n ", 3), "", "  \n", "two words", "Two  words", "other words"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)] + [(5000, None)]


def sets(text, n=5):
    w = WORDS.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    """The least id of each id's component, and pairs at 0.8 or more."""
    s, of = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if len(s[i] & s[j]) * 5 >= len(s[i] | s[j]) * 4:
                pairs.append((i, j))
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}, pairs


@pytest.fixture(scope="module")
def expected():
    rows = near_copies()
    return rows, *brute(rows)


@pytest.mark.parametrize(("hubs", "group"), [(shingles.HUBS, shingles.GROUP), (1, 8)])
def test_classes_are_those_of_brute_force(spark, expected, hubs, group):
    rows, of, pairs = expected
    assert len(pairs) > 150 and len(set(of.values())) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in shingles.classes(docs, hubs=hubs, group=group).collect()}
    assert got == of
    assert shingles.classes(docs.where("doc_id < 0")).count() == 0


def test_stage_keeps_one_of_each_component(spark, expected):
    rows, of, _ = expected
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(of.values()))


def test_bands_find_pairs_at_the_threshold():
    import numpy as np

    rng, found = np.random.default_rng(1), 0
    for _ in range(400):
        x = np.unique(rng.integers(0, 1 << 64, 180, np.uint64))
        a, b = x[rng.permutation(180)[:162]], np.zeros(0)
        b = np.concatenate([x[~np.isin(x, a)], a[18:]])  # 144 of 180 in common
        assert shingles.similar(np.sort(a), np.sort(b), 80) and not shingles.similar(np.sort(a), np.sort(b), 81)
        found += bool((shingles.bands(a) == shingles.bands(b)).any())
    assert found >= 399
