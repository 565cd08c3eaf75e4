"""Components of the n-gram join beside all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from bidloom.llm import ngram_join


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, size, percent):
    sets = {k: shingles(t, size) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(3000)]
    docs = []
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice([12, 60, 300, 500]))]
        for _ in range(40):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            docs.append(copy[: len(copy) - r.choice([0, 0, 0, 5])])
    family = [r.choice(vocabulary) for _ in range(200)]
    for k in range(60):  # a chain: each like the next, the ends unlike
        family[(3 * k) % 200] = r.choice(vocabulary)
        docs.append(list(family))
    texts = [" ".join(d) for d in docs] + ["", None, "  \t\n", "one", "One two", "one two", "a b c", "A B  C", "x " * 3000]
    return list(enumerate(texts))


@pytest.mark.parametrize("size,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, size, percent, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.id: (r.n, r.component) for r in ngram_join.jaccard_components(df, size=size, percent=percent).collect()}
    assert got == brute(docs, size, percent)


def test_odd_rows(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "y"), (5, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n string")
    got = sorted(((r.id, r.n, r.component) for r in ngram_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (5, 0, 5), (None, 0, None)], key=str)
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0
    assert sorted([r.doc_id for r in ngram_join.keep_one_row(df).collect()], key=str) == [1, 5, None]


def test_blocks_of_similar_sets_meet():
    """Any pair at the bound shares an announced block key."""
    r = np.random.default_rng(3)
    low, blocks, slack = ngram_join.size_classes(90)
    for n in (9, 10, 13, 19, 20, 40, 95, 200):
        for _ in range(30):
            common = r.integers(0, 2**63, n).astype(np.uint64)
            d = 2 * n // 19
            a = np.unique(np.concatenate([common[: n - d // 2], r.integers(0, 2**63, d // 2).astype(np.uint64)]))
            b = np.unique(common)
            if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)):
                continue
            both = []
            for x in (a, b):
                kind = np.array([np.searchsorted(low, len(x), "right") - 1])
                up = np.where(100 * len(x) >= 90 * low[kind + 1], kind + 1, -1)
                both.append([ngram_join.block_keys(x, np.array([0, len(x)]), c, blocks, slack) for c in (kind, up)])
            met = [(set(k.tolist()) & set(j.tolist()), max(p[0], q[0])) for k, _, p in both[0] for j, _, q in both[1]]
            assert any(len(common) >= need for common, need in met)


def test_one_row_of_each_component(spark):
    one, other = (" ".join(f"{p}{i}" for i in range(150)) for p in "ab")
    near = one.replace("a149", "z")
    rows = [(3, one, "s", 1), (3, one, "s", 1), (3, one, "r", 1), (4, near, "s", 1), (4, other, "s", 1), (None, one, "s", 1)]
    rows += [(None, "c d e f g", "s", k) for k in (2, 1, 1)] + [(5, "h i j k l", "s", 1), (None, "h i j k l", "s", 1)] + [(None, None, None, 0), (6, " ", "s", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string, tid int").repartition(3)
    kept = ngram_join.keep_one_row(df)
    wanted = [(3, one, "r", 1), (4, other, "s", 1), (None, "c d e f g", "s", 1), (5, "h i j k l", "s", 1)] + [(None, None, None, 0), (6, " ", "s", 1)] * 2
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(wanted, key=str)
    assert ngram_join.keep_one_row(df.limit(0)).count() == 0
