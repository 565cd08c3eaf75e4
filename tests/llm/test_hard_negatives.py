"""Hard negatives beside a plain scan of all pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from bidloom.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string"


def plain(rows, anchor, k=5):
    usable = {(i, label, tuple(math.floor(256 * c) for c in v)) for i, v, label, *_ in rows
              if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    sizes = [len(x) for _, _, x in usable]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), d), default=0)
    usable = [r for r in usable if len(r[2]) == dims]
    out = []
    for a, la, xa in usable:
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(xa, x)), i, label) for i, label, x in usable if i != a)
        for s, p, _ in [r for r in scored if r[2] == la][:k]:
            fits = [r for r in scored if r[2] != la and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def make(n, dims, seed, spread=0.3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = centres[r.randrange(4)]
        rows.append((i, [m + r.gauss(0, spread) for m in c], r.randrange(4), "clash"))
    return rows


def test_mining_agrees_with_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(H, "SMALL", 70)
    rows = make(420, 12, 1)
    rows += [(i, rows[10][1], 1, "") for i in range(1000, 1200)]  # copies of one vector, a third of all rows
    rows += [rows[20], rows[20], (20, rows[21][1], rows[20][2], ""), (3000, None, 1, ""), (3010, [None] * 12, 1, ""), (3020, [float("nan")] * 12, 1, ""), (3030, [], 1, ""),
             (3040, rows[1][1], None, ""), (None, rows[2][1], 1, ""), (3050, [1.0], 2, ""), (3060, [0.0] * 12, 2, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = H.mine(df, F.col("id") % 10 == 0)
    expected = plain(rows, lambda i: i % 10 == 0)
    assert len(expected) > 300 and sorted(map(tuple, got.collect())) == expected
    empty = H.mine(df.limit(0), F.col("id") % 10 == 0)
    assert empty.count() == 0 and empty.columns == got.columns
    assert H.mine(df, F.col("id") < 0).count() == 0


def test_values_beyond_doubles(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(0, 1e6) + (0 if i % 2 else 1e6) for _ in range(5)], i % 2, "") for i in range(60)]
    assert sorted(map(tuple, H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0).collect())) == plain(rows, lambda i: i % 10 == 0)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1, ""), (1, [0.9, 0.1], 2, ""), (2, [-1.0, 0.0], 1, "")]
    assert H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).count() == 0  # its one positive scores below nothing
    rows.append((3, [1.0, 0.2], 1, ""))
    assert [tuple(x) for x in H.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).collect()] == [(0, 3, 1, 1, 65536, 58880)]


def test_the_scan_drops_candidates_before_the_last_column():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-40, 40, (3000, 32)), rng.integers(150, 250, (30, 32))])
    n = len(x)
    block = H.Block(np.arange(n), np.arange(n), np.zeros(n, np.int64), x, True)
    seen = []
    among, wanted = slice(0, n), np.ones(n, bool)
    q = x[-1].astype(float)

    def keep(part, least, most):
        seen.append(len(part))
        bar = np.partition(part, len(part) - 5)[len(part) - 5] if len(part) > 5 else -np.inf
        return part + most >= bar + least

    rows, scores = block.scan(q, among, wanted, keep)
    assert seen[-1] < n / 10 and (x[rows] @ x[-1] == scores).all()
    best, top = block.nearest(-1, 0, q, 5)
    every = x @ x[-1]
    assert sorted(top.tolist(), reverse=True) == sorted(every.tolist(), reverse=True)[:5] and (every[best] == top).all()
