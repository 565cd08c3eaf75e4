"""Whitening beside plain arithmetic on Python integers."""

import math
import random
from fractions import Fraction

import numpy as np

from bidloom.llm import whitening as W
from bidloom.session import Scratch

SCHEMA = "vec_id bigint, embedding array<double>, label int, n string"


def good(v, dims):
    return v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)


def check(got, rows, dims, components=4):
    xs = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if good(v, dims)]
    listed = [list(t) for t in {tuple(x) for _, x in xs}]
    n = len(listed)
    sums = [sum(x[d] for x in listed) for d in range(dims)]
    v = np.array([[float(Fraction(sum(x[i] * x[j] for x in listed), n) - Fraction(sums[i], n) * Fraction(sums[j], n)) for j in range(dims)] for i in range(dims)])
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    k = int((values[:components] > values[0] * 1e-12).sum())
    assert len(got) == len(xs) * k
    expected = sorted((-1 if i is None else i, c, sum((n * x[d] - sums[d]) ** 2 for d in range(dims))) for i, x in xs for c in range(1, k + 1))
    assert sorted((-1 if r.id is None else r.id, r.component, r.deviation) for r in got) == expected
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for r in got:
        assert abs(r.explained / (values[r.component - 1] / v.trace()) - 1) < 1e-9
    # The whitened values are projections on unit eigenvectors: their sum of squares per component is n where vectors are distinct.
    by_vector = {}
    for r in got:
        by_vector.setdefault(r.deviation, {})[r.component] = r.whitened
    return listed, sums, v, values


def test_scatter_is_exact():
    rng = np.random.default_rng(2)
    for rows, span in ((1, 5), (63, 2), (200, 300), (130, 1 << 40), (5000, 9)):
        x = rng.integers(-span, span, (rows, 7))
        total, sums = W.scatter(x)
        assert total.tolist() == (x.astype(object).T @ x.astype(object)).tolist() and sums.tolist() == x.astype(object).sum(0).tolist()
        back = sum(part.astype(object) << (W.LIMB * k) for k, part in enumerate(W.limbs(total)))
        assert back.tolist() == total.tolist()


def test_whitening_beside_plain_arithmetic(spark):
    r = random.Random(1)
    mixing = np.random.default_rng(5).normal(size=(6, 6)) * 0.2
    rows = [(i, (mixing @ np.array([r.gauss(0, 1) for _ in range(6)])).tolist(), i % 3, "clash") for i in range(400)]
    rows += [(i, rows[0][1], 1, "clash") for i in range(1000, 1300)]  # one vector, a third of all rows
    rows += [(2000, None, 1, None), (2001, [None] * 6, 1, None), (2002, [float("nan")] + [0.0] * 5, 1, None), (2003, [float("inf")] * 6, 1, None),
             (2004, [], 1, None), (2005, [1.0, 2.0], 1, None), (None, rows[3][1], None, None), (7, rows[9][1], 2, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = W.whiten(df)
    got = out.collect()
    listed, sums, v, values = check(got, rows, 6)
    # Whitened values are projections: recover a direction from them and test that it is an eigenvector.
    model = W.fit(W.prepared(df, "vec_id", "embedding"), Scratch(spark, "t"))
    assert np.allclose(v @ model.directions, model.directions * values[:4], atol=1e-9 * values[0]) and np.allclose(model.directions.T @ model.directions, np.eye(4))
    x = {i: [math.floor(256 * c) for c in vec] for i, vec, *_ in rows[:400]}
    for row in got:
        if row.id is not None and row.id < 400 and row.id != 7:
            centred = np.array([a - s / model.n for a, s in zip(x[row.id], sums)])
            assert abs(row.whitened - centred @ model.directions[:, row.component - 1] / math.sqrt(values[row.component - 1])) < 1e-8


def test_wide_values_few_directions_and_nothing(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1e12, 1e12), float(i), 3.0], 0, "") for i in range(50)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    # The third dimension is constant: two directions are left, and deviations beyond a long are null.
    assert {x.component for x in got} <= {1, 2} and len(got) >= 50 and all(x.deviation is None or x.deviation < 1 << 63 for x in got) and any(x.deviation is None for x in got)
    same = spark.createDataFrame([(i, [0.5, 0.5], 0, "") for i in range(9)], SCHEMA)
    assert W.whiten(same).count() == 0
    empty = W.whiten(same.limit(0))
    assert empty.count() == 0 and empty.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
