import math
import random

import numpy as np
import pytest

from tideline.llm import whiten


def brute(rows, components=16):
    """Plain Python sums, numpy's eigh."""
    finite = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in finite]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = np.array([[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit) / n**3 for j in range(d)] for i in range(d)])
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1][:components], p[:, ::-1][:, :components]
    out = []
    for i, v in x:
        away = [n * c - t for c, t in zip(v, s)]
        w = np.array([a / n for a in away]) @ p / np.sqrt(e)
        out.append((i, n, sum(a * a for a in away), w))
    return out, e / cov.trace()


def rows(d=20, n=300, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 3
    out = [(i, r.tolist()) for i, r in enumerate(v)]
    out += [(1000 + i, out[7][1]) for i in range(200)] + [(5, None), (6, []), (7, [None] + [0.0] * (d - 1)), (8, [float("nan")] * d), (9, [float("inf")] * d), (None, [0.0] * d), (9, [1.0])]
    return out


def test_rows_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, n int").repartition(7)
    got = whiten.whiten(df).collect()
    want, explained = brute([r for r in data if r[1] is None or len(r[1]) == 20])
    assert len(got) == 16 * len(want)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    sign = {}
    for i, n, deviation, w in want:
        of = sorted(by[i, deviation], key=lambda r: r.component)[:16] if i != 9 else []
        for k, r in enumerate(of):
            assert r.component == k + 1 and r.n == n and r.identity_error < 1e-9 and r.explained == pytest.approx(explained[k], rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(w[k]), abs=1e-6)
            if abs(w[k]) > 1e-3:
                assert sign.setdefault(k, np.sign(w[k]) * np.sign(r.whitened)) == np.sign(w[k]) * np.sign(r.whitened)


def test_planes_give_exact_products():
    rng = random.Random(1)
    for bits in (1, 7, 20, 33, 57):
        x = np.array([[rng.getrandbits(bits) for _ in range(5)] for _ in range(130)], np.uint64)
        want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(5)] for i in range(5)]
        assert whiten.cross_products(x).tolist() == want
    x = np.array([[rng.randint(-(1 << 61), 1 << 61) for _ in range(4)] for _ in range(100)], np.int64)
    n, s, q = whiten.partial_sums(iter([x[:30], x[30:]]), 4)
    assert n == 100 and s.tolist() == [sum(int(r[i]) for r in x) for i in range(4)]
    assert q.tolist() == [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(4)] for i in range(4)]


def test_sums_of_all_partitions_are_exact(spark):
    rng = random.Random(2)
    x = [[rng.randint(-(1 << 58), 1 << 58), rng.randint(0, 3), -5] for _ in range(200)]
    n, s, q = whiten.sums(spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(9))
    assert n == 200 and s.tolist() == [sum(r[i] for r in x) for i in range(3)] and q.tolist() == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]


def test_values_far_apart_are_refined():
    rng = np.random.default_rng(4)
    p = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    e = np.array([1, 1, 1e-3, 1e-6, 1e-9, 1e-11])
    v = (p.astype(np.longdouble) * e) @ p.T
    got, x = whiten.eigen((v + v.T) / 2)
    assert np.allclose(got.astype(float) / e, 1, atol=1e-5) and np.abs((x.T @ x - np.eye(6)).astype(float)).max() < 1e-15


def test_wide_values_and_too_few_vectors(spark):
    make = lambda data: spark.createDataFrame(data, "vec_id long, embedding array<double>")
    wide = [(i, [float(x), float(i)]) for i, x in enumerate((1e15, -1e15, 3.0, 2e13, 0.25))]
    got = whiten.whiten(make(wide)).collect()
    assert {r.deviation for r in got} == {None} and len(got) in (5, 10) and got[0].identity_error < 1e-4
    assert whiten.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten.whiten(make([(1, None)])).count() == 0 and whiten.whiten(make([]).limit(0)).count() == 0
    flat = whiten.whiten(make([(i, [float(i), 5.0, 2.0 * i]) for i in range(4)])).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)
