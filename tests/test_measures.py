import math
import random

from pyspark.sql import functions as F

from tideline.operators import histograms
from tideline.operators.deltas import deltas

POINT = "k string, scale int, count long, sum double, min double, max double, zero long, positive struct<offset: int, counts: array<long>>, negative struct<offset: int, counts: array<long>>"


def histogram(values, scale):
    """The buckets of values at a scale: indexes below and above zero, and zeros."""
    sides = {1: {}, -1: {}}
    for v in values:
        if v:
            i = math.ceil(math.log2(abs(v)) * 2**scale) - 1
            side = sides[1 if v > 0 else -1]
            side[i] = side.get(i, 0) + 1
    dense = lambda c: (min(c), [c.get(i, 0) for i in range(min(c), max(c) + 1)]) if c else (0, [])
    return len(values), float(sum(values)), min(values), max(values), values.count(0.0), dense(sides[1]), dense(sides[-1])


def test_merged_quantiles_lie_within_a_bucket_of_exact_ones(spark):
    rng = random.Random(5)
    parts = {k: [[rng.choice([0.0, rng.lognormvariate(2, 2), -rng.lognormvariate(1, 1)]) if k == "mixed" else rng.lognormvariate(3, 1) for _ in range(rng.randint(1, 400))] for _ in range(6)] for k in ("mixed", "above")}
    rows = [(k, scale, *histogram(values, scale)) for k, of in parts.items() for scale, values in zip((3, 5, 2, 4, 3, 5), of)] + [(None, 1, 1, 1.0, 1.0, 1.0, 1, None, None), ("mixed", None, 1, 1.0, 1.0, 1.0, 1, None, None)]
    df = spark.createDataFrame(rows, POINT)
    merged = histograms.merge(df, "k")
    assert {r.scale for r in merged.collect()} == {2}
    everything = {k: sorted(v for values in of for v in values) for k, of in parts.items()}
    assert {r.k: (r.points, r["count"]) for r in histograms.totals(df, "k").collect()} == {k: (6, len(v)) for k, v in everything.items()}
    assert {r.k: r.n for r in merged.groupBy("k").agg(F.sum("n").alias("n")).collect()} == {k: len(v) for k, v in everything.items()}
    qs = (0.0, 0.01, 0.3, 0.5, 0.75, 0.99, 1.0)
    found = histograms.quantiles(merged, qs, "k").collect()
    assert len(found) == 2 * len(qs)
    for r in found:
        exact = everything[r.k][max(0, math.ceil(r.q * len(everything[r.k])) - 1)]
        assert r.lower - 1e-9 <= exact <= r.upper + 1e-9 and r.lower - 1e-9 <= r.value <= r.upper + 1e-9
        # the bound of the error: one bucket of the coarsest scale
        assert exact == 0 or abs(r.value - exact) <= abs(exact) * (2 ** (2**-2) - 1) * 1.0001


def test_buckets_below_one_and_far_scales(spark):
    rows = [("k", 20, 3, 1.0, 0.1, 9.0, None, (-5, [1, 0, 2]), None), ("k", -10, 1, 1.0, 1.0, 1.0, 0, (-1, [1, None]), (0, []))]
    got = {(r.scale, r.sign, r.bucket): r.n for r in histograms.merge(spark.createDataFrame(rows, POINT), "k").collect()}
    assert got == {(-10, 1, -1): 4}
    empty = spark.createDataFrame(rows, POINT).limit(0)
    assert histograms.merge(empty, "k").count() == 0 and histograms.quantiles(histograms.merge(empty, "k"), (0.5,), "k").count() == 0


def brute(points):
    out, by = [], {}
    for s, at, start, value in points:
        if None not in (s, at, value):
            by.setdefault(s, {}).setdefault(at, []).append((value, -1 if start in (None, 0) else start))
    for s, times in by.items():
        before = None
        for at in sorted(times):
            value, start = max(times[at])
            start = None if start == -1 else start
            if before is None:
                out.append((s, at, value if start is not None else None, "first", start))
            elif start is not None and before[2] is not None and start > before[2]:
                out.append((s, at, value, "restart", start))
            elif value < before[1]:
                out.append((s, at, value, "reset", max(start, before[0]) if start is not None else before[0]))
            else:
                out.append((s, at, value - before[1], "growth", before[0]))
            before = at, value, start
    return sorted(out, key=repr)


def test_deltas_equal_brute_force_over_ranges(spark):
    rng = random.Random(6)
    points = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(500)]), rng.choice([None, 0, 5, 100, 200]), rng.choice([None, *range(30)])) for _ in range(900)]
    df = spark.createDataFrame(points + points[:50], "series string, at long, start long, value long")
    for width in (7, 100, 10**9):
        assert sorted(map(tuple, deltas(df, width).collect()), key=repr) == brute(points)
    assert deltas(df.limit(0)).count() == 0


def test_audit_finds_every_difference_of_multisets(spark):
    from collections import Counter

    from tideline.operators import audit

    rng = random.Random(8)
    left = [(rng.choice(["a", "b", None]), rng.randint(1, 3), rng.choice([None, "", "x", "y", f"line {i}"])) for i in range(500)] + [("a", 1, "hot")] * 3000 + [("same", 1, f"s{i}") for i in range(50)]
    right = list(left)
    rng.shuffle(right)
    df = lambda rows: spark.createDataFrame([(p, d, v, i) for i, (p, d, v) in enumerate(rows)], "p string, d int, value string, i int")
    assert audit.differing(df(left), df(right), "p", "d").count() == 0 and audit.differences(df(left), df(right), "p", "d").count() == 0
    # one lost, one doubled, two that change places, a partition of its own on either side
    right.remove(("a", 1, "hot"))
    right += [right[5], ("new", 9, "z"), ("new", 9, "z")]
    left += [("old", 4, None)]
    lost = [r for r in right if r[0] == "b"][:2]
    for p, d, v in lost:
        right.remove((p, d, v))
        right.append((p, d, f"{v}!"))
    want = Counter(left)
    want.subtract(Counter(right))
    got = {(r.p, r.d, r.value): r.n for r in audit.differences(df(left), df(right), "p", "d").collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert not any(r.p == "same" for r in audit.differing(df(left), df(right), "p", "d").collect())


def test_top_k_equals_row_number_and_orders_candidates_only(spark):
    from tideline.operators import topk

    rng = random.Random(9)
    values = [None, 0.0, -0.0, -1.5, 1.5, 1e300, -1e300, 1e-300, -1e-300, float("inf"), float("-inf"), float("nan"), 3.0, 3.0000001]
    rows = [(rng.choice(["a", "b", None]), rng.choice([*values, rng.uniform(-50, 50)]), i) for i in range(400)] + [("hot", float(i % 1000), i) for i in range(20_000)] + [("ties", 7.0, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(6)
    for k in (1, 5, 60):
        got = topk.top_k(df, k, "v", "id", "g")
        from pyspark.sql.window import Window

        want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc_nulls_last("v"), "id"))).filter(F.col("rank") <= k)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.columns == ["g", "v", "id", "rank"]
    bound = {r.g: r._bound for r in topk.bounds(df, 5, "v", "g").collect()}
    left = df.filter(F.col("g") == "hot").filter(topk.cell(F.col("v")) >= bound["hot"]).count()
    assert left < 500
    assert topk.top_k(df.limit(0), 3, "v", "id", "g").count() == 0
