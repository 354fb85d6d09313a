"""Joins and statistics over an order against plain loops, with groups over many ranges and blocks."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import evaluation, ordered


def test_as_of(spark):
    rng = random.Random(1)
    left = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, rng.randint(0, 300)]), i) for i in range(300)] + [("hot", 5, -1)] * 2
    right = [(rng.choice(["hot", "a", None, "b"]), rng.choice([None, rng.randint(0, 300)]), rng.randint(0, 5), ["p", str(i)]) for i in range(120)]
    got = ordered.as_of(spark.createDataFrame(left, "g string, at long, id int"), spark.createDataFrame(right, "g string, start int, size int, path array<string>"), ["g"], "at", "start", ["start", "size", "path"])
    want = []
    for g, at, i in left:
        before = [(s, size, path) for h, s, size, path in right if h == g and s is not None and at is not None and s <= at]
        want.append((g, at, i, *(max(before) if before else (None, None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_overlaps_meet_once(spark):
    rng = random.Random(2)

    def made(n):
        starts = [(rng.choice(["x", "x", "y", None]), rng.randint(-50, 500)) for _ in range(n)]
        return [(g, s, s + rng.choice([0, 1, 7, 40, 300]), i) for i, (g, s) in enumerate(starts)]

    left, right = made(120), made(90) + [("x", None, 5, 1000)]
    schema = "g string, start long, stop long, id int"
    got = ordered.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"], width=16).select("l.id", "r.id").collect()
    want = [(a[3], b[3]) for a in left for b in right if a[0] == b[0] and a[0] and b[1] is not None and max(a[1], b[1]) < min(a[2], b[2])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_quantiles_of_a_hot_group(spark):
    rng = random.Random(3)
    values = {"hot": [rng.choice([1.5, 1.5, 2.0, rng.random() * 9, None]) for _ in range(800)], "one": [4.0], "none": [None, None], None: [3.0, 1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r.g: r for r in ordered.quantiles(df, "g", "v", [0.0, 0.37, 0.5, 0.95, 1.0]).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        vs = [v for v in vs if v is not None]
        assert got[g].n == len(vs)
        assert got[g].q == [None] * 5 if not vs else np.allclose(got[g].q, np.quantile(vs, [0.0, 0.37, 0.5, 0.95, 1.0]))


def test_sliding_percentiles(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "b"]), rng.choice([None, 1.0, 2.0, rng.random() * 5]), rng.randint(0, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v double, at int")
    for last, block, group in ((1, 7, None), (20, 16, "g"), (50, 8192, None), (30, 5, "g")):
        got = {r.id: r.p for r in ordered.sliding_percentile(df, "id", "v", ["at", "id"], last, 0.9, "p", group, block).collect()}
        assert len(got) == len(rows)
        for g in ("a", "b") if group else (None,):
            mine = sorted((r for r in rows if g is None or r[1] == g), key=lambda r: (r[3], r[0]))
            for i, r in enumerate(mine):
                held = sorted(x[2] for x in mine[max(0, i - last + 1) : i + 1] if x[2] is not None)
                assert got[r[0]] == (held[round(0.9 * (len(held) - 1))] if held else None)


def test_holm_of_one_group_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [("g", i, rng.choice([0.01, 0.02, rng.random()])) for i in range(300)] + [("h", 1, 0.5), (None, 1, 0.2), (None, 2, 0.9)]
    got = {(r.g, r.test): r.adjusted for r in evaluation.holm(spark.createDataFrame(rows, "g string, test int, p double"), "g").collect()}
    for g in ("g", "h", None):
        most, mine = 0.0, sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(mine):
            most = max(most, min(1.0, (len(mine) - i) * r[2]))
            assert math.isclose(got[g, r[1]], most)


def test_resamples_of_exactly_n(spark):
    rng = np.random.default_rng(6)
    v = rng.gamma(2.0, 3.0, 900)
    rows = [("big", i, float(x)) for i, x in enumerate(v)] + [("flat", i, 2.0) for i in range(5)] + [("one", 1, 7.0), ("none", 1, None)] + [("ones", i, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    got = {r.g: r for r in evaluation.resampled_ci(df, "g", "v", "i", 800, rows=100).collect()}
    assert set(got) == {"big", "flat", "one", "ones"} and (got["flat"].low, got["flat"].high, got["one"].low) == (2.0, 2.0, 7.0)
    means = np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(4000)])
    sd = means.std()
    assert abs(got["big"].low - np.quantile(means, 0.025)) < 0.35 * sd and abs(got["big"].high - np.quantile(means, 0.975)) < 0.35 * sd
    # of 40 draws of 0 and 1 every mean is a fortieth
    assert all(abs(x * 40 - round(x * 40)) < 0.06 for x in (got["ones"].low, got["ones"].high))
    again = {r.g: r for r in evaluation.resampled_ci(df.repartition(7), "g", "v", "i", 800, rows=100).collect()}
    assert all(math.isclose(again[g].low, got[g].low) and math.isclose(again[g].high, got[g].high) for g in got)
    a_b = df.withColumn("w", F.col("v") - 1.0)
    diff = {r.g: r for r in evaluation.paired_bootstrap(a_b, "g", "v", "w", "i", resamples=50).collect()}
    assert math.isclose(diff["big"].diff, 1.0)
