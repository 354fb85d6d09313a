"""Nearest neighbours against plain cosines."""

import numpy as np
import pytest

from tessella.llm import ann

SCHEMA = "vec_id long, embedding array<{kind}>, id string, vec int, cell string"


def brute(rows, dim, divisor=50, k=5):
    """{query: [(vec, score)]} of the usable rows; rows that share an id count by their best score."""
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, a in good:
        if q % divisor:
            continue
        best = dict(out.get(q, []))
        for i, b in good:
            if i != q:
                s = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
                best[i] = max(s, best.get(i, -2))
        out[q] = list(best.items())
    return {q: sorted(best, key=lambda p: (-round(p[1], 12), p[0]))[:k] for q, best in out.items()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    if kind == "float":
        x = x.astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, []), (5200, [1.0]), (5250, [None] * 16), (None, x[3].tolist()), (50, x[50].tolist()), (700, x[701].tolist())]
    df = spark.createDataFrame([(i, v, "a", 1, "c") for i, v in rows], SCHEMA.format(kind=kind)).repartition(7)
    got = {}
    for r in ann.search(df, lambda i: i % 50 == 0, crowd=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 16)
    assert set(got) == set(want)
    found = right = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, len(mine) + 1)) and len(mine) == 5 and q not in [v for _, v, _ in mine]
        score = dict(brute(rows, 16, k=10**6).get(q)) if q in (50, 700) else None
        for _, v, s in mine:
            if score:
                assert abs(score[v] - s) < 1e-12
        right += len({v for _, v, _ in mine} & {v for v, _ in best})
        found += 5
    assert right >= 0.9 * found
    assert [v for _, v, _ in sorted(got[150])] == [100, 101, 102, 103, 104]


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (50, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, lambda i: i % 50 == 0, tables=1, probes=1, block=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 50), (50, 2), (50, 1), (50, 0)]
    assert ann.search(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>"), lambda i: i % 50 == 0).count() == 0


def test_perturbations_come_by_expected_cost():
    sets = ann.perturbations(8, 70)
    assert len(sets) == len(set(sets)) == 70 and sets[0] == () and sets[1] == (0,)
    assert all(len(s) == len(set(s)) and not any(15 - x in s for x in s) for s in sets)
