"""Hashed embeddings, diversity reranking and context packing against plain loops."""

import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import rerank


def test_hashed_embedding(spark):
    texts = ["Costs of the river barges and barges", "", None, "alpha"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = rows.select("i", T.terms(F.col("x")).alias("t"), rerank.hashed_embedding(F.col("x"), 64).alias("v")).orderBy("i").collect()
    for _, terms, vector in got:
        want = np.zeros(64)
        for f in [*(terms or []), *(a + "_" + b for a, b in itertools.pairwise(terms or []))]:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
            want[h % 64] += 1 if h >> 63 else -1
        want = np.sign(want) * np.log1p(abs(want))
        assert np.allclose(vector, want / (np.linalg.norm(want) or 1), atol=1e-6)
    assert sum(got[1][2]) == 0 and any(got[3][2])


def test_mmr(spark):
    q, v = [1.0, 0.0], {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.6, 0.8], 4: [0.0, 1.0]}
    rows = [(7, k, r, q, x) for r, (k, x) in enumerate(v.items(), 1)] + [(8, 9, 1, q, [0.5, 0.5])]
    got = rerank.mmr(spark.createDataFrame(rows, "query_id long, vec_id long, rank int, q_vec array<double>, embedding array<double>"), k=2, trade=0.3)
    out = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in got.collect()}
    # second: 2 has 0.3 - 0.7, 3 has 0.18 - 0.42, 4 has 0 - 0
    assert out == {(7, 1): (1, 0.3), (7, 2): (4, 0.0), (7, 3): (2, 1.0), (7, 4): (3, 0.6), (8, 1): (9, 0.5)}


def test_context_pack(spark):
    rng, rows = random.Random(1), []
    for query in range(30):
        rows += [(query, 100 + r, r, rng.choice(["", " "]) + " ".join(["w"] * rng.choice([1, 3, 9, 30]))) for r in range(1, 12)]
    got = rerank.packed_context(spark.createDataFrame(rows, "query_id long, doc_id long, rank int, text string"), 40).collect()
    want = set()
    for query in range(30):
        room, seen, label = 40, set(), 0
        for _, doc, _, text in [r for r in rows if r[0] == query]:
            cost = len(text.split()) + 12
            if text.strip() not in seen and (not label or cost <= room):
                room, label = room - cost, label + 1
                seen.add(text.strip())
                want.add((query, doc, cost, label))
    assert {(r.query_id, r.doc_id, r.cost, r.label) for r in got} == want


def test_filter_and_citation(spark):
    ranked = spark.createDataFrame([(1, "superseded"), (2, None), (3, "current")], "rank int, status string")
    assert [r.rank for r in rerank.current_only(ranked).orderBy("rank").collect()] == [2, 3]
    rows = spark.createDataFrame([(1, "It is so.  "), (2, "Is it ?"), (3, "bare"), (4, "")], "i int, x string")
    assert [r[0] for r in rows.orderBy("i").select(rerank.cited(F.col("x"), F.col("i"))).collect()] == ["It is so [S1].", "Is it [S2]?", "bare [S3].", " [S4]."]
