"""Workers hold a few rows' work at a time, however long a batch is."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella import config
from tessella.functions import analysis
from tessella.operators import chunking
from tessella.operators.embedding import Hashing, embed, embedded
from tessella.operators.vectors import VectorIndex

PARTS = ["Wörd alpha running.", "the of", "Σίσυφος x1 É.", "— 42", "tests of words", "alpha"] * 60


class Few(Hashing):
    def vectors(self, texts):
        if len(texts) > 256:
            raise ValueError("too many texts at a time")
        return super().vectors(texts)


def test_embedding_by_slices(spark):
    texts = [f"word{i} alpha" if i % 7 else None for i in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1)
    got = [r.v for r in rows.select("i", embedded(F.col("x"), Few(16)).alias("v")).orderBy("i").collect()]
    assert np.allclose(got, embed(Hashing(16), [t or "" for t in texts]), atol=1e-7)


def test_windows_analyse_a_sentence_once(monkeypatch):
    for bigrams in (True, False):
        e = Hashing(32, bigrams)
        joined = embed(e, [" ".join(PARTS[max(0, i - 1) : i + 2]) for i in range(len(PARTS))])
        assert np.array_equal(e.windows(PARTS), joined) and len(e.windows([])) == 0
    seen, terms = [], analysis.terms
    monkeypatch.setattr(analysis, "terms", lambda t: seen.append(t) or terms(t))
    text = " ".join(f"Sentence {i} stands here." for i in range(30))
    chunking.semantic(chunking.Cutter(text), [], config.Chunking(strategy="semantic"), Hashing(32))
    assert len(" ".join(seen)) <= len(text)


def test_a_scan_hands_on_what_it_cannot_spare():
    rng = np.random.default_rng(1)
    index = VectorIndex("", "k", rng.normal(size=(1, 4)), rng.normal(size=(1, 256, 4)), 1, 1.0, {0: 9_000}, 1.0)
    q = rng.normal(size=(100, 4))
    batch = pd.DataFrame({"cell": np.zeros(9_000, np.int32), "key": np.arange(9_000), "code": [bytes([i % 256]) for i in range(9_000)]})
    got = list(index._scan({0: np.arange(100)}, q, 9_000)(iter([batch])))
    assert max(map(len, got)) < 700_000 and len(pd.concat(got).drop_duplicates(["row", "key"])) == 900_000
