"""The stored vector index against exact search."""

import numpy as np

from tessella import config
from tessella.operators import retrieval
from tessella.operators.embedding import Hashing
from tessella.operators.embedding_cache import StoredCache
from tessella.operators.vectors import VectorIndex, units

SF = "/root/testdata/sf0.1"


def _recall(got, want):
    g, w = ({(r.query_id, r.vec_id) for r in rows} for rows in (got.collect(), want.collect()))
    return len(g & w) / len(w)


def test_recall_and_share_on_even_vectors(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    questions = vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS q_vec")
    index = VectorIndex.build(vectors, f"{tmp_path}/index")
    found = index.search(questions)
    assert _recall(found, retrieval.dense(vectors, questions)) >= 0.9
    # these vectors are spread evenly, so many cells are visited; what is read of them are codes
    assert index.read["whole"] < 0.1 and index.read["bytes"] < 0.1
    again = VectorIndex.open(spark, index.path)
    assert (again.probes, again.share, again.counts, again.size) == (index.probes, index.share, index.counts, vectors.count())
    assert sorted(map(tuple, again.search(questions).collect())) == sorted(map(tuple, found.collect()))
    # all cells and all candidates: the exact search
    assert _recall(index.search(questions, probes=10**6, share=1.0), retrieval.dense(vectors, questions)) == 1.0


def _made(rng, n, centres):
    x = units(centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, centres.shape[1])))
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]


def test_clustered_vectors_need_few_cells_and_growth_is_told(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 30))
    rows = _made(rng, 4000, centres)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(vectors, f"{tmp_path}/a", sample=1500)
    questions = vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS q_vec")
    assert _recall(index.search(questions), retrieval.dense(vectors, questions)) >= 0.9
    assert index.read["coded"] < 0.1
    before = {p.name for p in (tmp_path / "a" / "vectors").rglob("*.parquet")}
    more = spark.createDataFrame([(i + 10_000, v) for i, v in _made(rng, 300, centres)], "vec_id long, embedding array<double>")
    grown = index.with_added(more)
    assert before < {p.name for p in (tmp_path / "a" / "vectors").rglob("*.parquet")} and grown.size == 4300 and not grown.drifted
    every = vectors.union(more)
    assert _recall(grown.search(questions), retrieval.dense(every, questions)) >= 0.9
    odd = spark.createDataFrame([(i + 20_000, v) for i, v in _made(rng, 300, rng.normal(size=(300, 30)))], "vec_id long, embedding array<double>")
    drifted = grown.with_added(odd)
    assert drifted.drifted
    new = drifted.refitted(spark, f"{tmp_path}/b", sample=1500)
    assert new.size == 4600 and not new.drifted
    assert _recall(new.search(questions), retrieval.dense(every.union(odd), questions)) >= 0.9


def test_odd_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [(i, [float(i + 1), 1.0, -1.0]) for i in range(30)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0]), (103, [1.0]), (104, []), (105, [1e200, 1e200, 0.0]), (106, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(vectors, f"{tmp_path}/index")
    questions = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0])], "query_id long, q_vec array<double>")
    got = index.search(questions, k=50).collect()
    assert {r.query_id for r in got} == {1} and len(got) == 31
    assert got[0].vec_id == 105 and np.isclose(got[0].score, 1.0)
    assert index.search(questions.where("query_id = 2")).collect() == []


def test_the_retriever_takes_the_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = _made(rng, 500, rng.normal(size=(10, 16)))
    chunks = spark.createDataFrame([(i, f"text {i}", v) for i, v in rows], "chunk_id long, text string, embedding array<double>")
    index = VectorIndex.build(chunks, f"{tmp_path}/index", "chunk_id")
    asked = spark.createDataFrame([(i, 0, "q", True, False, rows[i][1]) for i in range(0, 500, 50)], "query_id long, variant_no int, question string, dense boolean, lexical boolean, q_vec array<double>")
    cfg = config.Retrieval(mode="dense")
    got, want = (retrieval.retrieved(asked, chunks.drop("embedding"), cfg, vectors=v, key="chunk_id").collect() for v in (index, chunks.select("chunk_id", "embedding")))
    pairs = lambda found: {(r.query_id, r.chunk_id) for r in found}
    assert len(pairs(got) & pairs(want)) / len(want) >= 0.9


def test_a_stored_cache_embeds_once(spark, tmp_path):
    class Counting(Hashing):
        def vectors(self, texts):
            with open(f"{tmp_path}/asked", "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return super().vectors(texts)

    frame = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    cache = StoredCache(spark, f"{tmp_path}/cache", Counting(16))
    assert tuple(cache.counts(frame("one", "one", "two", None)).first()) == (0, 3, 2)
    got = {r.id: r.embedding for r in cache.embed(frame("one", "one", "two", None)).collect()}
    assert got[0] == got[1] != got[2] and got[3] is None
    other = StoredCache(spark, f"{tmp_path}/cache", Counting(16))
    assert tuple(other.counts(frame("one", "three", "three")).first()) == (1, 2, 1)
    head = other.fill(frame("one", "three", "three"))
    assert other.fill(frame("two", "three", None)) == head
    assert sorted(open(f"{tmp_path}/asked").read().split()) == ["one", "three", "two"]


def test_usage_adds_up(spark):
    asked = spark.createDataFrame([(1, "a b c", True), (1, "d e", True), (2, "a b", False), (3, None, True)], "query_id long, question string, dense boolean")
    one = retrieval.usage(asked, {"m": (2.0, 0.0)}, "m")
    assert {r.query_id: tuple(r)[1:] for r in one.collect()} == {1: (1, 5, 0, 1e-5), 2: (0, 0, 0, 0.0), 3: (1, 0, 0, 0.0)}
    assert {r.query_id: (r.calls, r.tokens_in) for r in retrieval.summed_usage(one, one).collect()} == {1: (2, 10), 2: (0, 0), 3: (2, 0)}
