"""The index in segments against one built anew."""

import random

from pyspark.sql import functions as F

from tessella.operators import retrieval
from tessella.operators.segments import Segments

WORDS = [f"word{i}" for i in range(60)] + ["alpha", "beta", "gamma"]


def _texts(rng, ids):
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return {i: " ".join(rng.choices(WORDS, weights, k=rng.choice([0, 3, 20, 120]))) if rng.random() > 0.03 else None for i in ids}


def _same(spark, index, texts, questions):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    plain = retrieval.Index.of(retrieval.counted(docs, "doc_id", "text"), "doc_id")
    n, avgdl = index.state()
    stats = plain.stats.first()
    assert n == stats.n and abs(avgdl - stats.avgdl) < 1e-9
    rows = lambda found: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in found.collect())
    for k in (1, 7):
        assert rows(index.search(questions, k)) == rows(plain.search(questions, k))
    asked = spark.createDataFrame([(1, w) for w in ("word0", "word40", "nothing")], "query_id long, term string")
    rows = lambda found: sorted((r.term, r.df, round(r.idf, 9)) for r in found.collect())
    assert rows(index.weights(asked)) == rows(plain.weights(asked))


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(9)
    frame = lambda texts: spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    questions = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate([1, 2, 3, 6, 15, 40])] + [(98, ""), (99, "nothing here")], "query_id long, question string")
    index, texts = Segments(spark, str(tmp_path)), _texts(rng, range(400))
    index.upsert(frame(texts))
    _same(spark, index, texts, questions)
    files = {p for p in tmp_path.rglob("*.parquet")}
    size = sum(p.stat().st_size for p in files)
    new = _texts(rng, [3, 5, 77, 500, 501])
    index.upsert(frame(new))
    texts |= new
    index.delete(spark.createDataFrame([(8,), (77,), (12345,)], "doc_id long"))
    texts = {i: t for i, t in texts.items() if i not in (8, 77)}
    # what was there stays, and what is new is small
    assert files < {p for p in tmp_path.rglob("*.parquet")} and sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) - size < 0.6 * size
    index.upsert(frame({8: "alpha beta again"}))
    texts[8] = "alpha beta again"
    _same(spark, Segments(spark, str(tmp_path)), texts, questions)
    assert not index.merged() and index.merged(most=2)
    _same(spark, index, texts, questions)
    more = _texts(rng, range(1000, 1450))
    index.upsert(frame(more))
    texts |= more
    assert index.merged() and len(index.tables.live()) == 1
    _same(spark, index, texts, questions)


def test_few_postings_of_frequent_terms_are_read(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    docs, questions = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS question")
    index = Segments(spark, str(tmp_path))
    index.upsert(docs)
    read = index.read_shares(questions).first()
    assert read.got_frequent < read.every_frequent / 3 and read.got < read.every / 3


def test_empty_index(spark, tmp_path):
    index = Segments(spark, str(tmp_path))
    questions = spark.createDataFrame([(1, "alpha")], "query_id long, question string")
    assert index.search(questions).collect() == [] and index.state() == (0, 1.0)
    index.upsert(spark.createDataFrame([], "doc_id long, text string"))
    assert index.search(questions).collect() == [] and index.delete(spark.createDataFrame([(1,)], "doc_id long")) == 1


def test_blocks_are_made_where_the_bags_lie(spark, tmp_path):
    rng = random.Random(4)
    texts = {i: t or "" for i, t in _texts(rng, range(700)).items()}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    bags = {r.doc_id: ({t.term: t.tf for t in r.terms}, r.dl) for r in retrieval.counted(docs, "doc_id", "text").collect()}
    index = Segments(spark, str(tmp_path))
    index.upsert(docs)
    rows = index.blocks().withColumn("file", F.input_file_name()).collect()
    # a block is in one file, whatever its terms
    assert len({r.block for r in rows}) == len({(r.block, r.file) for r in rows}) >= 700 // 64
    assert len({(r.term, r.block) for r in rows}) == len(rows)
    keys = {r.block: r["keys"] for r in index.texts().collect()}
    assert sorted(k for ks in keys.values() for k in ks) == sorted(texts)
    assert sorted((keys[r.block][a], r.term, tf, dl) for r in rows for a, tf, dl in zip(r.at, r.tf, r.dl)) == sorted((k, t, tf, dl) for k, (terms, dl) in bags.items() for t, tf in terms.items())
    for r in rows:
        assert r.n == len(r.at) == len(r.tf)
        for s in range(16):
            mine = [i for i, a in enumerate(r.at) if a // 4 == s]
            assert (r.most_tf[s], r.least_dl[s]) == ((max(r.tf[i] for i in mine), min(r.dl[i] for i in mine)) if mine else (0, 0))
