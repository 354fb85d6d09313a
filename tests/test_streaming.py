"""Streams against batches: incremental ingestion and windows."""

import datetime

from tessella.streaming import ingest, log


def test_ingestion_goes_on_and_skips(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "collection")
    schema = "doc_id long, hash string, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    take = lambda: {r.doc_id: r.text for r in ingest.into(spark.readStream.schema(schema).parquet(source), folder).collect()}
    put([(1, "a", "one"), (2, "b", "two"), (2, "c", "two again")])
    assert take() == {1: "one", 2: "two again"}
    put([(1, "a", "same hash"), (3, "d", "three"), (2, "e", "two anew")])
    assert take() == {1: "one", 2: "two anew", 3: "three"}
    assert take() == {1: "one", 2: "two anew", 3: "three"}


def test_late_repeated_and_unordered_versions(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "collection")
    schema = "doc_id long, hash string, text string, at timestamp"
    day = lambda d: datetime.datetime(2026, 1, d)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    take = lambda: {r.doc_id: (r.text, r.at and r.at.day) for r in ingest.into(spark.readStream.schema(schema).parquet(source), folder, order="at").collect()}
    put([(1, "z", "first", day(5)), (1, "a", "last", day(6)), (2, "b", "two", None), (None, "x", "lost", day(1)), (3, None, "no hash", day(2))])
    assert take() == {1: ("last", 6), 2: ("two", None), 3: ("no hash", 2)}
    put([(1, "y", "late", day(3)), (2, "c", "two dated", day(1))])
    put([(1, "a", "last", day(6)), (3, None, "no hash", day(2))])
    assert take() == {1: ("last", 6), 2: ("two dated", 1), 3: ("no hash", 2)}
    # a restart gives the last batch again, and another writer has been at work
    held = ingest.tables(spark, f"{folder}/tables", schema)
    other = spark.createDataFrame([(4, "d", "another's", day(9))], schema)
    held.commit(lambda t, head: ingest.Change({"rows": other}, other.select("doc_id"), t.note()))
    number, head = held.note()["batch"], held.log.head()
    assert ingest.upsert_batch(spark.createDataFrame([(1, "w", "again", day(9))], schema), held, number, order="at") == head
    put([(4, "e", "newer", day(10)), (1, "v", "newest", day(7))])
    assert take() == {1: ("newest", 7), 2: ("two dated", 1), 3: ("no hash", 2), 4: ("newer", 10)}
    assert held.log.head() == head + 1


def test_windows_of_a_log(spark, tmp_path):
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    rows = [(at(1), "a", 1.0), (at(9), "a", 3.0), (at(12), "a", 5.0), (at(3), "b", None), (None, "b", 9.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string, v double")
    want = {("a", 0, 2, 2.0), ("a", 10, 1, 5.0), ("b", 0, 1, None)}
    read = lambda out: {(r.kind, r.start.minute, r.n, r["mean"]) for r in out.collect()}
    assert read(log.windowed(df, "ts", "kind", "v")) == want
    df.write.parquet(str(tmp_path / "in"))
    stream = log.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "kind", "v")
    assert read(log.kept(stream, str(tmp_path / "out"))) == want
