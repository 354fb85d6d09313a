"""Tables changed by commits: what is read, what is written, and writers at the same time."""

import threading

import pytest

from tessella.operators.commits import Change, Conflict, Tables

SCHEMAS = {"documents": "doc_id long, text string", "chunks": "chunk_id string, doc_id long, said string"}


def _docs(spark, *ids, text="t"):
    return spark.createDataFrame([(i, f"{text}{i}") for i in ids], SCHEMAS["documents"])


def _chunks(spark, *ids, n=2, text="t"):
    return spark.createDataFrame([(f"{i}#{j}", i, f"{text}{i}.{j}") for i in ids for j in range(n)], SCHEMAS["chunks"])


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id long")


def _bytes(folder):
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_upserts_deletes_and_what_they_write(spark, tmp_path):
    t = Tables(spark, str(tmp_path), SCHEMAS, buckets=4)
    assert t.read("documents").collect() == [] and t.delete(_ids(spark, 1)) == -1
    many = list(range(2000))
    assert t.upsert({"documents": _docs(spark, *many), "chunks": _chunks(spark, *many)}, _ids(spark, *many)) == 0
    first = _bytes(tmp_path)
    t.upsert({"documents": _docs(spark, 3, 5, text="new"), "chunks": _chunks(spark, 3, 5, n=1, text="new")}, _ids(spark, 3, 5))
    t.delete(_ids(spark, 7, 99999))
    assert _bytes(tmp_path) - first < first / 4
    other = Tables(spark, str(tmp_path), SCHEMAS, buckets=4)
    docs = {r.doc_id: r.text for r in other.read("documents").collect()}
    assert len(docs) == 1999 and docs[3] == "new3" and docs[4] == "t4" and 7 not in docs
    assert sorted(r.said for r in other.read("chunks").where("doc_id IN (3, 7)").collect()) == ["new3.0"]
    assert {r.doc_id for r in other.read("documents", since=0).collect()} == {3, 5} and other.read("documents", at=0).count() == 2000
    # a document deleted and given again counts again
    t.upsert({"documents": _docs(spark, 7, text="again")}, _ids(spark, 7))
    assert [r.text for r in t.read("documents").where("doc_id = 7").collect()] == ["again7"] and t.read("chunks").where("doc_id = 7").isEmpty()
    before = sorted(map(tuple, t.read("documents").collect()))
    assert not t.compacted(most=4) and t.compacted(most=3)
    assert sorted(map(tuple, t.read("documents").collect())) == before and len(t.live()) == 1
    assert t.vacuum() > 0 and sorted(map(tuple, t.read("documents").collect())) == before and t.read("chunks").count() == 2 * 1997 + 2


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = (Tables(spark, str(tmp_path), SCHEMAS) for _ in range(2))
    a.upsert({"documents": _docs(spark, 1)}, _ids(spark, 1))
    turns = []

    def slow(t, head):
        turns.append(head)
        if len(turns) == 1:  # another writer commits while this one works
            b.upsert({"documents": _docs(spark, 2)}, _ids(spark, 2))
        return Change({"documents": _docs(spark, 3, text=f"{t.read('documents').count()}-")}, _ids(spark, 3))

    assert a.commit(slow) == 2 and turns == [0, 1]
    assert sorted(r.text for r in a.read("documents").collect()) == ["2-3", "t1", "t2"]
    with pytest.raises(Conflict):
        a.log.put(2, {"rows": {}})
    threads = [threading.Thread(target=lambda i=i: Tables(spark, str(tmp_path), SCHEMAS).upsert({"documents": _docs(spark, i)}, _ids(spark, i))) for i in range(10, 16)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert {r.doc_id for r in b.read("documents").collect()} == {1, 2, 3, *range(10, 16)}


def test_a_lost_writer_leaves_nothing_to_read(spark, tmp_path):
    t = Tables(spark, str(tmp_path), SCHEMAS)
    t.upsert({"documents": _docs(spark, 1)}, _ids(spark, 1))

    def fails(t, head):
        t._put_rows("documents", _docs(spark, 9), "lost")
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        t.commit(fails)
    assert {r.doc_id for r in t.read("documents").collect()} == {1}
    assert t.vacuum() == 1
