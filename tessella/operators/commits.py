"""Tables that change by small commits: a log of numbered entries, data files by hash bucket, and deletion records read with the data.

A folder has ``log/<n>``, an entry of each commit, and data folders that entries name. An entry is put in place by one rename that fails where
it is there already, so of two writers that have seen the same head one must look again; no commit is lost, and a reader sees whole commits only.
(The rename is atomic on file systems that have one, as HDFS does; an object store needs one writer at a time.)

A commit writes the new rows and the keys that it replaces, nothing else: a row counts unless a later commit names its key. ``compacted`` writes
the rows that count anew, once the records to be read beside them are many.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQ = "_seq"


class Conflict(RuntimeError):
    """Another commit took the number."""


class Log:
    """Numbered JSON entries in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: dict[int, dict] = {}

    def numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/log")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def entries(self) -> dict[int, dict]:
        """All entries by number; those met before are not read again."""
        for n in self.numbers():
            if n not in self._known:
                stream = self._fs.open(self._path(f"{self.folder}/log/{n:012d}"))
                try:
                    text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                self._known[n] = json.loads(text)
        return dict(sorted(self._known.items()))

    def head(self) -> int:
        """The last number, -1 without any."""
        return max(self.numbers(), default=-1)

    def put(self, n: int, entry: Mapping) -> None:
        """Conflict if there is an entry of this number."""
        waiting, at = self._path(f"{self.folder}/log/_{uuid.uuid4().hex}"), self._path(f"{self.folder}/log/{n:012d}")
        stream = self._fs.create(waiting, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(waiting, at, none)
        except Exception as e:
            self._fs.delete(waiting, False)
            if self._fs.exists(at):
                raise Conflict(f"commit {n} is there already") from e
            raise


@dataclass
class Change:
    """What a commit does: rows to add by table, and keys (one column) whose rows of before are gone."""

    rows: Mapping[str, DataFrame]
    gone: DataFrame | None = None
    note: Mapping | None = None


class Tables:
    """Tables of one key in a folder, changed by commits. schemas: DDL of each; every table has the key column. buckets: 0 leaves rows in the tasks that they come from."""

    def __init__(self, spark: SparkSession, folder: str, schemas: Mapping[str, str], key: str = "doc_id", buckets: int = 4) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schemas = {name: spark.createDataFrame([], s).schema for name, s in schemas.items()}
        self.log = Log(spark, folder)

    def live(self) -> dict[int, dict]:
        """Entries that count: a compaction stands for all before it."""
        entries = self.log.entries()
        since = max((n for n, e in entries.items() if e.get("whole")), default=0)
        return {n: e for n, e in entries.items() if n >= since}

    def note(self) -> dict:
        """That of the last commit."""
        entries = self.log.entries()
        return dict(entries[max(entries)].get("note", {})) if entries else {}

    def read(self, name: str, since: int = -1, at: int | None = None) -> DataFrame:
        """Rows that count. since: only rows of later commits; at: as of a commit, if no compaction has come after it."""
        entries = {n: e for n, e in self.live().items() if at is None or n <= at}
        columns = self.schemas[name].names
        parts = [self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{e['rows'][name]}").select(columns).withColumn(SEQ, F.lit(n)) for n, e in entries.items() if name in e["rows"] and n > since]
        if not parts:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        gone = self.gone(since, at)
        if gone is not None:
            last = gone.groupBy("_gone").agg(F.max("_gone_seq").alias("_gone_seq"))
            rows = rows.join(last, F.col(self.key) == F.col("_gone"), "left").where(F.col("_gone_seq").isNull() | (F.col(SEQ) >= F.col("_gone_seq")))
        return rows.select(columns)

    def gone(self, since: int = -1, at: int | None = None) -> DataFrame | None:
        """_gone, _gone_seq: keys replaced by each commit."""
        kind = self.schemas[next(iter(self.schemas))][self.key].dataType.simpleString()
        parts = [self.spark.read.schema(f"_gone {kind}").parquet(f"{self.folder}/{e['gone']}").withColumn("_gone_seq", F.lit(n)) for n, e in self.live().items() if e.get("gone") and n > since and (at is None or n <= at)]
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _put_rows(self, name: str, df: DataFrame, mark: str) -> str:
        place = f"{name}/{mark}"
        if not self.buckets:
            df.select(self.schemas[name].names).write.parquet(f"{self.folder}/{place}")
            return place
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        dealt = df.select(self.schemas[name].names).withColumn("_bucket", bucket).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.key)
        dealt.write.partitionBy("_bucket").parquet(f"{self.folder}/{place}")
        return place

    def commit(self, make: Callable[[Tables, int], Change | None], tries: int = 20) -> int:
        """Makes a change from the state at the head and puts it; where another writer was first, from the new head again. -> its number, or the head if there was nothing to do.

        make(tables, head) -> Change, or None to leave it."""
        for turn in range(tries):
            head = self.log.head()
            change = make(self, head)
            if change is None:
                return head
            mark = f"{head + 1:012d}-{uuid.uuid4().hex[:12]}"
            entry: dict = {"rows": {name: self._put_rows(name, df, mark) for name, df in change.rows.items()}, "note": dict(change.note or {})}
            if change.gone is not None:
                change.gone.select(F.col(change.gone.columns[0]).alias("_gone")).distinct().write.parquet(f"{self.folder}/gone/{mark}")
                entry["gone"] = f"gone/{mark}"
            try:
                self.log.put(head + 1, entry)
                return head + 1
            except Conflict:
                time.sleep(0.01 * turn)
        raise Conflict(f"no room for a commit after {tries} tries")

    def upsert(self, rows: Mapping[str, DataFrame], ids: DataFrame) -> int:
        """All rows of ids (one column) are replaced by rows."""
        return self.commit(lambda t, head: Change(rows, ids if head >= 0 else None))

    def delete(self, ids: DataFrame) -> int:
        return self.commit(lambda t, head: Change({}, ids) if head >= 0 else None)

    def compacted(self, most: int = 8) -> bool:
        """One commit of all rows that count, if over ``most`` commits are read now. Readers of before keep their files; a writer in between makes it look again."""
        if len(self.live()) <= most:
            return False

        def put(t: Tables, head: int) -> None:
            mark = f"{head + 1:012d}-{uuid.uuid4().hex[:12]}"
            t.log.put(head + 1, {"whole": True, "rows": {name: t._put_rows(name, t.read(name, at=head), mark) for name in t.schemas}, "note": t.note()})

        for _ in range(5):
            try:
                put(self, self.log.head())
                return True
            except Conflict:
                continue
        return False

    def drop(self) -> bool:
        """Deletes everything; whether there was anything."""
        there = self.log.head() >= 0
        self.log._fs.delete(self.log._path(self.folder), True)
        self.log._known.clear()
        return there

    def vacuum(self, keep: Sequence[int] = ()) -> int:
        """Deletes data folders that no entry needs any more; those of ``keep`` stay. Not while readers of old states or writers are at work. -> how many."""
        fs, path = self.log._fs, self.log._path
        used = {p for n, e in self.log.entries().items() if n in self.live() or n in keep for p in [*e["rows"].values(), *([e["gone"]] if e.get("gone") else [])]}
        n = 0
        for top in [*self.schemas, "gone"]:
            at = path(f"{self.folder}/{top}")
            for s in fs.listStatus(at) if fs.exists(at) else []:
                if f"{top}/{s.getPath().getName()}" not in used:
                    fs.delete(s.getPath(), True)
                    n += 1
        return n
