"""A BM25 index in segments: small changes write small segments, and a search reads few postings of frequent terms.

A commit adds the new texts' bags of terms and their postings in blocks; of texts that it replaces it records the keys, and how many of each term they
take away, so document frequencies, the number of texts and their mean length are those of an index built anew. Segments are merged from their bags,
without analysing a text again, once the later ones have grown to the first one's size or are many.

A block is a term's postings in ``SLOTS`` x ``WIDTH`` texts neighbouring in length, with the largest tf and the least length of each ``WIDTH`` of
them, a slot: a bound of what a text there can score by the term, whatever the mean length. Blocks are made of some thousand bags at a time, where the
bags lie: postings are not moved, and the bounds of all terms of a block lie in one file. Postings name a text by its place in the block; a row
without a term has the block's keys. A search adds up the bounds of a question's terms by slot, without
a posting; scores the texts of the most promising slots, of which the k-th best is a mark that a result must reach; and then takes the postings
of only those slots whose bounds reach the mark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.commits import SEQ, Change, Conflict, Tables
from tessella.operators.retrieval import counted, idf, top
from tessella.operators.storage import temporary, written

#: Texts of a slot and slots of a block; postings that a worker makes blocks of at once, about; asked terms up to which a read names them, so that Parquet skips pages.
WIDTH, SLOTS, BATCH, FEW = 4, 16, 400_000, 10
TERMS = "terms array<struct<term:string,tf:bigint>>"


class Segments:
    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", kind: str = "bigint") -> None:
        self.spark, self.folder, self.key, self.kind = spark, folder.rstrip("/"), key, kind
        self.tables = Tables(spark, folder, {"bags": f"{key} {kind}, dl long, {TERMS}"}, key, buckets=0)
        self._block = f"term string, block long, n long, most_tf array<int>, least_dl array<int>, at array<tinyint>, tf array<int>, dl array<int>, keys array<{kind}>"

    # changing
    def _blocks(self, bags: DataFrame) -> str:
        """Writes the postings of bags; -> their place."""
        place = f"blocks/{uuid.uuid4().hex}"
        bags.select(self.key, "dl", "terms").mapInArrow(_block_rows, self._block).write.parquet(f"{self.folder}/{place}")
        return place

    def _note(self, t: Tables, head: int, bags: DataFrame, gone: DataFrame | None) -> dict:
        added = bags.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        note = {"n": added.n, "dl": added.dl, "blocks": self._blocks(bags) if added.n else None}
        if gone is not None:
            # as a written table Spark knows how small the keys are, and need not move the bags
            keys = written(gone.select(F.col(gone.columns[0]).alias(self.key)).distinct(), temporary(self.spark, "gone"))
            left = written(t.read("bags", at=head).join(keys, self.key, "left_semi"), temporary(self.spark, "left"))
            lost = left.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
            if lost.n:
                place = f"minus/{uuid.uuid4().hex}"
                left.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{self.folder}/{place}")
                note |= {"minus": place, "n": added.n - lost.n, "dl": added.dl - lost.dl}
        note["added"] = added.n
        return note

    def apply(self, docs: DataFrame | None, gone: DataFrame | None = None, text: str = "text", note: dict | None = None, unless: tuple[str, object] | None = None) -> int:
        """Adds docs (key, text) and takes away what is held of keys in ``gone`` (one column) and in docs, in one commit. Keys of docs are to be different.

        note: kept with the commit; unless: a name in it and the value that it is to have had before, else nothing is done."""
        bags = None if docs is None else written(counted(docs.select(F.col(self.key).cast(self.kind).alias(self.key), text), self.key, text), temporary(self.spark, "bags"))

        def make(t: Tables, head: int) -> Change | None:
            if unless is not None and t.note().get(unless[0], -1) != unless[1]:
                return None
            new = bags if bags is not None else self.spark.createDataFrame([], t.schemas["bags"])
            out = new.select(self.key)
            out = out if gone is None else out.unionByName(gone.select(F.col(gone.columns[0]).cast(self.kind).alias(self.key)))
            out = out if head >= 0 else None
            return Change({"bags": new}, out, {**self._note(t, head, new, out), **(note or {})})

        return self.tables.commit(make)

    def upsert(self, docs: DataFrame, text: str = "text") -> int:
        return self.apply(docs, text=text)

    def delete(self, keys: DataFrame) -> int:
        return self.apply(None, keys)

    def merged(self, most: int = 16) -> bool:
        """One segment of all that counts, if there are over ``most``, or those after the first hold as many texts as it does."""
        notes = [e["note"] for e in self.tables.live().values()]
        if len(notes) <= 1 or (len(notes) <= most and sum(n["added"] for n in notes[1:]) < notes[0]["added"]):
            return False
        for _ in range(5):
            head = self.tables.log.head()
            bags = written(self.tables.read("bags", at=head), temporary(self.spark, "bags"))
            last = {k: v for k, v in self.tables.log.entries()[head]["note"].items() if k not in ("n", "dl", "blocks", "minus", "added")}
            note = {**last, **self._note(self.tables, head, bags, None)}
            place = self.tables._put_rows("bags", bags, f"{head + 1:012d}-{uuid.uuid4().hex[:12]}")
            try:
                self.tables.log.put(head + 1, {"whole": True, "rows": {"bags": place}, "note": note})
                return True
            except Conflict:
                continue
        return False

    # reading
    def state(self) -> tuple[int, float]:
        """Number of texts and their mean length (1 at least)."""
        notes = [e["note"] for e in self.tables.live().values()]
        n = sum(x["n"] for x in notes)
        return n, max(1.0, sum(x["dl"] for x in notes) / n if n else 1.0)

    def _rows(self) -> DataFrame:
        out = self.spark.createDataFrame([], self._block).withColumn(SEQ, F.lit(-1))
        for n, e in self.tables.live().items():
            if e["note"].get("blocks"):
                out = out.unionByName(self.spark.read.schema(self._block).parquet(f"{self.folder}/{e['note']['blocks']}").withColumn(SEQ, F.lit(n)))
        return out

    def texts(self) -> DataFrame:
        """commit, block and keys of its texts by their places, of all blocks."""
        return self._rows().where("term IS NULL").select(SEQ, "block", "keys")

    def blocks(self, asked: DataFrame | None = None) -> DataFrame:
        """All segments' blocks with their commit's number; asked: only those of its terms."""
        out = self._rows().drop("keys").where("term IS NOT NULL")
        if asked is None:
            return out
        terms = asked.select("term").distinct()
        few = [r.term for r in terms.limit(FEW + 1).collect()]
        return out.where(F.col("term").isin(few)) if len(few) <= FEW else out.join(F.broadcast(terms), "term", "left_semi")

    def _minus(self) -> DataFrame:
        out = self.spark.createDataFrame([], "term string, n long")
        for e in self.tables.live().values():
            if e["note"].get("minus"):
                out = out.unionByName(self.spark.read.schema("term string, n long").parquet(f"{self.folder}/{e['note']['minus']}"))
        return out.groupBy("term").agg(F.sum("n").alias("minus"))

    def _alive(self, postings: DataFrame) -> DataFrame:
        """Of rows with key and commit, those of texts that count."""
        gone = self.tables.gone()
        if gone is None:
            return postings
        last = gone.groupBy("_gone").agg(F.max("_gone_seq").alias("_gone_seq"))
        return postings.join(last, F.col("key") == F.col("_gone"), "left").where(F.col("_gone_seq").isNull() | (F.col(SEQ) >= F.col("_gone_seq"))).drop("_gone", "_gone_seq")

    def _weighed(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks of the questions' terms; query_id, term, df, idf."""
        n, _ = self.state()
        asked = written(questions.select("query_id", F.explode(F.array_distinct(T.terms(F.col("question")))).alias("term")), temporary(self.spark, "asked"))
        blocks = self.blocks(asked)
        df = blocks.select("term", "n").groupBy("term").agg(F.sum("n").alias("df"))
        df = df.join(self._minus(), "term", "left").withColumn("df", F.col("df") - F.coalesce("minus", F.lit(0))).where("df > 0")
        weighed = asked.join(df, "term").select("query_id", "term", "df", idf(F.lit(n), F.col("df")).alias("idf"))
        return blocks, written(weighed, temporary(self.spark, "weighed"))

    def _kept(self, questions: DataFrame, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Blocks, weighed terms, query_id, commit, block and slots of all texts that can be among the k best, and query_id with the mark that these reach."""
        avgdl = self.state()[1]
        blocks, weighed = self._weighed(questions)

        def bound(i: int) -> Column:
            tf = F.col("most_tf")[i]
            return F.sum(F.coalesce(F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("least_dl")[i] / avgdl)), F.lit(0.0)))

        sums = blocks.select("term", SEQ, "block", "most_tf", "least_dl").join(weighed, "term").groupBy("query_id", SEQ, "block").agg(F.array(*[bound(i) for i in range(SLOTS)]).alias("bounds"))
        sums = written(sums, temporary(self.spark, "bounds"))
        # the most promising slots: as many as could hold the k best four times over
        named = F.transform("bounds", lambda x, i: F.struct(x.alias("bound"), i.alias("slot")))
        best = sums.select("query_id", SEQ, "block", F.explode(F.slice(F.sort_array(named, asc=False), 1, 4)).alias("s")).select("query_id", SEQ, "block", "s.*")
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), SEQ, "block", "slot"))).where(F.col("nth") <= 4 * k)
        best = written(best.groupBy("query_id", SEQ, "block").agg(F.collect_set("slot").alias("slots")), temporary(self.spark, "best"))
        first = self._named(self._scores(blocks, weighed, best, k1, b))
        marks = first.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("nth") == k).select("query_id", F.col("score").alias("mark"))
        marks = written(marks, temporary(self.spark, "marks"))
        met = sums.join(marks, "query_id", "left")
        can = F.filter(F.transform("bounds", lambda x, i: F.when((x > 0) & (x >= F.coalesce("mark", F.lit(0.0)) - 1e-9), i)), lambda i: i.isNotNull())
        return blocks, weighed, met.select("query_id", SEQ, "block", can.alias("slots")).where(F.size("slots") > 0), marks

    def _postings(self, blocks: DataFrame, weighed: DataFrame, kept: DataFrame, weight: str = "idf") -> DataFrame:
        """query_id, idf or df, commit, block, at, tf, dl of the postings in the slots kept."""
        held = blocks.select("term", SEQ, "block", "at", "tf", "dl").join(weighed.select("query_id", "term", weight), "term").drop("term").join(kept, ["query_id", SEQ, "block"])
        some = F.filter(F.arrays_zip("at", "tf", "dl"), lambda p: F.array_contains("slots", F.shiftright(p["at"].cast("int"), WIDTH.bit_length() - 1)))
        return held.select("query_id", weight, SEQ, "block", F.explode(some).alias("p")).select("query_id", weight, SEQ, "block", "p.*")

    def _scores(self, blocks: DataFrame, weighed: DataFrame, kept: DataFrame, k1: float, b: float) -> DataFrame:
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / self.state()[1]))
        return self._postings(blocks, weighed, kept).groupBy("query_id", SEQ, "block", "at").agg(F.sum(part).alias("score"))

    def _named(self, scores: DataFrame) -> DataFrame:
        """query_id, key, score of the texts that count."""
        keyed = scores.join(self.texts(), [SEQ, "block"]).select("query_id", SEQ, F.get("keys", F.col("at").cast("int")).alias("key"), "score")
        return self._alive(keyed).select("query_id", "key", "score")

    def search(self, questions: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, key, score, rank of the k best texts that share a term with each question (query_id, question): the same as over all postings."""
        *read, marks = self._kept(questions, k, k1, b)
        reached = self._scores(*read, k1, b).join(marks, "query_id", "left").where(F.col("score") >= F.coalesce("mark", F.lit(0.0)) - 1e-9).drop("mark")
        scored = self._named(reached)
        return top(scored.withColumnRenamed("key", self.key), k, "query_id", [F.desc(F.round("score", 9)), F.asc(self.key)])

    def read_shares(self, questions: DataFrame, k: int = 10, frequent: float = 0.1, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """One row: postings of the asked terms and of the frequent ones among them (in over ``frequent`` of the texts), and how many of each a search takes for its last pass."""
        often = F.col("df") > frequent * self.state()[0]
        blocks, weighed, kept, _ = self._kept(questions, k, k1, b)
        every = weighed.agg(F.sum("df").alias("every"), F.sum(F.when(often, F.col("df")).otherwise(0)).alias("every_frequent"))
        return every.crossJoin(self._postings(blocks, weighed, kept, "df").agg(F.count("*").alias("got"), F.count(F.when(often, 1)).alias("got_frequent")))

    def weights(self, asked: DataFrame) -> DataFrame:
        """asked (query_id, term) -> also df, 0 for a term that no text has, and idf."""
        df = self.blocks(asked).select("term", "n").groupBy("term").agg(F.sum("n").alias("df")).join(self._minus(), "term", "left")
        known = asked.join(df, "term", "left").withColumn("df", F.coalesce(F.col("df") - F.coalesce("minus", F.lit(0)), F.lit(0)))
        return known.select("query_id", "term", "df", idf(F.lit(self.state()[0]), F.col("df")).alias("idf"))


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, dl, terms) -> blocks, in order of term for every ``BATCH`` postings or so. Their numbers are those of the task and a count."""
    number, names = TaskContext.get().partitionId() << 40, ["term", "block", "n", "most_tf", "least_dl", "at", "tf", "dl", "keys"]

    def named(rows: pa.RecordBatch) -> pa.RecordBatch:
        ends = np.append(np.arange(0, rows.num_rows, WIDTH * SLOTS), rows.num_rows).astype(np.int32)
        n = len(ends) - 1
        none = [pa.nulls(n, t) for t in (pa.string(), *[pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int8(), pa.int32(), pa.int32())])]
        return pa.RecordBatch.from_arrays([none[0], pa.array(number + np.arange(n)), pa.array(np.diff(ends).astype(np.int64)), *none[1:], pa.ListArray.from_arrays(pa.array(ends), rows.column(0))], names=names)

    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        flat = rows.column(2).flatten()
        text = np.repeat(np.arange(rows.num_rows), rows.column(2).value_lengths().to_numpy())
        words = flat.field(0).dictionary_encode()
        # the terms' numbers in their order
        by = pc.sort_indices(words.dictionary).to_numpy()
        nth = np.empty(len(by), np.int64)
        nth[by] = np.arange(len(by))
        term = nth[words.indices.to_numpy()]
        order = np.lexsort((text, term))
        term, text, tf = term[order], text[order], flat.field(1).to_numpy()[order].astype(np.int32)
        dl, block, slot = rows.column(1).to_numpy()[text].astype(np.int32), text // (WIDTH * SLOTS), text // WIDTH % SLOTS
        new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))
        heads, row = np.flatnonzero(new), np.cumsum(new) - 1
        # of a slot the first text is the shortest
        at = np.flatnonzero(new | np.append(True, slot[1:] != slot[:-1]))
        most, least = (np.zeros((len(heads), SLOTS), np.int32) for _ in range(2))
        most[row[at], slot[at]], least[row[at], slot[at]] = np.maximum.reduceat(tf, at), dl[at]
        dense = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, SLOTS, dtype=np.int32)), pa.array(x.reshape(-1)))
        ends = np.append(heads, len(term))
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in ((text % (WIDTH * SLOTS)).astype(np.int8), tf, dl)]
        none = pa.nulls(len(heads), pa.list_(rows.schema.types[0]))
        return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(by[term[heads]])), pa.array(number + block[heads]), pa.array(np.diff(ends)), dense(most), dense(least), *lists, none], names=names)

    for b in _cut(batches):
        if pc.sum(b.column(2).value_lengths()).as_py():
            b = b.take(pc.sort_indices(b.column(1)))
            yield named(b)
            yield made(b)
            number += -(-b.num_rows // (WIDTH * SLOTS))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a list at the end, in whole blocks' texts and of about ``BATCH`` elements, but the last ones."""
    held, n, size = [], 0, 0
    for b in batches:
        for lo in range(0, b.num_rows, WIDTH * SLOTS):
            part = b.slice(lo, WIDTH * SLOTS)
            held.append(part)
            n += part.num_rows
            size += pc.sum(part.column(2).value_lengths()).as_py() or 0
            if size >= BATCH:
                rows = pa.concat_batches(held)
                whole = n - n % (WIDTH * SLOTS) or n
                yield rows.slice(0, whole)
                held, n = [rows.slice(whole)] if whole < n else [], n - whole
                size = sum(pc.sum(x.column(2).value_lengths()).as_py() or 0 for x in held)
    if held:
        yield pa.concat_batches(held)
