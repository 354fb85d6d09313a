"""Operator 9: packing documents into token windows beside their lexical neighbours.

Documents are dealt into index shards by content: a document's key is the least hash of its runs of three ids, so that
copies share it, and other documents do as often as their runs overlap. Encoded documents are put in order of keys by
ranges (a key of very many documents spreads over several), and each run of about ``shard_ids`` ids is a shard with a BM25
inverted index over token ids, the end id left out. A seed document, the next unused one, opens a window; while there is
room, the index returns the seed's unused neighbours by all of the seed's terms, best first, and they fill the window
greedily, the last one cut to fit. The rest of a cut document opens the next window, so a document's pieces lie in
neighbouring windows in order. All windows are full but a shard's last, whose ids are cut into windows of powers of two, so
nothing is padded.

Defined results: a null or empty text is just the end id; repeated rows and repeated or null doc_ids are packed each, as rows
of their own; a document longer than a window fills windows of its own first; equal scores go to the earlier document of
the shard; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, partitions, written
from .tokens import BATCH_BYTES, WORDS, batches_of, encoder, releasing, vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ODD = np.uint64(0xD6E8FEB86659FD93)


def keys(ids: np.ndarray, n: np.ndarray, block: int = 200_000) -> np.ndarray:
    """Of each document, the least hash of its runs of three ids; ids: of all documents, n: how many each has (1 or more). ``block`` ids or a document at a time."""
    ends, out, first = np.cumsum(n), np.zeros(len(n), np.uint64), 0
    while first < len(n):
        begin = int(ends[first] - n[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + block, side="right")))
        x = ids[begin : ends[last - 1]].astype(np.uint64)
        x[:-2] = (x[:-2] * _ODD + x[1:-1]) * _ODD + x[2:]
        x = (x ^ (x >> np.uint64(29))) * _ODD
        x ^= x >> np.uint64(32)
        mine, at = n[first:last], ends[first:last] - begin
        # a document's last two ids begin no run of its own
        x[at - 1] = ~np.uint64(0)
        x[(at - 2)[mine > 1]] = ~np.uint64(0)
        out[first:last] = np.minimum.reduceat(x, at - mine)
        first = last
    return out.view(np.int64)


class Bm25:
    """Inverted index over the documents of a shard; terms are token ids."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, k1: float = 1.2, b: float = 0.75) -> None:
        self.n = len(n)
        both = np.repeat(np.arange(self.n, dtype=np.int64), n) << 32 | ids
        both.sort()
        new = np.flatnonzero(np.diff(both, prepend=-1))
        tf = np.diff(np.append(new, len(both))).astype(np.float32)
        doc, term = (both[new] >> 32).astype(np.int32), (both[new] & 0xFFFFFFFF).astype(np.int64)
        df = np.bincount(term)
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        long = (1 - b + b * n / max(n.mean() if self.n else 0, 1)).astype(np.float32)
        weight = idf[term] * tf * np.float32(k1 + 1) / (tf + np.float32(k1) * long[doc])
        # a query is its document's terms that other documents have too
        asked = df[term] > 1
        self.query, self.first = term[asked], np.concatenate([[0], np.cumsum(np.bincount(doc[asked], minlength=self.n))])
        # terms of an eighth of the documents or more as rows over all documents, the others as postings
        often = np.flatnonzero(df >= max(8, self.n / 8))
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        dense = self.row[term] >= 0
        self.rows = np.zeros((len(often), self.n), np.float32)
        self.rows[self.row[term[dense]], doc[dense]] = weight[dense]
        rest = np.flatnonzero(~dense)
        rest = rest[np.argsort(term[rest], kind="stable")]
        df[often] = 0
        self.doc, self.weight, self.at = doc[rest].astype(np.intp), weight[rest].astype(np.float64), np.concatenate([[0], np.cumsum(df)])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of each document for all terms of the seed."""
        terms = self.query[self.first[seed] : self.first[seed + 1]]
        rows = self.row[terms]
        terms = terms[rows < 0]
        out = self.rows[rows[rows >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        if len(terms):
            spans = [slice(a, b) for a, b in zip(self.at[terms].tolist(), self.at[terms + 1].tolist())]
            out += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return out

    def neighbours(self, seed: int, unused: np.ndarray, few: int = 48) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first; the best ``few`` are sorted before the others."""
        score = self.scores(seed) * unused
        found = np.flatnonzero(score)
        if len(found) > few:
            near = score[found] >= np.partition(score[found], len(found) - few)[len(found) - few]
            yield from found[near][np.argsort(-score[found[near]], kind="stable")].tolist()
            found = found[~near]
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], window: int = 1024) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0. docs: ids, the end id last."""
    sizes = np.array([len(d) for d in docs], np.int64)
    index = Bm25(np.concatenate([d[:-1] for d in docs]) if docs else np.zeros(0, np.uint32), sizes - 1)
    unused, nxt, sequence, used = np.ones(len(docs), bool), 0, 0, 0
    opened: list[tuple[int, int, int, int]] = []  # pieces of the open window: document, start, length, offset
    rest: tuple[int, int] | None = None

    def put(d: int, start: int) -> int:
        nonlocal used
        n = min(window - used, len(docs[d]) - start)
        opened.append((d, start, n, used))
        used += n
        return start + n

    while True:
        if rest is None:
            while nxt < len(docs) and not unused[nxt]:
                nxt += 1
            if nxt == len(docs):
                break
            rest = (nxt, 0)
            unused[nxt] = False
        seed, start = rest
        end, rest = put(seed, start), None
        if end < len(docs[seed]):
            rest = (seed, end)
        elif used < window:
            for d in index.neighbours(seed, unused):
                unused[d] = False
                end = put(d, 0)
                if end < len(docs[d]):
                    rest = (d, end)
                if used == window:
                    break
        if used == window:
            yield from ((d, s, n, sequence, o) for d, s, n, o in opened)
            opened, used, sequence = [], 0, sequence + 1
    # what is left is cut into powers of two, largest first
    size, at = 0, 0
    for d, s, n, _ in opened:
        while n:
            if size == at:
                size, at = 1 << (used.bit_length() - 1), 0
                used -= size
                sequence += 1
            take = min(n, size - at)
            yield d, s, take, sequence - 1, at
            s, n, at = s + take, n - take, at + take


def encoded(docs: DataFrame, vocab: str | None = None, end_id: int = 0, frugal: bool = False) -> DataFrame:
    """doc_id, key, salt (any even spread over a key's rows) and ids (little-endian, the end id last; two bytes each where wide is 0) of each row. frugal: workers handle less at a time and keep no words, at a third more time."""
    vocab = vocab or vocabulary()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for b in batches_of(batches, most=2_000_000 if frugal else BATCH_BYTES):
            ids, n = encoder(vocab, 50_000 if frugal else WORDS).encode_ended(b.column(1), end_id)
            wide = int(ids.max()) >> 16 > 0
            at = pa.array(np.concatenate([[0], (4 if wide else 2) * np.cumsum(n)]).astype(np.int64))
            flat = pa.Array.from_buffers(pa.large_binary(), len(n), [None, at.buffers()[1], pa.py_buffer(ids.astype("<u4" if wide else "<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys(ids, n)), pa.array(rng.integers(0, 1 << 62, len(n))), pa.array(np.full(len(n), wide, np.int32)), flat.cast(pa.binary())], names=["doc_id", "key", "salt", "wide", "ids"])

    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(lambda batches: releasing(rows(batches), not frugal), "doc_id long, key long, salt long, wide int, ids binary")


def pack(docs: DataFrame, window: int = 1024, vocab: str | None = None, end_id: int = 0, shard_ids: int = 500_000, frugal: bool = False) -> DataFrame:
    """A row per piece (SCHEMA). frugal: as for ``encoded``. shard_ids: ids of an index shard, but for its last document. sequence_id: partition and number within."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        size = 0

        def rows() -> pa.RecordBatch:
            nonlocal first
            got = list(pack_shard(docs, window))
            d, s, n, q, o = (np.array(x, np.int64) for x in zip(*got))
            crc = [zlib.crc32(docs[a][b : b + c].tobytes()) for a, b, c, _, _ in got]
            out = pa.RecordBatch.from_arrays([pa.array([names[a] for a in d.tolist()], pa.int64()), pa.array(s), pa.array(n), pa.array(crc, pa.int64()), pa.array([len(docs[a]) for a in d.tolist()], pa.int64()), pa.array(q + first), pa.array(o)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            first += int(q.max()) + 1
            return out

        for b in batches:
            for name, wide, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                names.append(name)
                docs.append(np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2").astype(np.uint32))
                size += len(docs[-1])
                if size >= shard_ids:
                    yield rows()
                    names, docs, size = [], [], 0
        if docs:
            yield rows()

    dealt = written(encoded(docs, vocab, end_id, frugal), "packing-ids").repartitionByRange(partitions(docs.sparkSession), "key", "salt")
    return dealt.sortWithinPartitions("key", "salt").select("doc_id", "wide", "ids").mapInArrow(lambda batches: releasing(shards(batches), not frugal), SCHEMA)
