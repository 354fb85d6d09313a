"""Operator 8: token-ID output in a binary file format with shuffled planes.

Documents go in ascending doc_id order (null last; rows of equal doc_id by a hash of the text). A file row is a group of
whole documents: their ids are cut into fixed-size blocks, each block is transposed into byte planes (or bit planes), each
plane is compressed by zstandard, and ``chunk_index`` says for each block where its planes lie in ``payload``. Rows carry
(shard, group_no), so that concatenating them in that order gives the corpus. The files are Parquet, written and committed
by Spark in any store; one row can be decoded without its neighbours.

Defined results: null text is empty, and an empty text is just the end id; a document of any length lies in one group; a
null doc_id is kept; repeated rows are stored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, only, own_settings, partitions
from .tokens import batches_of, encoder, releasing, vocabulary

END_ID = 2
SCHEMA = "shard int, group_no long, n_ids long, doc_ids array<bigint>, n_tokens array<bigint>, chunk_index array<struct<first:long,n:int,at:long,sizes:array<int>>>, payload binary"


def planes_of(block: np.ndarray, kind: str) -> list[bytes]:
    """Planes of uint32 ids, lowest byte (or bit) first."""
    as_bytes = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [as_bytes[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def block_of(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_ids(ids: np.ndarray, block: int = 65_536, kind: str = "byte", level: int = 1) -> tuple[list[dict], bytes]:
    """(chunk index, payload)"""
    import zstandard

    press, index, parts, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for first in range(0, len(ids), block):
        piece = ids[first : first + block]
        packed = [press.compress(p) for p in planes_of(piece, kind)]
        index.append({"first": first, "n": len(piece), "at": at, "sizes": [len(p) for p in packed]})
        parts += packed
        at += sum(map(len, packed))
    return index, b"".join(parts)


def decode_ids(index: list[dict], payload: bytes) -> np.ndarray:
    import zstandard

    press, out = zstandard.ZstdDecompressor(), []
    for chunk in index:
        at, planes = chunk["at"], []
        for size in chunk["sizes"]:
            planes.append(press.decompress(payload[at : at + size]))
            at += size
        out.append(block_of(planes, chunk["n"]))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_tokens(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID, group_ids: int = 262_144, block: int = 65_536, kind: str = "byte") -> None:
    """Encodes docs (doc_id, text) and writes the files under path."""
    vocab = vocab or vocabulary()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, no, size = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        kept: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            index, payload = encode_ids(np.concatenate(kept), block, kind)
            one = {"shard": shard, "group_no": no, "n_ids": size, "doc_ids": names, "n_tokens": np.concatenate(sizes).tolist(), "chunk_index": index, "payload": payload}
            return pa.RecordBatch.from_pylist([one], schema=arrow)

        for b in batches_of(batches):
            ids, n = encoder(vocab).encode_ended(b.column(1), end_id)
            ends, docs, lo = np.cumsum(n), b.column(0).to_pylist(), 0
            while lo < len(n):
                done = int(ends[lo - 1]) if lo else 0
                hi = min(int(np.searchsorted(ends, done + group_ids - size)) + 1, len(n))
                names += docs[lo:hi]
                sizes.append(n[lo:hi])
                kept.append(ids[done : ends[hi - 1]])
                size, lo = size + int(ends[hi - 1]) - done, hi
                if size >= group_ids:
                    yield row()
                    no, names, sizes, kept, size = no + 1, [], [], [], 0
        if kept:
            yield row()

    arrow = pa.schema([("shard", pa.int32()), ("group_no", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
                       ("chunk_index", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int32()), ("at", pa.int64()), ("sizes", pa.list_(pa.int32()))]))), ("payload", pa.binary())])
    spark = docs.sparkSession
    texts = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash")]
    # the hash parts the rows of one doc_id, or of none, into several ranges
    ordered = texts.repartitionByRange(max(partitions(spark), 2), *order).sortWithinPartitions(*order).select("doc_id", "text")
    with own_settings(spark):
        ordered.mapInArrow(lambda batches: releasing(groups(batches)), SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<long>) and ids_crc32 of each document in the files; start counts all ids before it."""
    files = spark.read.schema(SCHEMA).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = {k: b.column(k)[r].as_py() for k in ("shard", "group_no", "doc_ids", "n_tokens", "chunk_index", "payload")}
                ids, n = decode_ids(one["chunk_index"], one["payload"]), np.array(one["n_tokens"], np.int64)
                ends = np.cumsum(n)
                flat = memoryview(ids.tobytes())
                crc = [zlib.crc32(flat[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["shard"]] * len(n), pa.int32()), pa.array([one["group_no"]] * len(n), pa.int64()), pa.array(one["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["shard", "group_no", "doc_id", "in_group", "n_tokens", "ids_crc32"],
                )

    read = files.mapInArrow(documents, "shard int, group_no long, doc_id long, in_group long, n_tokens long, ids_crc32 long")
    sizes = files.select("shard", "group_no", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("shard_ids").over(before.orderBy("shard")), F.lit(0)).alias("shard_start"))
    starts = sizes.withColumn("group_start", F.coalesce(F.sum("n_ids").over(before.partitionBy("shard").orderBy("group_no")), F.lit(0))).join(shards, "shard").drop("n_ids")
    return read.join(starts, ["shard", "group_no"]).select("doc_id", (F.col("shard_start") + F.col("group_start") + F.col("in_group")).alias("start"), "n_tokens", "ids_crc32", "shard", "group_no")


def token_output(docs: DataFrame, **parameters) -> DataFrame:
    """Writes docs to a new place in the shared folder, and what read_tokens finds there."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **parameters)
    return read_tokens(docs.sparkSession, path)
