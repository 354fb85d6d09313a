"""Operator 1: nearest neighbours by multiprobe p-stable hashing.

A table hashes the unit vectors by ``hashes`` functions floor((a . v + b) / width) with normal a; a cell of a table is one
vector of values. A query visits, in every table, its own cell and the cells next to it in the order of the expected
success of their perturbations (from the query's distances to its cell's walls), ``probes`` in all. Vectors and visits
meet by cell; a task keeps the best of each query it has seen, and the tables' candidates are merged.

Cells of more than ``crowd`` vectors are split into parts by a hash of vec_id, and visits go to all parts of a cell, so
no task gets a whole crowded cell. A query that has met fewer than k others is answered by a scan over all vectors, in blocks of such queries.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do vectors of
another length than ``dim`` (the most frequent one among the others, if not given; the shorter of equals) or rows with a null vec_id; rows that share a vec_id count as one, by their best score; equal scores
go to the smaller vec_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

FOUND = "query_id long, vec_id long, score double"


def perturbations(hashes: int, n: int) -> list[tuple[int, ...]]:
    """The first n sets of steps, by expected cost; step j is that over the j-th nearest wall (from 0), and a hash takes one step at most."""
    m = hashes
    j = np.arange(1, 2 * m + 1)
    r = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - r / (m + 1) + r * (r + 1) / (4 * (m + 1) * (m + 2)))
    heap, out = [(cost[0], (0,))], [()]
    while heap and len(out) < n:
        c, steps = heapq.heappop(heap)
        last = steps[-1]
        if all(2 * m - 1 - s not in steps for s in steps):
            out.append(steps)
        if last + 1 < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*steps, last + 1)))
    return out


class Hashing:
    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.a, self.b = rng.normal(size=(dim, tables * hashes)), rng.uniform(0, width, tables * hashes)
        self.odd = rng.integers(1, 1 << 63, hashes + 1, dtype=np.int64) | 1
        self.tables, self.hashes, self.width = tables, hashes, width

    def places(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, hashes)"""
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            k = (cells * self.odd[1:]).sum(axis=1) + self.odd[0] * np.int64(table + 1)
            k = (k ^ (k >> np.int64(31))) * self.odd[0]
        return k ^ (k >> np.int64(29))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of a column of their bytes."""
    return _unit(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64))


def _nearest(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec, score): the k nearest of x (unit rows) to each of q but itself, by one product of matrices; each cosine is then summed the same way wherever it is taken."""
    rough = q @ x.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
        at, near = np.nonzero((rough >= least[:, None] - 1e-12) & (rough > -np.inf))
    else:
        at, near = np.nonzero(rough > -np.inf)
    return own[at], ids[near], (x[near] * q[at]).sum(axis=1)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different vectors of each query, best first, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    # rows that share an id count as one, by their best score
    seen = np.lexsort((np.arange(len(vec)), vec, query))
    again = np.zeros(len(vec), bool)
    again[seen[1:]] = (query[seen[1:]] == query[seen[:-1]]) & (vec[seen[1:]] == vec[seen[:-1]])
    query, vec, score = query[~again], vec[~again], score[~again]
    first = np.flatnonzero(np.diff(query, prepend=query[0] - 1 if len(query) else 0))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], vec[rank < k], score[rank < k]


class Best:
    """The k best of each query that a task has seen; given out when there are many queries."""

    def __init__(self, k: int, most: int = 50_000) -> None:
        self.k, self.most, self.parts, self.n = k, most, [], 0

    def add(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(found)
        self.n += len(found[0])
        if self.n > 4 * self.most:
            self.parts = [_best(*map(np.concatenate, zip(*self.parts)), self.k)]
            self.n = len(self.parts[0][0])
            if self.n > self.most * self.k:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(*map(np.concatenate, zip(*self.parts)), self.k)], names=["query_id", "vec_id", "score"])
        self.parts, self.n = [], 0


def _finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def usable(vectors: DataFrame, id_column: str, vector_column: str, dim: int, kind: str) -> DataFrame:
    """id and vec (bytes of the kind, little-endian) of the vectors that take part."""
    v = F.col(vector_column)
    good = F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) == dim) & _finite(v)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], names=["id", "vec"])

    plain = v if kind == "<f4" else v.cast("array<double>")
    return vectors.where(good).select(F.col(id_column).cast("long").alias("id"), plain.alias("vec")).mapInArrow(packed, "id long, vec binary")


def _kind(vectors: DataFrame, vector_column: str) -> str:
    return "<f4" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "<f8"


def search(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", dim: int | None = None, tables: int = 6, hashes: int = 8, width: float = 2.4, probes: int = 70, crowd: int = 512, block: int = 1000, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row for which is_query (a function of the id column) holds."""
    spark, kind = vectors.sparkSession, _kind(vectors, vector_column)
    if dim is None:
        v = F.col(vector_column)
        sizes = vectors.where(v.isNotNull()).where(_finite(v)).groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = sizes.dim if sizes else 1
    hashing, sets, n = Hashing(dim, tables, hashes, width, seed), perturbations(hashes, probes), partitions(spark)
    base = usable(vectors, id_column, vector_column, dim, kind)
    queries = base.where(is_query(F.col("id")))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                if part.num_rows:
                    at = np.floor(hashing.places(_rows(part.column(1), kind, dim))).astype(np.int64)
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(hashing.keys(at[:, t], t)), part.column(0), part.column(1)], names=["cell", "id", "vec"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                if not part.num_rows:
                    continue
                f = hashing.places(_rows(part.column(1), kind, dim))
                at = np.floor(f).astype(np.int64)
                rows = np.arange(len(at))
                for t in range(tables):
                    inside = f[:, t] - at[:, t]
                    nearest = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1)
                    for steps in sets:
                        cell = at[:, t].copy()
                        for s in steps:
                            wall = nearest[:, s]
                            cell[rows, wall % hashes] += np.where(wall < hashes, -1, 1)
                        yield pa.RecordBatch.from_arrays([pa.array(hashing.keys(cell, t)), part.column(0), part.column(1)], names=["cell", "id", "vec"])

    schema = "cell long, id long, vec binary"
    kept, went = base.mapInArrow(cells, schema), queries.mapInArrow(visits, schema)
    crowded = written(kept.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts")).where("parts > 1"), "ann-crowded")
    split = lambda df: df.join(crowded, F.col("cell") == F.col("c"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parts = split(kept).select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("visit"), "id", "vec")
    calls = split(went).select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("visit"), "id", "vec")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (cell, part, visit) -> the k best of each query in this task. At most a part's vectors are held."""
        best, now, ids, x = Best(k), None, np.zeros(0, np.int64), np.zeros((0, dim))
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                b = batch.slice(lo, 20_000)
                cell, part, visit, i = (b.column(c).to_numpy() for c in range(4))
                vec = _rows(b.column(4), kind, dim)
                starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))
                for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
                    stay = a + int(np.searchsorted(visit[a:z], 1))
                    if now != (cell[a], part[a]):
                        now, ids, x = (cell[a], part[a]), i[a:stay], vec[a:stay]
                    elif stay > a:
                        ids, x = np.concatenate([ids, i[a:stay]]), np.concatenate([x, vec[a:stay]])
                    for at in range(stay, z, 2_000):
                        if len(ids):
                            yield from best.add(_nearest(ids, x, i[at : min(at + 2_000, z)], vec[at : min(at + 2_000, z)], k))
        yield from best.rest()

    met = parts.unionByName(calls).repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "visit").mapInArrow(meet, FOUND)
    top = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    found = written(top(met), "ann-found")
    few = queries.select("id").distinct().join(found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id")), "id", "left_anti")
    few = written(queries.join(few.withColumnRenamed("id", "f"), F.col("id") == F.col("f")).select("id", "vec").dropDuplicates(["id"]), "ann-few")
    # those answered by a scan, block by block, and the others as found
    parts, last = [found.join(few.select(F.col("id").alias("f")), F.col("query_id") == F.col("f"), "left_anti")], None
    while True:
        chunk = (few if last is None else few.where(F.col("id") > last)).orderBy("id").limit(block).collect()  # at most ``block`` queries
        if not chunk:
            break
        last = chunk[-1].id
        parts.append(written(top(base.mapInArrow(_scan([(r.id, bytes(r.vec)) for r in chunk], k, dim, kind), FOUND)).select(*found.columns), "ann-scanned"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan(queries: list[tuple[int, bytes]], k: int, dim: int, kind: str):
    """The k best of each query in a task, by looking at all its vectors."""
    own = np.array([i for i, _ in queries], np.int64)
    q = _unit(np.frombuffer(b"".join(v for _, v in queries), kind).reshape(-1, dim).astype(np.float64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                b = batch.slice(lo, 2_000)
                yield from best.add(_nearest(b.column(0).to_numpy(), _rows(b.column(1), kind, dim), own, q, k))
        yield from best.rest()

    return scan
