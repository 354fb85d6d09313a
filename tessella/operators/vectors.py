"""A stored index of vectors: coarse cells as Parquet partitions, product-quantised residuals beside the vectors, drift and refitting.

Vectors are unit vectors here, so products are cosines. A bounded sample gives the cells' centroids, the code books of what is left after the
centroid, and, measured on the sample itself, how many cells a question has to visit and how many candidates to compare exactly so that ``recall`` of
the true neighbours are met. On vectors that lie in clusters these are few cells; where the vectors are spread evenly they are many, and the codes
(``dim / 4`` bytes a vector) carry the saving.

A search reads only the code column of the cells visited (partition pruning), ranks by the product with the coded vector, and compares
the best candidates of each question exactly. Vectors added later go to the cells there are; when they lie farther from their
centroids than the first ones, or crowd in a cell, ``drifted`` says so and ``refitted`` makes a new index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dimensions that share a code byte, codes of a byte, and rows of the sample at most.
WIDTH, CODES, SAMPLE = 4, 256, 20_000


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is scaled by its largest component first, so that none overflows. Zeros stay."""
    x = np.asarray(x, np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0.0), np.finfo(float).tiny)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def clustered(x: np.ndarray, k: int, turns: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of k clusters of rows, by alternating assignment and means; a cluster left empty keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: max(1, min(k, len(x)))]].copy()
    for _ in range(turns):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[i : i + block] @ centres.T - half).argmax(1) for i in range(0, len(x), block)] or [np.zeros(0, np.int64)])


@dataclass
class VectorIndex:
    """path: folder of ``vectors`` (cell, key, code, vector). probes: cells a question visits; share: of all vectors, those compared exactly."""

    path: str
    key: str
    centroids: np.ndarray
    books: np.ndarray
    probes: int
    share: float
    counts: dict[int, int]
    spread: float
    added: tuple[int, float] = (0, 0.0)
    read: dict[str, float] = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    @property
    def size(self) -> int:
        return sum(self.counts.values())

    # coding
    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, len(self.books) * WIDTH - x.shape[1])))

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code bytes and squared distance to the centroid of unit vectors."""
        cell = nearest(x, self.centroids)
        left = x - self.centroids[cell]
        parts = self._padded(left)
        code = np.stack([nearest(parts[:, j * WIDTH : (j + 1) * WIDTH], book) for j, book in enumerate(self.books)], axis=1).astype(np.uint8)
        return cell, code, (left * left).sum(1)

    def decoded(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        parts = np.concatenate([book[code[:, j]] for j, book in enumerate(self.books)], axis=1)
        return parts[:, : self.dim] + self.centroids[cell]

    # making
    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", recall: float = 0.95, sample: int = SAMPLE, cells: int | None = None, k: int = 10) -> VectorIndex:
        """vectors (key, vector) into ``path``. Null, zero and non-finite vectors, and those of another than the most frequent length, are left out.

        sample: vectors by the least hash of their key that the fit sees; cells: 4 times the root of their number if not given, with 8 of the sample or more in each."""
        usable = _usable(vectors, key, vector)
        most = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if most is None:
            raise ValueError("no vectors to index")
        usable, n = usable.where(F.size("v") == most.n), most["count"]
        seen = units(np.array([r.v for r in usable.orderBy(F.xxhash64("k"), "k").limit(sample).select("v").collect()]))
        made = cls.fit(seen, path, key, n, recall, cells, k)
        return made._write(usable, "overwrite")

    @classmethod
    def fit(cls, seen: np.ndarray, path: str, key: str, n: int, recall: float, cells: int | None, k: int) -> VectorIndex:
        cells = cells or max(1, min(int(4 * np.sqrt(n)), len(seen) // 8))
        centroids = clustered(seen, cells)
        own = nearest(seen, centroids)
        left = seen - centroids[own]
        m = -(-seen.shape[1] // WIDTH)
        parts = np.pad(left, ((0, 0), (0, m * WIDTH - seen.shape[1])))
        books = np.stack([np.resize(clustered(parts[:, j * WIDTH : (j + 1) * WIDTH], CODES), (CODES, WIDTH)) for j in range(m)])
        made = cls(path, key, centroids, books, len(centroids), 1.0, {}, float((left * left).sum(1).mean()))
        # what is needed to meet the true neighbours of some of the sample in the sample
        cell, code, _ = made.coded(seen)
        asked = np.random.default_rng(11).permutation(len(seen))[:300]
        true = seen[asked] @ seen.T
        rough = seen[asked] @ made.decoded(cell, code).T
        for row, i in enumerate(asked):
            true[row, i] = rough[row, i] = -np.inf
        best = np.argsort(-true, axis=1)[:, :k][:, : max(len(seen) - 1, 1)]
        near = np.argsort(np.argsort(-(seen[asked] @ centroids.T), axis=1), axis=1)
        visits = np.take_along_axis(near, cell[best], axis=1) + 1
        place = np.take_along_axis(np.argsort(np.argsort(-rough, axis=1), axis=1), best, axis=1) + 1
        half = 1 - (1 - recall) / 2
        return replace(made, probes=int(np.quantile(visits, half, method="higher")), share=float(min(1.0, np.quantile(place, half, method="higher") / len(seen))))

    def _write(self, usable: DataFrame, mode: str) -> VectorIndex:
        kind = usable.schema["k"].dataType.simpleString()

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo in range(0, len(b), 4096):
                    part = b.iloc[lo : lo + 4096]
                    if len(part):
                        x = units(np.stack(part["v"].to_numpy()))
                        cell, code, far = self.coded(x)
                        yield pd.DataFrame({"key": part["k"].to_numpy(), "code": [c.tobytes() for c in code], "vector": list(x), "far": far, "cell": cell.astype(np.int32)})

        rows = usable.mapInPandas(code, f"key {kind}, code binary, vector array<double>, far double, cell int")
        # a crowded cell is split over files; a small one is one file
        rows.hint("rebalance", "cell").sortWithinPartitions("cell", "key").write.partitionBy("cell").mode(mode).parquet(f"{self.path}/vectors")
        spark = usable.sparkSession
        held = self._stored(spark).groupBy("cell").agg(F.count("*").alias("n"), F.sum("far").alias("far")).collect()
        counts = {r["cell"]: r["n"] for r in held}
        new, far = sum(counts.values()) - self.size, sum(r["far"] for r in held) - self.spread * self.size
        grown = replace(self, counts=counts, added=(self.added[0] + new, self.added[1] + far) if mode == "append" else (0, 0.0), spread=self.spread if mode == "append" else sum(r["far"] for r in held) / max(sum(counts.values()), 1))
        grown._save(spark)
        return grown

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")

    def _save(self, spark: SparkSession) -> None:
        cells = [(i, [float(x) for x in c], self.counts.get(i, 0)) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(cells, "cell int, centroid array<double>, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        books = [(j, [float(x) for x in b.reshape(-1)]) for j, b in enumerate(self.books)]
        spark.createDataFrame(books, "part int, book array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/books")
        about = [(self.key, self.probes, self.share, self.spread, self.added[0], float(self.added[1]))]
        spark.createDataFrame(about, "key string, probes int, share double, spread double, added long, added_far double").write.mode("overwrite").parquet(f"{self.path}/about")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        about = spark.read.parquet(f"{path}/about").first()
        cells = sorted(spark.read.parquet(f"{path}/cells").collect())
        books = sorted(spark.read.parquet(f"{path}/books").collect())
        return cls(path, about.key, np.array([c.centroid for c in cells]), np.array([b.book for b in books]).reshape(len(books), CODES, WIDTH), about.probes, about.share, {c.cell: c.n for c in cells if c.n}, about.spread, (about.added, about.added_far))

    # changing
    def with_added(self, vectors: DataFrame, vector: str = "embedding") -> VectorIndex:
        """The index with more vectors in the cells there are; only files of their cells are written. Keys are to be new."""
        return self._write(_usable(vectors, self.key, vector).where(F.size("v") == self.dim), "append")

    @property
    def drifted(self) -> bool:
        """Whether what was added lies a quarter farther from its centroids than the rest did, or one cell has grown to 8 times the mean and a hundredth of all."""
        n, far = self.added
        crowded = max(self.counts.values(), default=0)
        return (n >= 0.01 * self.size and far / max(n, 1) > 1.25 * self.spread) or (n > 0.5 * self.size and crowded > max(8 * self.size / len(self.centroids), 0.01 * self.size))

    def refitted(self, spark: SparkSession, path: str, **options) -> VectorIndex:
        """A new index of all vectors, at another path."""
        return VectorIndex.build(self._stored(spark).select(F.col("key").alias(self.key), "vector"), path, self.key, "vector", **options)

    # searching
    def search(self, questions: DataFrame, k: int = 10, probes: int | None = None, share: float | None = None, block: int = 2048) -> DataFrame:
        """query_id, key, score, rank of the k best found for a stated set of questions (query_id, q_vec), ``block`` at a time.

        Null, zero and non-finite questions find nothing, nor do those of another length. A question visits more cells than ``probes`` until these hold k vectors."""
        spark = questions.sparkSession
        stored = self._stored(spark)
        kind, q_kind = stored.schema["key"].dataType.simpleString(), questions.schema["query_id"].dataType.simpleString()
        keep = max(2 * k, int(np.ceil((self.share if share is None else share) * self.size)))
        parts, visited, asked_n = [], 0, 0
        for ids, q in _blocks(questions, self.dim, block):
            order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
            sizes = np.array([self.counts.get(i, 0) for i in range(len(self.centroids))])
            wide = np.maximum(min(probes or self.probes, order.shape[1]), (np.cumsum(sizes[order], axis=1) < k).sum(1) + 1)
            asks: dict[int, list[int]] = {}
            for row, n in enumerate(np.minimum(wide, order.shape[1]).tolist()):
                visited += int(sizes[order[row, :n]].sum())
                for c in order[row, :n].tolist():
                    asks.setdefault(c, []).append(row)
            asked_n += len(ids)
            cells = [c for c in asks if sizes[c]]
            found = stored.where(F.col("cell").isin(cells)).select("cell", "key", "code").mapInPandas(self._scan({c: np.array(asks[c]) for c in cells}, q, keep), f"row int, key {kind}, cell int, rough double")
            rows = spark.createDataFrame([(i, name, [float(x) for x in v]) for i, (name, v) in enumerate(zip(ids, q))], f"row int, query_id {q_kind}, q array<double>")
            best = found.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("rough"), "key"))).where(F.col("n") <= keep).select("row", "key", "cell")
            full = stored.where(F.col("cell").isin(cells)).select("cell", "key", "vector").join(best, ["cell", "key"]).join(rows, "row")
            dot = F.aggregate(F.zip_with("vector", "q", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
            parts.append(full.select("query_id", F.col("key").alias(self.key), dot.alias("score")))
        self.read = {"coded": visited / max(asked_n * self.size, 1), "whole": keep / max(self.size, 1), "bytes": visited / max(asked_n * self.size, 1) * len(self.books) / (4 * self.dim) + keep / max(self.size, 1)}
        if not parts:
            return spark.createDataFrame([], f"query_id {q_kind}, {self.key} {kind}, score double, rank int")
        scored = parts[0]
        for p in parts[1:]:
            scored = scored.unionByName(p)
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), self.key))).where(F.col("rank") <= k)

    def _scan(self, asks: dict[int, np.ndarray], q: np.ndarray, keep: int):
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            n = 0

            def cut(parts: list[pd.DataFrame]) -> pd.DataFrame:
                every = pd.concat(parts, ignore_index=True).sort_values(["row", "rough"], ascending=[True, False], kind="stable")
                return every[every.groupby("row").cumcount() < keep]

            for b in batches:
                for cell, part in b.groupby("cell", sort=False):
                    rows = asks[int(cell)]
                    for lo in range(0, len(part), 2048):
                        some = part.iloc[lo : lo + 2048]
                        code = np.frombuffer(b"".join(some["code"]), np.uint8).reshape(len(some), -1)
                        rough = q[rows] @ self.decoded(np.full(len(some), cell), code).T
                        most = min(keep, len(some))
                        pick = np.argpartition(-rough, most - 1, axis=1)[:, :most] if most < len(some) else np.broadcast_to(np.arange(len(some)), rough.shape)
                        held.append(pd.DataFrame({"row": np.repeat(rows, most).astype(np.int32), "key": some["key"].to_numpy()[pick.reshape(-1)], "cell": np.int32(cell), "rough": np.take_along_axis(rough, pick, axis=1).reshape(-1)}))
                        n += len(held[-1])
                        if n > 400_000:
                            held = [cut(held)]
                            n = len(held[0])
                            if n > 200_000:  # ``keep`` grows with the index: what it spares little of is handed on, and cut when all tasks' are together
                                yield held.pop()
                                n = 0
            if held:
                yield cut(held)

        return scan


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """k and v (doubles) of vectors that are neither null, zero, nor hold a null or a non-finite component."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).alias("k"), v.alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull() & fine)


def _blocks(questions: DataFrame, dim: int, block: int) -> Iterator[tuple[list, np.ndarray]]:
    ids: list = []
    rows: list = []
    for r in _usable(questions, "query_id", "q_vec").where(F.size("v") == dim).toLocalIterator():
        ids.append(r.k)
        rows.append(r.v)
        if len(ids) == block:
            yield ids, units(np.array(rows))
            ids, rows = [], []
    if ids:
        yield ids, units(np.array(rows))
