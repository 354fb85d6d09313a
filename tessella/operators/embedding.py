"""Embedders: from a list of texts to unit vectors, and what every one of them shares.

An embedder is anything with ``name``, ``dim`` and ``vectors(texts) -> array (texts, dim)``. ``embed`` puts blank texts at zero and
the others at unit length; ``embedded`` applies it to a column by Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import analysis

#: Texts that are vectors of doubles at a time.
SLICE = 256


class Embedder(Protocol):
    name: str
    dim: int

    def vectors(self, texts: Sequence[str]) -> np.ndarray: ...


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    x = np.asarray(x, np.float64)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0).astype(np.float32)


def normalized(vector: Column) -> Column:
    """A vector at length 1; a zero or empty one as it is, null for null."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.element_at(F.transform(F.array(size), lambda n: F.when(n > 0, F.transform(vector, lambda v: v / n)).otherwise(vector.cast("array<double>"))), 1)


def embed(embedder: Embedder, texts: Sequence[str]) -> np.ndarray:
    out = np.zeros((len(texts), embedder.dim), np.float32)
    said = [i for i, t in enumerate(texts) if t.strip()]
    if said:
        out[said] = unit_rows(embedder.vectors([texts[i] for i in said]))
    return out


def embedded(text: Column, embedder: Embedder) -> Column:
    """array<float> of a text; null counts as blank."""

    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros((len(texts), embedder.dim), np.float32)
            for lo in range(0, len(texts), SLICE):
                out[lo : lo + SLICE] = embed(embedder, texts.slice(lo, SLICE).to_pylist())
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * embedder.dim), pa.array(out.reshape(-1)))

    return F.arrow_udf(vectors, "array<float>")(F.coalesce(text, F.lit("")))


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first .. first + size of each row, and their rows."""
    rows = np.repeat(np.arange(len(first)), size)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size - first, size)


@dataclass
class Hashing:
    """Signed sums of hashed stems and neighbouring pairs, damped by a logarithm."""

    dim: int = 1024
    bigrams: bool = True
    name: str = "hashing"
    known: dict[str, int] = field(default_factory=dict, repr=False)

    def code(self, feature: str) -> int:
        """Twice the feature's place, and 1 more if it counts as negative."""
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= 500_000:
                self.known.clear()
            digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
            found = self.known[feature] = int.from_bytes(digest, "little") % self.dim * 2 + (digest[7] < 128)
        return found

    def damped(self, rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        """n vectors from features' codes and the rows that they are of."""
        sums = np.bincount(rows * self.dim + (codes >> 1), 1.0 - 2.0 * (codes & 1), n * self.dim).reshape(n, self.dim)
        return np.copysign(np.log1p(np.abs(sums)), sums)

    def of_terms(self, terms: Sequence[str]) -> np.ndarray:
        features = [*terms, *(f"{a}_{b}" for a, b in zip(terms, terms[1:]) if self.bigrams)]
        codes = np.fromiter(map(self.code, features), np.int64, len(features))
        return self.damped(np.zeros(len(codes), np.int64), codes, 1)[0]

    def windows(self, texts: Sequence[str], around: int = 1) -> np.ndarray:
        """Unit vectors of each text joined with its neighbours by spaces; each text is analysed once, as a space ends a word."""
        said = [analysis.terms(t) for t in texts]
        terms = [t for part in said for t in part]
        ends = np.cumsum([0, *map(len, said)])
        one = np.fromiter(map(self.code, terms), np.int64, len(terms))
        two = np.fromiter((self.code(f"{a}_{b}") for a, b in zip(terms, terms[1:])), np.int64, max(0, len(terms) - 1)) if self.bigrams else one[:0]
        out = np.zeros((len(texts), self.dim), np.float32)
        for lo in range(0, len(texts), SLICE):
            i = np.arange(lo, min(lo + SLICE, len(texts)))
            first, last = ends[np.maximum(i - around, 0)], ends[np.minimum(i + around + 1, len(texts))]
            found = [_ranges(first, n) for n in (last - first, np.maximum(last - first - 1, 0) if self.bigrams else 0 * first)]
            rows, codes = np.concatenate([r for r, _ in found]), np.concatenate([one[found[0][1]], two[found[1][1]]])
            out[i] = unit_rows(self.damped(rows, codes, len(i)))
        return out

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        return np.stack([self.of_terms(analysis.terms(t)) for t in texts])


@dataclass
class WordVectors:
    """Mean of the vectors of a text's content words, from a table of word vectors; words without one are passed over."""

    table: Mapping[str, np.ndarray]
    name: str = "words"

    @property
    def dim(self) -> int:
        return len(next(iter(self.table.values()))) if self.table else 1

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        means = [[self.table[w] for w in analysis.content_words(t) if w in self.table] for t in texts]
        return np.stack([np.mean(m, axis=0) if m else np.zeros(self.dim) for m in means])

    def word_vectors(self, words: Sequence[str]) -> np.ndarray:
        return unit_rows(np.stack([np.asarray(self.table.get(w, np.zeros(self.dim)), np.float64) for w in words])) if words else np.zeros((0, self.dim), np.float32)


@dataclass
class Remote:
    """A service's embeddings. call: a list of texts -> rows (place in the list, vector) in any order, and the tokens used.

    Texts go ``batch`` at a time, newlines as spaces, cut at ``most`` characters (the service's limit).
    """

    call: Callable[[list[str]], tuple[list[tuple[int, Sequence[float]]], int]]
    name: str = "remote"
    batch: int = 128
    most: int = 24_000
    tokens: int = 0
    known_dim: int | None = None

    @property
    def dim(self) -> int:
        if self.known_dim is None:
            self.vectors(["dimension"])
        return int(self.known_dim or 0)

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        rows: list[Sequence[float]] = []
        for lo in range(0, len(texts), self.batch):
            got, used = self.call([t.replace("\n", " ")[: self.most] for t in texts[lo : lo + self.batch]])
            rows += [v for _, v in sorted(got, key=lambda r: r[0])]
            self.tokens += used
        self.known_dim = len(rows[0]) if rows else self.known_dim
        return np.asarray(rows, np.float64)


@dataclass
class Cached:
    """Another embedder with a memory: each different text is embedded once. hits and misses count texts, repeats included."""

    inner: Embedder
    store: dict[str, np.ndarray] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0

    @property
    def name(self) -> str:
        return self.inner.name

    @property
    def dim(self) -> int:
        return self.inner.dim

    def key(self, text: str) -> str:
        return hashlib.sha256(f"{self.name}\0{text}".encode()).hexdigest()

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        keys = [self.key(t) for t in texts]
        new = {k: t for k, t in zip(keys, texts) if k not in self.store}
        unknown = sum(k in new for k in keys)
        self.hits, self.misses = self.hits + len(keys) - unknown, self.misses + unknown
        if new:
            self.store.update(zip(new, self.inner.vectors(list(new.values()))))
        return np.stack([self.store[k] for k in keys])


def embedder(kind: str = "hashing", cached: bool = True, **options) -> Embedder:
    """hashing (never cached), words (table=) or remote (call=); ValueError for others."""
    if kind == "hashing":
        return Hashing(**options)
    if kind not in ("words", "remote"):
        raise ValueError(f"unknown embedder {kind!r}")
    made = WordVectors(**options) if kind == "words" else Remote(**options)
    return Cached(made) if cached else made


def embed_missing(texts: DataFrame, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """texts (text) and cache (key, embedding) -> the cache's rows to add: key and embedding of each different text it lacks."""
    keyed = texts.where("text IS NOT NULL").select("text").distinct().withColumn("key", F.sha2(F.concat(F.lit(f"{embedder.name}\0"), F.col("text")), 256))
    return keyed.join(cache.select("key"), "key", "left_anti").select("key", embedded(F.col("text"), embedder).alias("embedding"))
