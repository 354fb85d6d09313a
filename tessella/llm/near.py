"""Near copies by similarity of shingle sets: a prefix-filtered join, complete for its threshold, verified by Jaccard.

A text's set has the hashes of its distinct shingles (``shingle`` lower-cased (A-Z) words; a shorter text is one shingle).
Texts of equal sets are one class. Sets are put in one order of all shingles (rare ones first, by a sample; any order is
right). If two sets are at least ``similarity`` alike, the first shingle they share has so few before it, in both, that
it lies in both prefixes: the join over the prefixes' shingles meets every such pair there, and sizes and places drop most
others. What meets is verified on the whole sets, which are kept as the lower halves of their hashes: two sets of n shingles
share about n x n / 2^32 of these by chance, so only a pair one shingle short of the threshold can pass wrongly, and none is lost.

As components are wanted, not pairs, each shingle's sets are first compared with one of them, another in each of ``rounds``
turns, which joins much of a large group of near copies in a linear number of rows; then all pairs not yet in one component
are compared, none left out.

Defined results: null, empty and white-space texts have the empty set and are one class; repeated rows are of one class;
an empty table gives no rows; rows of null doc_id can't be named and stay; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, first_named, only, representatives, written
from .components import components

#: Similarity as a fraction, so that no rounding decides.
SIMILARITY = (4, 5)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle])) for i in range(n)), np.uint64, n).view(np.int64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four longs: whether an odd number of the set's shingles falls on each."""
    odd = np.bincount(hashes.view(np.uint64) >> np.uint64(56), minlength=256) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def ordered_prefix(h: np.ndarray, known: tuple[np.ndarray, np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The first shingles, in the order, of a set (sorted hashes): as many as a set alike must share one of; none if no other set can be."""
    (a, b), (names, counts), n = similarity, known, len(h)
    take = n - -(-a * n // b) + 1
    if not n or (take < 2 and a * (n + 1) > b * n):
        return h[:0]
    often = np.zeros(n, np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        often = np.where(names[at] == h, counts[at], 0)
    return h[np.lexsort((h, often))[:take]]


SETS = "doc_id long, hash long, rid long, cls long, n long, half array<int>, bits array<bigint>, prefix array<bigint>"


def sets(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """SETS: hash (of the text), rid (a number of the row's own), cls (hash of the set), n (its size), half (lower halves of its hashes), bits (parities), prefix."""
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
    known = frequent(texts, shingle)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        rid = TaskContext.get().partitionId() << 33
        lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in parts]).astype(np.int32)), pa.array(np.concatenate(parts).astype(kind)))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [shingles(t, shingle) for t in part.column(1).to_pylist()]
                cls = np.fromiter((xxh64_intdigest(h.tobytes()) for h in found), np.uint64, len(found)).view(np.int64)
                halves = [np.unique(h.astype(np.uint32)).view(np.int32) for h in found]
                bits = pa.array([parities(h).tolist() for h in found], pa.list_(pa.int64()))
                columns = [part.column(0), part.column(2), pa.array(np.arange(rid, rid + len(found))), pa.array(cls), pa.array(np.array([len(h) for h in found], np.int64)), lists(halves, np.int32), bits, lists([ordered_prefix(h, known, similarity) for h in found], np.int64)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SETS.split(", ")])
                rid += len(found)

    return texts.mapInArrow(made, SETS)


def frequent(texts: DataFrame, shingle: int = 5, sample: int = 20_000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several different texts of a sample have, sorted, and how many have them. It only decides the order of shingles."""
    # the sample is bounded in shingles too: 20,000 texts, those of least hash, with at most 500 shingles each
    chosen = texts.select("hash").distinct().orderBy(F.xxhash64("hash"), "hash").limit(sample)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [shingles(t, shingle)[:500] for t in part.column(0).to_pylist()]
                n = [len(h) for h in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(part.column(1).to_numpy(), n))], names=["s", "h"])

    part = texts.join(F.broadcast(chosen), "hash", "left_semi").select("text", "hash").mapInArrow(some, "s long, h long")
    rows = part.groupBy("s").agg(F.count_distinct("h").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(most).collect()
    pairs = sorted((r.s, r.n) for r in rows)
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def _possible(n: str, m: str, pos: str, at: str, similarity: tuple[int, int]) -> Column:
    """Whether sets of sizes n and m whose first common shingle has these places can be alike."""
    a, b = similarity
    size = (F.col(n) * a <= F.col(m) * b) & (F.col(m) * a <= F.col(n) * b)
    return size & ((F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at))) * (a + b) >= (F.col(n) + F.col(m)) * a)


def _parities_allow(n: str, m: str, bits: str, other: str, similarity: tuple[int, int]) -> Column:
    a, b = similarity
    differ = sum((F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(1, 4)), F.bit_count(F.col(bits)[0].bitwiseXOR(F.col(other)[0])))
    return differ * (a + b) <= (F.col(n) + F.col(m)) * (b - a)


def verified(pairs: DataFrame, classes: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Those of the pairs (u, v; a written table) whose sets are alike. Only the sets that a pair names are moved."""
    a, b = similarity
    named = pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct()
    some = classes.join(named, F.col("cls") == F.col("c"), "left_semi")
    one = pairs.join(some.select(F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("half").alias("hu")), "u")
    both = one.join(some.select(F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("half").alias("hv")), "v")
    # shingles of one set whose halves are equal stand there once: what that can hide is granted
    hidden = F.least(F.col("nu") - F.size("hu"), F.col("nv") - F.size("hv"))
    return both.where((F.size(F.array_intersect("hu", "hv")) + hidden) * (a + b) >= (F.col("nu") + F.col("nv")) * a).select("u", "v")


def links(classes: DataFrame, similarity: tuple[int, int] = SIMILARITY, rounds: int = 4) -> DataFrame:
    """(u, v) of classes (cls, n, half, bits, prefix): verified pairs whose transitive closure is that of all pairs at least ``similarity`` alike."""
    rows = classes.select(F.posexplode("prefix").alias("pos", "s"), "n", "cls").select("s", F.col("pos").cast("long").alias("pos"), "n", "cls")
    shared = rows.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s")
    met = written(rows.join(shared, "s").join(classes.select("cls", "bits"), "cls").select("s", "pos", "n", "cls", "bits"), "near-met")
    found, rooted = None, met.withColumn("root", F.col("cls"))
    other = [F.col(c).alias(f"o_{c}") for c in ("pos", "n", "cls", "root", "bits")]
    apart = (F.col("root") != F.col("o_root")) & _possible("n", "o_n", "pos", "o_pos", similarity) & _parities_allow("n", "o_n", "bits", "o_bits", similarity)
    pair = [F.least("cls", "o_cls").alias("u"), F.greatest("cls", "o_cls").alias("v")]

    def alike(meetings: DataFrame, name: str) -> DataFrame:
        pairs = written(meetings.where(apart).select(*pair).distinct(), f"near-pairs-{name}")
        out = written(verified(pairs, classes, similarity), f"near-links-{name}")
        drop(pairs)
        return out

    old = None
    for turn in range(rounds):
        lead = rooted.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min_by(F.struct("pos", "n", "cls", "root", "bits"), F.struct(F.xxhash64("cls", F.lit(turn)), "cls")).alias("lead"))
        lead = lead.where("least != most").select("s", *[F.col(f"lead.{c}").alias(f"o_{c}") for c in ("pos", "n", "cls", "root", "bits")])
        more = alike(rooted.join(lead, "s"), str(turn))
        if more.isEmpty():
            break
        found = more if found is None else found.unionByName(more)
        roots = components(found).select(F.col("node").alias("cls"), F.col("root").alias("to"))
        rooted = written(met.join(roots, "cls", "left").select("s", "pos", "n", "cls", "bits", F.coalesce("to", "cls").alias("root")), f"near-rooted-{turn}")
        drop(*[old] * (old is not None))
        old = rooted
    # a pair of two components: at least one of the two isn't in that of the shingle's least
    main = rooted.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("s", "least")
    outside = rooted.join(main, "s").where("root != least").select("s", *other)
    rest = alike(rooted.join(outside, "s"), "rest")
    drop(met, *[old] * (old is not None))
    return rest if found is None else found.unionByName(rest)


def linked(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, hash, component_id (least doc_id that links reach), component_hash (of that document's text, the least)."""
    every = written(sets(docs, shingle, similarity), "near-sets")
    firsts = every.where("n > 0").groupBy("cls").agg(F.min("rid").alias("r")).select("r")
    classes = written(every.join(firsts, F.col("rid") == F.col("r"), "left_semi").select("cls", "n", "half", "bits", "prefix"), "near-classes")
    marked = written(every.select("doc_id", "hash", "cls"), "near-marked")
    drop(every)
    roots = components(links(classes, similarity)).select(F.col("node").alias("cls"), "root")
    firsts = marked.groupBy("cls").agg(first_named().alias("first"))
    rooted = written(firsts.join(roots, "cls", "left").select("cls", "first", F.coalesce("root", "cls").alias("root")), "near-rooted-classes")
    drop(classes)
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("cls", F.col("component.doc_id").alias("component_id"), F.col("component.hash").alias("component_hash"))
    return marked.select("doc_id", "hash", "cls").join(named, "cls").select("doc_id", "hash", "component_id", "component_hash")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that stay: of each component the one of the least doc_id (and hash of the text); rows of null doc_id can't be named and stay."""
    return representatives(docs, linked(docs, **parameters))
