"""Operator 6: near-duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint's bits are cut into segments; the vector of the segments' bit counts is its place in a grid. The Manhattan
distance of two places is a lower bound of the Hamming distance of the fingerprints. The 32 two-bit segments form two halves,
so that of two fingerprints at most 2 bits apart at least one half's places are at most 1 apart: the range join
looks in a fingerprint's own cell and the cells one step up in one segment, which meets each such pair once per group.
What meets is verified on the fingerprints.

A cell holding more than ``crowd`` different fingerprints is not compared pair by pair: every fingerprint that meets it is
linked exactly through its one-bit changes (two fingerprints at most 2 bits apart share one, and what shares one is at
most 2 bits apart), 65 rows each and at most 65 fingerprints for a change. Copies collapse to one fingerprint before all that.

Defined results: null, empty or white-space text has fingerprint 0 and links like any other; repeated rows each get
their component; a null doc_id takes part, and a component of null doc_ids only has a null id; an empty table gives no
rows; extra columns are ignored (``linked``) or kept (``one_of_each``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_named, only, representatives, written
from .components import components


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over shingles of lower-cased (A-Z) words, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for lo in range(0, n, 100_000):  # bounds the bit matrix of a very long text
        part = [b" ".join(words[i : i + shingle]) for i in range(lo, min(n, lo + 100_000))]
        hashes = np.fromiter((xxh64_intdigest(s, seed) for s in part), np.uint64, len(part))
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, hash (of the text), fp (the fingerprint's bits as a signed long)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("hash"), fp("text").alias("fp"))


GROUPS, WIDTH = 2, 32
EVEN = 0x55555555


def _cell(fp: Column, group: int) -> Column:
    """The bit counts of the group's 16 two-bit segments, each in the two bits of its segment."""
    low = F.shiftrightunsigned(fp, group * WIDTH).bitwiseAND(F.lit(EVEN).cast("long"))
    high = F.shiftrightunsigned(fp, group * WIDTH + 1).bitwiseAND(F.lit(EVEN).cast("long"))
    return low + high


def pairs(fps: DataFrame, max_distance: int = 2, crowd: int = 64) -> DataFrame:
    """Links (u, v) over different fingerprints (fp): the transitive closure is that of all pairs at most max_distance (1 or 2) bits apart."""
    if max_distance not in (1, 2):
        raise ValueError("max_distance must be 1 or 2")
    cells = F.array(*[F.struct(F.lit(g).alias("g"), _cell(F.col("fp"), g).alias("cell")) for g in range(GROUPS)])
    base = fps.select("fp", F.explode(cells).alias("c")).select("fp", "c.g", "c.cell")
    # one step up in a segment whose count is under 2
    steps = F.array(*[F.when(F.col("cell").bitwiseAND(F.lit(2 << i).cast("long")) == 0, F.col("cell") + F.lit(1 << i).cast("long")) for i in range(0, WIDTH, 2)])
    up = F.array_compact(steps)
    probe = base.select(F.col("fp").alias("p"), F.col("g").alias("pg"), F.explode(F.concat(F.array("cell"), up)).alias("pcell"))
    crowded = base.groupBy("g", "cell").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(F.col("g").alias("cg"), F.col("cell").alias("ccell"))
    calm = base.join(crowded, (F.col("g") == F.col("cg")) & (F.col("cell") == F.col("ccell")), "left_anti")
    near = calm.join(probe, (F.col("g") == F.col("pg")) & (F.col("cell") == F.col("pcell")) & (F.col("fp") != F.col("p")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("p"))) <= max_distance))
    links = near.select(F.col("fp").alias("u"), F.col("p").alias("v"))
    meets = probe.join(crowded, (F.col("pg") == F.col("cg")) & (F.col("pcell") == F.col("ccell")), "left_semi").select(F.col("p").alias("fp"))
    ones = F.array(*[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)])
    among = meets.distinct()
    changes = among.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), ones)).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("via"), (F.col("bit") == 0).alias("own"))
    if max_distance == 2:
        hubs = changes.groupBy("via").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select(F.col("via").alias("h"), "v")
        star = changes.join(hubs, F.col("via") == F.col("h")).where("fp != v").select(F.col("fp").alias("u"), "v")
    else:
        star = changes.where(~F.col("own")).join(among.select(F.col("fp").alias("v")), F.col("via") == F.col("v")).select(F.col("fp").alias("u"), "v")
    return links.union(star).distinct()


def linked(docs: DataFrame, shingle: int = 3, max_distance: int = 2, crowd: int = 64, seed: int = 42) -> DataFrame:
    """doc_id, hash, fingerprint (16 hex digits), component_id (least doc_id that links reach), component_hash (of that document's text, the least)."""
    marked = written(fingerprints(docs, shingle, seed), "simhash")
    classes = written(marked.groupBy("fp").agg(first_named().alias("first")), "simhash-classes")
    roots = components(written(pairs(classes.select("fp"), max_distance, crowd), "simhash-links")).select(F.col("node"), "root")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select(F.col("fp").alias("f"), F.col("component.doc_id").alias("component_id"), F.col("component.hash").alias("component_hash"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, F.col("fp") == F.col("f")).select("doc_id", "hash", hexed.alias("fingerprint"), "component_id", "component_hash")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that stay: of each component the one of the least doc_id (and hash of the text); rows of null doc_id can't be named and stay."""
    return representatives(docs, linked(docs, **parameters))
