"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is joins and aggregations over link rows; a component is never gathered in one task or on the driver. The
steps' tables are written in the shared folder, each dropped when the next is there, and the loop ends when a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) of one orderable type -> (node, root): root is the least node that can be reached. Self links and repeats are allowed; only linked nodes are returned."""
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "components")
    before = _signature(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = written(large.distinct(), "components-large")
        drop(links)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(least, F.col("u") == F.col("n")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u != v").distinct(), "components")
        drop(large)
        after = _signature(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def united(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of doc_id, hash, component_id, component_hash over the same documents -> the same of the components that the links of both make.

    A document ties its component in one to that in the other; only components, not documents, are followed. Those of null doc_ids only stay as they are."""
    first = lambda t: F.struct(F.col(f"{t}.component_id").alias("doc_id"), F.col(f"{t}.component_hash").alias("hash"))
    named = [t.where("doc_id IS NOT NULL").distinct().alias(a) for t, a in ((one, "a"), (other, "b"))]
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.hash") == F.col("b.hash"))
    roots = components(named[0].join(named[1], same).select(first("a").alias("u"), first("b").alias("v")))
    roots = roots.select(F.col("node.doc_id").alias("n_id"), F.col("node.hash").alias("n_hash"), "root")
    both = one.join(roots, (F.col("component_id") == F.col("n_id")) & (F.col("component_hash") == F.col("n_hash")), "left")
    return both.select("doc_id", "hash", F.coalesce("root.doc_id", "component_id").alias("component_id"), F.coalesce("root.hash", "component_hash").alias("component_hash"))
