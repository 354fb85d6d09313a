"""Operator 10: document fingerprints as threshold-scaled sketches.

A sketch keeps every distinct hash of a text's shingles (``shingle`` words; a shorter text is one shingle) that lies below one
fraction of the hash range, 1 / ``SCALE``, whatever the text. Sketches are merged by union; a sketch of a higher fraction can be
cut down to a lower one (``cut``). The overlap over the smaller one estimates containment, however unequal the documents. A
fingerprint is written as the hash of the whole text, the fraction, the number of its hashes and the hashes, so texts with no
hash under the threshold are still told apart.

Defined results: null text is empty; an empty or white-space text has no shingles; likeness is 1 for equal texts, else the
estimated containment of the smaller in the larger, 0 if either keeps none (as a text of few shingles may). In the order of
documents, doc_id descends, a null doc_id comes last, and rows of equal doc_id are ordered by a hash of the text; the next of
the last is the first; a lone document is its own next. Rows equal in doc_id and text are worked on once and counted: the next
of all of them but one is such a row again. Texts may be of any length, doc_ids of any value. Extra columns are ignored.
Built-in SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, let, only, partitions, written

SHINGLE, SCALE = 5, 4
#: Repeated rows are written out in blocks of this many, so that no array grows with their number.
BLOCK = 1000
KEY = ["none", "did", "hash"]


def cut(hashes: Column, scale: int) -> Column:
    """A sketch's hashes in the lowest 1 / scale of the signed 64-bit range."""
    return hashes if scale == 1 else F.filter(hashes, lambda h: h < F.lit(-(1 << 63) + (1 << 64) // scale))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """array<long>: a text's distinct shingle hashes below the threshold, ascending."""
    words = F.filter(F.split(text, GAP, -1), lambda w: w != "")

    def made(w: Column) -> Column:
        n = F.greatest(F.size(w) - shingle + 1, F.lit(1))
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.try_element_at(w, i + k) for k in range(shingle)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(cut(each, scale))))

    return let(words, made)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller shingle set that lies in the larger; 0 if either sketch is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def written_as(text_hash: Column, hashes: Column, scale: int = SCALE) -> Column:
    return F.concat_ws(":", F.lpad(F.hex(text_hash), 16, "0"), F.lit(f"1/{scale}"), F.size(hashes).cast("string"), F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def in_order(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, gives). texts: the different (doc_id, text), as KEY and text. gives: g_ and KEY, of each the one before it in order (t_ and KEY), in how many ``copies`` that is there, and its first ``need`` code points that it takes.

    Keys are put in order on their own (ranges, then a lead within each range, then the ranges' edges); texts are
    dealt out by key once, for both of their uses. The hash in the key spreads rows of one doc_id, and of none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("did"), F.xxhash64(text).alias("hash"), text.alias("text"))
    keys = rows.groupBy(*KEY, F.length("text").alias("n")).agg(F.count("*").alias("copies"))
    order = ["none", F.desc("did"), "hash"]
    ranged = written(keys.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("p", F.spark_partition_id()), "fingerprint-order")
    me = F.struct(*KEY)
    # of each range: its first in order, and, for the range before it, the one that follows that range's last
    edges = ranged.groupBy("p").agg(F.min_by(me, F.struct("none", (-F.col("did").cast("decimal(20,0)")).alias("d"), "hash")).alias("first"))
    edges = edges.withColumn("after", F.coalesce(F.lead("first").over(Window.orderBy("p")), F.first("first").over(Window.orderBy("p")))).select(F.col("p").alias("q"), "after")
    led = ranged.withColumn("next", F.lead(me).over(Window.partitionBy("p").orderBy(*order))).join(edges, F.col("p") == F.col("q"))
    led = led.withColumn("next", F.coalesce("next", "after"))
    # to the one that gives: whose edit needs how much of it
    gives = led.select(*[F.col(f"next.{c}").alias(f"g_{c}") for c in KEY], *[F.col(c).alias(f"t_{c}") for c in KEY], F.floor(F.col("n") / 2).cast("int").alias("need"), "copies")
    return rows.groupBy(*KEY).agg(F.first("text").alias("text")), gives


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of docs."""
    texts, gives = in_order(docs)

    def joined(right: DataFrame, side: str) -> DataFrame:
        found = texts.join(right, [F.col(c) == F.col(f"{side}{c}") for c in KEY])
        return found.drop(*[f"{side}{c}" for c in KEY])

    kept = lambda c: sketch(F.col(c), shingle, scale)
    given = joined(gives, "g_").select("t_none", "t_did", "t_hash", "copies", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("prefix"), F.col("hash").alias("next_hash"), kept("text").alias("next_sketch"))
    # the last of equal rows is followed by another text, the others by themselves
    both = joined(given, "t_").withColumn("again", F.explode(F.when(F.col("copies") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    end = F.when(F.col("again"), F.substring(F.col("text"), F.lit(1), half)).otherwise(F.col("prefix"))
    full = both.select(
        F.when(~F.col("none"), F.col("did")).alias("doc_id"), n.cast("long").alias("n_chars"), "text", "hash",
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), end).alias("edited"), F.when(F.col("again"), F.col("hash")).otherwise(F.col("next_hash")).alias("next_hash"), "next_sketch",
        F.when(F.col("again"), F.col("copies") - 1).otherwise(F.lit(1)).alias("rows"),
    )
    full = full.select("doc_id", "n_chars", "rows", "hash", F.xxhash64("edited").alias("edited_hash"), F.sha2("edited", 256).alias("edited_sha256"), "next_hash", "next_sketch", kept("text").alias("own"), kept("edited").alias("edit"))
    near = lambda h, s: F.when(F.col("hash") == F.col(h), F.lit(1.0)).otherwise(containment(F.col("own"), F.col(s)))
    marks = [written_as(F.col("hash"), F.col("own"), scale).alias("fingerprint"), written_as(F.col("edited_hash"), F.col("edit"), scale).alias("edited_fingerprint")]
    out = full.select("rows", "doc_id", "n_chars", "edited_sha256", *marks, near("edited_hash", "edit").alias("near_edited"), near("next_hash", "next_sketch").alias("near_next"))
    blocks = out.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / BLOCK))))
    return blocks.withColumn("one", F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.col("rows") - F.col("block") * BLOCK)))).drop("rows", "block", "one")
