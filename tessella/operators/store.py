"""Document store operations as relational algebra: hashes, incremental ingest, upsert, delete, cached embedding lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(title: Column, text: Column) -> Column:
    """Null titles and texts are empty ones."""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\0"), F.coalesce(text, F.lit(""))), 256)


def classify(new: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """new (doc_id, hash) against stored (doc_id, hash): doc_id and action, one of added, updated, skipped."""
    old = stored.select("doc_id", F.col("hash").alias("old_hash"))
    same = F.lit(False) if force else F.col("hash") == F.col("old_hash")
    action = F.when(F.col("old_hash").isNull(), "added").when(same, "skipped").otherwise("updated")
    return new.join(old, "doc_id", "left").select("doc_id", action.alias("action"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows of the documents in new replace those stored."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(stored: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def cache_lookup(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """texts (text) with key and hit: whether cache (key) holds it."""
    keyed = texts.withColumn("key", F.sha2(F.concat(F.lit(model + "\0"), F.col("text")), 256))
    return keyed.join(cache.select("key", F.lit(True).alias("found")).distinct(), "key", "left").withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")


def counts(chunks: DataFrame) -> DataFrame:
    """(collection, doc_id) of chunks -> collection, documents, chunks."""
    return chunks.groupBy("collection").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


def unchanged(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of new (doc_id, hash) whose hash is stored for their doc_id."""
    return new.join(stored.select("doc_id", "hash"), ["doc_id", "hash"], "left_semi")
