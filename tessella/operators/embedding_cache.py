"""Embeddings kept in a folder, by model and text: what a run has embedded no later run embeds again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.commits import Change, Tables
from tessella.operators.embedding import Embedder, embedded


class StoredCache:
    """Tables in a folder; a fill adds only the files of what was missing. Several models can share a folder: the key is the digest of model and text."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder) -> None:
        self.embedder, self.tables = embedder, Tables(spark, folder, {"vectors": "key string, embedding array<float>"}, "key")

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.embedder.name}\0"), text), 256)

    def counts(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """One row: hits and misses of the texts (nulls are neither), and how many different ones are missing."""
        keyed = texts.where(F.col(text).isNotNull()).select(self.key(F.col(text)).alias("key"))
        met = keyed.join(self.tables.read("vectors").select("key", F.lit(True).alias("there")), "key", "left").groupBy("key", "there").agg(F.count("*").alias("n"))
        there = F.coalesce("there", F.lit(False))
        return met.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n) for n, c in (("hits", there), ("misses", ~there))], F.count_if(~there).alias("new"))

    def fill(self, texts: DataFrame, text: str = "text") -> int:
        """Embeds the different texts that are missing, each once, in one commit; -> its number. Of two runs at the same time the later one embeds only what is still missing."""

        def change(t: Tables, head: int) -> Change | None:
            new = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().withColumn("key", self.key(F.col("text"))).join(t.read("vectors").select("key"), "key", "left_anti")
            return None if new.isEmpty() else Change({"vectors": new.select("key", embedded(F.col("text"), self.embedder).alias("embedding"))})

        head = self.tables.commit(change)
        self.tables.compacted(64)
        return head

    def embed(self, texts: DataFrame, text: str = "text", name: str = "embedding") -> DataFrame:
        """texts with their vectors; null texts have none."""
        self.fill(texts, text)
        return texts.withColumn("_key", self.key(F.col(text))).join(self.tables.read("vectors").select(F.col("key").alias("_key"), F.col("embedding").alias(name)), "_key", "left").drop("_key")
