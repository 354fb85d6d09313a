"""Incremental ingestion as a stream: each batch's documents replace those stored, unchanged and outdated ones are skipped.

The collection's tables are the state: a document's row holds its last version's order, for as long as the document is held, so a version that comes late, again or
out of order, in this run or after a restart, is told from a new one. A batch is one commit, which writes what changes and names the batch, so a batch that a restart gives
again is not taken twice; other writers' commits between are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.commits import Change, Tables


def tables(spark, folder: str, schema: str, key: str = "doc_id") -> Tables:
    return Tables(spark, folder, {"rows": schema}, key)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def upsert_batch(batch: DataFrame, held: Tables, number: int, key: str = "doc_id", hash_column: str = "hash", order: str | None = None) -> int:
    """A batch's last versions into the collection; -> the commit that holds.

    Of a document's several rows the one of the largest order counts, among equals (or without an order) that of the largest hash. A row whose hash is stored is
    skipped, and so is one of a lower order than the stored row's. Null orders are the lowest. Rows of null keys are left out."""
    by = ([F.desc_nulls_last(order)] if order else []) + [F.desc_nulls_last(hash_column)]
    new = batch.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_n = 1").drop("_n")

    def change(t: Tables, head: int) -> Change | None:
        if t.note().get("batch", -1) >= number:
            return None
        stored = t.read("rows").select(F.col(key).alias("_key"), F.col(hash_column).alias("_hash"), (F.col(order) if order else F.lit(None)).alias("_order"))
        later = F.col("_order").isNull() | (F.col(order) >= F.col("_order")) if order else F.lit(True)
        met = new.join(stored, F.col(key) == F.col("_key"), "left").where(F.col("_key").isNull() | (~F.col(hash_column).eqNullSafe(F.col("_hash")) & later))
        return Change({"rows": met.select(new.columns)}, met.where("_key IS NOT NULL").select(key) if head >= 0 else None, {"batch": number})

    return held.commit(change)


def into(stream: DataFrame, folder: str, key: str = "doc_id", hash_column: str = "hash", order: str | None = None) -> DataFrame:
    """Takes all that the stream has now into the collection in ``folder`` and returns it; a later call goes on from there."""
    held = tables(stream.sparkSession, f"{folder}/tables", ddl(stream), key)
    put = lambda batch, n: upsert_batch(batch, tables(batch.sparkSession, held.folder, ddl(stream), key), n, key, hash_column, order)
    run = stream.writeStream.foreachBatch(lambda batch, n: put(batch, n) and None).option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start()
    run.awaitTermination()
    held.compacted(64)
    return held.read("rows")
