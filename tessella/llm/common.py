"""What every operator here shares: the cluster's shared folder, written tables, table reading and word rules."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is ASCII only: space and tab to carriage return; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or the checkpoint folder set before; where both are unset, one of our own on a local master, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. What is put there goes when the application ends."""
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


#: Settings of our own writes: the shuffle files behind a written table go at once, and Python gets few rows at a time, as texts may be long.
OWN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_one_at_a_time = threading.Lock()


@contextmanager
def own_settings(spark: SparkSession) -> Iterator[None]:
    """OWN for an action; what was set before comes back. One action at a time, as settings are the session's."""
    with _one_at_a_time:
        before = {k: spark.conf.get(k, None) for k in OWN}
        for k, v in OWN.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    for k, v in options.items():
        writer = writer.option(k, v)
    with own_settings(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for t in tables:
        fs, at = _file_system(t.sparkSession, t._written_at)
        fs.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, by name; a null column of type long or string stands in for a missing one, so extra or clashing names elsewhere in df don't matter."""
    have = set(df.columns)
    kinds = {"doc_id": "long", "n_chars": "long"}
    return df.select(*[df[c] if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in columns])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def n_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_rows(df: DataFrame, *columns: Column) -> DataFrame:
    """All columns of df as one, ``row``, beside the columns given: names in df can't meet names of ours."""
    return df.select(F.struct("*").alias("row"), *columns)


def first_named() -> Column:
    """Aggregate: the least (doc_id, hash) with a doc_id."""
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash")))


def representatives(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component in linked (doc_id, hash, component_id, component_hash), one for each; rows of null doc_id stay."""
    kept = linked.where((F.col("doc_id") == F.col("component_id")) & (F.col("hash") == F.col("component_hash"))).select(F.col("doc_id").alias("k_id"), F.col("hash").alias("k_hash")).distinct()
    rows = whole_rows(docs, F.col("doc_id").alias("r_id"), F.xxhash64("text").alias("r_hash"))
    named = rows.join(kept, (F.col("r_id") == F.col("k_id")) & (F.col("r_hash") == F.col("k_hash")), "left_semi").dropDuplicates(["r_id", "r_hash"])
    return named.unionByName(rows.where("r_id IS NULL")).select("row.*")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
