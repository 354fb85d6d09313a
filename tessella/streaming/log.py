"""The request log as a stream: counts and latencies of event-time windows, late rows taken until the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(log: DataFrame, time: str, group: str, value: str, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """group, start, n, mean of each window of a log, streaming or not; null times are left out, times without a zone are in UTC."""
    zoned = log.schema[time].dataType.simpleString() == "timestamp"
    at = F.col(time) if zoned else F.to_timestamp(F.concat(F.col(time).cast("string"), F.lit("+00:00")))
    rows = log.where(F.col(time).isNotNull()).withColumn(time, at)
    if log.isStreaming:
        rows = rows.withWatermark(time, late)
    out = rows.groupBy(F.window(time, size).alias("w"), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(group, F.col("w.start").alias("start"), "n", "mean")


def kept(stream: DataFrame, folder: str) -> DataFrame:
    """Takes all that an aggregated stream has now and returns its whole result; each batch's result is a table of its own, and the last one holds."""
    spark = stream.sparkSession
    last: list[str] = []

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result-{n}")
        last[:] = [f"{folder}/result-{n}"]

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
