"""Running values over groups of any size: per range of the order, then carried from range to range.

A group is not one task's work, as it is with a window over it. Rows are dealt to ranges of (group, order), so a large group has many
ranges; a window runs within a range, and what a group's earlier ranges add up to is carried into it. Only the first group of a
range can have begun in an earlier one, so the carried table has fewer rows than there are ranges, which bounds its broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.storage import temporary, written


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, ranges: int = 0) -> DataFrame:
    """df with a column for each of ``sums`` and ``maxima``: its sum (nulls count nothing) or maximum over the group's rows up to this one.

    order: columns that tell a group's rows apart; rows alike in all of them are interchangeable. Nulls come first, and null groups are groups. ranges: as many as the session's shuffle partitions
    if not given. Names beginning with ``_run_`` are ours."""
    sums, maxima = dict(sums or {}), dict(maxima or {})
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    valued = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_run_{k}") for k, c in sums.items()], *[c.alias(f"_run_{k}") for k, c in maxima.items()])
    dealt = written(valued.repartitionByRange(ranges, *group, *order).withColumn("_run_part", F.spark_partition_id()), temporary(spark, "ranges"))
    by_part = dealt.groupBy(*group, "_run_part").agg(*[F.sum(f"_run_{k}").alias(f"_sum_{k}") for k in sums], *[F.max(f"_run_{k}").alias(f"_max_{k}") for k in maxima])
    before = Window.partitionBy(*group).orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_part.select(
        *[F.col(g).alias(f"_run_group_{i}") for i, g in enumerate(group)], F.col("_run_part").alias("_run_at"), F.count("*").over(before).alias("_run_parts"),
        *[F.sum(f"_sum_{k}").over(before).alias(f"_run_carry_{k}") for k in sums], *[F.max(f"_max_{k}").over(before).alias(f"_run_carry_{k}") for k in maxima],
    ).where("_run_parts > 0")
    same = F.col("_run_part") == F.col("_run_at")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_run_group_{i}"))
    inside = Window.partitionBy("_run_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = dealt.select("*", *[F.sum(f"_run_{k}").over(inside).alias(f"_run_in_{k}") for k in sums], *[F.max(f"_run_{k}").over(inside).alias(f"_run_in_{k}") for k in maxima])
    joined = inner.join(F.broadcast(carried), same, "left")
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_run_in_{k}") + F.coalesce(f"_run_carry_{k}", F.lit(0))).alias(k) for k in sums], *[F.greatest(f"_run_in_{k}", f"_run_carry_{k}").alias(k) for k in maxima]
    )


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """df with each row's place in its group, from 1."""
    return running(df, group, order, {name: F.lit(1).cast("long")})
