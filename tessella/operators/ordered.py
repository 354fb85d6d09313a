"""Joins and statistics over an order, for groups of any size: as-of joins, overlaps of intervals, exact quantiles, sliding percentiles.

None of them gathers a group: they rest on running values over ranges (``prefix``), on bins, or on blocks of a bounded number of rows with the rows before that they need.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.prefix import numbered, running


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, take: Sequence[str]) -> DataFrame:
    """left with columns ``take`` of the last row of right, of equal ``by``, whose ``right_at`` is not after ``left_at``; nulls where there is none.

    Of right rows at one place the one of the largest values counts. Null places on the left find nothing, on the right are left out."""
    keys = [f"_by_{i}" for i in range(len(by))]
    last = F.struct(F.col(right_at).alias("_place"), *take)
    one = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(last).schema[0].dataType).alias("_last"))
    two = right.where(F.col(right_at).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(right_at).cast(left.schema[left_at].dataType).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), last.alias("_last"))
    # rows alike stay apart by their own hash, so that a crowd at one place is dealt to many ranges
    both = one.unionByName(two).withColumn("_tie", F.xxhash64("_row", "_last"))
    filled = running(both, keys, ["_at", "_side", "_tie"], maxima={"_found": F.col("_last")}).where("_side = 1")
    return filled.select("_row.*", *[F.when(F.col("_at").isNotNull(), F.col(f"_found.{c}")).alias(c) for c in take])


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], start: str = "start", stop: str = "stop", width: int = 2048) -> DataFrame:
    """left as struct ``l`` and right as struct ``r`` for pairs of equal ``by`` whose intervals [start, stop) share a place, each once.

    Intervals are put in the bins of ``width`` that they touch; a pair belongs to the bin where the later of the two starts, so only rows
    that share a bin meet. An interval of length w is in w / width + 2 bins at most. Empty intervals and null bounds meet nothing."""

    def binned(df: DataFrame, name: str) -> DataFrame:
        fine = df.where(F.col(start).isNotNull() & (F.col(start) < F.col(stop)))
        bins = F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor((F.col(stop) - 1) / width).cast("long"))
        return fine.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.explode(bins).alias("_bin"), F.struct(*df.columns).alias(name))

    keys = [f"_{i}" for i in range(len(by))] + ["_bin"]
    met = binned(left, "l").join(binned(right, "r"), keys)
    first, last = F.greatest(f"l.{start}", f"r.{start}"), F.least(f"l.{stop}", f"r.{stop}")
    return met.where((first < last) & (F.floor(first / width) == F.col("_bin"))).select("l", "r")


def quantiles(df: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """group, n and q, the exact quantiles at ``shares`` (between ranks by proportion) of its values that are not null.

    Equal values are counted before anything moves; their counts' running sums over ranges tell which value stands at a rank."""
    counts = df.groupBy(group, value).agg(F.count(value).alias("k"))
    run = running(counts, [group], [value], {"c": F.col("k")})
    n = counts.groupBy(F.col(group).alias("_g")).agg(F.sum("k").alias("n"))
    joined = run.join(n, F.col(group).eqNullSafe(F.col("_g")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("c") - F.col("k") < rank) & (rank <= F.col("c")), F.col(value).cast("double")))

    place = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    found = joined.groupBy(group).agg(F.first("n").alias("n"), *[at(F.floor(p) + 1).alias(f"_lo{i}") for i, p in enumerate(place)], *[at(F.ceil(p) + 1).alias(f"_hi{i}") for i, p in enumerate(place)])
    parts = [F.col(f"_lo{i}") + (p - F.floor(p)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i, p in enumerate(place)]
    return found.select(group, "n", F.array(*parts).alias("q"))


def sliding_percentile(df: DataFrame, key: str, value: str, order: Sequence[str], last: int, share: float, name: str = "percentile", group: str | None = None, block: int = 8192) -> DataFrame:
    """key and, for each row, the nearest-rank percentile (half-even index) of the values of the ``last`` rows up to it, in order (which tells rows apart), of its group.

    Null values take a place in the window and no rank; without any value it is null. A block of rows and the last - 1 before it are one task's work, by a sorted list of the window."""
    kept = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), (F.col(group) if group else F.lit(0)).alias("g"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    placed = numbered(kept, ["g"], [f"_o{i}" for i in range(len(order))], "n")
    own = F.floor((F.col("n") - 1) / block)
    dealt = placed.select("key", "value", "g", "n", F.explode(F.sequence(own, F.floor((F.col("n") + (last - 2)) / block))).alias("b"))
    kind = df.schema[key].dataType.simpleString()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        held: list[float] = []
        window: deque = deque()
        keys, out, begin = [], [], int(rows["b"].iloc[0]) * block
        for k, v, n in zip(rows["key"].tolist(), rows["value"].tolist(), rows["n"].tolist()):
            window.append((n, v))
            if v == v:
                insort(held, v)
            while window[0][0] <= n - last:
                old = window.popleft()[1]
                if old == old:
                    del held[bisect_left(held, old)]
            if n > begin:
                keys.append(k)
                out.append(held[round(share * (len(held) - 1))] if held else math.nan)
        return pd.DataFrame({"key": pd.Series(keys, dtype=rows["key"].dtype), "p": pd.Series(out, dtype=float)})

    found = dealt.groupBy("g", "b").applyInPandas(one, f"key {kind}, p double")
    return found.select(F.col("key").alias(key), F.when(~F.isnan("p"), F.col("p")).alias(name))
