"""Running values over ranges against plain loops."""

import random

from pyspark.sql import functions as F

from tessella.operators import prefix


def test_running_values_of_groups_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i if i % 9 else None, rng.choice([None, -3, 0, 1, 7, 20 + i]), "z") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, v long, n string").withColumn("id", F.col("v") * 0 + 1)
    # rows of equal order have equal values here, so that any order of theirs gives the same
    df = df.withColumn("v", F.when(F.col("o").isNull(), 1).otherwise(F.col("v")))
    got = prefix.running(df, ["g"], ["o"], {"s": F.col("v"), "k": F.lit(1)}, {"m": F.col("v")}, ranges=13).collect()
    assert len(got) == len(rows)
    for g in ("hot", "a", "b", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.o is not None, r.o or 0, r.k))
        s, m = 0, None
        for i, r in enumerate(mine):
            s += r.v or 0
            m = r.v if m is None else m if r.v is None else max(m, r.v)
            assert (r.s, r.m, r.k) == (s, m, i + 1)


def test_numbered_empty_and_single(spark):
    empty = spark.createDataFrame([], "g string, o int")
    assert prefix.numbered(empty, ["g"], ["o"]).collect() == []
    assert [tuple(r) for r in prefix.numbered(spark.createDataFrame([("x", 5)], "g string, o int"), ["g"], ["o"], "place").collect()] == [("x", 5, 1)]
