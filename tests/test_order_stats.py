"""Positions, ranks and running sums over ranges equal the plain windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contentlake.operators.order_stats import ranged, statistics

SCHEMA = "g string, a long, b string, x long, _range string, _carry long"


def plain(df, keys, by, full):
    w = Window.partitionBy(*keys)
    return df.select("*", F.row_number().over(w.orderBy(*full)).cast("long").alias("pos"), F.rank().over(w.orderBy(*by)).cast("long").alias("rk"),
                     F.dense_rank().over(w.orderBy(*by)).cast("long").alias("dr"), F.count(F.lit(1)).over(w).alias("n"),
                     F.sum(F.coalesce("x", F.lit(0))).over(w.orderBy(*full).rowsBetween(Window.unboundedPreceding, 0)).alias("sx"))


@pytest.mark.parametrize("keys, up, values", [(["g"], True, 5), (["g"], False, 40), ([], True, 3), ([], False, 1)])
def test_statistics_equal_windows(spark, keys, up, values):
    r = random.Random(values)
    rows = [(r.choice(["hot"] * 6 + ["b", None, "c"]), r.choice([None, *range(values)]), f"t{i}", r.choice([None, 1, 2, 5]), "own", i)
            for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    by = [F.col("a").asc_nulls_first() if up else F.col("a").desc_nulls_last()]
    want = plain(df, keys, by, [*by, F.col("b").asc_nulls_first()])
    got = statistics(df, keys, [("a", up)], ["b"], position="pos", rank="rk", dense_rank="dr", group_size="n", sums={"sx": "x"}, ranges=13)
    key = lambda x: x["_carry"]
    assert sorted((x.asDict() for x in got.collect()), key=key) == sorted((x.asDict() for x in want.collect()), key=key)


def test_statistics_without_rows_and_with_repeated_rows(spark):
    none = spark.createDataFrame([], "g string, a long")
    assert statistics(none, ["g"], [("a", True)], position="p", rank="r", dense_rank="d", group_size="n").collect() == []
    same = spark.createDataFrame([("x", 1)] * 7, "g string, a long")
    assert sorted(x["p"] for x in statistics(same, ["g"], [("a", True)], position="p").collect()) == list(range(1, 8))


def test_a_hot_key_is_spread_over_ranges(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("a"))
    sizes = [x["count"] for x in ranged(df, ["g"], [F.col("a")], 8).groupBy("_range").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * 4000 / 8
