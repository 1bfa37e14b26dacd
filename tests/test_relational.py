"""Deep pages, foreign-key deletes, interval and as-of joins, threads of one hot root against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contentlake.operators import fk_graph as FK
from contentlake.operators import merge as M
from contentlake.operators import paging as PG
from contentlake.operators import range_join as RJ
from contentlake.operators.chat import threads


def test_pages_equal_the_sorted_table(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.choice("ab"), r.choice([None, *range(9)]), None if i % 10 else dt.datetime(2024, 1, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, kind string, n long, deleted_at timestamp_ntz").repartition(4)
    for down in (True, False):
        path = str(tmp_path / f"p{down}")
        PG.write_page_index(df, path, "n", down, "id", ["kind"], ranges=7)
        for offset, limit in ((0, 5), (17, 40), (120, 30), (1000, 3), (3, 0)):
            want = df.where("deleted_at is null and kind = 'a'").orderBy(F.col("n").desc_nulls_last() if down else F.col("n").asc_nulls_last(), "id")
            got = PG.page_of(spark, path, "n", down, "id", {"kind": "a"}, limit, offset)
            assert [x["id"] for x in got.collect()] == [x["id"] for x in want.offset(offset).limit(limit).collect()], (down, offset)
    assert [x["id"] for x in M.list_page(df, {"kind": "b"}, "id", False, 3).collect()] == [x[0] for x in rows if x[1] == "b" and x[3] is None][:3]


def test_a_page_reads_its_ranges_only(spark, tmp_path):
    df = spark.range(5000).select("id", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    PG.write_page_index(df, str(tmp_path / "p"), "id", False, "id", ranges=10)
    plan = PG.page_of(spark, str(tmp_path / "p"), "id", False, "id", limit=20, offset=2500)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan or "_range#" in plan.split("PartitionFilters:")[1][:200]


def test_deletes_travel_the_graph(spark):
    """A chain of fifty replies, a cycle, set-null and two ways to the same row."""
    t = {"users": (spark.createDataFrame([(i,) for i in range(5)], "u long"), ["u"]),
         "posts": (spark.createDataFrame([(i, i % 5) for i in range(20)], "p long, u long"), ["p"]),
         "replies": (spark.createDataFrame([(f"c{i}", 3, f"c{i - 1}" if i else None, 4) for i in range(51)] + [("x", 8, "y", 1), ("y", 9, "x", 1), ("z", 9, None, None)],
                                           "c string, p long, parent string, u long"), ["c"]),
         "logs": (spark.createDataFrame([(i, i % 20 if i % 3 else None) for i in range(40)], "l long, p long"), ["l"]),
         "pairs": (spark.createDataFrame([(1, "c50"), (2, "z"), (8, "x")], "p long, c string"), ["p", "c"])}
    keys = [FK.ForeignKey("posts", "u", "users"), FK.ForeignKey("replies", "p", "posts"), FK.ForeignKey("replies", "parent", "replies"),
            FK.ForeignKey("replies", "u", "users", "set_null"), FK.ForeignKey("logs", "p", "posts", "set_null"),
            FK.ForeignKey("pairs", "p", "posts"), FK.ForeignKey("pairs", "c", "replies")]
    left = FK.delete(t, keys, {"replies": spark.createDataFrame([("c0",), ("x",)], "c string"), "users": spark.createDataFrame([(1,)], "u long")})
    assert [x["u"] for x in left["users"].orderBy("u").collect()] == [0, 2, 3, 4]
    gone = {i for i in range(20) if i % 5 == 1}
    assert {x["p"] for x in left["posts"].collect()} == set(range(20)) - gone
    assert [tuple(x) for x in left["replies"].collect()] == [("z", 9, None, None)]
    assert {(x["l"], x["p"]) for x in left["logs"].collect()} == {(i, None if not i % 3 or i % 20 in gone else i % 20) for i in range(40)}
    assert [tuple(x) for x in left["pairs"].collect()] == [(2, "z")]
    assert left["replies"].columns == ["c", "p", "parent", "u"]


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_interval_join_equals_all_pairs(spark, ranges):
    r = random.Random(ranges)
    points = [(i, r.choice([None, 5, 5, 5, *range(60)])) for i in range(200)]
    spans = [(f"s{i}", a, a + r.choice([-3, 0, 1, 7, 90])) for i, a in enumerate(r.choices(range(-5, 60), k=60))] + [("n", None, 4), ("m", 4, None)]
    got = RJ.interval_join(spark.createDataFrame(points, "id long, at long"), "at", spark.createDataFrame(spans, "span string, lo long, hi long"), "lo", "hi", ranges)
    want = sorted((i, s) for i, x in points for s, lo, hi in spans if None not in (x, lo, hi) and lo <= x < hi)
    assert sorted((x["id"], x["span"]) for x in got.collect()) == want
    assert "Cartesian" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan


@pytest.mark.parametrize("by", [[], ["g"]])
def test_asof_join_equals_plain(spark, by):
    r = random.Random(len(by))
    left = [(i, r.choice("ab") if i % 9 else None, r.choice([None, *range(40)]), "own") for i in range(120)]
    right = [(i, r.choice("abc") if i % 7 else None, r.choice([None, 5, 5, *range(0, 40, 4)]), i * 1.5 if i % 3 else None) for i in range(40)]
    l = spark.createDataFrame(left, "id long, g string, at long, _range string").repartition(3)
    got = RJ.asof_join(l, "at", spark.createDataFrame(right, "r long, g string, at long, v double"), "at", ["r", "v"], "r", by, ranges=6)
    assert got.columns == ["id", "g", "at", "_range", "r", "v"]
    out = {x["id"]: (x["r"], x["v"]) for x in got.collect()}
    assert len(out) == len(left)
    for i, g, at, _ in left:
        fit = [x for x in right if at is not None and x[2] is not None and x[2] <= at and (not by or (g is not None and x[1] == g))]
        best = max(fit, key=lambda x: (x[2], x[0]), default=None)
        assert out[i] == ((best[0], best[3]) if best else (None, None)), i


def test_one_hot_thread_is_spread(spark):
    """One thread with a third of all rows, all of one time: positions as by a window, no range above twice the mean."""
    n = 900
    rows = [("r", None, dt.datetime(2024, 1, 1))] + [(f"c{i:04}", "r", dt.datetime(2024, 1, 2)) for i in range(n // 3)]
    rows += [(f"d{i}", None, dt.datetime(2024, 1, 1)) for i in range(2 * n // 3)]
    c = spark.createDataFrame(rows, "comment_id string, parent_comment_id string, posted_at timestamp_ntz").repartition(4)
    got = {x["comment_id"]: (x["root_id"], x["position"], x["thread_size"]) for x in threads(c, ranges=12).collect()}
    assert got["r"] == ("r", 1, n // 3 + 1) and all(got[f"c{i:04}"] == ("r", i + 2, n // 3 + 1) for i in range(n // 3))
    assert all(got[f"d{i}"] == (f"d{i}", 1, 1) for i in range(2 * n // 3))
