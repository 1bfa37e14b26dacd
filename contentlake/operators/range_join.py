"""Interval and as-of joins without an equality key.

Spark joins on a range condition alone by comparing all pairs. Here both sides are cut at borders: quantiles
of the points, as many as the shuffle has partitions, so every range holds about the same number of points.

* ``interval_join``: a point goes to its range, an interval is copied only to the ranges that it touches; the
  join is an equality join on the range with the interval condition inside.
* ``asof_join``: both sides are put in one order (``order_stats.ranged``); inside a range a window takes the last
  row of the right side, and the last one of all ranges before is carried over by one row per range.

Rows with a null time, bound or key match nothing (an as-of row of the left side is kept with nulls). Right
rows of equal times: the one with the greatest tie column counts. Intervals are closed at the start, open at
the end; empty ones match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order_stats import _free, _same, ranged


def _number(c: Column, kind: str) -> Column:
    """Times as micros, everything else as it is, for quantiles and buckets."""
    return F.unix_micros(c.cast("timestamp")).cast("double") if "time" in kind or kind == "date" else c.cast("double")


def borders(points: DataFrame, column: str, ranges: int) -> list[float]:
    """At least one and at most ``ranges - 1`` increasing borders (driver: one number per range)."""
    ranges = max(2, ranges)
    kind = dict(points.dtypes)[column]
    cuts = points.select(_number(F.col(column), kind).alias("x")).where("x is not null") \
                 .agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(cuts or [0.0]))


def _bucketed(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """``df`` with the number of borders at or below the value (a binary search in the JVM)."""
    from pyspark.ml.feature import Bucketizer
    x = _free(df, "_x")
    df = df.withColumn(x, _number(F.col(column), dict(df.dtypes)[column])).where(F.col(x).isNotNull())
    out = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=x, outputCol=name, handleInvalid="keep").transform(df)
    return out.drop(x)


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, ranges: int | None = None) -> DataFrame:
    """All (point, interval) with start <= at < end; columns of both sides, which must differ in name."""
    n = ranges or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = borders(points, at, n)
    p = _bucketed(points, at, cuts, "_bucket").withColumn("_bucket", F.col("_bucket").cast("int"))
    i = intervals.where(F.col(start) < F.col(end))
    i = _bucketed(_bucketed(i, start, cuts, "_first"), end, cuts, "_last")
    i = i.withColumn("_bucket", F.explode(F.sequence(F.col("_first").cast("int"), F.col("_last").cast("int")))).drop("_first", "_last")
    return p.join(i, "_bucket").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def asof_join(left: DataFrame, left_at: str, right: DataFrame, right_at: str, values: Sequence[str], tie: str, by: Sequence[str] = (),
              ranges: int | None = None) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` at or before it (null where none is),
    per value of the ``by`` columns, which both sides have, or over all rows without them."""
    row, at, kind, order, seen = (_free(left, c) for c in ("_row", "_at", "_kind", "_order", "_seen"))
    packed = F.struct(*[F.col(c) for c in values])
    l = left.select(*by, F.col(left_at).alias(at), F.lit(1).alias(kind), F.lit(None).cast(right.schema[tie].dataType).alias(order),
                    F.struct("*").alias(row), F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType).alias(seen))
    r = right.where(F.col(right_at).isNotNull()).select(*by, F.col(right_at).alias(at), F.lit(0).alias(kind), F.col(tie).alias(order),
                                                       F.lit(None).cast(l.schema[row].dataType).alias(row), packed.alias(seen))
    cols = [F.col(at).asc_nulls_first(), F.col(kind), F.col(order).asc_nulls_first()]
    part = _free(l, "_range")
    cut = ranged(l.unionByName(r), by, cols, ranges, part)
    inside = Window.partitionBy(*by, part).orderBy(*cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cut.withColumn("_here", F.last(seen, ignorenulls=True).over(inside))
    last = cut.where(F.col(kind) == 0).groupBy(*by, part).agg(F.max_by(F.col(seen), F.struct(at, order)).alias("_last"))
    every = cut.select(*by, part).distinct().join(last, [*by, part], "left") if not by else \
        cut.select(*by, part).distinct().alias("a").join(last.alias("b"), [_same(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in (*by, part)], "left") \
           .select(*[F.col(f"a.{c}") for c in (*by, part)], "_last")
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(part).alias("_p"),
                         F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    on = [F.col(part) == F.col("_p"), *[_same(F.col(c), F.col(f"_b{i}")) for i, c in enumerate(by)]]
    out = rows.where(F.col(kind) == 1).join(carry, on)
    known = F.col(at).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    got = F.when(known, F.coalesce("_here", "_carried"))
    return out.select(f"{row}.*", *[got[c].alias(c) for c in values])
