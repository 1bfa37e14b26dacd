"""Positions, ranks and running sums in groups of any size.

A window over a key sorts all rows of that key in one task, so a key that holds a third of all rows
holds up the job however many machines there are. Here the rows are cut into ranges of the whole
order (key, order columns): Spark samples the borders, so a hot key spreads over as many ranges as it
needs. Inside a range an ordinary window numbers the rows of each key; what a range passes on to the
next one (how many rows, how many distinct values, where the last group of equal values began, the
sums) is one row per (key, range), added up by a small window, and joined back.

The work is two shuffles of the rows, one by range and one by (key, range), and a third one of one
row per (key, range). The ranged rows are written to the shared checkpoint folder first, so that every
later step, and a task that runs again, sees the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

RANGE = "_range"


def _free(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int | None = None,
           name: str = RANGE) -> DataFrame:
    """The rows with ``name``, the number of their range: ranges cut the order (keys, order) into
    parts of about equal size, rows of equal keys and order values share one. Written once."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys], *order)
    return materialize(cut.withColumn(name, F.spark_partition_id()))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def statistics(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], ties: Sequence[str] = (), *,
               position: str | None = None, rank: str | None = None, dense_rank: str | None = None,
               sums: dict[str, str] | None = None, group_size: str | None = None, ranges: int | None = None) -> DataFrame:
    """The rows of ``df`` with the asked statistics of each key (all rows are one group without keys).

    ``order`` lists (column, ascending); nulls come first where ascending, last where descending.
    ``ties`` are ascending columns that tell rows with equal order values apart: they take part in
    positions, running sums and the cut into ranges, not in ranks.

    * ``position``: number of the row in its key, from 1 (rows equal in everything: any order)
    * ``rank``, ``dense_rank``: as in SQL, of the order values alone
    * ``sums``: {new column: column}: running sum up to and with the row, nulls counting as 0
    * ``group_size``: number of rows of the key

    Null keys are a key of their own. An empty table stays empty. Integer sums are exact; the sum of
    floating-point values depends on the ranges in its last digits."""
    by = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
    full = by + [F.col(c).asc_nulls_first() for c in ties]
    sums = sums or {}
    r, rn, rk, dn, peer, was = (_free(df, c) for c in (RANGE, "_rn", "_rk", "_dn", "_peer", "_carry"))
    run = [_free(df, f"_run{i}") for i in range(len(sums))]
    cut = ranged(df, keys, full, ranges, r)
    inside = Window.partitionBy(*keys, r)
    cols = [F.row_number().over(inside.orderBy(*full)).cast("long").alias(rn)]
    ranks = rank is not None or dense_rank is not None
    if ranks:
        cols += [F.rank().over(inside.orderBy(*by)).cast("long").alias(rk), F.dense_rank().over(inside.orderBy(*by)).cast("long").alias(dn),
                 F.struct(*[F.col(c).alias(f"v{i}") for i, (c, _) in enumerate(order)]).alias(peer)]
    frame = inside.orderBy(*full).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols += [F.sum(F.coalesce(F.col(c), F.lit(0))).over(frame).alias(run[i]) for i, c in enumerate(sums.values())]
    rows = cut.select("*", *cols)

    # What each range holds of each key: one row, however many the range has.
    part = [F.max(rn).alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"s{i}") for i, c in enumerate(sums.values())]]
    if ranks:
        part += [F.max(dn).alias("d"), F.max(rk).alias("last_at"), F.min_by(peer, rn).alias("first"), F.max_by(peer, rn).alias("last")]
    held = rows.groupBy(*keys, r).agg(*part)
    before = Window.partitionBy(*keys).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    carry = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(r).alias("_r"), prior("n").alias("_n"),
                        F.sum("n").over(Window.partitionBy(*keys)).alias("_size"), *[prior(f"s{i}").alias(f"_s{i}") for i in range(len(sums))],
                        *([F.col(c).alias(f"_{c}") for c in ("d", "last_at", "first", "last")] if ranks else []))
    if ranks:
        ks = [f"_k{i}" for i in range(len(keys))]
        at = Window.partitionBy(*ks).orderBy("_r")
        # The first group of equal values goes on from the range before.
        carry = carry.withColumn("_on", F.coalesce(_same(F.col("_first"), F.lag("_last").over(at)) & (F.col("_n") > 0), F.lit(False)))
        begun = F.when(~(F.col("_on") & (F.col("_d") == 1)), F.col("_n") + F.col("_last_at"))
        past = at.rowsBetween(Window.unboundedPreceding, -1)
        carry = carry.withColumn("_begun", F.last(begun, ignorenulls=True).over(past)) \
                     .withColumn("_dn", F.coalesce(F.sum(F.col("_d") - F.col("_on").cast("long")).over(past), F.lit(0)))
    carry = carry.select(F.struct("*").alias(was))
    of = lambda c: F.col(was)[c]
    on = reduce(lambda a, b: a & b, [_same(F.col(k), of(f"_k{i}")) for i, k in enumerate(keys)], F.col(r) == of("_r"))
    out = rows.join(carry, on)
    kept = [F.col(c) for c in df.columns]
    if position is not None:
        kept.append((of("_n") + F.col(rn)).alias(position))
    if rank is not None:
        kept.append(F.when(of("_on") & (F.col(dn) == 1), of("_begun")).otherwise(of("_n") + F.col(rk)).alias(rank))
    if dense_rank is not None:
        kept.append((of("_dn") + F.col(dn) - of("_on").cast("long")).alias(dense_rank))
    kept += [(of(f"_s{i}") + F.col(run[i])).alias(name) for i, name in enumerate(sums)]
    if group_size is not None:
        kept.append(of("_size").alias(group_size))
    return out.select(*kept)
