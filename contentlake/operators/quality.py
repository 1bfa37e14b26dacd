"""Data-quality checks from the declared constraints (DQ1-DQ5): each returns counts, never rows to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DQ1: keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """DQ2: child rows whose non-NULL foreign key has no parent (left anti)."""
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(p, F.col(fk) == F.col("_pk"), "left_anti")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """DQ3/DQ4: per named rule, the number of rows where it fails (one scan, ``count_if`` each)."""
    agg = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
    names = list(checks)
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return agg.selectExpr(f"stack({len(names)}, {stack}) as (rule, n_violations)")
