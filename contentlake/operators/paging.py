"""Paged listing at any depth (S14): an offset index instead of a sort of the table per page.

The rows are cut once into ranges of (filter columns, order, id) and stored by range with the number of rows
of every (filter values, range). A page is then found by arithmetic: the counts say which ranges hold its
rows, only those are read and sorted, whatever the offset. The counts of one filter are at most as many rows
as there are ranges; they are added up in Spark and only the ranges of the page come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .merge import live
from .order_stats import RANGE, ranged


def _order(order_by: str, descending: bool, key: str):
    return [F.col(order_by).desc_nulls_last() if descending else F.col(order_by).asc_nulls_last(), F.col(key).asc_nulls_last()]


def write_page_index(df: DataFrame, path: str, order_by: str, descending: bool = True, key: str = "id", filters: Sequence[str] = (),
                     include_deleted: bool = False, ranges: int | None = None) -> None:
    """Store ``df`` for paging in this order; pages may filter by equality on the ``filters`` columns (all of
    them at once). Deleted rows stay out unless asked for."""
    rows = ranged(live(df, include_deleted), filters, _order(order_by, descending, key), ranges)
    rows.write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows")
    rows.groupBy(*filters, RANGE).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def page_of(spark: SparkSession, path: str, order_by: str, descending: bool = True, key: str = "id", filters: dict | None = None,
            limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the stored order, as ``merge.list_page`` would give them. A page
    beyond the end is empty. ``filters`` names every filter column of the index."""
    where = F.lit(True)
    for k, v in (filters or {}).items():
        where = where & F.col(k).eqNullSafe(F.lit(v))
    counts = spark.read.parquet(f"{path}/counts").where(where)
    at = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(RANGE, "n", F.coalesce(F.sum("n").over(at), F.lit(0)).alias("start"))
    held = starts.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).orderBy("start").collect()
    rows = spark.read.parquet(f"{path}/rows").where(where & F.col(RANGE).isin([r[RANGE] for r in held])).drop(RANGE)
    skip = offset - held[0]["start"] if held else 0
    return rows.orderBy(*_order(order_by, descending, key)).offset(skip).limit(limit)
