"""Deletes over a whole foreign-key graph (S25): a semi-naive fixpoint.

All foreign keys of all tables become one edge table (child table, child key, parent table, parent key,
action, column), written once. A frontier of newly deleted keys is joined to the edges of action
``cascade``; what is reached and was not deleted before is the next frontier, until it is empty. A round costs
one join of the frontier, whatever the number of foreign keys; self-references (replies of replies) need a
round per level and touch only the rows of that level. ``set_null`` edges of deleted parents are applied once
at the end. Cycles of references end, since a key enters the frontier once; null references point nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    on_delete: str = "cascade"


def _key(columns: Sequence[str]):
    return F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns])


def edges(tables: dict[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[ForeignKey]) -> DataFrame:
    """(child, child_key, parent, parent_key, action, column) of every row that refers to another."""
    parts = []
    for k in keys:
        df, pk = tables[k.child]
        parts.append(df.where(F.col(k.column).isNotNull()).select(
            F.lit(k.child).alias("child"), _key(pk).alias("child_key"), F.lit(k.parent).alias("parent"),
            F.col(k.column).cast("string").alias("parent_key"), F.lit(k.on_delete).alias("action"), F.lit(k.column).alias("column")))
    return materialize(reduce(DataFrame.unionByName, parts))


def deleted_keys(all_edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(tbl, key) of all rows that go when the rows of ``seeds`` (tbl, key) are deleted."""
    cascade = all_edges.where("action = 'cascade'").select(F.col("parent").alias("tbl"), F.col("parent_key").alias("key"), "child", "child_key")
    frontier = materialize(seeds.select("tbl", F.col("key").cast("string").alias("key")).distinct())
    gone = frontier
    while not frontier.isEmpty():
        reached = frontier.join(cascade, ["tbl", "key"]).select(F.col("child").alias("tbl"), F.col("child_key").alias("key")).distinct()
        frontier = materialize(reached.join(gone, ["tbl", "key"], "left_anti"))
        gone = gone.unionByName(frontier)
    return gone


def delete(tables: dict[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[ForeignKey], seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without the rows that go when the ``seeds`` (per table, a frame of its key columns) are deleted.

    ``tables`` gives each table's frame and key columns; a referred table has one key column. Columns of
    ``set_null`` keys whose parent goes become null."""
    all_edges = edges(tables, keys)
    first = reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("tbl"), _key(tables[t][1]).alias("key")) for t, df in seeds.items()])
    gone = materialize(deleted_keys(all_edges, first))
    out = {}
    for t, (df, pk) in tables.items():
        mine = gone.where(F.col("tbl") == t).select(F.col("key").alias("_gone"))
        left = df.join(mine, _key(pk) == F.col("_gone"), "left_anti")
        for k in keys:
            if k.child == t and k.on_delete == "set_null":
                lost = gone.where(F.col("tbl") == k.parent).select(F.col("key").alias("_lost"))
                left = left.join(lost, F.col(k.column).cast("string") == F.col("_lost"), "left") \
                           .withColumn(k.column, F.when(F.col("_lost").isNull(), F.col(k.column))).drop("_lost")
        out[t] = left
    return out
