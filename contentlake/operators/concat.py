"""Ordered string concatenation per group, in two levels.

Level 1 joins the texts inside fixed spans of the ordering key (``order div span``); level 2 joins
the partial strings in order. No task ever gathers more than one span of rows of a group, so a
group holding a large share of the rows is spread over many tasks until its final string."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_concat(df: DataFrame, keys: Sequence[str], order: str, text: str, sep: str, out: str,
                   span: int = 1024) -> DataFrame:
    """``keys`` + ``out``: ``text`` values joined by ``sep`` in ``order`` (a numeric column)."""
    keys = list(keys)
    lvl1 = (df.withColumn("_chunk", F.floor(F.col(order) / span))
            .groupBy(*keys, "_chunk")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("xs"))
            .select(*keys, F.col("xs")[0]["o"].alias("o"), F.array_join(F.transform("xs", lambda x: x["t"]), sep).alias("t")))
    lvl2 = lvl1.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("xs"))
    return lvl2.select(*keys, F.array_join(F.transform("xs", lambda x: x["t"]), sep).alias(out))
