"""Identity, de-duplication and reference remapping.

Deterministic ids (``sha2(platform:native_id)``) make re-runs and task retries
agree, so the local->persisted id map of the reference becomes a key join.
Every step is a window or an equi-join on the natural key: it shuffles once on
the key and never gathers a group on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType


def entity_id(*cols) -> Column:
    """Deterministic id from the natural key parts."""
    return F.sha2(F.concat_ws(":", *[F.col(c) if isinstance(c, str) else c for c in cols]), 256)


def dedupe_last_wins(df: DataFrame, keys: Sequence[str], order: str = "item_seq") -> DataFrame:
    """One row per key, the **last** in scrape order; ``first_seq`` keeps first-seen order.

    An aggregate (``max_by`` over the row) instead of a window: it is partially aggregated on the
    map side, so a key holding a large share of the rows is reduced before the shuffle."""
    others = [c for c in df.columns if c not in keys and c != order]
    row = F.struct(*[F.col(c) for c in [order] + others])
    agg = df.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_r"), F.min(order).alias("first_seq"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in [order] + others], "first_seq")


def canonical_first_seen(df: DataFrame, keys: Sequence[str], order: str = "item_seq") -> DataFrame:
    """The first-seen row per key is canonical; references carry the key, not a row id.
    (``min_by`` aggregate, map-side combined like D1.)"""
    others = [c for c in df.columns if c not in keys and c != order]
    row = F.struct(*[F.col(c) for c in [order] + others])
    agg = df.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in [order] + others])


def _empty_to_null(c: Column, dtype) -> Column:
    if isinstance(dtype, StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(dtype, (ArrayType, MapType)):
        return F.when(F.size(c) > 0, c)
    return c


def merge_prefer_non_null(old: DataFrame, new: DataFrame, keys: Sequence[str],
                          keep_old: Sequence[str] = ()) -> DataFrame:
    """D3: incoming values win unless NULL, '', [] or {}; then the existing value is kept.
    Columns in ``keep_old`` (ids, creation times) always keep an existing value."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, list(keys), "full_outer")
    cols = [F.col(k) for k in keys]
    types = {f.name: f.dataType for f in new.schema.fields}
    for c in old.columns:
        if c in keys:
            continue
        if c in keep_old and c in types:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in types:
            cols.append(F.coalesce(_empty_to_null(F.col(f"n.{c}"), types[c]), F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}"))
    for c in new.columns:
        if c not in keys and c not in old.columns:
            cols.append(F.col(f"n.{c}"))
    return j.select(*cols)


def id_map(local: DataFrame, persisted: DataFrame, keys: Sequence[str], local_id: str = "local_id",
           persisted_id: str = "id") -> DataFrame:
    """Local id -> persisted id by natural key (for externally assigned ids)."""
    return (local.select(*keys, F.col(local_id).alias("local_id"))
            .join(persisted.select(*keys, F.col(persisted_id).alias("persisted_id")), list(keys), "inner")
            .select("local_id", "persisted_id"))


def fk_remap(df: DataFrame, fk: str, mapping: DataFrame) -> DataFrame:
    """Replace ``fk`` by its persisted id; keep the original when unmapped."""
    m = mapping.select(F.col("local_id").alias("_lid"), F.col("persisted_id").alias("_pid"))
    j = df.join(m, F.col(fk) == F.col("_lid"), "left")
    return j.withColumn(fk, F.coalesce(F.col("_pid"), F.col(fk))).drop("_lid", "_pid")


def relink_parents(comments: DataFrame, persisted: DataFrame) -> DataFrame:
    """A reply's ``parent_comment_id`` is set only when both reply and parent are persisted.

    Matching is on native ids within a platform for every platform.
    """
    parents = persisted.select(F.col("platform").alias("_pp"), F.col("platform_comment_id").alias("_pn"),
                               F.col("comment_id").alias("_pid"))
    live = persisted.select(F.col("platform").alias("_cp"), F.col("platform_comment_id").alias("_cn"))
    j = (comments.join(parents, (F.col("platform") == F.col("_pp")) & (F.col("parent_native_id") == F.col("_pn")), "left")
                 .join(live, (F.col("platform") == F.col("_cp")) & (F.col("platform_comment_id") == F.col("_cn")), "left"))
    return j.withColumn("parent_comment_id", F.when(F.col("_cn").isNotNull(), F.col("_pid"))) \
            .drop("_pp", "_pn", "_pid", "_cp", "_cn")


def distinct_tags(posts: DataFrame, col: str = "hashtags") -> DataFrame:
    """The distinct tag set of a batch."""
    return posts.select(F.explode(col).alias("tag")).where(F.col("tag") != "").distinct()
