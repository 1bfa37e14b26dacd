"""Table maintenance without a database.

Parquet has no MERGE, so an upsert is a full outer join of the current
snapshot with the batch on the natural key, written as a new snapshot; with a
v2 catalog (Delta/Iceberg) the same plan is a ``MERGE INTO``. Everything is
joins and windows on keys; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .analytics import live
from .identity import merge_prefer_non_null


def list_page(df: DataFrame, filters: dict | None = None, order_by: str = "created_at", descending: bool = True,
              limit: int = 100, offset: int = 0, key: str = "id", include_deleted: bool = False) -> DataFrame:
    """Not-deleted rows, equality filters, ordered, ``offset``..``offset+limit`` (id breaks ties)."""
    d = live(df, include_deleted)
    for k, v in (filters or {}).items():
        d = d.where(F.col(k) == F.lit(v))
    o = F.col(order_by).desc() if descending else F.col(order_by).asc()
    return d.orderBy(o, F.col(key).asc()).offset(offset).limit(limit)


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], id_col: str = "id",
           created_col: str = "created_at", mode: str = "overwrite") -> DataFrame:
    """Natural-key upsert. Existing ``id``/``created_at`` are kept; every other column comes
    from the batch (``overwrite``: even NULL; ``prefer_non_null``: NULL/empty keeps the old value).
    Adds ``action`` = insert / update / keep."""
    if mode == "prefer_non_null":
        merged = merge_prefer_non_null(current, batch, keys, keep_old=[id_col, created_col])
        flags = current.select(*keys, F.lit(True).alias("_old")).join(
            batch.select(*keys, F.lit(True).alias("_new")), list(keys), "full_outer")
        out = merged.join(flags, list(keys), "left")
        return out.withColumn("action", F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep")
                              .otherwise("update")).drop("_old", "_new")
    o = current.alias("o").withColumn("_old", F.lit(True))
    n = batch.alias("n").withColumn("_new", F.lit(True))
    j = o.join(n, list(keys), "full_outer")
    cols = [F.col(k) for k in keys]
    for c in current.columns:
        if c in keys:
            continue
        if c in (id_col, created_col):
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in batch.columns
                        else F.col(f"o.{c}"))
        elif c in batch.columns:
            cols.append(F.when(F.col("_new").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}"))
    # Columns that only the batch has are added; rows it does not touch have none.
    cols += [F.col(f"n.{c}") for c in batch.columns if c not in current.columns]
    action = (F.when(F.col("_old").isNull(), F.lit("insert")).when(F.col("_new").isNull(), F.lit("keep"))
              .otherwise(F.lit("update")))
    return j.select(*cols, action.alias("action"))


def insert_new(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key already exists are rejected (left semi); the rest are appended (left anti)."""
    existing = current.select(*keys).distinct()
    rejects = batch.join(existing, list(keys), "left_semi")
    fresh = batch.join(existing, list(keys), "left_anti").dropDuplicates(list(keys))
    return fresh, rejects


def link_rows(posts: DataFrame, tags: DataFrame, current_links: DataFrame) -> DataFrame:
    """post<->tag links, idempotent: explode, resolve tag ids, de-duplicate, drop existing."""
    exploded = posts.select("post_id", F.explode("hashtags").alias("tag"))
    j = exploded.join(tags.select("tag", "hashtag_id"), "tag").select("post_id", "hashtag_id").dropDuplicates()
    return j.join(current_links.select("post_id", "hashtag_id"), ["post_id", "hashtag_id"], "left_anti")


def patch_by_id(current: DataFrame, patch: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Apply patch columns to matching ids (values set even when NULL); unknown ids are rejects."""
    pcols = [c for c in patch.columns if c != key]
    p = patch.select(F.col(key).alias("_pk"), *[F.col(c).alias(f"_p_{c}") for c in pcols])
    j = current.join(p, F.col(key) == F.col("_pk"), "left")
    cols = []
    for c in current.columns:
        if c in pcols:
            cols.append(F.when(F.col("_pk").isNotNull(), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    patched = j.select(*cols, F.col("_pk").isNotNull().alias("patched"))
    rejects = patch.join(current.select(key), key, "left_anti")
    return patched, rejects


def soft_delete(current: DataFrame, ids: DataFrame, key: str, at: Column, col: str = "deleted_at") -> DataFrame:
    """Set ``deleted_at`` (or ``is_archived``) for the given ids."""
    patch = ids.select(key).distinct().withColumn(col, at)
    patched, _ = patch_by_id(current, patch, key)
    return patched


def latest_status(events: DataFrame, key: str = "job_id", order: str = "event_seq") -> DataFrame:
    """Current state of each job = its last event (append-only job log)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def seed(current: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert reference rows, doing nothing on conflict."""
    return current.unionByName(rows.join(current.select(*keys), list(keys), "left_anti"))


def cascade_delete(parent_ids: DataFrame, child: DataFrame, fk: str, action: str = "cascade",
                   parent_key: str = "id") -> DataFrame:
    """Children of deleted parents are removed (cascade) or detached (set_null)."""
    deleted = parent_ids.select(F.col(parent_key).alias("_del")).distinct()
    if action == "cascade":
        return child.join(deleted, F.col(fk) == F.col("_del"), "left_anti")
    j = child.join(deleted, F.col(fk) == F.col("_del"), "left")
    return j.withColumn(fk, F.when(F.col("_del").isNull(), F.col(fk))).drop("_del")
