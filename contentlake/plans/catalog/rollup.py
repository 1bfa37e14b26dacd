"""Dashboards kept up to date over three batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators.rollup import Rollup, dashboard_cells
from ...session import checkpoint_dir, materialize
from ..registry import register


def post_batches(t):
    """Three batches of posts: all of them with the engagement of the first third of the events' time, those
    touched in the second third, those touched in the last third and the soft-deleted ones. Each row
    carries its post's totals so far."""
    first, last = t.events.agg(F.min("ts"), F.max("ts")).first()
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = F.unix_micros(F.lit(first).cast("timestamp")), F.unix_micros(F.lit(last).cast("timestamp"))
    third = F.coalesce(F.least(F.floor(3 * (micros - low) / (high - low)), F.lit(2)), F.lit(0)) + 1
    e = t.events.select(F.col("user_id").alias("post_id"), third.alias("third"), (F.col("event_type") != "view").cast("int").alias("counts"))
    e = e.groupBy("post_id").agg(*(F.sum(F.when(F.col("third") <= r, F.col("counts")).otherwise(0)).alias(f"e{r}") for r in (1, 2, 3)),
                                 *(F.count_if(F.col("third") == r).alias(f"c{r}") for r in (1, 2, 3)))
    p = t.posts.select("post_id", "platform", F.date_format("posted_at", "yyyy-MM-dd").alias("day"), F.col("hashtags").alias("tags"), "deleted_at")
    p = materialize(p.join(e, "post_id", "left"))
    alive = F.lit(None).cast("timestamp_ntz")
    wanted = {1: F.lit(True), 2: F.col("c2") > 0, 3: (F.col("c3") > 0) | F.col("deleted_at").isNotNull()}
    for r, touched in wanted.items():
        yield r, p.where(touched).withColumn("deleted_at", F.col("deleted_at") if r == 3 else alive) \
                  .select("post_id", "platform", "day", "tags", "deleted_at", F.col(f"e{r}").alias("engagement"), F.lit(r).alias("version"))


@register("dashboard_incremental", """
    with x as (select p.post_id, p.platform, strftime(p.posted_at, '%Y-%m-%d') as day, p.hashtags,
                      coalesce(e.likes, 0) + coalesce(e.shares, 0) + coalesce(e.comments_count, 0) + coalesce(e.saves, 0) as engagement
               from posts p left join engagement e on e.post_id = p.post_id where p.deleted_at is null)
    select 'platform' as grain, platform, cast(null as varchar) as day, cast(null as varchar) as tag,
           count(*) as n_posts, cast(sum(engagement) as bigint) as engagement from x group by platform
    union all select 'day', platform, day, null, count(*), cast(sum(engagement) as bigint) from x group by platform, day
    union all select 'tag', platform, null, t.tag, count(*), cast(sum(engagement) as bigint)
              from x cross join unnest(x.hashtags) as t(tag) group by platform, t.tag""")
def dashboard_incremental(t):
    """Posts and engagement per platform, day and tag after three batches with updates and soft
    deletes, from signed partial sums; the oracle computes them from the last rows."""
    path = f"{checkpoint_dir(t.spark)}/rollup-{uuid.uuid4().hex}"
    kept = Rollup(t.spark, path, "post_id", "version", dashboard_cells(), {"engagement": F.col("engagement")},
                  F.col("deleted_at").isNull(), "n_posts")
    for run, batch in post_batches(t):
        kept.apply(batch, run)
    return kept.read()
