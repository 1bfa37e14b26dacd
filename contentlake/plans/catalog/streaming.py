"""Streaming jobs (T1-T3) run with availableNow into file sinks under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...streaming import jobs as S
from ..registry import register

EV = "events.parquet"


def _path(t):
    return f"{t.sf_dir}/{EV}"


@register("stream_dedup", """select distinct event_id, user_id, event_type, ts from events""")
def stream_dedup(t):
    """The event stream delivered twice; duplicates within the watermark dropped."""
    out = S.dedup_stream(t.spark, _path(t))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


CLOSED = "(select max(ts) - interval 1 hour from events)"


@register("stream_tumbling", f"""
    select time_bucket(interval 1 day, ts) as window_start, time_bucket(interval 1 day, ts) + interval 1 day as window_end,
      event_type, count(*) as n, round(sum(value), 6) as total
    from events group by 1, 2, 3 having time_bucket(interval 1 day, ts) + interval 1 day <= {CLOSED}""")
def stream_tumbling(t):
    """Daily tumbling windows per event type; windows still open at the end are not emitted (append)."""
    out = S.windowed_counts(t.spark, _path(t), "1 day")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n",
                      F.round("total", 6).alias("total"))


@register("stream_late_drop", f"""
    select time_bucket(interval 1 day, ts) as window_start, time_bucket(interval 1 day, ts) + interval 1 day as window_end,
      event_type, count(*) as n, round(sum(value), 6) as total
    from events group by 1, 2, 3 having time_bucket(interval 1 day, ts) + interval 1 day <= {CLOSED}""")
def stream_late_drop(t):
    """A later landing of replayed events 5 days in the past is behind the watermark and dropped:
    the daily windows equal those of the on-time stream."""
    out = S.late_data_counts(t.spark, _path(t))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n",
                      F.round("total", 6).alias("total"))


@register("stream_sliding", f"""
    select ws as window_start, ws + interval 1 day as window_end, event_type, count(*) as n, round(sum(value), 6) as total
    from (select time_bucket(interval 12 hours, ts) as ws, event_type, value from events
          union all select time_bucket(interval 12 hours, ts) - interval 12 hours, event_type, value from events)
    group by 1, 2, 3 having ws + interval 1 day <= {CLOSED}""")
def stream_sliding(t):
    """1-day windows sliding every 12 hours."""
    out = S.windowed_counts(t.spark, _path(t), "1 day", "12 hours")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n",
                      F.round("total", 6).alias("total"))


@register("stream_session", f"""
    select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n
    from (select user_id, ts, sum(brk) over (partition by user_id order by ts, event_id) as sid
          from (select user_id, ts, event_id,
                  case when lag(ts) over (partition by user_id order by ts, event_id) is null
                         or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minutes
                       then 1 else 0 end as brk from events))
    group by user_id, sid having max(ts) + interval 30 minutes <= {CLOSED}""")
def stream_session(t):
    """Per-user session windows with a 30 minute gap."""
    out = S.session_counts(t.spark, _path(t), "30 minutes")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                      F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


from .raw_oracle import strip as _strip  # noqa: E402

IG_MAP = "map {'video':'reel','clips':'reel','igtv':'video','sidecar':'post','image':'post','feed':'post'}"


@register("stream_ingest", f"""
    select 'instagram' as platform, coalesce(j->>'$.id', j->>'$.shortCode', '') as platform_post_id,
      coalesce({_strip("case when item_seq % 5 = 0 and j->>'$.caption' is not null then 'EDITED ' || (j->>'$.caption') else coalesce(j->>'$.caption', j->>'$.text') end")}, '') as caption,
      coalesce(map_extract({IG_MAP}, lower(coalesce(j->>'$.productType', j->>'$.type', 'feed')))[1], 'post') as content_type,
      coalesce(cast(j->>'$.likesCount' as bigint), cast(j->>'$.likeCount' as bigint)) as likes_count
    from (select item_seq, cast(raw as json) as j from raw_ig_posts)""")
def stream_ingest(t):
    """Three landing runs of instagram items (first run, an edited re-run, a replay) streamed through
    normalize -> dedupe -> upsert; the final snapshot has one row per post key."""
    from ...operators.normalize import instagram
    from .normalize import raw_items
    spark = t.spark
    base = S._run_dir(spark, "landing")
    r = raw_items(t).instagram_posts
    edited = r.where(F.col("item_seq") % 5 == 0).withColumn(
        "raw", F.regexp_replace("raw", '"caption":"', '"caption":"EDITED '))
    for i, df in enumerate([r, edited, edited]):
        df.select("raw").write.mode("overwrite").text(f"{base}/run={i}")

    def norm(raw):
        return instagram.post(raw).select("item_seq", "platform", "platform_post_id", "caption", "content_type",
                                          "likes_count")

    # The three landings may share a micro-batch: items are ordered by when and where they landed.
    snap = S.ingest_stream(spark, f"{base}/*", norm, ["platform", "platform_post_id"])
    return snap.select("platform", "platform_post_id", "caption", "content_type", "likes_count")
