"""The full ingest pipeline (D8/E6) run twice over the same landed batch."""

from __future__ import annotations

import uuid

from ...operators.embeddings import HashingProvider
from ...operators.pipeline import Lake, ingest
from ...session import checkpoint_dir
from ..registry import ORACLES, register
from .normalize import raw_items
from .raw_oracle import strip

APPEND_ONLY = {"media", "hashtags", "post_hashtags", "mentions"}
TABLES = ["authors", "channels", "posts", "videos", "comments", "media", "hashtags", "post_hashtags", "mentions",
          "engagement", "embeddings"]


def run_pipeline(t, runs: int = 2):
    spark = t.spark
    lake = Lake(spark, f"{checkpoint_dir(spark).rstrip('/')}/lake-{uuid.uuid4().hex[:12]}")
    r = raw_items(t)
    posts_raw = {"instagram": r.instagram_posts, "twitter": r.twitter_posts, "youtube": r.youtube_videos}
    comments_raw = {"instagram": r.instagram_comments, "twitter": r.twitter_comments, "youtube": r.youtube_comments}
    rows = []
    for run in range(1, runs + 1):
        rep = ingest(spark, lake, posts_raw, comments_raw, HashingProvider(64))
        for k, v in sorted(rep.counters.items()):
            rows.append((run, k, int(v)))
        rows.append((run, "total_records", rep.total_records))
        rows.append((run, "errors", len(rep.errors)))
        for table in TABLES:
            df = lake.read(table) if table not in APPEND_ONLY else lake.read_rows(table)
            rows.append((run, f"rows:{table}", 0 if df is None else df.count()))
            if table in lake.last_counts:
                rows.append((run, f"inserted:{table}", int(lake.last_counts[table].get("insert", 0))))
    return spark.createDataFrame(rows, "run int, metric string, value long"), lake


def _sub(name: str) -> str:
    return f"({ORACLES[name]})"


POSTS_ALL = f"""(select platform, platform_post_id, caption, content, hashtags, mentions, media from {_sub('norm_ig_post')}
  union all select platform, platform_post_id, caption, content, hashtags, mentions, media from {_sub('norm_tw_post')}
  union all select platform, platform_post_id, caption, content, hashtags, mentions, media from {_sub('norm_yt_post')})"""
SIZES = f"""
  with authors_all as (
    select platform, platform_user_id from {_sub('norm_ig_author')}
    union all select platform, platform_user_id from {_sub('norm_tw_author')}
    union all select platform, platform_user_id from {_sub('norm_yt_author')}
    union all select platform, author_native_id from {_sub('norm_ig_comment')}
    union all select 'twitter', coalesce(coalesce(j->'$.author', j)->>'$.id', coalesce(j->'$.author', j)->>'$.userId',
                                         coalesce(j->'$.author', j)->>'$.restId', '')
      from (select cast(raw as json) as j from raw_tw_comments)
    union all select platform, author_display_name from {_sub('norm_yt_comment')} where author_display_name is not null),
  posts_all as {POSTS_ALL},
  comments_all as (
    select platform, platform_comment_id, content from {_sub('norm_ig_comment')}
    union all select 'twitter', c.platform_comment_id, n.content from {_sub('comments_exclude_root')} c
      join {_sub('norm_tw_comment')} n on n.item_seq = c.item_seq
    union all select platform, platform_comment_id, content from {_sub('norm_yt_comment')}),
  media_all as (select platform, platform_post_id, split_part(m, '|', 2) as url
                from (select platform, platform_post_id, unnest(string_split(media, ',')) as m from posts_all where media <> '')),
  tags_all as (select platform, platform_post_id, unnest(string_split(hashtags, ',')) as tag from posts_all),
  mentions_all as (select platform, platform_post_id, unnest(string_split(mentions, ',')) as m from posts_all)
  select 'authors' as tbl, count(distinct platform || ':' || platform_user_id) as n from authors_all
  union all select 'channels', count(distinct platform_channel_id) from {_sub('norm_yt_channel')}
  union all select 'posts', count(distinct platform || ':' || platform_post_id) from posts_all
  union all select 'videos', count(distinct platform_video_id) from {_sub('norm_yt_video')}
  union all select 'comments', count(distinct platform || ':' || platform_comment_id) from comments_all
  union all select 'media', count(distinct platform || ':' || platform_post_id || '|' || url) from media_all
  union all select 'hashtags', count(distinct tag) from tags_all where tag <> ''
  union all select 'post_hashtags', count(distinct platform || ':' || platform_post_id || '#' || tag) from tags_all where tag <> ''
  union all select 'mentions', count(distinct platform || ':' || platform_post_id || '@' || m) from mentions_all where m <> ''
  union all select 'engagement', count(distinct platform || ':' || platform_post_id) from posts_all
  union all select 'embeddings', (select count(*) from (select distinct platform, platform_post_id from posts_all
      where coalesce(nullif({strip('caption')}, ''), {strip('content')}) <> ''))
      + (select count(distinct platform || ':' || platform_comment_id) from comments_all where {strip('content')} <> '')"""
UPSERTED = {"authors": "authors_upserted", "channels": "channels_upserted", "posts": "posts_upserted",
            "videos": "videos_upserted", "comments": "comments_upserted", "engagement": "engagement_upserted"}
APPENDED = {"media": "media_created", "post_hashtags": "hashtags_linked", "mentions": "mentions_created",
            "embeddings": "embeddings_generated"}
ACTION_TABLES = ["authors", "channels", "posts", "videos", "comments", "engagement", "embeddings"]


def _pipeline_oracle() -> str:
    parts = []
    for run in (1, 2):
        parts.append(f"select {run} as run, 'rows:' || tbl as metric, n as value from sizes")
        for tbl, counter in UPSERTED.items():
            parts.append(f"select {run}, '{counter}', n from sizes where tbl = '{tbl}'")
        for tbl, counter in APPENDED.items():
            parts.append(f"select {run}, '{counter}', {'n' if run == 1 else '0'} from sizes where tbl = '{tbl}'")
        for tbl in ACTION_TABLES:
            parts.append(f"select {run}, 'inserted:{tbl}', {'n' if run == 1 else '0'} from sizes where tbl = '{tbl}'")
        parts.append(f"select {run}, 'total_records', sum(n) from sizes "
                     "where tbl in ('authors', 'channels', 'posts', 'videos', 'comments')")
        parts.append(f"select {run}, 'errors', 0")
        parts.append(f"select {run}, 'quarantined', 0")
    body = "\n  union all ".join(parts)
    return f"with sizes as ({SIZES})\nselect run, metric, cast(value as bigint) as value from (\n  {body})"


@register("pipeline_run", _pipeline_oracle())
def pipeline_run(t):
    """Authors -> channels -> posts -> videos -> comments -> media -> tags -> mentions -> engagement
    -> embeddings, twice; the second run inserts nothing and changes no id."""
    df, _ = run_pipeline(t)
    return df
