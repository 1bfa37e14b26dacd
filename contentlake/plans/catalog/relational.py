"""Order statistics, deep pages, foreign-key deletes, interval and as-of joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import fk_graph as FK
from ...operators import paging as PG
from ...operators import range_join as RJ
from ...operators.order_stats import statistics
from ...session import checkpoint_dir
from ..registry import register


def _path(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# --------------------------------------------------------------------------- W8
@register("rank_within_platform", """
    select doc_id, platform, row_number() over (partition by platform order by n_chars desc, doc_id) as position,
      rank() over (partition by platform order by n_chars desc) as rank, dense_rank() over (partition by platform order by n_chars desc) as dense_rank,
      cast(sum(n_chars) over (partition by platform order by n_chars desc, doc_id rows unbounded preceding) as bigint) as running_chars,
      count(*) over (partition by platform) as n_in_platform
    from (select doc_id, n_chars, case when doc_id % 3 = 0 then 'instagram' when doc_id % 3 = 1 then 'twitter' else 'youtube' end as platform from documents)""")
def rank_within_platform(t):
    """Position, rank, dense rank and running total in three hot groups, spread over ranges."""
    from ...sources.bindings import platform_of
    d = t.documents.select("doc_id", "n_chars", platform_of("doc_id").alias("platform"))
    out = statistics(d, ["platform"], [("n_chars", False)], ["doc_id"], position="position", rank="rank", dense_rank="dense_rank",
                     sums={"running_chars": "n_chars"}, group_size="n_in_platform")
    return out.drop("n_chars")


# --------------------------------------------------------------------------- S14
@register("list_page_deep", """
    select * exclude (_rn, _n) from (select *, row_number() over (order by created_at desc, job_id) as _rn, count(*) over () as _n
      from scrape_jobs where status = 'succeeded') where _rn > _n // 2 and _rn <= _n // 2 + 25""")
def list_page_deep(t):
    """25 rows from the middle of all succeeded jobs, newest first, through an offset index."""
    path = _path(t, "pages")
    PG.write_page_index(t.scrape_jobs, path, "created_at", True, "job_id", ["status"])
    n = t.spark.read.parquet(f"{path}/counts").where("status = 'succeeded'").agg(F.sum("n")).first()[0] or 0
    return PG.page_of(t.spark, path, "created_at", True, "job_id", {"status": "succeeded"}, limit=25, offset=n // 2)


# --------------------------------------------------------------------------- S25
KEYS = [
    FK.ForeignKey("channels", "author_id", "authors"), FK.ForeignKey("posts", "author_id", "authors"),
    FK.ForeignKey("videos", "channel_id", "channels"), FK.ForeignKey("videos", "post_id", "posts", "set_null"),
    FK.ForeignKey("media", "post_id", "posts"), FK.ForeignKey("post_hashtags", "post_id", "posts"),
    FK.ForeignKey("post_hashtags", "tag", "hashtags"), FK.ForeignKey("mentions", "post_id", "posts"),
    FK.ForeignKey("comments", "post_id", "posts"), FK.ForeignKey("comments", "parent_comment_id", "comments"),
    FK.ForeignKey("engagement", "post_id", "posts"), FK.ForeignKey("messages", "conversation_id", "conversations"),
    FK.ForeignKey("query_logs", "conversation_id", "conversations", "set_null"),
]


def _model(t):
    """Every table with a declared foreign key, as bound to the driver's tables, with its key columns."""
    posts, youtube = t.posts.select("post_id", "author_id", "platform", "hashtags", "mentions"), F.col("platform") == "youtube"
    return {
        "authors": (t.authors.select("author_id"), ["author_id"]),
        "channels": (t.authors.where(youtube).select(F.col("author_id").alias("channel_id"), "author_id"), ["channel_id"]),
        "posts": (posts.select("post_id", "author_id"), ["post_id"]),
        "videos": (posts.where(youtube).select(F.col("post_id").alias("video_id"), (F.col("author_id") * 3 + 2).alias("channel_id"), "post_id"), ["video_id"]),
        "media": (posts.select(F.concat(F.lit("m"), F.col("post_id").cast("string")).alias("media_id"), "post_id"), ["media_id"]),
        "hashtags": (posts.select(F.explode("hashtags").alias("tag")).distinct(), ["tag"]),
        "post_hashtags": (posts.select("post_id", F.explode("hashtags").alias("tag")), ["post_id", "tag"]),
        "mentions": (posts.select("post_id", F.explode("mentions").alias("username")), ["post_id", "username"]),
        "comments": (t.comments.select("comment_id", "post_id", "parent_comment_id"), ["comment_id"]),
        "engagement": (t.engagement.select("post_id"), ["post_id"]),
        "conversations": (t.chats.select("conversation_id"), ["conversation_id"]),
        "messages": (t.messages.select("conversation_id", "turn"), ["conversation_id", "turn"]),
        "query_logs": (t.query_logs.select("log_id", "conversation_id"), ["log_id"]),
    }


CASCADE_SQL = """
    with recursive gone_authors as (select author_id from authors where author_id % 17 = 3),
    gone_channels as (select author_id as channel_id from authors where platform = 'youtube' and (author_id in (select author_id from gone_authors) or author_id % 10 = 2)),
    gone_posts as (select post_id from posts where author_id in (select author_id from gone_authors) or post_id % 31 = 7),
    gone_tags as (select 'src3' as tag),
    gone_comments as (select comment_id from comments where post_id in (select post_id from gone_posts) or (turn = 1 and post_id % 5 = 0)
      union select c.comment_id from comments c join gone_comments g on c.parent_comment_id = g.comment_id),
    gone_conversations as (select conversation_id from chats where conversation_id % 9 = 0),
    left_posts as (select * from posts where post_id not in (select post_id from gone_posts))
    select 'authors' as tbl, cast(author_id as varchar) as row_key, cast(null as varchar) as ref from authors where author_id not in (select author_id from gone_authors)
    union all select 'channels', cast(author_id as varchar), cast(author_id as varchar) from authors where platform = 'youtube' and author_id not in (select channel_id from gone_channels)
    union all select 'posts', cast(post_id as varchar), cast(author_id as varchar) from left_posts
    union all select 'videos', cast(post_id as varchar), case when post_id in (select post_id from gone_posts) then null else cast(post_id as varchar) end
      from posts where platform = 'youtube' and author_id * 3 + 2 not in (select channel_id from gone_channels)
    union all select 'media', 'm' || post_id, cast(post_id as varchar) from left_posts
    union all select distinct 'hashtags', tag, null from (select unnest(hashtags) as tag from posts) where tag not in (select tag from gone_tags)
    union all select 'post_hashtags', post_id || ',' || tag, cast(post_id as varchar) from (select post_id, unnest(hashtags) as tag from left_posts) where tag not in (select tag from gone_tags)
    union all select 'mentions', post_id || ',' || username, cast(post_id as varchar) from (select post_id, unnest(mentions) as username from left_posts)
    union all select 'comments', comment_id, parent_comment_id from comments where comment_id not in (select comment_id from gone_comments)
    union all select 'engagement', cast(post_id as varchar), cast(post_id as varchar) from engagement where post_id not in (select post_id from gone_posts)
    union all select 'conversations', cast(conversation_id as varchar), null from chats where conversation_id not in (select conversation_id from gone_conversations)
    union all select 'messages', conversation_id || ',' || turn, cast(conversation_id as varchar) from messages where conversation_id not in (select conversation_id from gone_conversations)
    union all select 'query_logs', cast(log_id as varchar), case when conversation_id in (select conversation_id from gone_conversations) then null
      else cast(conversation_id as varchar) end from query_logs"""


@register("cascade_delete_graph", CASCADE_SQL)
def cascade_delete_graph(t):
    """Authors, posts, channels, a tag, replies and conversations deleted at once; every row that is left in
    every table, with a reference that set-null keys may have cleared."""
    seeds = {"authors": t.authors.where("author_id % 17 = 3").select("author_id"),
             "channels": t.authors.where("platform = 'youtube' and author_id % 10 = 2").select(F.col("author_id").alias("channel_id")),
             "posts": t.posts.where("post_id % 31 = 7").select("post_id"), "hashtags": t.spark.createDataFrame([("src3",)], "tag string"),
             "comments": t.comments.where("turn = 1 and post_id % 5 = 0").select("comment_id"),
             "conversations": t.chats.where("conversation_id % 9 = 0").select("conversation_id")}
    tables = _model(t)
    left = FK.delete(tables, KEYS, seeds)
    refs = {"channels": "author_id", "posts": "author_id", "videos": "post_id", "media": "post_id", "post_hashtags": "post_id", "mentions": "post_id",
            "comments": "parent_comment_id", "engagement": "post_id", "messages": "conversation_id", "query_logs": "conversation_id"}
    out = None
    for name, df in left.items():
        key = F.concat_ws(",", *[F.col(c).cast("string") for c in tables[name][1]])
        ref = F.col(refs[name]).cast("string") if name in refs else F.lit(None).cast("string")
        rows = df.select(F.lit(name).alias("tbl"), key.alias("row_key"), ref.alias("ref"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --------------------------------------------------------------------------- J10
@register("interval_join", """
    select c.conversation_id, count(*) as n_logs, round(avg(q.latency_ms), 6) as avg_latency, min(q.log_id) as first_log
    from chats c join query_logs q on q.created_at >= c.created_at and q.created_at < c.updated_at + interval 6 hour
    group by c.conversation_id""")
def interval_join(t):
    """Queries logged while a conversation ran (and six hours on), joined on the time alone."""
    chats = t.chats.select("conversation_id", F.col("created_at").alias("begun"), (F.col("updated_at") + F.expr("interval 6 hours")).alias("ended"))
    logs = t.query_logs.select("log_id", "latency_ms", F.col("created_at").alias("logged"))
    j = RJ.interval_join(logs, "logged", chats, "begun", "ended")
    return j.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_logs"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
                                            F.min("log_id").alias("first_log"))


@register("asof_engagement", """
    select comment_id, log_id, likes from (
      select kind, comment_id, last_value(case when kind = 0 then log_id end ignore nulls) over w as log_id,
        last_value(case when kind = 0 then likes end ignore nulls) over w as likes
      from (select 1 as kind, posted_at as tm, comment_id, cast(null as bigint) as log_id, cast(null as bigint) as likes from comments
            union all
            select 0, ts, null, event_id, cast(sum(case when event_type = 'click' then 1 else 0 end) over (order by ts, event_id rows unbounded preceding) as bigint)
            from events)
      window w as (order by tm, kind, log_id rows unbounded preceding)) where kind = 1""")
def asof_engagement(t):
    """How many likes there were in all when each comment was posted: a running total over ranges, then an
    as-of join on time without any equality key."""
    likes = t.events.select("event_id", "ts", F.when(F.col("event_type") == "click", 1).otherwise(0).cast("long").alias("one"))
    total = statistics(likes, [], [("ts", True)], ["event_id"], sums={"likes": "one"}).select(F.col("event_id").alias("log_id"), "ts", "likes")
    return RJ.asof_join(t.comments.select("comment_id", "posted_at"), "posted_at", total, "ts", ["log_id", "likes"], "log_id").drop("posted_at")
