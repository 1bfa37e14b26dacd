"""Aggregations, rankings and the flagship query (A*, W1-W3, W6/R5, J2, J9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import analytics as A
from ..registry import register

TOTAL_SQL = "cast(coalesce(e.likes,0)+coalesce(e.shares,0)+coalesce(e.comments_count,0)+coalesce(e.saves,0) as bigint)"


@register("tag_engagement_by_platform", f"""
    select p.platform, t.tag, count(*) as n_posts, cast(sum({TOTAL_SQL}) as bigint) as total_engagement
    from posts p cross join unnest(p.hashtags) as t(tag) join engagement e on e.post_id = p.post_id
    where p.deleted_at is null
    group by p.platform, t.tag order by total_engagement desc, platform, tag limit 12""")
def tag_engagement_by_platform(t):
    """Flagship: hashtags (F4) of live posts joined to engagement (J2), summed per platform and tag."""
    return A.tag_engagement_by_platform(t.posts, t.engagement, 12, text="caption")


@register("trending_hashtags", """
    select t.tag, count(*) as n_posts
    from posts p cross join unnest(p.hashtags) as t(tag) where p.deleted_at is null
    group by t.tag order by n_posts desc, tag limit 10""")
def trending_hashtags(t):
    return A.trending_hashtags(t.posts, 10)


@register("platform_distribution", """
    select pl.platform, cast(coalesce(c.n, 0) as bigint) as n_posts
    from (select unnest(['instagram','twitter','youtube','reddit','linkedin','facebook','tiktok','news']) as platform) pl
    left join (select platform, count(*) as n from posts where deleted_at is null group by platform) c
      on c.platform = pl.platform""")
def platform_distribution(t):
    return A.platform_distribution(t.posts)


@register("total_counts", """
    select (select count(*) from posts) as n_posts,
           (select count(*) from posts where deleted_at is null) as n_live_posts,
           (select count(*) from posts where platform = 'twitter') as n_twitter_posts,
           (select count(*) from comments) as n_comments,
           (select count(*) from authors) as n_authors""")
def total_counts(t):
    """A1: exact counts; ``count`` includes deleted rows, the live count excludes them.

    Each count is a one-row aggregate; they are stacked and pivoted into one row (no join)."""
    p = t.posts
    posts = p.agg(F.count(F.lit(1)).alias("n_posts"),
                  F.count_if(F.col("deleted_at").isNull()).alias("n_live_posts"),
                  F.count_if(F.col("platform") == "twitter").alias("n_twitter_posts"))
    stacked = posts.selectExpr("stack(3, 'n_posts', n_posts, 'n_live_posts', n_live_posts, "
                               "'n_twitter_posts', n_twitter_posts) as (name, n)")
    stacked = stacked.unionByName(A.count_rows(t.comments).select(F.lit("n_comments").alias("name"), "n")) \
                     .unionByName(A.count_rows(t.authors).select(F.lit("n_authors").alias("name"), "n"))
    names = ["n_posts", "n_live_posts", "n_twitter_posts", "n_comments", "n_authors"]
    return stacked.groupBy().pivot("name", names).agg(F.first("n")).select(*names)


@register("ai_query_stats", """
    select count(*) as total_queries, round(avg(latency_ms), 2) as avg_latency_ms
    from (select * from query_logs order by created_at desc, log_id desc limit 200) r""")
def ai_query_stats(t):
    return A.query_stats(t.query_logs, 200)


@register("posts_with_engagement", f"""
    select p.post_id, p.platform, e.likes, e.views, e.shares, e.comments_count, e.saves,
      {TOTAL_SQL} as total_engagement,
      round({TOTAL_SQL} / nullif(e.views, 0), 6) as engagement_rate
    from posts p join engagement e on e.post_id = p.post_id""")
def posts_with_engagement(t):
    j = A.with_engagement(t.posts, t.engagement)
    return j.select("post_id", "platform", "likes", "views", "shares", "comments_count", "saves",
                    "total_engagement", "engagement_rate")


@register("engagement_by_platform", f"""
    select p.platform, count(*) as n_posts, cast(sum(coalesce(e.likes, 0)) as bigint) as sum_likes,
      cast(sum(e.views) as bigint) as sum_views, cast(sum({TOTAL_SQL}) as bigint) as sum_engagement,
      round(avg(round({TOTAL_SQL} / nullif(e.views, 0), 6)), 6) as avg_engagement_rate
    from posts p join engagement e on e.post_id = p.post_id where p.deleted_at is null
    group by p.platform""")
def engagement_by_platform(t):
    return A.engagement_by_platform(t.posts, t.engagement)


@register("activity_over_time", """
    select date_trunc('day', posted_at) as bucket, platform, count(*) as n_posts
    from posts where deleted_at is null group by 1, 2""")
def activity_over_time(t):
    return A.activity_over_time(t.posts, "day").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("top_engagement_posts", """
    select * from engagement order by likes desc nulls last, post_id limit 10""")
def top_engagement_posts(t):
    return A.top_by_likes(t.engagement, 10)


@register("most_active_authors", """
    select * from authors where deleted_at is null
    order by post_count desc nulls last, author_id limit 10""")
def most_active_authors(t):
    return A.most_active_authors(t.authors, 10)


@register("most_active_authors_platform", """
    select * from authors where deleted_at is null and platform = 'youtube'
    order by post_count desc nulls first, author_id limit 10""")
def most_active_authors_platform(t):
    """W2 with a platform filter and the NULLs-first parity ordering."""
    return A.most_active_authors(t.authors, 10, platform="youtube", nulls_first=True)


@register("recent_jobs", """
    select * from scrape_jobs order by created_at desc, job_id desc limit 20""")
def recent_jobs(t):
    return A.recent(t.scrape_jobs, 20)


@register("recent_saved_searches", """
    select saved_search_id, kind, created_at from saved_searches where deleted_at is null and kind = 'hybrid'
    order by created_at desc, saved_search_id desc limit 5""")
def recent_saved_searches(t):
    """Newest live saved searches of one kind."""
    from ...operators.analytics import live as _live
    s = _live(t.saved_searches).where(F.col("kind") == "hybrid")
    return A.recent(s, 5, "created_at", "saved_search_id").select("saved_search_id", "kind", "created_at")


@register("popular_posts", """
    select 'post' as source_type, p.post_id, p.platform,
      coalesce(nullif(p.caption, ''), p.content, '') as content,
      cast(coalesce(e.likes, 0) as double) as score, e.likes, e.views
    from posts p join engagement e on e.post_id = p.post_id
    where p.deleted_at is null and p.platform = 'twitter'
    order by score desc, p.post_id limit 10""")
def popular_posts(t):
    return A.popular_posts(t.posts, t.engagement, 10, platform="twitter")


@register("popular_posts_parity", """
    select 'post' as source_type, p.post_id, p.platform,
      coalesce(nullif(p.caption, ''), p.content, '') as content,
      cast(coalesce(e.likes, 0) as double) as score, e.likes, e.views
    from posts p join (select * from engagement order by likes desc nulls last, post_id limit 15) e on e.post_id = p.post_id
    where p.deleted_at is null and p.platform = 'twitter'
    order by score desc, p.post_id limit 5""")
def popular_posts_parity(t):
    """R5/W6 parity: top 3 x 5 engagement rows first, then post lookup and platform filter, then cut."""
    return A.popular_posts(t.posts, t.engagement, 5, platform="twitter", overfetch=3)


@register("dashboard_summary", """
    with dist as (
      select pl.platform, coalesce(c.n, 0) as n from
        (select unnest(['instagram','twitter','youtube','reddit','linkedin','facebook','tiktok','news']) as platform) pl
        left join (select platform, count(*) as n from posts where deleted_at is null group by platform) c
        on c.platform = pl.platform),
    auth as (select * from authors where deleted_at is null order by post_count desc nulls last, author_id limit 10),
    tags as (select t.tag, count(*) as n from posts p cross join unnest(p.hashtags) as t(tag)
             where p.deleted_at is null group by t.tag order by n desc, tag limit 10),
    topl as (select * from engagement order by likes desc nulls last, post_id limit 10),
    jobs as (select * from scrape_jobs order by created_at desc, job_id desc limit 20),
    ql as (select * from query_logs order by created_at desc, log_id desc limit 200)
    select 'total_posts' as section, 1 as rank, 'posts' as item,
           cast((select count(*) from posts where deleted_at is null) as double) as value
    union all select 'total_comments', 1, 'comments', cast((select count(*) from comments) as double)
    union all select 'platform_distribution', cast(row_number() over (order by platform) as int), platform, cast(n as double) from dist
    union all select 'most_active_authors', cast(row_number() over (order by post_count desc nulls last, author_id) as int),
                     username, cast(post_count as double) from auth
    union all select 'trending_hashtags', cast(row_number() over (order by n desc, tag) as int), tag, cast(n as double) from tags
    union all select 'top_engagement_posts', cast(row_number() over (order by likes desc nulls last, post_id) as int),
                     cast(post_id as varchar), cast(likes as double) from topl
    union all select 'recent_scrape_jobs', cast(row_number() over (order by created_at desc, job_id desc) as int),
                     cast(job_id as varchar), cast(records_scraped as double) from jobs
    union all select 'ai_query_stats', 1, 'total_queries', cast((select count(*) from ql) as double)
    union all select 'ai_query_stats', 2, 'avg_latency_ms', (select round(avg(latency_ms), 2) from ql)""")
def dashboard_summary(t):
    return A.dashboard_summary(t.posts, t.comments, t.authors, t.engagement, t.scrape_jobs, t.query_logs)
