"""Dashboard aggregates, rankings and top-k.

All are declarative DataFrame plans: group-bys use partial (map-side)
aggregation so a hot key is pre-aggregated before the shuffle, and top-k uses
``orderBy().limit()`` which plans TakeOrderedAndProject (per-partition top-k,
no full sort).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..schema import PLATFORMS, STATS_WINDOW


def live(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Rows not soft-deleted (P1), unless ``include_deleted``."""
    if include_deleted or "deleted_at" not in df.columns:
        return df
    return df.where(F.col("deleted_at").isNull())


def count_rows(df: DataFrame, filters: dict | None = None, include_deleted: bool = True) -> DataFrame:
    """A1: exact count with equality filters; deleted rows included by default."""
    df = live(df, include_deleted)
    for k, v in (filters or {}).items():
        df = df.where(F.col(k) == F.lit(v))
    return df.agg(F.count(F.lit(1)).alias("n"))


def platforms_frame(spark: SparkSession) -> DataFrame:
    """The fixed platform list (8 rows) as a DataFrame."""
    return spark.createDataFrame([(p, i) for i, p in enumerate(PLATFORMS)], "platform string, platform_order int")


def platform_distribution(posts: DataFrame, include_deleted: bool = False) -> DataFrame:
    """A2: posts per platform, zero-filled over every known platform, in one scan."""
    counts = live(posts, include_deleted).groupBy("platform").agg(F.count(F.lit(1)).alias("n_posts"))
    plats = platforms_frame(posts.sparkSession)
    # The platform list has a fixed size (8 rows): broadcasting it is bounded.
    return (F.broadcast(plats).join(counts, "platform", "left")
            .select("platform", F.coalesce("n_posts", F.lit(0)).cast("bigint").alias("n_posts")))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k; callers include a unique key last so ties are stable."""
    return df.orderBy(*order).limit(k)


def query_stats(logs: DataFrame, n: int = STATS_WINDOW) -> DataFrame:
    """A3: count and mean latency (round 2, NULLs ignored) of the last ``n`` logs."""
    recent = top_k(logs, [F.col("created_at").desc(), F.col("log_id").desc()], n)
    return recent.agg(F.count(F.lit(1)).alias("total_queries"),
                      F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"))


def tag_links(posts: DataFrame) -> DataFrame:
    """post_id, tag rows (distinct per post)."""
    return (posts.select("post_id", "platform", F.explode(F.array_distinct("hashtags")).alias("tag")))


def trending_hashtags(posts: DataFrame, k: int = 10, include_deleted: bool = False) -> DataFrame:
    """A4: posts per hashtag, top k (count desc, tag asc)."""
    links = tag_links(live(posts, include_deleted))
    counts = links.groupBy("tag").agg(F.count(F.lit(1)).alias("n_posts"))
    return top_k(counts, [F.col("n_posts").desc(), F.col("tag")], k)


def tag_engagement_by_platform(posts: DataFrame, engagement: DataFrame, k: int = 12, text: str | None = None) -> DataFrame:
    """Flagship: per (platform, tag) posts and total engagement over posts that have engagement.

    The join runs on posts (one row per post) before the tags are exploded, so it moves posts, not
    post x tag rows; the aggregate after the explode is map-side combined. With ``text`` the tags
    are extracted from that column, after the join: only posts that have engagement are searched."""
    tags = F.array_distinct("hashtags") if text is None else fn.hashtags(text)
    p = live(posts).select("post_id", "platform", *(["hashtags"] if text is None else [text]))
    eng = engagement.select("post_id", fn.total_engagement().alias("total_engagement"))
    j = p.join(eng, "post_id").select("platform", F.explode_outer(tags).alias("tag"), "total_engagement").where("tag is not null")
    agg = j.groupBy("platform", "tag").agg(F.count(F.lit(1)).alias("n_posts"),
                                           F.sum("total_engagement").alias("total_engagement"))
    return top_k(agg, [F.col("total_engagement").desc(), F.col("platform"), F.col("tag")], k)


def with_engagement(posts: DataFrame, engagement: DataFrame, how: str = "inner") -> DataFrame:
    """Posts joined with their engagement row, plus total and rate."""
    j = posts.join(engagement, "post_id", how)
    total = fn.total_engagement()
    return j.withColumn("total_engagement", total).withColumn(
        "engagement_rate", fn.engagement_rate(F.col("total_engagement")))


def engagement_by_platform(posts: DataFrame, engagement: DataFrame) -> DataFrame:
    """Cross-platform comparison of engagement."""
    j = with_engagement(live(posts), engagement)
    return j.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.sum(F.coalesce("likes", F.lit(0))).alias("sum_likes"),
        F.sum("views").alias("sum_views"),
        F.sum("total_engagement").alias("sum_engagement"),
        F.round(F.avg("engagement_rate"), 6).alias("avg_engagement_rate"))


def activity_over_time(posts: DataFrame, unit: str = "day") -> DataFrame:
    """Posts per time bucket and platform."""
    return (live(posts).groupBy(F.date_trunc(unit, "posted_at").alias("bucket"), "platform")
            .agg(F.count(F.lit(1)).alias("n_posts")))


def most_active_authors(authors: DataFrame, k: int = 10, platform: str | None = None,
                        nulls_first: bool = False) -> DataFrame:
    """Authors by stored post_count desc (NULLs last unless parity asks first)."""
    a = live(authors)
    if platform is not None:
        a = a.where(F.col("platform") == platform)
    pc = F.col("post_count").desc_nulls_first() if nulls_first else F.col("post_count").desc_nulls_last()
    return top_k(a, [pc, F.col("author_id")], k)


def top_by_likes(engagement: DataFrame, k: int = 10) -> DataFrame:
    """Engagement rows by likes desc."""
    return top_k(engagement, [F.col("likes").desc_nulls_last(), F.col("post_id")], k)


def recent(df: DataFrame, k: int, ts: str = "created_at", key: str = "job_id") -> DataFrame:
    """Newest rows first."""
    return top_k(df, [F.col(ts).desc(), F.col(key).desc()], k)


def popular_posts(posts: DataFrame, engagement: DataFrame, k: int = 10, platform: str | None = None,
                  overfetch: int | None = None) -> DataFrame:
    """Posts by likes desc; filters apply before the cut (no over-fetch needed).

    ``overfetch`` reproduces the reference: take the top ``overfetch x k`` engagement rows first,
    then drop missing posts / other platforms, then cut (may return fewer than k)."""
    p = live(posts)
    if platform is not None:
        p = p.where(F.col("platform") == platform)
    if overfetch:
        engagement = top_k(engagement, [F.col("likes").desc_nulls_last(), F.col("post_id")], overfetch * k)
    j = p.join(engagement, "post_id")
    out = j.select(F.lit("post").alias("source_type"), "post_id", "platform",
                   F.coalesce(F.nullif("caption", F.lit("")), F.col("content"), F.lit("")).alias("content"),
                   F.coalesce("likes", F.lit(0)).cast("double").alias("score"), "likes", "views")
    return top_k(out, [F.col("score").desc(), F.col("post_id")], k)


def dashboard_summary(posts: DataFrame, comments: DataFrame, authors: DataFrame, engagement: DataFrame,
                      jobs: DataFrame, logs: DataFrame, k: int = 10) -> DataFrame:
    """A10: the eight dashboard results as one long (section, rank, item, value) frame.

    Each section is a small aggregate or top-k over its own table; the union
    needs no join, so nothing is broadcast or cross-joined.
    """
    def section(name: str, df: DataFrame, item: Column, value: Column, order: list[Column]) -> DataFrame:
        from pyspark.sql.window import Window
        w = Window.orderBy(*order)
        return df.select(F.lit(name).alias("section"), F.row_number().over(w).alias("rank"),
                         item.cast("string").alias("item"), value.cast("double").alias("value"))

    total_posts = count_rows(posts, include_deleted=False).select(
        F.lit("total_posts").alias("section"), F.lit(1).alias("rank"), F.lit("posts").alias("item"),
        F.col("n").cast("double").alias("value"))
    total_comments = count_rows(comments).select(
        F.lit("total_comments").alias("section"), F.lit(1).alias("rank"), F.lit("comments").alias("item"),
        F.col("n").cast("double").alias("value"))
    dist = section("platform_distribution", platform_distribution(posts), F.col("platform"),
                   F.col("n_posts"), [F.col("platform")])
    auth = section("most_active_authors", most_active_authors(authors, k), F.col("username"),
                   F.col("post_count"), [F.col("post_count").desc_nulls_last(), F.col("author_id")])
    tags = section("trending_hashtags", trending_hashtags(posts, k), F.col("tag"), F.col("n_posts"),
                   [F.col("n_posts").desc(), F.col("tag")])
    top = section("top_engagement_posts", top_by_likes(engagement, k), F.col("post_id"), F.col("likes"),
                  [F.col("likes").desc_nulls_last(), F.col("post_id")])
    jobs_s = section("recent_scrape_jobs", recent(jobs, 20), F.col("job_id"), F.col("records_scraped"),
                     [F.col("created_at").desc(), F.col("job_id").desc()])
    stats = query_stats(logs)
    ai = stats.select(F.lit("ai_query_stats").alias("section"), F.lit(1).alias("rank"),
                      F.lit("total_queries").alias("item"), F.col("total_queries").cast("double").alias("value")) \
        .unionByName(stats.select(F.lit("ai_query_stats").alias("section"), F.lit(2).alias("rank"),
                                  F.lit("avg_latency_ms").alias("item"), F.col("avg_latency_ms").alias("value")))
    out = total_posts
    for s in (total_comments, dist, auth, tags, top, jobs_s, ai):
        out = out.unionByName(s)
    return out.withColumn("rank", F.col("rank").cast("int"))
