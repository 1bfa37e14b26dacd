"""Model views over the driver's tables.

Each binding is a plain projection/aggregation of the given tables, so its work
grows with them. ``Tables`` builds them lazily as DataFrames; ``ORACLE_VIEWS``
holds the same definitions as DuckDB CTE text for the correctness oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn

ACTIVE_PLATFORMS = ["instagram", "twitter", "youtube"]
BASE_TS = "timestamp_ntz'2024-01-01 00:00:00'"


def platform_of(k) -> Column:
    """instagram / twitter / youtube by key mod 3."""
    k = F.col(k) if isinstance(k, str) else k
    return (F.when(k % 3 == 0, F.lit("instagram")).when(k % 3 == 1, F.lit("twitter"))
            .otherwise(F.lit("youtube")))


def hours_after_base(expr: str) -> Column:
    return F.expr(f"{BASE_TS} + make_dt_interval(0, cast({expr} as int))")


class Tables:
    """Driver tables and model bindings for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def posts(self) -> DataFrame:
        d = self.table("documents")
        caption = F.concat(F.col("text"), F.lit(" #"), F.col("lang"), F.lit(" #"),
                           F.col("source"), F.lit(" @"), F.col("source"),
                           F.lit(" (https://example.com/d/"), F.col("doc_id").cast("string"), F.lit(")."))
        plat = platform_of("doc_id")
        ctype = (F.when(plat == "instagram", F.when(F.col("n_chars") > 2000, "reel").otherwise("post"))
                 .when(plat == "twitter", F.when(F.col("doc_id") % 10 == 1, "retweet")
                       .when(F.col("doc_id") % 10 == 4, "quote").otherwise("tweet"))
                 .otherwise(F.when(F.col("n_chars") <= 500, "short").otherwise("video")))
        posted = hours_after_base("doc_id")
        return d.select(
            F.col("doc_id").alias("post_id"),
            plat.alias("platform"),
            F.col("doc_id").cast("string").alias("platform_post_id"),
            (F.col("doc_id") % 100).alias("author_id"),
            ctype.alias("content_type"),
            caption.alias("caption"),
            F.col("text").alias("content"),
            F.col("lang").alias("language"),
            F.col("source"),
            posted.alias("posted_at"),
            F.when(F.col("doc_id") % 50 == 7, posted + F.expr("make_dt_interval(30)")).alias("deleted_at"),
        ).withColumn("hashtags", fn.hashtags("caption")) \
         .withColumn("mentions", fn.mentions("caption")) \
         .withColumn("urls", fn.urls("caption"))

    @cached_property
    def authors(self) -> DataFrame:
        c = self.table("customer")
        return c.select(
            F.col("c_custkey").alias("author_id"),
            platform_of("c_custkey").alias("platform"),
            F.col("c_custkey").cast("string").alias("platform_user_id"),
            F.col("c_name").alias("username"),
            ((F.col("c_custkey") * 37) % 10000).cast("bigint").alias("follower_count"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("bigint")).alias("post_count"),
            (F.col("c_mktsegment") == "BUILDING").alias("is_verified"),
            F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        )

    @cached_property
    def engagement(self) -> DataFrame:
        e = self.table("events")
        t = F.col("event_type")
        return e.groupBy(F.col("user_id").alias("post_id")).agg(
            F.count_if(t == "click").alias("likes"),
            F.nullif(F.count_if(t == "view"), F.lit(0)).alias("views"),
            F.nullif(F.count_if(t == "purchase"), F.lit(0)).alias("shares"),
            F.count_if(t == "signup").alias("comments_count"),
            F.nullif(F.count_if(t == "error"), F.lit(0)).alias("saves"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        c = self.table("conversations")
        cid = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        parent = F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id").cast("string"),
                                                        (F.col("turn") - 1).cast("string")))
        return c.select(
            cid.alias("comment_id"),
            F.col("conv_id").alias("post_id"),
            platform_of("conv_id").alias("platform"),
            cid.alias("platform_comment_id"),
            parent.alias("parent_comment_id"),
            F.col("role").alias("author"),
            F.col("text").alias("content"),
            (F.length("text") % 50).cast("bigint").alias("likes"),
            F.col("turn"),
            (hours_after_base("conv_id") + F.expr("make_dt_interval(0, 0, cast(turn as int))")).alias("posted_at"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(
            F.col("conv_id").alias("conversation_id"), F.col("turn"), F.col("role"),
            F.col("text").alias("content"),
            (hours_after_base("conv_id") + F.expr("make_dt_interval(0, 0, cast(turn as int))")).alias("created_at"),
        )

    @cached_property
    def chats(self) -> DataFrame:
        """Conversations (chat sessions): title = first 60 chars of turn 0."""
        m = self.messages
        return m.groupBy("conversation_id").agg(
            F.max(F.when(F.col("turn") == 0, F.substring("content", 1, 60))).alias("title"),
            F.min("created_at").alias("created_at"),
            F.max("created_at").alias("updated_at"),
        ).withColumn("is_archived", F.col("conversation_id") % 10 == 3)

    @cached_property
    def query_logs(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("log_id"),
            F.col("user_id").alias("conversation_id"),
            F.concat(F.lit("how many "), F.col("event_type"), F.lit(" events")).alias("question"),
            F.col("value").alias("latency_ms"),
            F.col("ts").alias("created_at"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), F.col("props"))).alias("error"),
        )

    @cached_property
    def scrape_jobs(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("job_id"),
            platform_of("o_custkey").alias("platform"),
            F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running")
             .otherwise("partial").alias("status"),
            F.col("o_orderdate").alias("created_at"),
            (F.col("o_totalprice") / 1000).cast("bigint").alias("records_scraped"),
            F.col("o_orderpriority").alias("priority"),
        )

    @cached_property
    def saved_searches(self) -> DataFrame:
        """Saved searches: one per benchmark item (kind by id, query = first 80 chars)."""
        b = self.table("benchmark")
        kind = F.when(F.col("item_id") % 3 == 0, "keyword").when(F.col("item_id") % 3 == 1, "semantic") \
                .otherwise("hybrid")
        return b.select(F.col("item_id").alias("saved_search_id"), kind.alias("kind"),
                        F.col("text").alias("query"),
                        hours_after_base("item_id * 7").alias("created_at"),
                        F.when(F.col("item_id") % 11 == 5, hours_after_base("item_id * 7 + 24")).alias("deleted_at"))

    @cached_property
    def search_docs(self) -> DataFrame:
        """Retrieval documents: one per post text."""
        d = self.table("documents")
        return d.select(F.lit("post").alias("source_type"), F.col("doc_id").alias("source_id"),
                        platform_of("doc_id").alias("platform"), F.col("text").alias("content"))

    @cached_property
    def doc_embeddings(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.lit("post").alias("source_type"), F.col("vec_id").alias("source_id"),
                        platform_of("vec_id").alias("platform"), F.col("embedding"), F.col("label"))


DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_PLAT_SQL = "case when {k} % 3 = 0 then 'instagram' when {k} % 3 = 1 then 'twitter' else 'youtube' end"
HASHTAG_SQL = r"(?:^|[^\p{L}\p{N}_])#([\p{L}\p{N}_]+)"
MENTION_SQL = r"(?:^|[^\p{L}\p{N}_])@([\p{L}\p{N}_]+)"


def plat_sql(k: str) -> str:
    return _PLAT_SQL.format(k=k)


def distinct_sql(xs: str) -> str:
    """Order-preserving distinct of a DuckDB list."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


# DuckDB text of the same bindings: name -> (sql, dependencies).
ORACLE_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "posts_base": (f"""
        select doc_id as post_id, {plat_sql('doc_id')} as platform,
          cast(doc_id as varchar) as platform_post_id, doc_id % 100 as author_id,
          case when doc_id % 3 = 0 then (case when n_chars > 2000 then 'reel' else 'post' end)
               when doc_id % 3 = 1 then (case when doc_id % 10 = 1 then 'retweet'
                                              when doc_id % 10 = 4 then 'quote' else 'tweet' end)
               else (case when n_chars <= 500 then 'short' else 'video' end) end as content_type,
          text || ' #' || lang || ' #' || source || ' @' || source
            || ' (https://example.com/d/' || cast(doc_id as varchar) || ').' as caption,
          text as content, lang as language, source,
          timestamp '2024-01-01' + to_hours(doc_id) as posted_at,
          case when doc_id % 50 = 7 then timestamp '2024-01-01' + to_hours(doc_id) + interval 30 day end as deleted_at
        from documents""", ()),
    "posts": (f"""
        select *, {distinct_sql(f"regexp_extract_all(lower(caption), '{HASHTAG_SQL}', 1)")} as hashtags,
          {distinct_sql(f"regexp_extract_all(lower(caption), '{MENTION_SQL}', 1)")} as mentions,
          {distinct_sql("list_transform(regexp_extract_all(caption, 'https?://[^\\s<>\"'']+', 0), lambda u: regexp_replace(u, '[).,]+$', ''))")} as urls
        from posts_base""", ("posts_base",)),
    "authors": (f"""
        select c_custkey as author_id, {plat_sql('c_custkey')} as platform,
          cast(c_custkey as varchar) as platform_user_id, c_name as username,
          cast((c_custkey * 37) % 10000 as bigint) as follower_count,
          case when c_acctbal >= 0 then cast(trunc(c_acctbal) as bigint) end as post_count,
          c_mktsegment = 'BUILDING' as is_verified, cast(null as timestamp) as deleted_at
        from customer""", ()),
    "engagement": ("""
        select user_id as post_id,
          cast(count(*) filter (where event_type = 'click') as bigint) as likes,
          cast(nullif(count(*) filter (where event_type = 'view'), 0) as bigint) as views,
          cast(nullif(count(*) filter (where event_type = 'purchase'), 0) as bigint) as shares,
          cast(count(*) filter (where event_type = 'signup') as bigint) as comments_count,
          cast(nullif(count(*) filter (where event_type = 'error'), 0) as bigint) as saves
        from events group by user_id""", ()),
    "comments": (f"""
        select cast(conv_id as varchar) || ':' || cast(turn as varchar) as comment_id,
          conv_id as post_id, {plat_sql('conv_id')} as platform,
          cast(conv_id as varchar) || ':' || cast(turn as varchar) as platform_comment_id,
          case when turn > 0 then cast(conv_id as varchar) || ':' || cast(turn - 1 as varchar) end as parent_comment_id,
          role as author, text as content, cast(length(text) % 50 as bigint) as likes, turn,
          timestamp '2024-01-01' + to_hours(conv_id) + to_minutes(turn) as posted_at
        from conversations""", ()),
    "messages": ("""
        select conv_id as conversation_id, turn, role, text as content,
          timestamp '2024-01-01' + to_hours(conv_id) + to_minutes(turn) as created_at
        from conversations""", ()),
    "chats": ("""
        select conversation_id, max(case when turn = 0 then substr(content, 1, 60) end) as title,
          min(created_at) as created_at, max(created_at) as updated_at,
          conversation_id % 10 = 3 as is_archived
        from messages group by conversation_id""", ("messages",)),
    "query_logs": ("""
        select event_id as log_id, user_id as conversation_id,
          'how many ' || event_type || ' events' as question, value as latency_ms, ts as created_at,
          case when event_type = 'error' then 'failed: ' || props end as error
        from events""", ()),
    "scrape_jobs": (f"""
        select o_orderkey as job_id, {plat_sql('o_custkey')} as platform,
          case o_orderstatus when 'F' then 'succeeded' when 'O' then 'running' else 'partial' end as status,
          o_orderdate as created_at, cast(trunc(o_totalprice / 1000) as bigint) as records_scraped,
          o_orderpriority as priority
        from orders""", ()),
    "saved_searches": ("""
        select item_id as saved_search_id,
          case when item_id % 3 = 0 then 'keyword' when item_id % 3 = 1 then 'semantic' else 'hybrid' end as kind,
          text as query, timestamp '2024-01-01' + to_hours(item_id * 7) as created_at,
          case when item_id % 11 = 5 then timestamp '2024-01-01' + to_hours(item_id * 7 + 24) end as deleted_at
        from benchmark""", ()),
    "search_docs": (f"""
        select 'post' as source_type, doc_id as source_id, {plat_sql('doc_id')} as platform, text as content
        from documents""", ()),
    "doc_embeddings": (f"""
        select 'post' as source_type, vec_id as source_id, {plat_sql('vec_id')} as platform,
          cast(embedding as double[]) as embedding, label
        from embeddings""", ()),
}
