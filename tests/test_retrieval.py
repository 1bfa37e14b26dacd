"""Retrieval filters, popularity, embeddings skip rules and service aggregates on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from contentlake.operators import analytics as A
from contentlake.operators import chat as C
from contentlake.operators import embeddings as E
from contentlake.operators import retrieval as RT

HIT = "source_type string, source_id string, platform string, content string, score double, match string"


@pytest.fixture(scope="module")
def ctx(spark):
    posts = spark.createDataFrame([
        (1, "instagram", 10, "reel", ["sunset"], dt.datetime(2024, 1, 10), "cap", "c", None),
        (2, "twitter", 11, "tweet", ["news"], dt.datetime(2024, 2, 10), "cap2", "c2", None),
        (3, "twitter", 99, "tweet", [], None, "", "only content", None),
    ], "post_id long, platform string, author_id long, content_type string, hashtags array<string>, "
       "posted_at timestamp_ntz, caption string, content string, deleted_at timestamp_ntz")
    authors = spark.createDataFrame([(10, "Alice"), (11, "bob")], "author_id long, username string")
    eng = spark.createDataFrame([(1, 50, 1000), (2, None, None)], "post_id long, likes long, views long")
    hits = spark.createDataFrame([("post", "1", "instagram", "a", 0.9, "semantic"),
                                  ("post", "2", "twitter", "b", 0.8, "keyword"),
                                  ("post", "404", "twitter", "gone", 0.7, "keyword"),
                                  ("comment", "c1", "twitter", "x", 0.5, "keyword")], HIT)
    return posts, authors, eng, hits


def ids(df):
    return sorted(r["source_id"] for r in df.collect())


def test_no_filters_is_noop(ctx):
    posts, authors, eng, hits = ctx
    assert ids(RT.apply_filters(hits, RT.Filters(), posts, authors, eng)) == ["1", "2", "404", "c1"]


@pytest.mark.parametrize("f,expected", [
    (RT.Filters(hashtag="#Sunset"), ["1", "c1"]),
    (RT.Filters(hashtag="nothing"), ["c1"]),
    (RT.Filters(date_from="2024-01-01", date_to="2024-01-31"), ["1", "c1"]),
    (RT.Filters(date_from="2024-02-01"), ["2", "c1"]),
    (RT.Filters(date_to="2024-01-09"), ["c1"]),
    (RT.Filters(author_username="@ALICE"), ["1", "c1"]),
    (RT.Filters(author_username="carol"), ["c1"]),
    (RT.Filters(min_likes=10), ["1", "c1"]),
    (RT.Filters(min_likes=0), ["1", "2", "c1"]),
    (RT.Filters(min_likes=100), ["c1"]),
    (RT.Filters(content_types=("reel",)), ["1", "c1"]),
    (RT.Filters(content_types=("story",)), ["c1"]),
])
def test_filters_both_ways(ctx, f, expected):
    posts, authors, eng, hits = ctx
    assert ids(RT.apply_filters(hits, f, posts, authors, eng)) == expected


def test_popular_posts(ctx):
    posts, authors, eng, hits = ctx
    out = A.popular_posts(posts, eng, k=10).collect()
    assert [(r["post_id"], r["score"]) for r in out] == [(1, 50.0), (2, 0.0)]
    assert [r["post_id"] for r in A.popular_posts(posts, eng, k=10, platform="twitter").collect()] == [2]
    assert len(A.popular_posts(posts, eng, k=1).collect()) == 1


def test_hybrid_search_sorted_and_limited(spark):
    kw = spark.createDataFrame([("post", str(i), "x", "c", 1.0, "keyword") for i in range(5)], HIT)
    se = spark.createDataFrame([("post", str(i), "x", "c", i / 10, "semantic") for i in range(3, 8)], HIT)
    h = RT.hybrid(kw, se).orderBy(F.col("score").desc(), "source_id").limit(3).collect()
    assert [r["source_id"] for r in h] == ["4", "3", "7"]
    assert [r["match"] for r in h] == ["hybrid", "hybrid", "semantic"]


def test_embed_pending_skips(spark):
    posts = spark.createDataFrame([(1, "x", "hello", "c"), (2, "x", "   ", "   "), (3, "x", "new text", "c")],
                                  "post_id long, platform string, caption string, content string")
    comments = spark.createDataFrame([], "comment_id string, platform string, content string")
    items = E.embeddable_items(posts, comments)
    assert sorted(r["source_id"] for r in items.collect()) == ["1", "3"]  # blank dropped
    import hashlib
    existing = spark.createDataFrame([("post", "1", "m", hashlib.sha256(b"hello").hexdigest()),
                                      ("post", "3", "m", "stale")], "source_type string, source_id string, model string, checksum string")
    p = {r["source_id"]: r["reason"] for r in E.pending(items, existing, "m").collect()}
    assert p == {"3": "changed"}
    assert {r["source_id"] for r in E.pending(items, existing, "other-model").collect()} == {"1", "3"}


def test_ai_query_stats(spark):
    logs = spark.createDataFrame([(1, 100.0, dt.datetime(2024, 1, 1)), (2, 200.0, dt.datetime(2024, 1, 2))],
                                 "log_id long, latency_ms double, created_at timestamp_ntz")
    r = A.query_stats(logs).collect()[0]
    assert (r["total_queries"], r["avg_latency_ms"]) == (2, 150.0)
    r0 = A.query_stats(logs.limit(0)).collect()[0]
    assert (r0["total_queries"], r0["avg_latency_ms"]) == (0, None)


def test_dashboard_sections(spark, sf_dir):
    from contentlake.plans.registry import tables
    t = tables(spark, sf_dir)
    d = A.dashboard_summary(t.posts, t.comments, t.authors, t.engagement, t.scrape_jobs, t.query_logs)
    assert {r["section"] for r in d.select("section").distinct().collect()} == {
        "total_posts", "total_comments", "platform_distribution", "most_active_authors", "trending_hashtags",
        "top_engagement_posts", "recent_scrape_jobs", "ai_query_stats"}


def test_markdown_export(spark):
    chats = spark.createDataFrame([(1, "My chat"), (2, None)], "conversation_id long, title string")
    msgs = spark.createDataFrame([(1, 0, "user", "hi", dt.datetime(2024, 1, 1, 9)),
                                  (1, 1, "assistant", "hello", dt.datetime(2024, 1, 1, 9, 1))],
                                 "conversation_id long, turn long, role string, content string, created_at timestamp_ntz")
    out = {r["conversation_id"]: r["markdown"] for r in C.markdown_export(chats, msgs).collect()}
    assert out[1] == ("# My chat\n\n**You** (2024-01-01T09:00:00+00:00):\nhi\n\n"
                      "**Assistant** (2024-01-01T09:01:00+00:00):\nhello\n")
    assert out[2] == "# New conversation\n"
