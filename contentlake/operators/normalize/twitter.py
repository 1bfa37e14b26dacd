"""Twitter/X items -> authors, posts, comments, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import first_present, hashtags, lower_list, mentions, parse_ts_native, py_strip, twitter_content_type, urls
from ...functions.metrics import TWITTER_VIDEO_TYPES
from .common import EMPTY_MEDIA, indexed, media_struct

PLATFORM = "twitter"


def _author_obj() -> Column:
    """The embedded ``author`` object, else the item itself."""
    return F.coalesce(F.try_variant_get("v", "$.author", "variant"), F.col("v"))


def author_key(a: Column | None = None) -> list[Column]:
    """``platform_user_id`` and ``username`` of an item's author."""
    a = _author_obj() if a is None else a
    return [F.coalesce(first_present(a, ["id", "userId", "restId"]), F.lit("")).alias("platform_user_id"),
            F.coalesce(py_strip(first_present(a, ["userName", "username", "screen_name"])), F.lit("unknown"))
            .alias("username")]


def author(raw: DataFrame) -> DataFrame:
    """N5."""
    return raw.withColumn("a", _author_obj()).select(
        "item_seq", F.lit(PLATFORM).alias("platform"), *author_key(F.col("a")),
        first_present(F.col("a"), ["name", "displayName"]).alias("display_name"),
        first_present(F.col("a"), ["description", "bio"]).alias("bio"),
        F.try_variant_get(F.col("a"), "$.location", "string").alias("location"),
        F.try_variant_get(F.col("a"), "$.url", "string").alias("external_url"),
        F.concat(F.lit("https://x.com/"), F.coalesce(first_present(F.col("a"), ["userName", "username"]), F.lit("")))
        .alias("profile_url"),
        F.coalesce(first_present(F.col("a"), ["isVerified", "isBlueVerified", "verified"], "boolean"), F.lit(False))
        .alias("is_verified"),
        first_present(F.col("a"), ["followers", "followersCount"], "bigint").alias("follower_count"),
        first_present(F.col("a"), ["following", "followingCount"], "bigint").alias("following_count"),
        first_present(F.col("a"), ["statusesCount", "tweetsCount"], "bigint").alias("post_count"),
    ).drop("a")


def _entity_list(path: str, field: str) -> Column:
    """Entity array whose elements are objects (read ``field``) or plain strings."""
    xs = F.try_variant_get("v", path, "array<variant>")
    return F.coalesce(F.transform(xs, lambda x: F.coalesce(F.try_variant_get(x, f"$.{field}", "string"),
                                                           F.try_variant_get(x, "$", "string"))),
                      F.array().cast("array<string>"))


def post(raw: DataFrame, *keep: str) -> DataFrame:
    """Entity lists beat extraction when non-empty; retweet > quote > tweet; media fallback.
    ``keep`` names further columns of ``raw``."""
    v = F.col("v")
    text = F.coalesce(py_strip(first_present(v, ["fullText", "text"])), F.lit(""))
    media_items = F.try_variant_get(v, "$.media", "array<variant>")
    ext_items = F.try_variant_get(v, "$.extendedEntities.media", "array<variant>")
    items = F.when(F.size(media_items) > 0, media_items).otherwise(
        F.coalesce(ext_items, F.array().cast("array<variant>")))
    media = F.filter(F.transform(items, lambda m: media_struct(
        F.when(F.try_variant_get(m, "$.type", "string").isin(*TWITTER_VIDEO_TYPES), "video").otherwise("image"),
        F.coalesce(F.try_variant_get(m, "$.media_url_https", "string"), F.try_variant_get(m, "$.mediaUrl", "string"),
                   F.try_variant_get(m, "$.url", "string")))), lambda m: m["url"].isNotNull())
    tags = _entity_list("$.entities.hashtags", "text")
    ments = _entity_list("$.entities.mentions", "username")
    links = _entity_list("$.entities.urls", "expanded_url")
    a = _author_obj()
    return raw.withColumn("_text", text).select(
        "item_seq", F.lit(PLATFORM).alias("platform"),
        F.coalesce(first_present(v, ["id", "tweetId"]), F.lit("")).alias("platform_post_id"),
        F.coalesce(first_present(a, ["id", "userId", "restId"]), F.lit("")).alias("author_native_id"),
        twitter_content_type(first_present(v, ["isRetweet"], "boolean"),
                             first_present(v, ["isQuote"], "boolean")).alias("content_type"),
        F.col("_text").alias("caption"), F.col("_text").alias("content"),
        F.try_variant_get(v, "$.lang", "string").alias("language"),
        first_present(v, ["url", "twitterUrl"]).alias("url"),
        lower_list(F.when(F.size(tags) > 0, tags).otherwise(hashtags("_text"))).alias("hashtags"),
        lower_list(F.when(F.size(ments) > 0, ments).otherwise(mentions("_text"))).alias("mentions"),
        F.when(F.size(links) > 0, links).otherwise(urls("_text")).alias("urls"),
        indexed(F.coalesce(media, F.array().cast(EMPTY_MEDIA))).alias("media"),
        parse_ts_native(first_present(v, ["createdAt", "created_at"])).alias("posted_at"),
        first_present(v, ["retweetCount", "retweet_count"], "bigint").alias("retweet_count"),
        first_present(v, ["replyCount", "reply_count"], "bigint").alias("reply_count"),
        first_present(v, ["likeCount", "favorite_count"], "bigint").alias("like_count"),
        first_present(v, ["quoteCount", "quote_count"], "bigint").alias("quote_count"),
        first_present(v, ["viewCount", "views"], "bigint").alias("view_count"), *keep,
    )


def comment(raw: DataFrame, *keep: str) -> DataFrame:
    """N7 + S5: conversation search results minus the root post (by id or bare id)."""
    v = F.col("v")
    text = F.coalesce(py_strip(first_present(v, ["fullText", "text"])), F.lit(""))
    a = _author_obj()
    cid = F.coalesce(first_present(v, ["id", "tweetId"]), F.lit(""))
    out = raw.withColumn("_text", text).select(
        "item_seq", F.lit(PLATFORM).alias("platform"), cid.alias("platform_comment_id"),
        F.col("target").alias("post_ref"),
        F.coalesce(first_present(a, ["id", "userId", "restId"]), F.lit("")).alias("author_native_id"),
        F.try_variant_get(v, "$.inReplyToId", "string").alias("parent_native_id"),
        F.when(F.col("_text") == "", F.lit("(no text)")).otherwise(F.col("_text")).alias("content"),
        F.try_variant_get(v, "$.lang", "string").alias("language"),
        first_present(v, ["likeCount", "favorite_count"], "bigint").alias("likes"),
        first_present(v, ["replyCount", "reply_count"], "bigint").alias("reply_count"),
        hashtags("_text").alias("hashtags"), mentions("_text").alias("mentions"),
        parse_ts_native(first_present(v, ["createdAt", "created_at"])).alias("posted_at"), *keep,
    )
    return out


def exclude_root(comments: DataFrame) -> DataFrame:
    """Drop the searched root tweet itself; the target may be a status URL or a bare id."""
    from ...functions import bare_post_id
    return comments.where(F.col("platform_comment_id") != bare_post_id(F.col("post_ref")))


def engagement(posts: DataFrame) -> DataFrame:
    """Retweets are shares, replies are comments."""
    return posts.select(
        "platform", "platform_post_id", F.col("like_count").alias("likes"), F.col("view_count").alias("views"),
        F.col("retweet_count").alias("shares"), F.col("reply_count").alias("comments_count"),
        F.lit(None).cast("bigint").alias("saves"))
