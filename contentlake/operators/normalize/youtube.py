"""YouTube items -> authors, channels, posts, videos, comments, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import first_present, hashtags, lower_list, mentions, parse_ts, py_strip, urls, youtube_content_type
from ...functions.parse import variant_duration
from .common import EMPTY_MEDIA, indexed, media_struct

PLATFORM = "youtube"


def _channel_id():
    return F.coalesce(first_present(F.col("v"), ["channelId", "channelUrl"]), F.lit(""))


def author_key() -> list[Column]:
    """``platform_user_id`` and ``username`` of an item's author."""
    return [_channel_id().alias("platform_user_id"),
            F.coalesce(py_strip(first_present(F.col("v"), ["channelName", "channelUsername"])), F.lit("unknown")).alias("username")]


def author(raw: DataFrame) -> DataFrame:
    """The channel owner; id = channelId else channelUrl."""
    v = F.col("v")
    cid = _channel_id()
    return raw.select(
        "item_seq", F.lit(PLATFORM).alias("platform"), *author_key(),
        F.try_variant_get(v, "$.channelName", "string").alias("display_name"),
        F.coalesce(F.try_variant_get(v, "$.channelUrl", "string"),
                   F.concat(F.lit("https://www.youtube.com/channel/"), cid)).alias("profile_url"),
        F.coalesce(F.try_variant_get(v, "$.channelIsVerified", "boolean"), F.lit(False)).alias("is_verified"),
        first_present(v, ["numberOfSubscribers", "subscriberCount"], "bigint").alias("follower_count"),
        first_present(v, ["channelTotalVideos", "videoCount"], "bigint").alias("post_count"),
    )


def channel_columns() -> list[Column]:
    """The channel fields that the lake stores."""
    v = F.col("v")
    return [_channel_id().alias("platform_channel_id"), _channel_id().alias("author_native_id"),
            F.coalesce(py_strip(F.try_variant_get(v, "$.channelName", "string")), F.lit("unknown")).alias("name"),
            first_present(v, ["numberOfSubscribers", "subscriberCount"], "bigint").alias("subscriber_count")]


def channel(raw: DataFrame) -> DataFrame:
    """The same item also yields the channel row."""
    v = F.col("v")
    return raw.select(
        "item_seq", F.lit(PLATFORM).alias("platform"), *channel_columns(),
        F.try_variant_get(v, "$.channelDescription", "string").alias("description"),
        first_present(v, ["channelTotalVideos", "videoCount"], "bigint").alias("video_count"),
        first_present(v, ["channelTotalViews", "channelViewCount"], "bigint").alias("total_views"),
        F.try_variant_get(v, "$.channelLocation", "string").alias("country"),
    )


def post(raw: DataFrame, *keep: str) -> DataFrame:
    """Short when duration <= 60 s, else (or unknown) video; ``keep`` names further columns of ``raw``."""
    v = F.col("v")
    desc = F.coalesce(py_strip(first_present(v, ["text", "description"])), F.lit(""))
    vurl = first_present(v, ["url", "videoUrl"])
    dur = variant_duration(v, "$.duration")
    media = F.when(vurl.isNotNull(), F.array(media_struct("video", vurl))).otherwise(F.array().cast(EMPTY_MEDIA))
    explicit = F.try_variant_get(v, "$.hashtags", "array<string>")
    return raw.withColumn("_desc", desc).withColumn("_dur", dur).select(
        "item_seq", F.lit(PLATFORM).alias("platform"),
        F.coalesce(first_present(v, ["id", "videoId"]), F.lit("")).alias("platform_post_id"),
        _channel_id().alias("author_native_id"),
        youtube_content_type(F.col("_dur")).alias("content_type"),
        F.coalesce(py_strip(F.try_variant_get(v, "$.title", "string")), F.lit("")).alias("caption"),
        F.col("_desc").alias("content"), vurl.alias("url"),
        lower_list(F.when(F.size(explicit) > 0, explicit).otherwise(hashtags("_desc"))).alias("hashtags"),
        lower_list(mentions("_desc")).alias("mentions"), urls("_desc").alias("urls"),
        indexed(media).alias("media"),
        parse_ts(first_present(v, ["date", "uploadDate"])).alias("posted_at"),
        first_present(v, ["viewCount", "views"], "bigint").alias("view_count"),
        F.try_variant_get(v, "$.likes", "bigint").alias("like_count"),
        F.try_variant_get(v, "$.commentsCount", "bigint").alias("comments_count"),
        F.col("_dur").alias("duration_seconds"), *keep,
    )


def video_columns() -> list[Column]:
    """The video fields that the lake stores."""
    v = F.col("v")
    vid = F.coalesce(first_present(v, ["id", "videoId"]), F.lit(""))
    return [vid.alias("platform_video_id"), _channel_id().alias("channel_native_id"), vid.alias("post_native_id"),
            F.coalesce(py_strip(F.try_variant_get(v, "$.title", "string")), F.lit("")).alias("title"),
            variant_duration(v, "$.duration").alias("duration_seconds"),
            first_present(v, ["url", "videoUrl"]).alias("video_url"),
            parse_ts(first_present(v, ["date", "uploadDate"])).alias("published_at")]


def video(raw: DataFrame) -> DataFrame:
    """The same item also yields the video row (linked to its post by natural key)."""
    v = F.col("v")
    return raw.select(
        "item_seq", F.lit(PLATFORM).alias("platform"), *video_columns(),
        F.coalesce(py_strip(first_present(v, ["text", "description"])), F.lit("")).alias("description"),
        F.try_variant_get(v, "$.transcript", "string").alias("transcript"),
        F.try_variant_get(v, "$.thumbnailUrl", "string").alias("thumbnail_url"),
    )


def comment(raw: DataFrame, *keep: str) -> DataFrame:
    """parent = parentCommentId only when isReply."""
    v = F.col("v")
    text = F.coalesce(py_strip(first_present(v, ["text", "comment"])), F.lit(""))
    is_reply = F.coalesce(F.try_variant_get(v, "$.isReply", "boolean"), F.lit(False))
    return raw.withColumn("_text", text).select(
        "item_seq", F.lit(PLATFORM).alias("platform"),
        F.coalesce(first_present(v, ["id", "cid"]), F.lit("")).alias("platform_comment_id"),
        F.col("target").alias("post_ref"),
        F.when(is_reply, F.try_variant_get(v, "$.parentCommentId", "string")).alias("parent_native_id"),
        F.when(F.col("_text") == "", F.lit("(no text)")).otherwise(F.col("_text")).alias("content"),
        first_present(v, ["voteCount", "likesCount"], "bigint").alias("likes"),
        F.try_variant_get(v, "$.replyCount", "bigint").alias("reply_count"),
        hashtags("_text").alias("hashtags"), mentions("_text").alias("mentions"),
        parse_ts(F.try_variant_get(v, "$.publishedAt", "string")).alias("posted_at"),
        F.try_variant_get(v, "$.author", "string").alias("author_display_name"), *keep,
    )


def engagement(posts: DataFrame) -> DataFrame:
    """Likes, views, comments; no shares."""
    return posts.select(
        "platform", "platform_post_id", F.col("like_count").alias("likes"), F.col("view_count").alias("views"),
        F.lit(None).cast("bigint").alias("shares"), F.col("comments_count").alias("comments_count"),
        F.lit(None).cast("bigint").alias("saves"))
