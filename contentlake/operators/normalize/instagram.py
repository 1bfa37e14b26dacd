"""Instagram items -> authors, posts, comments, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import (as_int, first_present, hashtags, instagram_content_type, mentions, parse_ts, py_strip, urls,
                          vget)
from .common import EMPTY_MEDIA, explicit_or, flag, fp, indexed, media_struct, sfp

PLATFORM = "instagram"
# --- fixed values: profile keys kept out of the author metadata -----------------
AUTHOR_META_EXCLUDED = ["ownerUsername", "username", "ownerFullName", "fullName", "biography", "bio",
                        "profilePicUrl"]
# ------------------------------------------------------------------------------


def author_key() -> list[Column]:
    """``platform_user_id`` and ``username`` of an item's author."""
    return [F.coalesce(fp(["ownerId", "id", "userId", "pk"]), fp(["username"]), F.lit("")).alias("platform_user_id"),
            F.coalesce(py_strip(fp(["ownerUsername", "username"])), F.lit("unknown")).alias("username")]


def author(raw: DataFrame) -> DataFrame:
    """One author per item; id falls back to the item id, then the username."""
    username = fp(["ownerUsername", "username"])
    keys = F.json_object_keys(F.col("raw"))
    return raw.select(
        "item_seq", F.lit(PLATFORM).alias("platform"), *author_key(),
        sfp(["ownerFullName", "fullName", "full_name"]).alias("display_name"),
        sfp(["biography", "bio"]).alias("bio"),
        F.coalesce(fp(["url", "profileUrl"]),
                   F.concat(F.lit("https://www.instagram.com/"), F.coalesce(username, F.lit("")), F.lit("/")))
        .alias("profile_url"),
        fp(["profilePicUrl", "profilePicUrlHD"]).alias("avatar_url"),
        flag(["verified", "isVerified"]).alias("is_verified"),
        flag(["private", "isPrivate"]).alias("is_private"),
        as_int(fp(["followersCount", "followerCount"], "bigint")).alias("follower_count"),
        as_int(fp(["followsCount", "followingCount"], "bigint")).alias("following_count"),
        as_int(fp(["postsCount", "postCount"], "bigint")).alias("post_count"),
        fp(["externalUrl"]).alias("external_url"),
        F.array_sort(F.filter(keys, lambda k: ~k.isin(*AUTHOR_META_EXCLUDED))).alias("metadata_keys"),
    )


def post(raw: DataFrame, *keep: str) -> DataFrame:
    """Post with content type map, tag fallback and ordered media; ``keep`` names further columns of ``raw``."""
    v = F.col("v")
    caption = F.coalesce(sfp(["caption", "text"]), F.lit(""))
    display = F.nullif(vget(v, "$.displayUrl"), F.lit(""))
    video = F.nullif(vget(v, "$.videoUrl"), F.lit(""))
    part = lambda c, k: F.nullif(F.try_variant_get(c, f"$.{k}", "string"), F.lit(""))
    children = F.transform(
        F.coalesce(vget(v, "$.childPosts", "array<variant>"), F.array().cast("array<variant>")),
        lambda c: media_struct(F.when(part(c, "videoUrl").isNotNull(), "video").otherwise("image"),
                               F.coalesce(part(c, "displayUrl"), part(c, "videoUrl"))))
    media = F.concat(
        F.when(display.isNotNull(), F.array(media_struct("image", display))).otherwise(F.array().cast(EMPTY_MEDIA)),
        F.filter(children, lambda m: m["url"].isNotNull()),
        F.when(video.isNotNull(), F.array(media_struct("video", video))).otherwise(F.array().cast(EMPTY_MEDIA)))
    short = F.coalesce(vget(v, "$.shortCode"), F.lit(""))
    return raw.withColumn("_caption", caption).select(
        "item_seq", F.lit(PLATFORM).alias("platform"),
        F.coalesce(fp(["id", "shortCode"]), F.lit("")).alias("platform_post_id"),
        F.coalesce(fp(["ownerId", "id", "userId", "pk"]), fp(["username"]), F.lit("")).alias("author_native_id"),
        instagram_content_type(F.coalesce(fp(["productType", "type"]), F.lit("feed"))).alias("content_type"),
        F.col("_caption").alias("caption"), F.col("_caption").alias("content"),
        F.coalesce(F.nullif(fp(["url"]), F.lit("")), F.concat(F.lit("https://www.instagram.com/p/"), short, F.lit("/"))).alias("url"),
        explicit_or(hashtags("_caption"), "$.hashtags").alias("hashtags"),
        explicit_or(mentions("_caption"), "$.mentions").alias("mentions"),
        urls("_caption").alias("urls"),
        indexed(media).alias("media"),
        parse_ts(fp(["timestamp", "takenAt"])).alias("posted_at"),
        flag(["isSponsored"]).alias("is_sponsored"),
        vget(v, "$.locationName").alias("location"),
        fp(["likesCount", "likeCount"], "bigint").alias("likes_count"),
        fp(["commentsCount", "commentCount"], "bigint").alias("comments_count"),
        vget(v, "$.videoViewCount", "bigint").alias("video_view_count"),
        vget(v, "$.videoPlayCount", "bigint").alias("video_play_count"), *keep,
    )


def comment(raw: DataFrame, *keep: str) -> DataFrame:
    """N3 + S4: root comments and their nested replies, flattened; a reply's parent is its root."""
    v = F.col("v")
    replies = vget(v, "$.replies", "array<variant>")
    child = vget(v, "$.childComments", "array<variant>")
    nested = F.when(F.size(replies) > 0, replies).otherwise(F.coalesce(child, F.array().cast("array<variant>")))
    # The root is element 0 of its thread, so that an item is read once.
    allc = raw.select("item_seq", "target", *keep, F.coalesce(first_present(v, ["id", "commentId"]), F.lit("")).alias("_root"),
                      F.posexplode(F.concat(F.array(v), nested)).alias("reply_pos", "c")) \
              .withColumn("parent_native_id", F.when(F.col("reply_pos") > 0, F.col("_root")))
    c = F.col("c")
    text = F.coalesce(py_strip(first_present(c, ["text", "content"])), F.lit(""))
    return allc.select(
        "item_seq", "reply_pos", F.lit(PLATFORM).alias("platform"),
        F.coalesce(first_present(c, ["id", "commentId"]), F.lit("")).alias("platform_comment_id"),
        F.col("target").alias("post_ref"),
        F.coalesce(first_present(c, ["ownerId", "id", "userId", "pk"]), F.lit("")).alias("author_native_id"),
        "parent_native_id",
        F.when(text == "", F.lit("(no text)")).otherwise(text).alias("content"),
        first_present(c, ["likesCount", "likeCount"], "bigint").alias("likes"),
        first_present(c, ["repliesCount", "replyCount"], "bigint").alias("reply_count"),
        hashtags(text).alias("hashtags"), mentions(text).alias("mentions"),
        parse_ts(first_present(c, ["timestamp", "createdAt"])).alias("posted_at"),
        first_present(c, ["ownerUsername", "username"]).alias("owner_username"), *keep,
    )


def engagement(posts: DataFrame) -> DataFrame:
    """Likes, views (view count, 0 or NULL falls to play count), comments; no shares."""
    return posts.select(
        "platform", "platform_post_id", F.col("likes_count").alias("likes"),
        F.coalesce(F.nullif(F.col("video_view_count"), F.lit(0)), F.col("video_play_count")).alias("views"),
        F.lit(None).cast("bigint").alias("shares"), F.col("comments_count").alias("comments_count"),
        F.lit(None).cast("bigint").alias("saves"))
