"""Engagement maths, content-type maps and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, py_strip

# --- fixed values: raw type -> content type (instagram); short-video limit -----
INSTAGRAM_TYPE_MAP = {"video": "reel", "clips": "reel", "igtv": "video",
                      "sidecar": "post", "image": "post", "feed": "post"}
SHORT_MAX_SECONDS = 60
TWITTER_VIDEO_TYPES = ["video", "animated_gif"]
# -----------------------------------------------------------------------------


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def instagram_content_type(raw_type) -> Column:
    return F.coalesce(F.element_at(_map_literal(INSTAGRAM_TYPE_MAP), F.lower(_col(raw_type))), F.lit("post"))


def twitter_content_type(is_retweet, is_quote) -> Column:
    return (F.when(F.coalesce(_col(is_retweet), F.lit(False)), F.lit("retweet"))
            .when(F.coalesce(_col(is_quote), F.lit(False)), F.lit("quote"))
            .otherwise(F.lit("tweet")))


def youtube_content_type(duration) -> Column:
    d = _col(duration)
    return F.when(d.isNotNull() & (d <= SHORT_MAX_SECONDS), F.lit("short")).otherwise(F.lit("video"))


def total_engagement(likes="likes", shares="shares", comments="comments_count", saves="saves",
                     reactions=None) -> Column:
    """Sum of known likes, shares, comments, saves plus all reactions; views excluded."""
    total = sum((F.coalesce(_col(c), F.lit(0)) for c in (likes, shares, comments, saves)), F.lit(0))
    if reactions is not None:
        r = F.coalesce(F.map_values(_col(reactions)), F.array().cast("array<bigint>"))
        total = total + F.aggregate(r, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total.cast("bigint")


def engagement_rate(total, views="views") -> Column:
    """total / views rounded to 6 places; NULL when views is NULL or 0."""
    v = _col(views)
    return F.round(_col(total) / F.nullif(v, F.lit(0)), 6)


def has_items(xs) -> Column:
    return F.coalesce(F.size(_col(xs)) > 0, F.lit(False))


def has_text(x) -> Column:
    return F.coalesce(py_strip(x) != "", F.lit(False))


def embeddable_text(caption, content) -> Column:
    """Caption, else content; blank becomes NULL (dropped by callers)."""
    t = F.coalesce(F.nullif(py_strip(caption), F.lit("")), py_strip(content))
    return F.nullif(t, F.lit(""))
