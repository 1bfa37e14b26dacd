"""Entity model: allowed values, natural keys, soft-delete columns.

Fixed values below must equal the reference's enumerations for results to match.
"""

from __future__ import annotations

# --- fixed values (must equal the reference) ---------------------------------
PLATFORMS = ["instagram", "twitter", "youtube", "reddit", "linkedin", "facebook", "tiktok", "news"]
MEDIA_TYPES = ["image", "video", "audio", "carousel", "gif", "other"]
CONTENT_TYPES = ["post", "reel", "story", "tweet", "retweet", "quote", "video", "short", "live"]
MESSAGE_ROLES = ["user", "assistant", "system"]
EMBEDDING_SOURCE_TYPES = ["post", "comment", "caption", "description", "transcript"]
SCRAPE_JOB_STATUSES = ["pending", "running", "succeeded", "failed", "partial"]
SAVED_SEARCH_KINDS = ["keyword", "semantic", "hybrid"]
# Hybrid retrieval weights; candidate over-fetch factors; assistant context sizes.
KEYWORD_WEIGHT = 0.4
SEMANTIC_WEIGHT = 0.6
HYBRID_OVERFETCH = 2
POPULAR_OVERFETCH = 3
SNIPPET_CHARS = 500
MAX_HITS = 8
MAX_SQL_ROWS = 20
MAX_HISTORY_TURNS = 6
HISTORY_FETCH = 20
STATS_WINDOW = 200
TITLE_CHARS = 60
PROMPT_LOG_CHARS = 4000
JOB_ERRORS_KEPT = 20
TRANSCRIPT_MAX_LIMIT = 10
DEFAULT_VECTOR_DIMS = 1536
IVF_LISTS = 100
# -----------------------------------------------------------------------------

# Platforms that support each scrape mode; youtube has no hashtag/keyword mode.
SCRAPE_MODES = {
    "instagram": {"profile", "posts", "comments", "hashtag"},
    "twitter": {"profile", "posts", "comments", "hashtag", "keyword"},
    "youtube": {"profile", "posts", "comments"},
}

# Natural (upsert) keys per table.
NATURAL_KEYS = {
    "authors": ["platform", "platform_user_id"],
    "channels": ["platform", "platform_channel_id"],
    "posts": ["platform", "platform_post_id"],
    "videos": ["platform", "platform_video_id"],
    "comments": ["platform", "platform_comment_id"],
    "hashtags": ["tag"],
    "engagement": ["post_id"],
    "post_hashtags": ["post_id", "hashtag_id"],
    "documents": ["source_type", "source_id"],
    "embeddings": ["source_id", "source_type", "model"],
}

SOFT_DELETE_TABLES = {"authors", "channels", "posts", "videos", "comments", "conversations", "saved_searches"}

# Foreign keys: child table, child column, parent table, parent column, on-delete action.
FOREIGN_KEYS = [
    ("channels", "author_id", "authors", "author_id", "cascade"),
    ("posts", "author_id", "authors", "author_id", "cascade"),
    ("videos", "channel_id", "channels", "channel_id", "cascade"),
    ("videos", "post_id", "posts", "post_id", "set_null"),
    ("media", "post_id", "posts", "post_id", "cascade"),
    ("post_hashtags", "post_id", "posts", "post_id", "cascade"),
    ("mentions", "post_id", "posts", "post_id", "cascade"),
    ("comments", "post_id", "posts", "post_id", "cascade"),
    ("comments", "parent_comment_id", "comments", "comment_id", "cascade"),
    ("engagement", "post_id", "posts", "post_id", "cascade"),
    ("query_logs", "conversation_id", "conversations", "conversation_id", "set_null"),
]


class PlanError(ValueError):
    """Raised at plan time, before any job runs (unknown platform, bad mode, unsafe SQL)."""


def check_scrape_mode(platform: str, mode: str) -> None:
    if platform not in SCRAPE_MODES:
        raise PlanError(f"unknown platform {platform!r}")
    if mode not in SCRAPE_MODES[platform]:
        raise PlanError(f"platform {platform!r} does not support mode {mode!r}")
