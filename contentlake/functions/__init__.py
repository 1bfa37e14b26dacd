"""Scalar functions: Column -> Column, built from pyspark.sql.functions only."""

from .chat import display_title, question_intent, title_from_question  # noqa: F401
from .metrics import (embeddable_text, engagement_rate, has_items, has_text,  # noqa: F401
                      instagram_content_type, total_engagement, twitter_content_type,
                      youtube_content_type)
from .parse import (as_float, as_int, duration_seconds, filters_json, first_present,  # noqa: F401
                    parse_ts, parse_ts_native, parse_vector, vget)
from .text import (bare_post_id, checksum, citation, clean_tag, clean_username,  # noqa: F401
                   guess_language, hashtags, lower_list, mentions, natural_key, py_strip, snippet, tokens,
                   trigrams, urls)
