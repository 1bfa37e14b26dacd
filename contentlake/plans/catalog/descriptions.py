"""One-line descriptions (with the SURVEY section 2 id) for registered queries without a docstring."""

DESCRIPTIONS = {
    "activity_over_time": "A9: live posts per day and platform",
    "ai_query_stats": "A3: count and mean latency (round 2) of the last 200 query logs",
    "dashboard_summary": "A10: the eight dashboard results as one long (section, rank, item, value) frame",
    "engagement_by_platform": "A8: posts, likes, views, total engagement and mean rate per platform",
    "most_active_authors": "W2/W7: authors by stored post count, NULLs last",
    "platform_distribution": "A2: live posts per platform, zero-filled over the 8 known platforms",
    "popular_posts": "R5/W6: twitter posts by likes, filters before the cut",
    "posts_with_engagement": "J2: posts joined with engagement, total and rate (F17, F18)",
    "recent_jobs": "W3: newest 20 scrape jobs",
    "top_engagement_posts": "W1: engagement rows by likes desc",
    "trending_hashtags": "A4/J9: posts per hashtag, top 10",
    "semantic_topk_platform": "R2: cosine top-10 restricted to one platform",
    "fn_as_float": "F3: text/JSON/junk to double",
    "fn_as_int": "F2: Python int() semantics (numeric text, truncating floats, junk -> NULL)",
    "fn_bare_post_id": "F21: bare id from a status URL (query cut)",
    "fn_checksum": "F12: SHA-256 of the stripped text",
    "fn_citation": "F25: [platform/type/id8] + 500-char snippet",
    "fn_clean_names": "F9/F10: username and tag/mention name cleaning",
    "fn_content_type": "F16: content-type maps of the three platforms",
    "fn_duration_seconds": "F15: seconds from numbers, H:M:S or M:S text; junk -> NULL",
    "fn_engagement_rate": "F18: total / views rounded 6; NULL when views NULL or 0",
    "fn_filters_json": "F23: JSON of the set filters only",
    "fn_flags": "F19: is_reply, has_text, has_media, is_deleted",
    "fn_guess_language": "F7: blank -> und, pure ASCII -> en, else und",
    "fn_hashtags": "F4: distinct lower-case hashtags in first-seen order over whole texts",
    "fn_lower_list": "F8: strip leading #/@ and lower-case every element",
    "fn_mentions": "F5: distinct lower-case mentions in first-seen order over whole texts",
    "fn_parse_ts": "F13: ISO-with-Z and epoch timestamps, junk -> NULL",
    "fn_parse_ts_native": "F14: native 'Wed Oct 10 20:19:24 +0000 2018' and ISO timestamps",
    "fn_parse_vector": "F22: vector text -> array<float>",
    "fn_question_intent": "F24: first matching intent (trend, sentiment, comparison, summary)",
    "fn_titles": "F20: display title default and 60-char new title",
    "fn_total_engagement": "F17: likes+shares+comments+saves (+ reactions), views excluded",
    "fn_urls": "F6: distinct http(s) URLs, trailing ).,  stripped",
    "norm_ig_author": "N1: instagram author per item (id fallbacks, profile URL template, metadata keys)",
    "norm_ig_comment": "N3/S4: instagram comments with nested replies flattened",
    "norm_ig_engagement": "N4: instagram engagement (0 or NULL views fall to play count)",
    "norm_ig_post": "N2: instagram post (type map, explicit-or-extracted tags, ordered media)",
    "norm_tw_author": "N5: twitter author from the embedded author object or the item",
    "norm_tw_comment": "N7: twitter comments (conversation search results)",
    "norm_tw_engagement": "N8: twitter engagement (retweets -> shares, replies -> comments)",
    "norm_tw_post": "N6: twitter post (entity lists, retweet > quote > tweet, media fallback)",
    "norm_yt_author": "N9: youtube channel owner (channelId else channelUrl)",
    "norm_yt_channel": "N10: youtube channel from the same item",
    "norm_yt_comment": "N13: youtube comments (parent only when isReply)",
    "norm_yt_engagement": "N14: youtube engagement (no shares)",
    "norm_yt_post": "N11: youtube post (short when duration <= 60 s)",
    "norm_yt_video": "N12: youtube video row from the same item",
    "safe_sql_basic": "Q1/Q2: guarded read-only SQL over the registered views",
    "sql_array": "Q5: array explode in guarded SQL",
    "sql_case_distinct": "Q5: CASE and DISTINCT in guarded SQL",
    "sql_cte": "Q5: common table expressions in guarded SQL",
    "sql_cube": "A11: CUBE",
    "sql_date_interval": "Q5: date_trunc and interval arithmetic",
    "sql_distinct_agg": "A11: distinct aggregates",
    "sql_exists": "Q5: EXISTS / IN / NOT IN subqueries",
    "sql_grouping_sets": "A11: GROUPING SETS",
    "sql_having": "Q5: HAVING",
    "sql_json": "Q5: JSON field access",
    "sql_lag_lead": "W8: lag / lead / first_value",
    "sql_limit_offset": "Q5: LIMIT / OFFSET",
    "sql_match_embeddings": "Q6/X3: match_embeddings table function, top 10 by the caller's LIMIT",
    "sql_range_join": "J10: equi + range (band) join",
    "sql_recursive": "Q5: recursive CTE (comment chains)",
    "sql_rollup": "A11: ROLLUP with grouping()",
    "sql_set_ops": "U2: UNION / INTERSECT / EXCEPT",
    "sql_string": "Q5: string functions",
    "sql_subquery": "Q5: correlated and scalar subqueries",
    "sql_window_frame": "W8: ROWS and RANGE window frames",
    "sql_window_rank": "W8: rank / dense_rank / row_number",
}
