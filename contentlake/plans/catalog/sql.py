"""Guarded read-only SQL (Q1-Q6) and the SQL shapes it must support.

Each query is one SQL text run through ``safe_sql`` over the registered views;
where the dialects agree the oracle is the very same text (views become CTEs).
"""

from __future__ import annotations

from ..registry import register
from ..safe_sql import safe_sql, schema_catalog


def _sql(name: str, text: str, oracle: str | None = None):
    def q(t, _text=text):
        return safe_sql(t.spark, _text, t)

    return register(name, oracle if oracle is not None else text)(q)


_sql("safe_sql_basic", """
    select platform, count(*) as n_posts, min(posted_at) as first_post from posts
    where deleted_at is null group by platform""")

_sql("sql_cte", """
    with recent as (select * from posts where posted_at >= timestamp '2024-01-03'),
         liked as (select post_id, likes from engagement where likes > 5)
    select r.platform, count(*) as n, sum(l.likes) as likes
    from recent r join liked l on l.post_id = r.post_id group by r.platform""",
     """
    with recent as (select * from posts where posted_at >= timestamp '2024-01-03'),
         liked as (select post_id, likes from engagement where likes > 5)
    select r.platform, count(*) as n, cast(sum(l.likes) as bigint) as likes
    from recent r join liked l on l.post_id = r.post_id group by r.platform""")

_sql("sql_recursive", """
    with recursive chain(comment_id, root_id, depth) as (
      select comment_id, comment_id, 0 from comments where parent_comment_id is null
      union all
      select c.comment_id, ch.root_id, ch.depth + 1 from comments c join chain ch on c.parent_comment_id = ch.comment_id)
    select root_id, count(*) as n, max(depth) as max_depth from chain group by root_id""")

_sql("sql_subquery", """
    select a.author_id, a.username,
      (select count(*) from posts p where p.author_id = a.author_id) as n_posts
    from authors a where a.post_count > (select avg(post_count) from authors)""")

_sql("sql_exists", """
    select p.post_id from posts p
    where exists (select 1 from engagement e where e.post_id = p.post_id and e.likes > 12)
      and p.post_id in (select post_id from comments)
      and p.post_id not in (select post_id from posts where deleted_at is not null)""")

_sql("sql_having", """
    select author_id, count(*) as n, count(distinct platform) as n_platforms from posts
    group by author_id having count(*) >= 10 and count(distinct platform) > 0""")

_sql("sql_date_interval", """
    select cast(date_trunc('week', created_at) as date) as wk, count(*) as n, round(avg(latency_ms), 4) as avg_latency
    from query_logs where created_at < timestamp '2024-01-01' + interval 14 days group by 1""")

_sql("sql_json", """
    select cast(get_json_object(props, '$.k') as int) % 10 as k10, event_type, count(*) as n
    from events group by 1, 2""", """
    select cast(json_extract_string(props, '$.k') as int) % 10 as k10, event_type, count(*) as n
    from events group by 1, 2""")

_sql("sql_array", """
    select tag, count(*) as n, count(distinct platform) as n_platforms
    from posts lateral view explode(hashtags) x as tag group by tag""", """
    select tag, count(*) as n, count(distinct platform) as n_platforms
    from (select platform, unnest(hashtags) as tag from posts) group by tag""")

_sql("sql_string", """
    select author_id, upper(substr(username, 1, 8)) as u8, cast(length(username) as bigint) as len, replace(username, '#', '-') as dashed,
      lpad(cast(author_id as string), 6, '0') as padded, concat_ws('|', platform, username) as joined,
      username like 'Customer#00000001%' as is_like
    from authors""")

_sql("sql_rollup", """
    select platform, content_type, count(*) as n, cast(grouping(content_type) as bigint) as g
    from posts group by rollup(platform, content_type)""")

_sql("sql_cube", """
    select platform, language, count(*) as n from posts group by cube(platform, language)""")

_sql("sql_grouping_sets", """
    select platform, content_type, count(*) as n from posts
    group by grouping sets ((platform), (content_type), ())""")

_sql("sql_distinct_agg", """
    select platform, count(distinct author_id) as n_authors, count(distinct language) as n_lang,
      count(distinct source) as n_sources, count(*) as n from posts group by platform""")

_sql("sql_window_rank", """
    select p.post_id, p.platform, e.likes,
      cast(rank() over (partition by p.platform order by e.likes desc) as bigint) as rnk,
      cast(dense_rank() over (partition by p.platform order by e.likes desc) as bigint) as drnk,
      cast(row_number() over (partition by p.platform order by e.likes desc, p.post_id) as bigint) as rn
    from posts p join engagement e on e.post_id = p.post_id""")

_sql("sql_window_frame", """
    select p.post_id, p.platform,
      sum(e.likes) over (partition by p.platform order by p.post_id rows between 2 preceding and current row) as likes_3,
      avg(e.likes) over (partition by p.platform order by p.post_id rows between unbounded preceding and current row) as avg_run,
      count(*) over (partition by p.platform order by p.post_id range between 9 preceding and current row) as n_range
    from posts p join engagement e on e.post_id = p.post_id""", """
    select post_id, platform, cast(likes_3 as bigint) as likes_3, avg_run, n_range from (
    select p.post_id, p.platform,
      sum(e.likes) over (partition by p.platform order by p.post_id rows between 2 preceding and current row) as likes_3,
      avg(e.likes) over (partition by p.platform order by p.post_id rows between unbounded preceding and current row) as avg_run,
      count(*) over (partition by p.platform order by p.post_id range between 9 preceding and current row) as n_range
    from posts p join engagement e on e.post_id = p.post_id)""")

_sql("sql_lag_lead", """
    select log_id, conversation_id,
      lag(latency_ms) over (partition by conversation_id order by created_at, log_id) as prev_latency,
      lead(log_id, 2) over (partition by conversation_id order by created_at, log_id) as next2,
      first_value(log_id) over (partition by conversation_id order by created_at, log_id) as first_log
    from query_logs""")

_sql("sql_set_ops", """
    select author_id from posts where platform = 'instagram'
    union select author_id from posts where platform = 'twitter'
    intersect select author_id from authors where post_count > 1000
    except select author_id from authors where author_id % 5 = 0""", """
    (select author_id from posts where platform = 'instagram'
     union select author_id from posts where platform = 'twitter'
     intersect select author_id from authors where post_count > 1000)
    except select author_id from authors where author_id % 5 = 0""")

_sql("sql_limit_offset", """
    select job_id, platform, status, created_at from scrape_jobs
    where status in ('succeeded', 'partial') order by created_at desc, job_id limit 15 offset 30""")

_sql("sql_case_distinct", """
    select distinct platform,
      case when n_chars_bucket >= 3 then 'long' when n_chars_bucket = 2 then 'medium' else 'short' end as size_class
    from (select platform, least(floor(length(content) / 1000), 3) as n_chars_bucket from posts) x""")

_sql("sql_range_join", """
    select p.post_id, count(*) as n_logs, min(q.created_at) as first_log
    from posts p join query_logs q on q.conversation_id = p.post_id
      and q.created_at between p.posted_at - interval 1 day and p.posted_at + interval 10 days
    group by p.post_id""")


_sql("sql_match_embeddings", """
    select source_type, cast(source_id as string) as source_id, round(similarity, 6) as similarity from (
      select * from match_embeddings((select embedding from embeddings where vec_id = 7), 'twitter')
      order by similarity desc, source_id limit 10)""", """
    select source_type, cast(source_id as varchar) as source_id, round(similarity, 6) as similarity from (
      select source_type, source_id,
        list_cosine_similarity(embedding, (select cast(embedding as double[]) from embeddings where vec_id = 7)) as similarity
      from doc_embeddings where platform = 'twitter' order by similarity desc, source_id limit 10)""")


@register("schema_catalog")
def schema_catalog_q(t):
    """Q3: the views and columns a user may query."""
    return schema_catalog(t.spark, t)
