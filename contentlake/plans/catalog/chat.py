"""Conversations, threads, filters and data quality (W4, W5, S23, S24, P3-P6, P13, A5, A6, DQ1-DQ4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import functions as fn
from ...operators import chat as C
from ...operators import quality as Q
from ...operators.analytics import live
from ...schema import CONTENT_TYPES, MESSAGE_ROLES, PLATFORMS, SCRAPE_JOB_STATUSES
from ...sources.bindings import plat_sql, platform_of
from ..registry import ORACLES, register
from .normalize import raw_items


@register("conversation_history", """
    select conversation_id, turn, role, created_at,
      row_number() over (partition by conversation_id order by created_at, turn) as position
    from messages qualify position <= 200""")
def conversation_history(t):
    """Messages per conversation, ascending, at most 200."""
    h = C.history(t.messages, 200)
    return h.select("conversation_id", "turn", "role", "created_at", F.col("position").cast("bigint").alias("position"))


@register("memory_window", """
    select conversation_id, string_agg(role || ': ' || content, chr(10) order by created_at, turn) as memory
    from (select *, row_number() over (partition by conversation_id order by created_at desc, turn desc) as d
          from messages) where d <= 6 group by conversation_id""")
def memory_window(t):
    """Last 6 turns as 'role: content' lines (default; K8 parity flag available)."""
    return C.memory_window(t.messages, 6, 20, parity=False)


@register("memory_window_parity", """
    select conversation_id, string_agg(role || ': ' || content, chr(10) order by created_at, turn) as memory
    from (select *, row_number() over (partition by conversation_id order by created_at desc, turn desc) as d
          from (select * from messages qualify row_number() over (partition by conversation_id order by created_at, turn) <= 3))
    where d <= 2 group by conversation_id""")
def memory_window_parity(t):
    """W5 parity (K8): last 2 of the first 3 fetched messages."""
    return C.memory_window(t.messages, 2, 3, parity=True)


@register("conversation_markdown", """
    select c.conversation_id,
      case when m.body is null then '# ' || coalesce(nullif(c.title, ''), 'New conversation') || chr(10)
           else '# ' || coalesce(nullif(c.title, ''), 'New conversation') || chr(10) || chr(10) || m.body end as markdown
    from chats c left join (
      select conversation_id, string_agg(case when role = 'user' then '**You**' else '**Assistant**' end || ' ('
          || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00):' || chr(10) || content || chr(10), chr(10)
          order by created_at, turn) as body
      from messages group by conversation_id) m on m.conversation_id = c.conversation_id""")
def conversation_markdown(t):
    """Markdown export per conversation."""
    return C.markdown_export(t.chats, t.messages)


TURNS_SQL = """(select u.conversation_id, u.turn, u.content as question, a.content as answer,
      ['post:' || u.conversation_id, 'sql:q' || u.turn, 'comment:' || u.conversation_id || ':' || a.turn] as sources,
      'history' || chr(10) || u.content as prompt
    from messages u join messages a on a.conversation_id = u.conversation_id and a.turn = u.turn + 1
    where u.role = 'user' and a.role = 'assistant')"""


@register("turn_log_rows", f"""
    with turns as {TURNS_SQL}
    select 'messages' as tbl, conversation_id, turn, 'user' as role, question as content, null as retrieved_ids, null as prompt from turns
    union all select 'messages', conversation_id, turn, 'assistant', answer, array_to_string(sources, ','), null from turns
    union all select 'query_logs', conversation_id, turn, null, question,
                     array_to_string(list_filter(sources, lambda s: not starts_with(s, 'sql:')), ','), null from turns
    union all select 'assistant_logs', conversation_id, turn, null, null, null, substr(prompt, 1, 4000) from turns""")
def turn_log_rows(t):
    """Each answered turn logged to four tables."""
    m = t.messages
    u = m.where(F.col("role") == "user").alias("u")
    a = m.where(F.col("role") == "assistant").alias("a")
    j = u.join(a, (F.col("a.conversation_id") == F.col("u.conversation_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    turns = j.select(F.col("u.conversation_id").alias("conversation_id"), F.col("u.turn").alias("turn"),
                     F.col("u.content").alias("question"), F.col("a.content").alias("answer"),
                     F.array(F.concat(F.lit("post:"), F.col("u.conversation_id").cast("string")),
                             F.concat(F.lit("sql:q"), F.col("u.turn").cast("string")),
                             F.concat_ws(":", F.lit("comment"), F.col("u.conversation_id").cast("string"),
                                         F.col("a.turn").cast("string"))).alias("sources"),
                     F.concat(F.lit("history\n"), F.col("u.content")).alias("prompt"))
    return C.turn_log_rows(turns)


@register("search_by_title", r"""
    select conversation_id, title from chats where not is_archived and title ilike '%th%' escape '\'
    union all
    select conversation_id, title from chats where not is_archived and title ilike '%e\_%' escape '\'""")
def search_by_title(t):
    """Case-insensitive title search; '%' and '_' in the query are literal."""
    a = C.search_by_title(t.chats, "TH").select("conversation_id", "title")
    b = C.search_by_title(t.chats, "e_").select("conversation_id", "title")
    return a.unionByName(b)


@register("failed_logs", """
    select log_id, error from query_logs where error is not null order by created_at desc, log_id desc limit 50""")
def failed_logs(t):
    """Failed query logs, newest first (filter before the cut)."""
    return C.failed_logs(t.query_logs, 50).select("log_id", "error")


@register("failed_logs_parity", """
    select log_id, error from (select * from query_logs order by created_at desc, log_id desc limit 50)
    where error is not null""")
def failed_logs_parity(t):
    """P13 parity (K16): cut to 50 first, then keep failures."""
    return C.failed_logs(t.query_logs, 50, parity=True).select("log_id", "error")


@register("thread_participants", """
    with recursive chain(comment_id, root_id) as (
      select comment_id, comment_id from comments where parent_comment_id is null
      union all select c.comment_id, ch.root_id from comments c join chain ch on c.parent_comment_id = ch.comment_id)
    select ch.root_id, count(distinct c.author) as participants, count(*) as n_comments
    from chain ch join comments c on c.comment_id = ch.comment_id group by ch.root_id""")
def thread_participants(t):
    """A5: distinct participants per thread (roots found by pointer jumping)."""
    return C.thread_participants(t.comments)


@register("threads", """
    with recursive chain(comment_id, root_id, depth) as (
      select comment_id, comment_id, 0 from comments where parent_comment_id is null
      union all select c.comment_id, ch.root_id, ch.depth + 1 from comments c join chain ch on c.parent_comment_id = ch.comment_id)
    select ch.root_id, ch.comment_id, ch.depth,
      row_number() over (partition by ch.root_id order by c.posted_at, ch.comment_id) as position,
      count(*) over (partition by ch.root_id) as thread_size
    from chain ch join comments c on c.comment_id = ch.comment_id""")
def threads(t):
    """Each thread as ordered rows (root, comment, depth, position, size)."""
    return C.threads(t.comments).withColumn("position", F.col("position").cast("bigint")) \
                                .withColumn("depth", F.col("depth").cast("int"))


@register("posted_between", """
    select post_id, platform, posted_at from posts
    where deleted_at is null and posted_at between timestamp '2024-01-05' and timestamp '2024-01-20 12:00:00'
      and platform = 'instagram' order by posted_at desc, post_id limit 20""")
def posted_between(t):
    """Closed time range + platform, newest first."""
    p = live(t.posts).where(F.col("posted_at").between(F.lit("2024-01-05").cast("timestamp_ntz"),
                                                      F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")))
    p = p.where(F.col("platform") == "instagram")
    return p.orderBy(F.col("posted_at").desc(), "post_id").limit(20).select("post_id", "platform", "posted_at")


@register("lookup_natural_keys", f"""
    select p.post_id, p.platform, p.platform_post_id from posts p
    where exists (select 1 from (select {plat_sql('doc_id')} as platform, cast(doc_id as varchar) as platform_post_id
                                 from labels where quality = 1
                                 union all select 'twitter', cast(doc_id + 1000000 as varchar) from labels where toxic = 1) k
                  where k.platform = p.platform and k.platform_post_id = p.platform_post_id)""")
def lookup_natural_keys(t):
    """P5: batch lookup of many (platform, native id) keys with one semi join: the keys are the
    posts labelled good quality, plus keys that match nothing (a foreign id form)."""
    lab = t.labels
    keys = lab.where(F.col("quality") == 1).select(platform_of("doc_id").alias("platform"),
                                                   F.col("doc_id").cast("string").alias("platform_post_id")) \
        .unionByName(lab.where(F.col("toxic") == 1).select(
            F.lit("twitter").alias("platform"), (F.col("doc_id") + 1000000).cast("string").alias("platform_post_id")))
    return t.posts.join(keys, ["platform", "platform_post_id"], "left_semi").select("post_id", "platform",
                                                                                    "platform_post_id")


@register("lookup_by_key", """
    select 'tag' as kind, cast(p.post_id as varchar) as id from posts p where list_contains(p.hashtags, 'src3')
    union all select 'mention', cast(p.post_id as varchar) from posts p where list_contains(p.mentions, 'src7')
    union all select 'author', cast(author_id as varchar) from authors where username = 'Customer#000000042'
    union all select 'platform', cast(job_id as varchar) from scrape_jobs where platform = 'youtube'""")
def lookup_by_key(t):
    """Lookups by tag, mention, username and platform with the argument normalised."""
    p = t.posts
    tag = p.where(F.array_contains("hashtags", fn.clean_tag(F.lit(" #SRC3"), "#"))).select(
        F.lit("tag").alias("kind"), F.col("post_id").cast("string").alias("id"))
    men = p.where(F.array_contains("mentions", fn.clean_tag(F.lit("@Src7 "), "@"))).select(
        F.lit("mention").alias("kind"), F.col("post_id").cast("string").alias("id"))
    au = t.authors.where(F.col("username") == fn.clean_username(F.lit(" @Customer#000000042"))).select(
        F.lit("author").alias("kind"), F.col("author_id").cast("string").alias("id"))
    pl = t.scrape_jobs.where(F.col("platform") == "youtube").select(
        F.lit("platform").alias("kind"), F.col("job_id").cast("string").alias("id"))
    return tag.unionByName(men).unionByName(au).unionByName(pl)


# ------------------------------------------------------------------ data quality
@register("dq_unique", f"""
    select 'authors' as tbl, platform || ':' || platform_user_id as k, count(*) as n
    from ({ORACLES['norm_ig_author']}) group by 1, 2 having count(*) > 1
    union all
    select 'documents', sha256(text), count(*) from documents group by 1, 2 having count(*) > 1""")
def dq_unique(t):
    """DQ1: natural keys seen more than once (raw author items; document texts)."""
    a = raw_items(t).instagram_posts
    from ...operators.normalize import instagram
    au = Q.duplicates(instagram.author(a).select(fn.natural_key("platform", "platform_user_id").alias("k")), ["k"])
    docs = Q.duplicates(t.documents.select(F.sha2("text", 256).alias("k")), ["k"])
    return au.select(F.lit("authors").alias("tbl"), "k", "n").unionByName(docs.select(F.lit("documents").alias("tbl"), "k", "n"))


@register("dq_orphans", """
    select 'comments.post_id' as fk, count(*) as n_orphans from comments c where c.post_id not in (select post_id from posts)
    union all select 'posts.author_id', count(*) from posts p where p.author_id not in (select author_id from authors)
    union all select 'engagement.post_id', count(*) from engagement e where e.post_id not in (select post_id from posts)
    union all select 'query_logs.conversation_id', count(*) from query_logs q
      where q.conversation_id is not null and q.conversation_id not in (select conversation_id from chats)""")
def dq_orphans(t):
    """DQ2: foreign keys that do not resolve (left anti joins)."""
    checks = [("comments.post_id", t.comments, "post_id", t.posts, "post_id"),
              ("posts.author_id", t.posts, "author_id", t.authors, "author_id"),
              ("engagement.post_id", t.engagement, "post_id", t.posts, "post_id"),
              ("query_logs.conversation_id", t.query_logs, "conversation_id", t.chats, "conversation_id")]
    out = None
    for name, child, fk, parent, pk in checks:
        part = Q.orphans(child, fk, parent, pk).agg(F.count(F.lit(1)).alias("n_orphans")) \
                .select(F.lit(name).alias("fk"), "n_orphans")
        out = part if out is None else out.unionByName(part)
    return out


@register("dq_checks", """
    select 'likes_non_negative' as rule, count(*) filter (where not coalesce(likes >= 0, true)) as n_violations from engagement
    union all select 'views_non_negative', count(*) filter (where not coalesce(views >= 0, true)) from engagement
    union all select 'latency_non_negative', count(*) filter (where not coalesce(latency_ms >= 0, true)) from query_logs
    union all select 'post_count_non_negative', count(*) filter (where not coalesce(post_count >= 0, true)) from authors
    union all select 'comment_text_not_blank', count(*) filter (where not coalesce(trim(content) <> '', true)) from comments
    union all select 'mention_has_target', count(*) filter (where not coalesce(m <> '', true))
      from (select unnest(mentions) as m from posts)""")
def dq_checks(t):
    """DQ3/DQ5: counters >= 0, mention has a target, comment text not blank."""
    e = Q.violations(t.engagement, {"likes_non_negative": F.col("likes") >= 0, "views_non_negative": F.col("views") >= 0})
    q = Q.violations(t.query_logs, {"latency_non_negative": F.col("latency_ms") >= 0})
    a = Q.violations(t.authors, {"post_count_non_negative": F.col("post_count") >= 0})
    c = Q.violations(t.comments, {"comment_text_not_blank": F.trim("content") != ""})
    m = Q.violations(t.posts.select(F.explode("mentions").alias("m")), {"mention_has_target": F.col("m") != ""})
    return e.unionByName(q).unionByName(a).unionByName(c).unionByName(m)


def _in_list(col: str, values: list[str]) -> str:
    return f"{col} in (" + ", ".join(f"'{v}'" for v in values) + ")"


@register("dq_enums", f"""
    select 'posts.platform' as rule, count(*) filter (where not coalesce({_in_list('platform', PLATFORMS)}, true)) as n_violations from posts
    union all select 'posts.content_type', count(*) filter (where not coalesce({_in_list('content_type', CONTENT_TYPES)}, true)) from posts
    union all select 'messages.role', count(*) filter (where not coalesce({_in_list('role', MESSAGE_ROLES)}, true)) from messages
    union all select 'scrape_jobs.status', count(*) filter (where not coalesce({_in_list('status', SCRAPE_JOB_STATUSES)}, true)) from scrape_jobs
    union all select 'documents.lang', count(*) filter (where not coalesce(lang in ('en', 'fr', 'de'), true)) from documents""")
def dq_enums(t):
    """DQ4: values outside the allowed sets (the last rule shows a failing check)."""
    parts = [Q.violations(t.posts, {"posts.platform": F.col("platform").isin(*PLATFORMS),
                                    "posts.content_type": F.col("content_type").isin(*CONTENT_TYPES)}),
             Q.violations(t.messages, {"messages.role": F.col("role").isin(*MESSAGE_ROLES)}),
             Q.violations(t.scrape_jobs, {"scrape_jobs.status": F.col("status").isin(*SCRAPE_JOB_STATUSES)}),
             Q.violations(t.documents, {"documents.lang": F.col("lang").isin("en", "fr", "de")})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
