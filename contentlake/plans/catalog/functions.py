"""Scalar functions F1-F26 applied over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import functions as fn
from ...sources.bindings import HASHTAG_SQL, MENTION_SQL, distinct_sql, platform_of, plat_sql
from ..registry import register

WS = r"[\s\p{Z}\x1c-\x1f\x85]"


def _tag_probe():
    """Text exercising tag edge cases, built from each document."""
    return F.concat(F.col("text"), F.lit(" #"), F.upper("source"), F.lit(" #"), F.col("source"),
                    F.lit(" ##"), F.col("lang"), F.lit(" a#b $5#no #"), F.col("lang"), F.lit("_x @"),
                    F.col("source"), F.lit(" mail@host @"), F.upper("lang"), F.lit(" @@"), F.col("source"))


TAG_PROBE_SQL = ("text || ' #' || upper(source) || ' #' || source || ' ##' || lang || "
                 "' a#b $5#no #' || lang || '_x @' || source || ' mail@host @' || upper(lang) || ' @@' || source")


@register("fn_hashtags", f"""
    select doc_id, array_to_string({distinct_sql(f"regexp_extract_all(lower({TAG_PROBE_SQL}), '{HASHTAG_SQL}', 1)")}, ',') as tags
    from documents""")
def fn_hashtags(t):
    return t.documents.select("doc_id", F.array_join(fn.hashtags(_tag_probe()), ",").alias("tags"))


@register("fn_mentions", f"""
    select doc_id, array_to_string({distinct_sql(f"regexp_extract_all(lower({TAG_PROBE_SQL}), '{MENTION_SQL}', 1)")}, ',') as mentions
    from documents""")
def fn_mentions(t):
    return t.documents.select("doc_id", F.array_join(fn.mentions(_tag_probe()), ",").alias("mentions"))


@register("fn_urls", f"""
    select page_id, array_to_string({distinct_sql("list_transform(regexp_extract_all('see (' || url || '). and ' || url || ', ' || html, 'https?://[^\\s<>\"'']+', 0), lambda u: regexp_replace(u, '[).,]+$', ''))")}, ' ') as urls
    from pages""")
def fn_urls(t):
    p = t.pages
    probe = F.concat(F.lit("see ("), F.col("url"), F.lit("). and "), F.col("url"), F.lit(", "), F.col("html"))
    return p.select("page_id", F.array_join(fn.urls(probe), " ").alias("urls"))


@register("fn_guess_language", """
    select doc_id, lang, case when text is null or trim(text) = '' then 'und'
                              when regexp_full_match(text, '[\\x00-\\x7F]*') then 'en' else 'und' end as guessed
    from documents""")
def fn_guess_language(t):
    return t.documents.select("doc_id", "lang", fn.guess_language("text").alias("guessed"))


AS_INT_SQL = "case when regexp_full_match(trim({s}), '[+-]?[0-9]+') then cast(trim({s}) as bigint) end"


@register("fn_as_int", f"""
    select event_id, cast(trunc(value) as bigint) as from_double,
      {AS_INT_SQL.format(s='cast(value as varchar)')} as from_text,
      {AS_INT_SQL.format(s="cast(json_extract(props, '$.k') as varchar)")} as from_json_text,
      {AS_INT_SQL.format(s="'n' || event_type")} as from_junk
    from events""")
def fn_as_int(t):
    e = t.events
    return e.select("event_id", fn.as_int(F.col("value")).alias("from_double"),
                    fn.as_int(F.col("value").cast("string")).alias("from_text"),
                    fn.as_int(F.get_json_object("props", "$.k")).alias("from_json_text"),
                    fn.as_int(F.concat(F.lit("n"), F.col("event_type"))).alias("from_junk"))


@register("fn_as_float", """
    select event_id, try_cast(cast(value as varchar) as double) as from_text,
      try_cast(json_extract_string(props, '$.k') as double) as from_json, try_cast(event_type as double) as from_junk
    from events""")
def fn_as_float(t):
    e = t.events
    return e.select("event_id", fn.as_float(F.col("value").cast("string")).alias("from_text"),
                    fn.as_float(F.get_json_object("props", "$.k")).alias("from_json"),
                    fn.as_float(F.col("event_type")).alias("from_junk"))


@register("fn_lower_list", """
    select doc_id, array_to_string(list_transform(['#' || upper(source), '@' || upper(lang), '##' || source, 'Mixed' || lang],
                                   lambda x: lower(regexp_replace(x, '^[#@]+', ''))), ',') as tags
    from documents""")
def fn_lower_list(t):
    d = t.documents
    xs = F.array(F.concat(F.lit("#"), F.upper("source")), F.concat(F.lit("@"), F.upper("lang")),
                 F.concat(F.lit("##"), F.col("source")), F.concat(F.lit("Mixed"), F.col("lang")))
    return d.select("doc_id", F.array_join(fn.lower_list(xs), ",").alias("tags"))


@register("fn_clean_names", """
    select c_custkey, trim(regexp_replace(trim('  @' || c_name || ' '), '^@+', '')) as username,
      lower(trim(regexp_replace(trim(' #' || c_mktsegment), '^#+', ''))) as tag,
      lower(trim(regexp_replace(trim('@' || c_name), '^@+', ''))) as mention
    from customer""")
def fn_clean_names(t):
    c = t.customer
    return c.select("c_custkey",
                    fn.clean_username(F.concat(F.lit("  @"), F.col("c_name"), F.lit(" "))).alias("username"),
                    fn.clean_tag(F.concat(F.lit(" #"), F.col("c_mktsegment")), "#").alias("tag"),
                    fn.clean_tag(F.concat(F.lit("@"), F.col("c_name")), "@").alias("mention"))


@register("fn_checksum", f"""
    select doc_id, sha256(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) as checksum,
      sha256(regexp_replace('  ' || text || chr(10), '^{WS}+|{WS}+$', '', 'g')) as checksum_padded
    from documents""")
def fn_checksum(t):
    d = t.documents
    return d.select("doc_id", fn.checksum("text").alias("checksum"),
                    fn.checksum(F.concat(F.lit("  "), F.col("text"), F.lit("\n"))).alias("checksum_padded"))


@register("fn_parse_ts", """
    select event_id,
      timezone('UTC', try_cast(strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as timestamptz)) as from_iso,
      cast(to_timestamp(event_id * 3600 + 1700000000) as timestamp) as from_epoch,
      cast(null as timestamp) as from_junk
    from events""")
def fn_parse_ts(t):
    e = t.events
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return e.select("event_id", fn.parse_ts(iso).alias("from_iso"),
                    fn.parse_ts(F.col("event_id") * 3600 + 1700000000).alias("from_epoch"),
                    fn.parse_ts(F.concat(F.lit("yesterday "), F.col("event_type"))).alias("from_junk"))


@register("fn_parse_ts_native", """
    select event_id,
      timezone('UTC', strptime(strftime(ts, '%a %b %d %H:%M:%S +0000 %Y'), '%a %b %d %H:%M:%S %z %Y')) as from_native,
      timezone('UTC', try_cast(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as timestamptz)) as from_iso
    from events""")
def fn_parse_ts_native(t):
    e = t.events
    native = F.date_format("ts", "EEE MMM dd HH:mm:ss +0000 yyyy")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return e.select("event_id", fn.parse_ts_native(native).alias("from_native"),
                    fn.parse_ts_native(iso).alias("from_iso"))


DUR_TEXT_SQL = """case doc_id % 5 when 0 then cast(n_chars as varchar)
      when 1 then cast(n_chars // 60 as varchar) || ':' || lpad(cast(n_chars % 60 as varchar), 2, '0')
      when 2 then '01:' || cast(n_chars // 60 as varchar) || ':' || lpad(cast(n_chars % 60 as varchar), 2, '0')
      when 3 then 'PT' || cast(n_chars as varchar) || 'S' else cast(n_chars as varchar) || '.5' end"""


@register("fn_duration_seconds", f"""
    select doc_id, case when regexp_full_match(d, '[0-9]+(:[0-9]+)*')
        then list_reduce(list_transform(string_split(d, ':'), lambda p: cast(p as double)), lambda a, b: a * 60 + b) end as seconds,
      cast(n_chars as double) as from_number
    from (select doc_id, n_chars, {DUR_TEXT_SQL} as d from documents)""")
def fn_duration_seconds(t):
    d = t.documents
    text = (F.when(F.col("doc_id") % 5 == 0, F.col("n_chars").cast("string"))
            .when(F.col("doc_id") % 5 == 1, F.concat((F.col("n_chars") / 60).cast("bigint").cast("string"), F.lit(":"),
                                                     F.lpad((F.col("n_chars") % 60).cast("string"), 2, "0")))
            .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("01:"), (F.col("n_chars") / 60).cast("bigint").cast("string"),
                                                     F.lit(":"), F.lpad((F.col("n_chars") % 60).cast("string"), 2, "0")))
            .when(F.col("doc_id") % 5 == 3, F.concat(F.lit("PT"), F.col("n_chars").cast("string"), F.lit("S")))
            .otherwise(F.concat(F.col("n_chars").cast("string"), F.lit(".5"))))
    return d.select("doc_id", fn.duration_seconds(text).alias("seconds"),
                    fn.duration_seconds(F.col("n_chars"), F.lit(True)).alias("from_number"))


IG_TYPES = "['video','clips','igtv','sidecar','image','feed','Carousel','CLIPS']"


@register("fn_content_type", f"""
    select doc_id,
      coalesce(map_extract(map {{'video':'reel','clips':'reel','igtv':'video','sidecar':'post','image':'post','feed':'post'}},
               lower({IG_TYPES}[doc_id % 8 + 1]))[1], 'post') as instagram_type,
      case when doc_id % 7 = 1 then 'retweet' when doc_id % 5 = 2 then 'quote' else 'tweet' end as twitter_type,
      case when n_chars % 120 <= 60 then 'short' else 'video' end as youtube_type,
      case when doc_id % 9 = 0 then 'video' else (case when n_chars % 120 <= 60 then 'short' else 'video' end) end as youtube_type_nullable
    from documents""")
def fn_content_type(t):
    d = t.documents
    raw = F.element_at(F.array(*[F.lit(x) for x in ["video", "clips", "igtv", "sidecar", "image", "feed",
                                                      "Carousel", "CLIPS"]]), (F.col("doc_id") % 8 + 1).cast("int"))
    dur = (F.col("n_chars") % 120).cast("double")
    return d.select("doc_id", fn.instagram_content_type(raw).alias("instagram_type"),
                    fn.twitter_content_type(F.col("doc_id") % 7 == 1, F.col("doc_id") % 5 == 2).alias("twitter_type"),
                    fn.youtube_content_type(dur).alias("youtube_type"),
                    fn.youtube_content_type(F.when(F.col("doc_id") % 9 != 0, dur)).alias("youtube_type_nullable"))


TOTAL_SQL = "cast(coalesce(likes,0)+coalesce(shares,0)+coalesce(comments_count,0)+coalesce(saves,0) as bigint)"


@register("fn_total_engagement", f"""
    select post_id, {TOTAL_SQL} as total_engagement,
      {TOTAL_SQL} + cast(coalesce(views, 0) * 2 + post_id % 7 as bigint) as total_with_reactions
    from engagement""")
def fn_total_engagement(t):
    e = t.engagement
    reactions = F.create_map(F.lit("love"), F.coalesce(F.col("views"), F.lit(0)) * 2,
                             F.lit("wow"), F.col("post_id") % 7)
    return e.select("post_id", fn.total_engagement().alias("total_engagement"),
                    fn.total_engagement(reactions=reactions).alias("total_with_reactions"))


@register("fn_engagement_rate", f"""
    select post_id, round({TOTAL_SQL} / nullif(views, 0), 6) as engagement_rate,
      round({TOTAL_SQL} / nullif(case when post_id % 4 = 0 then 0 else views end, 0), 6) as rate_zero_views
    from engagement""")
def fn_engagement_rate(t):
    e = t.engagement
    total = fn.total_engagement()
    return e.select("post_id", fn.engagement_rate(total).alias("engagement_rate"),
                    fn.engagement_rate(total, F.when(F.col("post_id") % 4 == 0, 0).otherwise(F.col("views")))
                    .alias("rate_zero_views"))


@register("fn_flags", """
    select c.comment_id, c.parent_comment_id is not null as is_reply,
      coalesce(trim(c.content) <> '', false) as has_text,
      coalesce(len(p.urls) > 0, false) as has_media, p.deleted_at is not null as is_deleted
    from comments c left join posts p on p.post_id = c.post_id""")
def fn_flags(t):
    c, p = t.comments, t.posts.select("post_id", "urls", "deleted_at")
    j = c.join(p, "post_id", "left")
    return j.select("comment_id", F.col("parent_comment_id").isNotNull().alias("is_reply"),
                    fn.has_text("content").alias("has_text"), fn.has_items("urls").alias("has_media"),
                    F.col("deleted_at").isNotNull().alias("is_deleted"))


@register("fn_titles", """
    select conversation_id, coalesce(nullif(case when conversation_id % 4 = 0 then '' else title end, ''),
                                     'New conversation') as display_title,
      substr(coalesce(title, ''), 1, 60) as new_title
    from chats""")
def fn_titles(t):
    c = t.chats
    return c.select("conversation_id",
                    fn.display_title(F.when(F.col("conversation_id") % 4 == 0, F.lit("")).otherwise(F.col("title")))
                    .alias("display_title"),
                    fn.title_from_question(F.coalesce("title", F.lit(""))).alias("new_title"))


@register("fn_bare_post_id", """
    select doc_id, case when s like '%/status/%' then split_part(string_split(s, '/')[-1], '?', 1) else s end as bare_id
    from (select doc_id, case when doc_id % 3 = 0 then 'https://x.com/' || source || '/status/' || cast(doc_id as varchar) || '?s=20'
                              when doc_id % 3 = 1 then 'https://x.com/' || source || '/status/' || cast(doc_id as varchar)
                              else cast(doc_id as varchar) end as s from documents)""")
def fn_bare_post_id(t):
    d = t.documents
    s = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://x.com/"), F.col("source"), F.lit("/status/"),
                                                   F.col("doc_id").cast("string"), F.lit("?s=20")))
         .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("https://x.com/"), F.col("source"), F.lit("/status/"),
                                                  F.col("doc_id").cast("string")))
         .otherwise(F.col("doc_id").cast("string")))
    return d.select("doc_id", fn.bare_post_id(s).alias("bare_id"))


@register("fn_parse_vector", """
    select vec_id, len(v) as dims, round(list_sum(cast(v as double[])), 4) as total
    from (select vec_id, cast(cast(embedding as varchar) as float[]) as v from embeddings)""")
def fn_parse_vector(t):
    e = t.embeddings
    v = fn.parse_vector(F.to_json("embedding"))
    return e.select("vec_id", F.size(v).cast("bigint").alias("dims"),
                    F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@register("fn_filters_json", f"""
    select event_id, '{{' || concat_ws(',',
        case when event_id % 2 = 0 then '"platform":"' || {plat_sql('user_id')} || '"' end,
        case when event_id % 5 = 0 then '"hashtag":"' || event_type || '"' end,
        case when event_id % 3 = 0 then '"date_from":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"' end,
        case when event_id % 7 = 0 then '"min_likes":' || cast(cast(trunc(value) as bigint) as varchar) end) || '}}' as filters_json
    from events""")
def fn_filters_json(t):
    e = t.events
    return e.select("event_id", fn.filters_json(
        platform=F.when(F.col("event_id") % 2 == 0, platform_of("user_id")),
        hashtag=F.when(F.col("event_id") % 5 == 0, F.col("event_type")),
        date_from=F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
        min_likes=F.when(F.col("event_id") % 7 == 0, F.col("value").cast("bigint")),
    ).alias("filters_json"))


INTENT_SQL = """case when q like '%trend%' or q like '%trending%' or q like '%over time%' or q like '%time-series%' or q like '%timeseries%' then 'trend'
  when q like '%sentiment%' or q like '%feel about%' or q like '%opinion%' or q like '%controversial%' then 'sentiment'
  when q like '%compare%' or q like '%comparison%' or q like '% vs %' or q like '%versus%' or q like '%cross-platform%' then 'comparison'
  when q like '%summarize%' or q like '%summary%' or q like '%sum up%' or q like '%tl;dr%' then 'summary' end"""
PREFIXES = ["Show the trend of ", "What is the Sentiment on ", "Compare ", "TL;DR: ", "Tell me about "]


@register("fn_question_intent", f"""
    select conv_id, turn, {INTENT_SQL} as intent
    from (select conv_id, turn, lower(['{"','".join(PREFIXES)}'][conv_id % 5 + 1] || text) as q
          from conversations where role = 'user')""")
def fn_question_intent(t):
    c = t.conversations.where(F.col("role") == "user")
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("conv_id") % 5 + 1).cast("int"))
    q = F.concat(prefix, F.col("text"))
    return c.select("conv_id", "turn", fn.question_intent(q).alias("intent"))


@register("fn_citation", """
    select source_id, '[' || platform || '/' || source_type || '/' || substr(cast(source_id as varchar), 1, 8) || '] '
      || substr(coalesce(content, ''), 1, 500) as citation
    from search_docs""")
def fn_citation(t):
    s = t.search_docs
    return s.select("source_id", fn.citation("platform", "source_type", "source_id", "content").alias("citation"))
