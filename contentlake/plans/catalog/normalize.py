"""Normalization jobs (N1-N15) over raw items landed from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.normalize import engagement_all, instagram, twitter, youtube
from ...operators.normalize.common import media_text
from ...sources.raw import RawItems
from ..registry import register
from .raw_oracle import fp, fpi, joined, lower_list, strip, tags_sql, ts_native_sql, ts_sql, urls_sql

_RAW: dict[int, RawItems] = {}


def raw_items(t) -> RawItems:
    if id(t) not in _RAW:
        _RAW[id(t)] = RawItems(t)
    return _RAW[id(t)]


def _j(xs: str) -> F.Column:
    return F.array_join(F.col(xs), ",")


# ---------------------------------------------------------------- instagram
@register("norm_ig_author", f"""
    select item_seq, 'instagram' as platform,
      coalesce({fp(['ownerId', 'id', 'userId', 'pk'])}, j->>'$.username', '') as platform_user_id,
      coalesce({strip(fp(['ownerUsername', 'username']))}, 'unknown') as username,
      coalesce({fp(['url', 'profileUrl'])}, 'https://www.instagram.com/' || coalesce({fp(['ownerUsername', 'username'])}, '') || '/') as profile_url,
      coalesce(cast({fp(['verified', 'isVerified'])} as boolean), false) as is_verified,
      coalesce(cast({fp(['private', 'isPrivate'])} as boolean), false) as is_private,
      {fpi(['followersCount', 'followerCount'])} as follower_count,
      array_to_string(list_sort(list_filter(json_keys(j), lambda k: k not in
        ('ownerUsername','username','ownerFullName','fullName','biography','bio','profilePicUrl'))), ',') as metadata_keys
    from (select item_seq, cast(raw as json) as j from raw_ig_posts)""")
def norm_ig_author(t):
    a = instagram.author(raw_items(t).instagram_posts)
    return a.select("item_seq", "platform", "platform_user_id", "username", "profile_url", "is_verified",
                    "is_private", "follower_count", F.array_join("metadata_keys", ",").alias("metadata_keys"))


IG_MAP = "map {'video':'reel','clips':'reel','igtv':'video','sidecar':'post','image':'post','feed':'post'}"
IG_MEDIA = """
  (case when j->>'$.displayUrl' is not null then ['image|' || (j->>'$.displayUrl')] else [] end)
  || coalesce(list_transform(list_filter(cast(j->'$.childPosts' as json[]),
          lambda c: coalesce(c->>'$.displayUrl', c->>'$.videoUrl') is not null),
        lambda c: (case when c->>'$.videoUrl' is not null then 'video' else 'image' end) || '|'
                  || coalesce(c->>'$.displayUrl', c->>'$.videoUrl')), [])
  || (case when j->>'$.videoUrl' is not null then ['video|' || (j->>'$.videoUrl')] else [] end)"""


@register("norm_ig_post", f"""
    select item_seq, 'instagram' as platform, coalesce({fp(['id', 'shortCode'])}, '') as platform_post_id,
      coalesce({fp(['ownerId', 'id', 'userId', 'pk'])}, j->>'$.username', '') as author_native_id,
      coalesce(map_extract({IG_MAP}, lower(coalesce({fp(['productType', 'type'])}, 'feed')))[1], 'post') as content_type,
      cap as caption, cap as content,
      coalesce(j->>'$.url', 'https://www.instagram.com/p/' || coalesce(j->>'$.shortCode', '') || '/') as url,
      {joined(lower_list(f"case when len(from_json(j->'$.hashtags', '[\"VARCHAR\"]')) > 0 then from_json(j->'$.hashtags', '[\"VARCHAR\"]') else {tags_sql('cap', '#')} end"))} as hashtags,
      {joined(lower_list(f"case when len(from_json(j->'$.mentions', '[\"VARCHAR\"]')) > 0 then from_json(j->'$.mentions', '[\"VARCHAR\"]') else {tags_sql('cap', '@')} end"))} as mentions,
      {joined(urls_sql('cap'))} as urls,
      array_to_string({IG_MEDIA}, ',') as media,
      {ts_sql(fp(['timestamp', 'takenAt']))} as posted_at,
      coalesce(cast(j->>'$.isSponsored' as boolean), false) as is_sponsored, j->>'$.locationName' as location,
      {fpi(['likesCount', 'likeCount'])} as likes_count, {fpi(['commentsCount', 'commentCount'])} as comments_count
    from (select item_seq, j, coalesce({strip(fp(['caption', 'text']))}, '') as cap
          from (select item_seq, cast(raw as json) as j from raw_ig_posts))""")
def norm_ig_post(t):
    p = instagram.post(raw_items(t).instagram_posts)
    return p.select("item_seq", "platform", "platform_post_id", "author_native_id", "content_type", "caption",
                    "content", "url", _j("hashtags").alias("hashtags"), _j("mentions").alias("mentions"),
                    _j("urls").alias("urls"), media_text("media").alias("media"), "posted_at", "is_sponsored",
                    "location", "likes_count", "comments_count")


IG_COMMENTS_FLAT = f"""
    with items as (select item_seq, target, cast(raw as json) as j from raw_ig_comments),
    nested as (select item_seq, target, j,
                 case when len(cast(j->'$.replies' as json[])) > 0 then cast(j->'$.replies' as json[])
                      else coalesce(cast(j->'$.childComments' as json[]), []) end as reps from items),
    flat as (select item_seq, 0 as reply_pos, target, j as c, cast(null as varchar) as parent_native_id from items
             union all
             select item_seq, reply_pos, target, reps[reply_pos] as c, coalesce({fp(['id', 'commentId'])}, '') as parent_native_id
             from (select *, unnest(generate_series(1, len(reps))) as reply_pos from nested where len(reps) > 0))"""


@register("norm_ig_comment", IG_COMMENTS_FLAT + f"""
    select item_seq, reply_pos, 'instagram' as platform, coalesce({fp(['id', 'commentId'], 'c')}, '') as platform_comment_id,
      target as post_ref, coalesce({fp(['ownerId', 'id', 'userId', 'pk'], 'c')}, '') as author_native_id, parent_native_id,
      case when txt = '' then '(no text)' else txt end as content,
      {fpi(['likesCount', 'likeCount'], 'c')} as likes,
      {joined(tags_sql('txt', '#'))} as hashtags, {joined(tags_sql('txt', '@'))} as mentions,
      {ts_sql(fp(['timestamp', 'createdAt'], 'c'))} as posted_at, {fp(['ownerUsername', 'username'], 'c')} as owner_username
    from (select *, coalesce({strip(fp(['text', 'content'], 'c'))}, '') as txt from flat)""")
def norm_ig_comment(t):
    c = instagram.comment(raw_items(t).instagram_comments)
    return c.select("item_seq", F.col("reply_pos").cast("bigint").alias("reply_pos"), "platform", "platform_comment_id", "post_ref", "author_native_id",
                    "parent_native_id", "content", "likes", _j("hashtags").alias("hashtags"),
                    _j("mentions").alias("mentions"), "posted_at", "owner_username")


@register("comments_flatten_replies", IG_COMMENTS_FLAT + f"""
    select item_seq, reply_pos, coalesce({fp(['id', 'commentId'], 'c')}, '') as platform_comment_id, parent_native_id
    from flat""")
def comments_flatten_replies(t):
    """Nested replies become rows whose parent is the root comment."""
    c = instagram.comment(raw_items(t).instagram_comments)
    return c.select("item_seq", F.col("reply_pos").cast("bigint").alias("reply_pos"), "platform_comment_id",
                    "parent_native_id")


@register("norm_ig_engagement", f"""
    select coalesce({fp(['id', 'shortCode'])}, '') as platform_post_id, {fpi(['likesCount', 'likeCount'])} as likes,
      coalesce(nullif(cast(j->>'$.videoViewCount' as bigint), 0), cast(j->>'$.videoPlayCount' as bigint)) as views,
      {fpi(['commentsCount', 'commentCount'])} as comments_count
    from (select cast(raw as json) as j from raw_ig_posts)""")
def norm_ig_engagement(t):
    e = instagram.engagement(instagram.post(raw_items(t).instagram_posts))
    return e.select("platform_post_id", "likes", "views", "comments_count")


# ---------------------------------------------------------------- twitter
TW_AUTHOR = "coalesce(j->'$.author', j)"


@register("norm_tw_author", f"""
    select item_seq, 'twitter' as platform, coalesce({fp(['id', 'userId', 'restId'], 'a')}, '') as platform_user_id,
      coalesce({strip(fp(['userName', 'username', 'screen_name'], 'a'))}, 'unknown') as username,
      {fp(['name', 'displayName'], 'a')} as display_name,
      'https://x.com/' || coalesce({fp(['userName', 'username'], 'a')}, '') as profile_url,
      {fpi(['followers', 'followersCount'], 'a')} as follower_count
    from (select item_seq, {TW_AUTHOR} as a from (select item_seq, cast(raw as json) as j from raw_tw_posts))""")
def norm_tw_author(t):
    a = twitter.author(raw_items(t).twitter_posts)
    return a.select("item_seq", "platform", "platform_user_id", "username", "display_name", "profile_url",
                    "follower_count")


def _ent(path: str, field: str) -> str:
    return (f"coalesce(list_transform(cast(j->'{path}' as json[]), lambda x: coalesce(x->>'$.{field}', "
            f"case when json_type(x) = 'VARCHAR' then x->>'$' end)), [])")


TW_MEDIA = """list_filter(list_transform(
      case when len(cast(j->'$.media' as json[])) > 0 then cast(j->'$.media' as json[])
           else coalesce(cast(j->'$.extendedEntities.media' as json[]), []) end,
      lambda m: (case when m->>'$.type' in ('video', 'animated_gif') then 'video' else 'image' end) || '|'
                || coalesce(m->>'$.media_url_https', m->>'$.mediaUrl', m->>'$.url')), lambda s: s is not null)"""


@register("norm_tw_post", f"""
    select item_seq, 'twitter' as platform, coalesce({fp(['id', 'tweetId'])}, '') as platform_post_id,
      coalesce({fp(['id', 'userId', 'restId'], 'a')}, '') as author_native_id,
      case when coalesce(cast(j->>'$.isRetweet' as boolean), false) then 'retweet'
           when coalesce(cast(j->>'$.isQuote' as boolean), false) then 'quote' else 'tweet' end as content_type,
      txt as caption, txt as content, j->>'$.lang' as language, {fp(['url', 'twitterUrl'])} as url,
      {joined(lower_list(f"case when len({_ent('$.entities.hashtags', 'text')}) > 0 then {_ent('$.entities.hashtags', 'text')} else {tags_sql('txt', '#')} end"))} as hashtags,
      {joined(lower_list(f"case when len({_ent('$.entities.mentions', 'username')}) > 0 then {_ent('$.entities.mentions', 'username')} else {tags_sql('txt', '@')} end"))} as mentions,
      {joined(f"case when len({_ent('$.entities.urls', 'expanded_url')}) > 0 then {_ent('$.entities.urls', 'expanded_url')} else {urls_sql('txt')} end")} as urls,
      array_to_string({TW_MEDIA}, ',') as media,
      {ts_native_sql(fp(['createdAt', 'created_at']))} as posted_at,
      {fpi(['retweetCount', 'retweet_count'])} as retweet_count, {fpi(['replyCount', 'reply_count'])} as reply_count,
      {fpi(['likeCount', 'favorite_count'])} as like_count, {fpi(['viewCount', 'views'])} as view_count
    from (select item_seq, j, {TW_AUTHOR} as a, coalesce({strip(fp(['fullText', 'text']))}, '') as txt
          from (select item_seq, cast(raw as json) as j from raw_tw_posts))""")
def norm_tw_post(t):
    p = twitter.post(raw_items(t).twitter_posts)
    return p.select("item_seq", "platform", "platform_post_id", "author_native_id", "content_type", "caption",
                    "content", "language", "url", _j("hashtags").alias("hashtags"), _j("mentions").alias("mentions"),
                    _j("urls").alias("urls"), media_text("media").alias("media"), "posted_at", "retweet_count",
                    "reply_count", "like_count", "view_count")


TW_COMMENTS = f"""
    select item_seq, 'twitter' as platform, coalesce({fp(['id', 'tweetId'])}, '') as platform_comment_id, target as post_ref,
      coalesce({fp(['id', 'userId', 'restId'], 'a')}, '') as author_native_id, j->>'$.inReplyToId' as parent_native_id,
      case when txt = '' then '(no text)' else txt end as content, j->>'$.lang' as language,
      {fpi(['likeCount', 'favorite_count'])} as likes, {fpi(['replyCount', 'reply_count'])} as reply_count,
      {joined(tags_sql('txt', '#'))} as hashtags, {ts_native_sql(fp(['createdAt', 'created_at']))} as posted_at
    from (select item_seq, target, j, {TW_AUTHOR} as a, coalesce({strip(fp(['fullText', 'text']))}, '') as txt
          from (select item_seq, target, cast(raw as json) as j from raw_tw_comments))"""


@register("norm_tw_comment", TW_COMMENTS)
def norm_tw_comment(t):
    c = twitter.comment(raw_items(t).twitter_comments)
    return c.select("item_seq", "platform", "platform_comment_id", "post_ref", "author_native_id", "parent_native_id",
                    "content", "language", "likes", "reply_count", _j("hashtags").alias("hashtags"), "posted_at")


@register("comments_exclude_root", f"""
    select item_seq, platform_comment_id, parent_native_id from ({TW_COMMENTS})
    where platform_comment_id <> (case when post_ref like '%/status/%'
                                       then split_part(string_split(post_ref, '/')[-1], '?', 1) else post_ref end)""")
def comments_exclude_root(t):
    """The conversation search returns the root tweet too; drop it by id or bare id."""
    c = twitter.exclude_root(twitter.comment(raw_items(t).twitter_comments))
    return c.select("item_seq", "platform_comment_id", "parent_native_id")


@register("norm_tw_engagement", f"""
    select coalesce({fp(['id', 'tweetId'])}, '') as platform_post_id, {fpi(['likeCount', 'favorite_count'])} as likes,
      {fpi(['viewCount', 'views'])} as views, {fpi(['retweetCount', 'retweet_count'])} as shares,
      {fpi(['replyCount', 'reply_count'])} as comments_count
    from (select cast(raw as json) as j from raw_tw_posts)""")
def norm_tw_engagement(t):
    e = twitter.engagement(twitter.post(raw_items(t).twitter_posts))
    return e.select("platform_post_id", "likes", "views", "shares", "comments_count")


# ---------------------------------------------------------------- youtube
YT_CH = f"coalesce({fp(['channelId', 'channelUrl'])}, '')"
YT_DUR = """case when json_type(j->'$.duration') in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(j->>'$.duration' as double)
     when regexp_full_match(j->>'$.duration', '[0-9]+(:[0-9]+)*')
       then list_reduce(list_transform(string_split(j->>'$.duration', ':'), lambda p: cast(p as double)), lambda a, b: a * 60 + b)
     end"""


@register("norm_yt_author", f"""
    select item_seq, 'youtube' as platform, {YT_CH} as platform_user_id,
      coalesce({strip(fp(['channelName', 'channelUsername']))}, 'unknown') as username,
      coalesce(j->>'$.channelUrl', 'https://www.youtube.com/channel/' || {YT_CH}) as profile_url,
      {fpi(['numberOfSubscribers', 'subscriberCount'])} as follower_count
    from (select item_seq, cast(raw as json) as j from raw_yt_videos)""")
def norm_yt_author(t):
    a = youtube.author(raw_items(t).youtube_videos)
    return a.select("item_seq", "platform", "platform_user_id", "username", "profile_url", "follower_count")


@register("norm_yt_channel", f"""
    select item_seq, 'youtube' as platform, {YT_CH} as platform_channel_id,
      coalesce({strip("j->>'$.channelName'")}, 'unknown') as name,
      {fpi(['numberOfSubscribers', 'subscriberCount'])} as subscriber_count
    from (select item_seq, cast(raw as json) as j from raw_yt_videos)""")
def norm_yt_channel(t):
    c = youtube.channel(raw_items(t).youtube_videos)
    return c.select("item_seq", "platform", "platform_channel_id", "name", "subscriber_count")


@register("norm_yt_post", f"""
    select item_seq, 'youtube' as platform, coalesce({fp(['id', 'videoId'])}, '') as platform_post_id,
      {YT_CH} as author_native_id,
      case when dur is not null and dur <= 60 then 'short' else 'video' end as content_type,
      coalesce({strip("j->>'$.title'")}, '') as caption, descr as content, {fp(['url', 'videoUrl'])} as url,
      {joined(lower_list(f"case when len(from_json(j->'$.hashtags', '[\"VARCHAR\"]')) > 0 then from_json(j->'$.hashtags', '[\"VARCHAR\"]') else {tags_sql('descr', '#')} end"))} as hashtags,
      {joined(lower_list(tags_sql('descr', '@')))} as mentions, {joined(urls_sql('descr'))} as urls,
      case when {fp(['url', 'videoUrl'])} is not null then 'video|' || {fp(['url', 'videoUrl'])} else '' end as media,
      {ts_sql(fp(['date', 'uploadDate']))} as posted_at, {fpi(['viewCount', 'views'])} as view_count,
      cast(j->>'$.likes' as bigint) as like_count, dur as duration_seconds
    from (select item_seq, j, coalesce({strip(fp(['text', 'description']))}, '') as descr, {YT_DUR} as dur
          from (select item_seq, cast(raw as json) as j from raw_yt_videos))""")
def norm_yt_post(t):
    p = youtube.post(raw_items(t).youtube_videos)
    return p.select("item_seq", "platform", "platform_post_id", "author_native_id", "content_type", "caption",
                    "content", "url", _j("hashtags").alias("hashtags"), _j("mentions").alias("mentions"),
                    _j("urls").alias("urls"), media_text("media").alias("media"), "posted_at", "view_count",
                    "like_count", "duration_seconds")


@register("norm_yt_video", f"""
    select item_seq, coalesce({fp(['id', 'videoId'])}, '') as platform_video_id, {YT_CH} as channel_native_id,
      coalesce({strip("j->>'$.title'")}, '') as title, {YT_DUR} as duration_seconds,
      j->>'$.thumbnailUrl' as thumbnail_url, {fp(['url', 'videoUrl'])} as video_url,
      {ts_sql(fp(['date', 'uploadDate']))} as published_at
    from (select item_seq, cast(raw as json) as j from raw_yt_videos)""")
def norm_yt_video(t):
    v = youtube.video(raw_items(t).youtube_videos)
    return v.select("item_seq", "platform_video_id", "channel_native_id", "title", "duration_seconds",
                    "thumbnail_url", "video_url", "published_at")


@register("norm_yt_comment", f"""
    select item_seq, 'youtube' as platform, coalesce({fp(['id', 'cid'])}, '') as platform_comment_id, target as post_ref,
      case when coalesce(cast(j->>'$.isReply' as boolean), false) then j->>'$.parentCommentId' end as parent_native_id,
      case when txt = '' then '(no text)' else txt end as content,
      {fpi(['voteCount', 'likesCount'])} as likes, cast(j->>'$.replyCount' as bigint) as reply_count,
      {ts_sql("j->>'$.publishedAt'")} as posted_at, j->>'$.author' as author_display_name
    from (select item_seq, target, j, coalesce({strip(fp(['text', 'comment']))}, '') as txt
          from (select item_seq, target, cast(raw as json) as j from raw_yt_comments))""")
def norm_yt_comment(t):
    c = youtube.comment(raw_items(t).youtube_comments)
    return c.select("item_seq", "platform", "platform_comment_id", "post_ref", "parent_native_id", "content", "likes",
                    "reply_count", "posted_at", "author_display_name")


@register("norm_yt_engagement", f"""
    select coalesce({fp(['id', 'videoId'])}, '') as platform_post_id, cast(j->>'$.likes' as bigint) as likes,
      {fpi(['viewCount', 'views'])} as views, cast(j->>'$.commentsCount' as bigint) as comments_count
    from (select cast(raw as json) as j from raw_yt_videos)""")
def norm_yt_engagement(t):
    e = youtube.engagement(youtube.post(raw_items(t).youtube_videos))
    return e.select("platform_post_id", "likes", "views", "comments_count")


@register("engagement_all_platforms", f"""
    select platform, count(*) as n_rows, count(likes) as n_likes, count(views) as n_views, count(shares) as n_shares,
      cast(sum(coalesce(likes,0)+coalesce(shares,0)+coalesce(comments_count,0)) as bigint) as total_engagement,
      count(error) as n_errors
    from (
      select 'instagram' as platform, {fpi(['likesCount', 'likeCount'])} as likes,
        coalesce(nullif(cast(j->>'$.videoViewCount' as bigint), 0), cast(j->>'$.videoPlayCount' as bigint)) as views,
        cast(null as bigint) as shares, {fpi(['commentsCount', 'commentCount'])} as comments_count, cast(null as varchar) as error
      from (select cast(raw as json) as j from raw_ig_posts)
      union all
      select 'twitter', {fpi(['likeCount', 'favorite_count'])}, {fpi(['viewCount', 'views'])},
        {fpi(['retweetCount', 'retweet_count'])}, {fpi(['replyCount', 'reply_count'])}, null
      from (select cast(raw as json) as j from raw_tw_posts)
      union all
      select 'youtube', cast(j->>'$.likes' as bigint), {fpi(['viewCount', 'views'])}, null,
        cast(j->>'$.commentsCount' as bigint), null
      from (select cast(raw as json) as j from raw_yt_videos)
      union all
      select 'reddit', null, null, null, null, 'unknown platform reddit'
      from (select doc_id from documents where doc_id % 10 = 9))
    group by platform""")
def engagement_all_platforms(t):
    """Dispatch by platform; a platform without a builder yields error rows, not an abort."""
    r = raw_items(t)
    reddit = t.documents.where(F.col("doc_id") % 10 == 9).select(F.col("doc_id").cast("string").alias("platform_post_id"))
    e = engagement_all({"instagram": instagram.post(r.instagram_posts), "twitter": twitter.post(r.twitter_posts),
                        "youtube": youtube.post(r.youtube_videos), "reddit": reddit})
    total = F.coalesce("likes", F.lit(0)) + F.coalesce("shares", F.lit(0)) + F.coalesce("comments_count", F.lit(0))
    return e.groupBy("platform").agg(F.count(F.lit(1)).alias("n_rows"), F.count("likes").alias("n_likes"),
                                     F.count("views").alias("n_views"), F.count("shares").alias("n_shares"),
                                     F.sum(total).cast("bigint").alias("total_engagement"),
                                     F.count("error").alias("n_errors"))

