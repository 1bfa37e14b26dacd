"""DuckDB text of the raw-item landing views (same JSON as ``RawItems`` builds in Spark)."""

from __future__ import annotations

from ..registry import oracle_view

WS = r"[\s\p{Z}\x1c-\x1f\x85]"
IG_TYPES = "['video','clips','igtv','sidecar','image','feed','Carousel','CLIPS']"
ISO = "strftime(posted, '%Y-%m-%dT%H:%M:%SZ')"
NATIVE = "strftime(posted, '%a %b %d %H:%M:%S +0000 %Y')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def fp(keys, j: str = "j") -> str:
    return "coalesce(" + ", ".join(f"{j}->>'$.{k}'" for k in keys) + ")" if len(keys) > 1 else f"{j}->>'$.{keys[0]}'"


def fpi(keys, j: str = "j") -> str:
    return "coalesce(" + ", ".join(f"cast({j}->>'$.{k}' as bigint)" for k in keys) + ")"


def ts_sql(x: str) -> str:
    """parse_ts: epoch number or ISO text -> UTC TIMESTAMP."""
    return (f"case when regexp_full_match({x}, '-?[0-9]+(\\.[0-9]+)?') then timezone('UTC', to_timestamp(cast({x} as double))) "
            f"else timezone('UTC', try_cast({x} as timestamptz)) end")


def ts_native_sql(x: str) -> str:
    return (f"coalesce(case when regexp_matches({x}, '^[0-9]{{4}}-') then timezone('UTC', try_cast({x} as timestamptz)) end, "
            f"timezone('UTC', try_strptime({x}, '%a %b %d %H:%M:%S %z %Y')))")


def lower_list(xs: str) -> str:
    return f"list_transform({xs}, lambda x: lower(regexp_replace(x, '^[#@]+', '')))"


def distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def tags_sql(text: str, mark: str) -> str:
    pat = r"(?:^|[^\p{L}\p{N}_])" + mark + r"([\p{L}\p{N}_]+)"
    return distinct(f"coalesce(regexp_extract_all(lower({text}), '{pat}', 1), [])")


def urls_sql(text: str) -> str:
    return distinct(f"list_transform(regexp_extract_all({text}, 'https?://[^\\s<>\"'']+', 0), "
                    f"lambda u: regexp_replace(u, '[).,]+$', ''))")


def joined(xs: str, sep: str = ",") -> str:
    return f"array_to_string({xs}, '{sep}')"


oracle_view("raw_ig_posts", f"""
  select 'instagram' as platform, 'posts' as mode, source as target, doc_id as item_seq,
   json_merge_patch('{{}}', json_object(
    'id', case when k%2=0 then 'ig'||doc_id end, 'shortCode', 'C'||doc_id,
    'caption', case when k%3<>2 then cap end, 'text', case when k%3=2 then cap end,
    'productType', case when k%2=0 then {IG_TYPES}[k%8+1] end, 'type', case when k%2=1 then {IG_TYPES}[k%8+1] end,
    'ownerId', case when k%5<>0 then 'u'||(doc_id%40) end, 'ownerUsername', source||'_'||(doc_id%40),
    'likesCount', case when k%2=0 then n_chars%1000 end, 'likeCount', case when k%2=1 then n_chars%1000 end,
    'commentsCount', case when k%3=0 then n_chars%97 end, 'commentCount', case when k%3<>0 then n_chars%97 end,
    'timestamp', case when k%2=0 then {ISO} end, 'takenAt', case when k%2=1 then doc_id*3600+1704067200 end,
    'displayUrl', case when k%7<>6 then img||'.jpg' end, 'videoUrl', case when k%4=1 then img||'.mp4' end,
    'childPosts', case when k%5=2 then json_array(json_object('displayUrl', img||'_c1.jpg'), json_object('videoUrl', img||'_c2.mp4'))
                       when k%5=3 then json_array(json_object('displayUrl', img||'_c1.jpg', 'videoUrl', img||'_c1.mp4')) end,
    'hashtags', case when k%6=0 then json_array('#'||upper(source), lang) when k%6=1 then json_array() end,
    'mentions', case when k%6=0 then json_array('@'||source) end,
    'videoViewCount', case when k%4=0 then 0 when k%4=2 then n_chars*3 end,
    'videoPlayCount', case when k%4<=1 then n_chars*2 end,
    'isSponsored', case when k%7=0 then true end, 'locationName', case when k%9=0 then 'Paris' end,
    'url', case when k%4=3 then 'https://instagram.com/p/ig'||doc_id end)) as raw
  from (select *, doc_id//3 as k, timestamp '2024-01-01' + to_hours(doc_id) as posted,
          text||' #'||lang||' #'||upper(source)||' @'||source as cap,
          'https://cdn.example.com/ig/'||doc_id as img from documents where doc_id%3=0)""")

oracle_view("raw_tw_posts", f"""
  select 'twitter' as platform, 'posts' as mode, source as target, doc_id as item_seq,
   json_merge_patch('{{}}', json_object(
    'id', case when k%2=0 then tid end, 'tweetId', case when k%2=1 then tid end,
    'fullText', case when k%3<>1 then body end, 'text', case when k%3=1 then body end,
    'createdAt', case when k%2=0 then {NATIVE} else {ISO} end,
    'author', case when k%5<>0 then json_object('id', 'a'||(doc_id%30), 'userName', source||'x'||(doc_id%30),
                                                 'name', upper(source), 'followers', (doc_id%30)*10) end,
    'entities', case when k%4=0 then json_object('hashtags', json_array(json_object('text', 'Tag'||lang), 'plain'||source),
                                                 'mentions', json_array(json_object('username', 'm'||source)),
                                                 'urls', json_array(json_object('expanded_url', 'https://ex.com/'||doc_id)))
                     when k%4=1 then json_object('hashtags', json_array()) end,
    'isRetweet', case when k%6=1 then true end, 'isQuote', case when k%5=2 then true end,
    'media', case when k%4=2 then json_array(json_object('media_url_https', 'https://pbs.example.com/'||doc_id||'.jpg', 'type', 'photo'),
                                             json_object('mediaUrl', 'https://video.example.com/'||doc_id||'.mp4', 'type', 'video')) end,
    'extendedEntities', case when k%4=3 then json_object('media', json_array(json_object('url', 'https://pbs.example.com/'||doc_id||'.gif', 'type', 'animated_gif'))) end,
    'lang', lang,
    'likeCount', case when k%2=0 then n_chars%500 end, 'favorite_count', case when k%2=1 then n_chars%500 end,
    'retweetCount', n_chars%41,
    'replyCount', case when k%3<>2 then n_chars%13 end, 'reply_count', case when k%3=2 then n_chars%13 end,
    'viewCount', case when k%3=0 then n_chars*5 end, 'views', case when k%3=1 then n_chars*5 end,
    'url', 'https://x.com/i/status/'||tid)) as raw
  from (select *, doc_id//3 as k, cast(doc_id+1000000 as varchar) as tid, timestamp '2024-01-01' + to_hours(doc_id) as posted,
          text||' #'||lang||' @'||source||' https://t.co/'||doc_id as body from documents where doc_id%3=1)""")

oracle_view("raw_yt_videos", f"""
  select 'youtube' as platform, 'posts' as mode, source as target, doc_id as item_seq,
   json_merge_patch('{{}}', json_object(
    'id', case when k%2=0 then 'yt'||doc_id end, 'videoId', case when k%2=1 then 'yt'||doc_id end,
    'title', string_split(text, chr(10))[1],
    'text', case when k%3=0 then descr end, 'description', case when k%3<>0 then descr end,
    'channelId', case when k%4<>3 then 'UC'||(doc_id%20) end, 'channelUrl', 'https://www.youtube.com/channel/UC'||(doc_id%20),
    'channelName', upper(source), 'numberOfSubscribers', (doc_id%20)*1000,
    'duration', case when k%4=0 then to_json(n_chars%200) when k%4=1 then to_json(mmss) when k%4=2 then to_json('01:'||mmss)
                     else to_json('live') end,
    'date', case when k%2=0 then {ISO} end, 'uploadDate', case when k%2=1 then {ISO} end,
    'url', case when k%2=1 then vurl end, 'videoUrl', case when k%2=0 then vurl end,
    'viewCount', case when k%3=0 then n_chars*7 end, 'views', case when k%3<>0 then n_chars*7 end,
    'likes', n_chars%300, 'commentsCount', n_chars%31,
    'hashtags', case when k%5=0 then json_array(source) end,
    'thumbnailUrl', 'https://i.ytimg.com/'||doc_id||'.jpg')) as raw
  from (select *, doc_id//3 as k, timestamp '2024-01-01' + to_hours(doc_id) as posted,
          cast(n_chars//60 as varchar)||':'||lpad(cast(n_chars%60 as varchar), 2, '0') as mmss,
          'https://www.youtube.com/watch?v=yt'||doc_id as vurl,
          text||' #'||source||' @'||lang as descr from documents where doc_id%3=2)""")

oracle_view("raw_posts_all", """
  select * from raw_ig_posts union all select * from raw_tw_posts union all select * from raw_yt_videos""",
            ("raw_ig_posts", "raw_tw_posts", "raw_yt_videos"))

oracle_view("raw_ig_comments", f"""
  with t as (select *, turn//3 as root, timestamp '2024-01-01' + to_hours(conv_id) + to_minutes(turn) as posted,
               'c'||conv_id||'_'||turn as cid from conversations where conv_id%3=0),
  o as (select conv_id, root, turn, json_merge_patch('{{}}', json_object(
     'id', case when turn%2=0 then cid end, 'commentId', case when turn%2=1 then cid end,
     'text', case when conv_id%4<>1 then text end, 'content', case when conv_id%4=1 then text end,
     'ownerUsername', role||(conv_id%7), 'ownerId', 'o'||role||(conv_id%7), 'likesCount', length(text)%50,
     'timestamp', case when turn%2=0 then {ISO} end, 'createdAt', case when turn%2=1 then {ISO} end)) as obj from t),
  g as (select conv_id, root, min(turn) as turn, arg_min(obj, turn) as item,
          coalesce(list(obj order by turn) filter (where turn%3<>0), []) as replies from o group by conv_id, root)
  select 'instagram' as platform, 'comments' as mode, 'p'||conv_id as target, conv_id*100+turn as item_seq,
    json_merge_patch(item, json_object('replies', case when conv_id%2=0 then to_json(replies) when conv_id%4=1 then json_array() end,
        'childComments', case when conv_id%2=1 then to_json(replies) end)) as raw
  from g""")

oracle_view("raw_tw_comments", f"""
  select 'twitter' as platform, 'comments' as mode, cast(conv_id*100+5000000 as varchar) as target,
    conv_id*100+turn as item_seq,
    json_merge_patch('{{}}', json_object('id', tid, 'fullText', case when turn%2=0 then text end,
      'text', case when turn%2=1 then text end, 'lang', 'en', 'conversationId', cast(conv_id*100+5000000 as varchar),
      'inReplyToId', case when turn>0 then cast(conv_id*100+turn-1+5000000 as varchar) end,
      'author', json_object('id', 'r'||role, 'userName', role), 'likeCount', length(text)%50, 'replyCount', turn,
      'createdAt', {NATIVE})) as raw
  from (select *, cast(conv_id*100+turn+5000000 as varchar) as tid,
          timestamp '2024-01-01' + to_hours(conv_id) + to_minutes(turn) as posted from conversations where conv_id%3=1)""")

oracle_view("raw_yt_comments", f"""
  select 'youtube' as platform, 'comments' as mode,
    case when conv_id%2=0 then 'https://www.youtube.com/watch?v=yt'||conv_id else 'yt'||conv_id end as target,
    conv_id*100+turn as item_seq,
    json_merge_patch('{{}}', json_object('id', case when turn%2=0 then cid end, 'cid', case when turn%2=1 then cid end,
      'text', case when turn%3<>1 then text end, 'comment', case when turn%3=1 then text end,
      'author', '@'||role, 'publishedAt', {ISO},
      'voteCount', case when turn%2=0 then length(text)%50 end, 'likesCount', case when turn%2=1 then length(text)%50 end,
      'replyCount', case when turn=0 then 3 end, 'isReply', turn>0,
      'parentCommentId', case when turn>0 then 'yc'||conv_id||'_'||(turn-1) end)) as raw
  from (select *, 'yc'||conv_id||'_'||turn as cid,
          timestamp '2024-01-01' + to_hours(conv_id) + to_minutes(turn) as posted from conversations where conv_id%3=2)""")

oracle_view("raw_transcripts", """
  select 'youtube' as platform, 'transcript' as mode, 'yt'||doc_id as target, doc_id*100000+line_no as item_seq,
    json_merge_patch('{}', json_object('text', case when trim(line) <> '' then line end, 'start', line_no*5)) as raw
  from (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) - 1 as line_no
        from (select doc_id, string_split(text, chr(10)) as parts from documents where doc_id%3=2))""")
