"""Retrieval, vectors and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import functions as fn
from ...operators import embeddings as E
from ...operators import retrieval as RT
from ...operators import text_index as TI
from ...operators import trigrams as TG
from ...operators import vector as V
from ...operators import vector_blocks as VB
from ..registry import register
from . import stem_oracle  # noqa: F401 - declares the oracle's views of stems

QVEC_ID = 7
TOK = r"'[\p{L}\p{N}_]+'"


def qvec(t):
    return V.query_vector(t.embeddings, "vec_id", QVEC_ID, "embedding")


SEM_SQL = """(select source_type, cast(source_id as varchar) as source_id, platform,
      list_cosine_similarity(embedding, (select cast(embedding as double[]) from embeddings where vec_id = {q})) as similarity
    from doc_embeddings {where} order by similarity desc, source_type, source_id limit {k})"""


def sem_sql(k: int, where: str = "") -> str:
    return SEM_SQL.format(q=QVEC_ID, where=where, k=k)


@register("semantic_topk", f"""
    select source_type, source_id, round(similarity, 6) as similarity from {sem_sql(10)}""")
def semantic_topk(t):
    """match_embeddings(query vector, 10) - exact cosine top-k."""
    top = V.cosine_topk(t.doc_embeddings, "embedding", qvec(t), 10, ["source_type", "source_id"])
    return top.select("source_type", F.col("source_id").cast("string").alias("source_id"),
                      F.round("similarity", 6).alias("similarity"))


@register("semantic_topk_platform", f"""
    select source_type, source_id, round(similarity, 6) as similarity from {sem_sql(10, "where platform = 'twitter'")}""")
def semantic_topk_platform(t):
    top = V.cosine_topk(t.doc_embeddings, "embedding", qvec(t), 10, ["source_type", "source_id"],
                        where=F.col("platform") == "twitter")
    return top.select("source_type", F.col("source_id").cast("string").alias("source_id"),
                      F.round("similarity", 6).alias("similarity"))


def kw_sql(where: str, limit: int = 20, platform: str | None = None, source: str = "stem_docs") -> str:
    pf = f" and platform = '{platform}'" if platform else ""
    return f"""(select source_type, cast(source_id as varchar) as source_id, platform, content, cast(1.0 as double) as score, 'keyword' as match
      from (select * from {source} where ({where}){pf} order by source_id limit {limit}))"""


def phrase_sql(*words: tuple[str, int]) -> str:
    at = " and ".join(f"stems[i + {k}] = '{w}'" for w, k in words)
    return f"len(list_filter(range(1, len(stems) + 1), lambda i: coalesce({at}, false))) > 0"


@register("keyword_search", "select source_type, source_id, platform, score, match from " + kw_sql(
    "list_contains(stems, 'tion') and list_contains(stems, 'thon') and not list_contains(stems, 'ther')"))
def keyword_search(t):
    """R1: 'tion thon -ther' by stems (AND, NOT); stop words ignored; ordered by id."""
    return RT.keyword_search(t.search_docs, "the tion thon -ther", limit=20).drop("content")


@register("keyword_search_stemmed", "select source_type, source_id, platform, score, match from " + kw_sql(
    "(list_contains(stems, 'tion') and list_contains(stems, 'thon') and not list_contains(stems, 'ther')) or list_contains(stems, 'erti')"))
def keyword_search_stemmed(t):
    """Other forms of the words: 'tioning thonly -thers or erties' finds every form of each."""
    return RT.keyword_search(t.search_docs, "the tioning thonly -thers or erties", limit=20).drop("content")


def _index(t) -> str:
    import uuid

    from ...session import checkpoint_dir
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/positions-{uuid.uuid4().hex[:12]}"
    TI.write_index(t.search_docs, path)
    return t.spark.read.parquet(path)


@register("keyword_search_indexed", "select source_type, source_id, platform, score, match from " + kw_sql(
    "(list_contains(stems, 'tion') and list_contains(stems, 'thon') and not list_contains(stems, 'ther')) or "
    + phrase_sql(("erin", 0), ("thnt", 1)), 50))
def keyword_search_indexed(t):
    """R1 at corpus scale: words, a negated word and a phrase answered from a positional index of stems; texts
    are read for the hits alone."""
    return TI.search_index(_index(t), t.search_docs, 'the tion thon -ther or "erin thnts"', limit=50).drop("content")


@register("positional_index", """
    select stem, count(*) as n_docs, cast(sum(n) as bigint) as n_places, min(first) as first_place, max(last) as last_place
    from (select stem, source_id, count(*) as n, min(i) - 1 as first, max(i) - 1 as last
          from (select source_id, unnest(stems) as stem, generate_subscripts(stems, 1) as i from stem_docs) where stem is not null group by stem, source_id)
    group by stem""")
def positional_index(t):
    """The written index itself, stem by stem: documents, places, first and last place."""
    p = TI.entries(_index(t))
    return p.groupBy("stem").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("positions").cast("long")).alias("n_places"),
                                 F.min(F.get("positions", F.lit(0))).cast("long").alias("first_place"),
                                 F.max(F.element_at("positions", -1)).cast("long").alias("last_place"))


@register("keyword_search_or", "select source_type, source_id, platform, score, match from " + kw_sql(
    "list_contains(stems, 'thre') or (list_contains(stems, 'thnt') and list_contains(stems, 'erin'))", 20, "youtube"))
def keyword_search_or(t):
    """R1: 'thre or thnt erin' on youtube only (platform filter before the match)."""
    return RT.keyword_search(t.search_docs, "thre or thnt erin", platform="youtube", limit=20).drop("content")


@register("keyword_search_phrase", "select source_type, source_id, platform, score, match from " + kw_sql(
    "((" + phrase_sql(("er", 0), ("re", 1)) + ") and not list_contains(stems, 'ther')) or (" + phrase_sql(("nd", 0), ("er", 1)) + ") or ("
    + phrase_sql(("st", 0), ("er", 2)) + ")", 25))
def keyword_search_phrase(t):
    """Quoted phrases (stems at the phrase's distances, a stop word between two of them) with a negated word."""
    return RT.keyword_search(t.search_docs, '"er re" -ther or "nd er" or "st the er"', limit=25).drop("content")


HYB_SQL = f"""
    with kw as {kw_sql("list_contains(stems, 'tion') and list_contains(stems, 'thon')", 20)},
    se as (select s.source_type, s.source_id, d.platform, d.content, s.similarity as score
           from {sem_sql(20)} s join (select source_type, cast(source_id as varchar) as source_id, platform, content
                                      from search_docs) d on d.source_type = s.source_type and d.source_id = s.source_id),
    merged as (select coalesce(k.source_type, s.source_type) as source_type, coalesce(k.source_id, s.source_id) as source_id,
                 coalesce(k.platform, s.platform) as platform,
                 coalesce(k.score * 0.4, 0.0) + coalesce(s.score * 0.6, 0.0) as score,
                 case when k.source_id is not null and s.source_id is not null then 'hybrid'
                      when k.source_id is not null then 'keyword' else 'semantic' end as match
               from kw k full outer join se s on k.source_type = s.source_type and k.source_id = s.source_id)"""


@register("hybrid_search", HYB_SQL + """
    select source_type, source_id, platform, round(score, 6) as score, match from merged
    order by merged.score desc, source_type, source_id limit 10""")
def hybrid_search(t):
    """Keyword (x0.4) and semantic (x0.6) candidates merged by key, ranked, cut to 10."""
    h = RT.hybrid_search(t.search_docs, t.doc_embeddings, "tion thon", qvec(t), t.posts, t.authors, t.engagement,
                         limit=10)
    return h.select("source_type", "source_id", "platform", F.round("score", 6).alias("score"), "match")


@register("hybrid_search_prefiltered", f"""
    with ok as (select cast(p.post_id as varchar) as source_id from posts p
                where coalesce(list_contains(p.hashtags, 'en'), false) and coalesce(p.posted_at >= timestamp '2024-01-03', false)),
    kw as (select source_type, cast(source_id as varchar) as source_id, platform, cast(1.0 as double) as score from (
             select * from stem_docs
             where list_contains(stems, 'tion') and list_contains(stems, 'thon')
               and cast(source_id as varchar) in (select source_id from ok) order by source_id limit 10)),
    se as (select source_type, cast(source_id as varchar) as source_id, platform,
             list_cosine_similarity(embedding, (select cast(embedding as double[]) from embeddings where vec_id = {QVEC_ID})) as score
           from doc_embeddings where cast(source_id as varchar) in (select source_id from ok)
           order by score desc, source_type, source_id limit 10),
    merged as (select coalesce(k.source_type, s.source_type) as source_type, coalesce(k.source_id, s.source_id) as source_id,
                 coalesce(k.platform, s.platform) as platform,
                 coalesce(k.score * 0.4, 0.0) + coalesce(s.score * 0.6, 0.0) as score,
                 case when k.source_id is not null and s.source_id is not null then 'hybrid'
                      when k.source_id is not null then 'keyword' else 'semantic' end as match
               from kw k full outer join se s on k.source_type = s.source_type and k.source_id = s.source_id)
    select source_type, source_id, platform, round(score, 6) as score, match from merged
    order by merged.score desc, source_type, source_id limit 10""")
def hybrid_search_prefiltered(t):
    """Filters applied before ranking (semi join with allowed posts): never starved by filters."""
    f = RT.Filters(hashtag="#EN", date_from="2024-01-03")
    h = RT.hybrid_search(t.search_docs, t.doc_embeddings, "tion thon", qvec(t), t.posts, t.authors, t.engagement,
                         filters=f, limit=10, prefilter=True)
    return h.select("source_type", "source_id", "platform", F.round("score", 6).alias("score"), "match")


FILTER_HITS_SQL = HYB_SQL + f""",
    chits as (select source_type, source_id, platform, cast(1.0 as double) as score, 'keyword' as match
              from stem_comments where list_contains(stems, 'tion') order by source_id limit 10),
    hits as (select source_type, source_id, platform, score, match from merged
             union all select * from chits),
    ctx as (select h.*, p.post_id as pid, p.content_type, p.hashtags, p.posted_at, a.username, e.post_id as eid, e.likes
            from hits h left join posts p on h.source_type = 'post' and h.source_id = cast(p.post_id as varchar)
            left join authors a on a.author_id = p.author_id
            left join engagement e on h.source_id = cast(e.post_id as varchar))"""


@register("filtered_search", FILTER_HITS_SQL + """
    select source_type, source_id, platform, round(score, 6) as score, match from ctx
    where source_type <> 'post' or (pid is not null and coalesce(content_type in ('post','tweet','short','video','reel'), false)
          and coalesce(list_contains(hashtags, 'en'), false) and coalesce(posted_at >= timestamp '2024-01-03', false))""")
def filtered_search(t):
    """Content types, hashtag ('#EN' -> 'en') and date filters; comment hits bypass them."""
    hits = _filter_hits(t)
    f = RT.Filters(hashtag="#EN", date_from="2024-01-03", content_types=("post", "tweet", "short", "video", "reel"))
    out = RT.apply_filters(hits, f, t.posts, t.authors, t.engagement)
    return out.select("source_type", "source_id", "platform", F.round("score", 6).alias("score"), "match")


@register("filtered_search_likes", FILTER_HITS_SQL + """
    select source_type, source_id, platform, round(score, 6) as score, match from ctx
    where source_type <> 'post' or (pid is not null and eid is not null and coalesce(likes, 0) >= 5
          and coalesce(posted_at <= timestamp '2024-01-20', false))""")
def filtered_search_likes(t):
    """Min likes (missing engagement fails, NULL likes = 0) and an upper date bound."""
    hits = _filter_hits(t)
    out = RT.apply_filters(hits, RT.Filters(min_likes=5, date_to="2024-01-20"), t.posts, t.authors, t.engagement)
    return out.select("source_type", "source_id", "platform", F.round("score", 6).alias("score"), "match")


@register("filtered_search_author", FILTER_HITS_SQL + """
    select source_type, source_id, platform, round(score, 6) as score, match from ctx
    where source_type <> 'post' or (pid is not null and coalesce(lower(username) = 'customer#000000042', false))""")
def filtered_search_author(t):
    """R6/P10 (+K3): author username filter, '@' stripped, compared lower to lower."""
    hits = _filter_hits(t)
    out = RT.apply_filters(hits, RT.Filters(author_username="@Customer#000000042"), t.posts, t.authors, t.engagement)
    return out.select("source_type", "source_id", "platform", F.round("score", 6).alias("score"), "match")


def _filter_hits(t):
    kw = RT.keyword_search(t.search_docs, "tion thon", limit=20)
    se = RT.semantic_search(t.doc_embeddings, t.search_docs, qvec(t), limit=20)
    c = t.comments.select(F.lit("comment").alias("source_type"), F.col("comment_id").alias("source_id"), "platform",
                          "content")
    chits = RT.keyword_search(c, "tion", limit=10).select("source_type", "source_id", "platform", "score", "match")
    return RT.hybrid(kw, se).select("source_type", "source_id", "platform", "score", "match").unionByName(chits)


@register("join_filter_context", FILTER_HITS_SQL + """
    select source_type, source_id, content_type, username as author_username, likes from ctx""")
def join_filter_context(t):
    """Each candidate hit left-joined to its post, author and engagement in one pass."""
    ctx = RT.filter_context(_filter_hits(t), t.posts, t.authors, t.engagement)
    return ctx.select("source_type", "source_id", "content_type", "author_username", F.col("_likes").alias("likes"))


# --------------------------------------------------------------------------- batch questions
QUESTIONS_SQL = f"""(select item_id as qid, list_filter(list_distinct(regexp_extract_all(lower(text), {TOK})),
                      lambda x: not list_contains([{", ".join(f"'{w}'" for w in RT.STOP_WORDS)}], x)) as words from benchmark)"""


def _questions(t):
    return t.benchmark.select(F.col("item_id").alias("qid"), RT.question_words("text").alias("words"))


def _qvecs(t):
    b = t.benchmark.select(F.col("item_id").alias("vec_id"))
    return t.embeddings.join(b, "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


HYB_BATCH_SQL = f"""
    with q as {QUESTIONS_SQL},
    kw as (select qid, source_type, source_id, platform, score from (
             select q.qid, d.source_type, cast(d.source_id as varchar) as source_id, d.platform, cast(1.0 as double) as score,
               row_number() over (partition by q.qid order by d.source_id) as rn
             from q join (select *, list_distinct(regexp_extract_all(lower(content), {TOK})) as toks from search_docs) d
               on len(q.words) > 0 and list_has_all(d.toks, q.words)) where rn <= 10),
    se as (select qid, source_type, source_id, platform, score from (
             select e.vec_id as qid, d.source_type, cast(d.source_id as varchar) as source_id, d.platform,
               list_cosine_similarity(d.embedding, cast(e.embedding as double[])) as score,
               row_number() over (partition by e.vec_id order by list_cosine_similarity(d.embedding, cast(e.embedding as double[])) desc,
                                  d.source_type, d.source_id) as rn
             from (select * from embeddings where vec_id in (select item_id from benchmark)) e join doc_embeddings d on true) where rn <= 10),
    merged as (select coalesce(k.qid, s.qid) as qid, coalesce(k.source_type, s.source_type) as source_type,
                 coalesce(k.source_id, s.source_id) as source_id, coalesce(k.platform, s.platform) as platform,
                 coalesce(k.score * 0.4, 0.0) + coalesce(s.score * 0.6, 0.0) as score,
                 case when k.source_id is not null and s.source_id is not null then 'hybrid'
                      when k.source_id is not null then 'keyword' else 'semantic' end as match
               from kw k full outer join se s on k.qid = s.qid and k.source_type = s.source_type and k.source_id = s.source_id),
    ranked as (select *, row_number() over (partition by qid order by score desc, source_type, source_id) as rank from merged)"""


@register("hybrid_batch", HYB_BATCH_SQL + """
    select qid, source_type, source_id, platform, round(score, 6) as score, match, rank from ranked where rank <= 5""")
def hybrid_batch(t):
    """Every benchmark question answered in one job (inverted-index join + batched vector top-k)."""
    h = RT.hybrid_batch(t.search_docs, t.doc_embeddings, _questions(t), _qvecs(t), limit=5)
    return h.select("qid", "source_type", "source_id", "platform", F.round("score", 6).alias("score"), "match",
                    F.col("rank").cast("bigint").alias("rank"))


@register("question_context", HYB_BATCH_SQL.replace("rn <= 10", "rn <= 16") + """
    select r.qid, count(*) as n_hits,
      string_agg('[' || r.platform || '/' || r.source_type || '/' || substr(r.source_id, 1, 8) || '] '
                 || substr(coalesce(d.content, ''), 1, 500), chr(10) order by r.rank) as context,
      string_agg(r.source_type || ':' || r.source_id, ',' order by r.rank) as sources
    from ranked r left join (select source_type, cast(source_id as varchar) as source_id, content from search_docs) d
      on d.source_type = r.source_type and d.source_id = r.source_id
    where r.rank <= 8 group by r.qid""")
def question_context(t):
    """Grounded context per question: 8 hits, 500-char snippets with citation labels, source list."""
    h = RT.hybrid_batch(t.search_docs, t.doc_embeddings, _questions(t), _qvecs(t), limit=8)
    return RT.question_context(h, t.search_docs, 8, 500).withColumn("n_hits", F.col("n_hits").cast("bigint"))


@register("keyword_postings_indexed", f"""
    with q as (select qid, unnest(words) as term from {QUESTIONS_SQL}),
    d as (select source_id, unnest(list_distinct(regexp_extract_all(lower(content), {TOK}))) as term from search_docs)
    select q.qid, q.term, count(d.source_id) as n_docs, cast(min(d.source_id) as varchar) as first_doc
    from q join d on d.term = q.term group by q.qid, q.term""")
def keyword_postings_indexed(t):
    """R1/R7 at scale: an inverted index written once, partitioned by term bucket; the question batch
    reads only its buckets (dynamic partition pruning) and counts postings per question."""
    import uuid

    from ...session import checkpoint_dir
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/inverted-{uuid.uuid4().hex[:12]}"
    RT.write_inverted_index(t.search_docs, path, buckets=64)
    index = t.spark.read.parquet(path)
    hits = RT.postings_for(index, _questions(t).select("qid", F.explode("words").alias("term")), buckets=64)
    return hits.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("n_docs"),
                                           F.min("source_id").cast("string").alias("first_doc"))


INTENT_Q = """case when q like '%trend%' or q like '%trending%' or q like '%over time%' or q like '%time-series%' or q like '%timeseries%' then 'trend'
  when q like '%sentiment%' or q like '%feel about%' or q like '%opinion%' or q like '%controversial%' then 'sentiment'
  when q like '%compare%' or q like '%comparison%' or q like '% vs %' or q like '%versus%' or q like '%cross-platform%' then 'comparison'
  when q like '%summarize%' or q like '%summary%' or q like '%sum up%' or q like '%tl;dr%' then 'summary' end"""


PLAT_Q = "case when b.item_id % 3 = 0 then 'instagram' when b.item_id % 3 = 1 then 'twitter' else 'youtube' end"


@register("assistant_context", HYB_BATCH_SQL.replace("rn <= 10", "rn <= 16") + f""",
    ctx as (select r.qid, count(*) as n_hits,
              string_agg('[' || r.platform || '/' || r.source_type || '/' || substr(r.source_id, 1, 8) || '] '
                         || substr(coalesce(d.content, ''), 1, 500), chr(10) order by r.rank) as context,
              string_agg(r.source_type || ':' || r.source_id, ',' order by r.rank) as sources
            from ranked r left join (select source_type, cast(source_id as varchar) as source_id, content from search_docs) d
              on d.source_type = r.source_type and d.source_id = r.source_id
            where r.rank <= 8 group by r.qid)
    select b.item_id as qid, substr(b.text, 1, 60) as title, (select {INTENT_Q} from (select lower(b.text) as q)) as intent,
      '{{"platform":"' || {PLAT_Q} || '"}}' as filters_json, coalesce(c.n_hits, 0) as n_hits, c.sources,
      cast(length(substr('Question: ' || b.text || chr(10) || coalesce(c.context, ''), 1, 4000)) as bigint) as prompt_chars
    from benchmark b left join ctx c on c.qid = b.item_id""")
def assistant_context(t):
    """Read path of one assistant turn for every benchmark question, as one job: title (F20), intent
    (F24), null-free filter JSON (F23), hybrid hits and grounded context (R7/R8), the source list and
    the prompt cut to 4000 characters for the log (S24). The chat-model call itself is not built."""
    from ... import functions as fn
    from ...sources.bindings import platform_of
    b = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    hits = RT.hybrid_batch(t.search_docs, t.doc_embeddings, _questions(t), _qvecs(t), limit=8)
    ctx = RT.question_context(hits, t.search_docs, 8, 500)
    j = b.join(ctx, "qid", "left")
    prompt = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n"), F.coalesce("context", F.lit("")))
    return j.select("qid", fn.title_from_question("question").alias("title"),
                    fn.question_intent("question").alias("intent"),
                    fn.filters_json(platform=platform_of("qid")).alias("filters_json"),
                    F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"), "sources",
                    F.length(F.substring(prompt, 1, 4000)).cast("bigint").alias("prompt_chars"))


# --------------------------------------------------------------------------- joins
@register("join_docs_embeddings", """
    select e.vec_id, d.doc_id, d.lang, d.n_chars, e.label, len(e.embedding) as dims
    from embeddings e join documents d on d.doc_id = e.vec_id""")
def join_docs_embeddings(t):
    """Embeddings joined to their documents."""
    e, d = t.embeddings, t.documents
    j = e.join(d, e["vec_id"] == d["doc_id"])
    return j.select("vec_id", "doc_id", "lang", "n_chars", "label", F.size("embedding").cast("bigint").alias("dims"))


@register("join_semi_existing", """
    select source_id from search_docs d
    where exists (select 1 from search_docs x where x.source_id % 3 = 0 and x.source_type = d.source_type
                  and x.source_id = d.source_id)
      and exists (select 1 from search_docs y where y.source_id = d.source_id and y.source_id % 3 = 0)""")
def join_semi_existing(t):
    """Rows whose (key, checksum) already exists are found by a left semi join."""
    d = t.search_docs.withColumn("checksum", fn.checksum("content"))
    existing = d.where(F.col("source_id") % 3 == 0).select("source_type", "source_id", "checksum")
    return d.join(existing, ["source_type", "source_id", "checksum"], "left_semi").select("source_id")


@register("replies_self_join", """
    select c.comment_id, c.parent_comment_id, p.author as parent_author, c.author
    from comments c join comments p on p.comment_id = c.parent_comment_id""")
def replies_self_join(t):
    """Each reply with its parent comment (self equi-join)."""
    c = t.comments
    p = c.select(F.col("comment_id").alias("pid"), F.col("author").alias("parent_author"))
    return c.join(p, c["parent_comment_id"] == p["pid"]).select("comment_id", "parent_comment_id", "parent_author",
                                                                "author")


# --------------------------------------------------------------------------- ANN
#: Lists of the index, and the recall@10 that its number of probes is calibrated to.
ANN_LISTS, ANN_RECALL = 32, 0.95


def _ann(t):
    """(exact answers, answers from the lists, probes): the questions are the vectors whose id is divisible by 50."""
    import uuid

    from ...session import checkpoint_dir, materialize
    keys, vecs = ["source_type", "source_id"], t.doc_embeddings
    asked = t.embeddings.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    exact = materialize(VB.exact_topk(vecs, "embedding", keys, asked, "qid", "q", 10))
    centres = VB.train(vecs, "embedding", ANN_LISTS)
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/lists-{uuid.uuid4().hex[:12]}"
    later = F.col("source_id") % 10 == 9  # a batch that comes after training goes to the same centres
    VB.write_lists(VB.assign(vecs.where(~later), "embedding", centres), path, "embedding", keys)
    VB.write_lists(VB.assign(vecs.where(later), "embedding", centres), path, "embedding", keys, mode="append")
    lists = t.spark.read.parquet(path)
    probes, _ = VB.calibrate(lists, centres, keys, asked, "qid", "q", 10, ANN_RECALL, exact)
    return exact, VB.lists_topk(lists, centres, keys, asked, "qid", "q", 10, probes), probes


BATCH_TOPK_SQL = """
    select qid, source_type, source_id, similarity, rank from (
      select q.vec_id as qid, d.source_type, cast(d.source_id as varchar) as source_id, round(s, 6) as similarity,
        row_number() over (partition by q.vec_id order by s desc, d.source_type, d.source_id) as rank
      from (select vec_id, cast(embedding as double[]) as v from embeddings where vec_id % 50 = 0) q
      cross join (select * from doc_embeddings) d, lateral (select list_cosine_similarity(d.embedding, q.v) as s)) where rank <= 10"""


@register("semantic_topk_batch", BATCH_TOPK_SQL)
def semantic_topk_batch(t):
    """The exact ten nearest documents of every vector whose id is divisible by 50, in packed blocks."""
    asked = t.embeddings.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    top = VB.exact_topk(t.doc_embeddings, "embedding", ["source_type", "source_id"], asked, "qid", "q", 10)
    return top.select("qid", "source_type", F.col("source_id").cast("string").alias("source_id"), F.round("similarity", 6).alias("similarity"),
                      F.col("rank").cast("bigint").alias("rank"))


@register("ann_ivf_topk")
def ann_ivf_topk(t):
    """The same questions from inverted lists, with the measured recall@10 of each and the probes it took."""
    exact, found, probes = _ann(t)
    keys = ["source_type", "source_id"]
    marked = found.join(VB.recall(found, exact, keys), "qid")
    return marked.select("qid", "source_type", F.col("source_id").cast("string").alias("source_id"), F.round("similarity", 6).alias("similarity"),
                         F.col("rank").cast("bigint").alias("rank"), F.round("recall", 6).alias("recall"), F.lit(probes).alias("probes"))


@register("ann_recall", """
    select cast(count(*) as bigint) as n_questions, true as recall_reached, true as probes_within from embeddings where vec_id % 50 = 0""")
def ann_recall(t):
    """Mean recall@10 over all questions against the exact answers is at least 0.9."""
    exact, found, probes = _ann(t)
    r = VB.recall(found, exact, ["source_type", "source_id"])
    return r.agg(F.count(F.lit(1)).alias("n_questions"), (F.avg("recall") >= 0.9).alias("recall_reached"),
                 F.lit(1 <= probes <= ANN_LISTS).alias("probes_within"))


# --------------------------------------------------------------------------- embeddings
WS = r"[\s\p{Z}\x1c-\x1f\x85]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


ITEMS_SQL = f"""(select source_type, source_id, platform, text from (
      select 'post' as source_type, cast(post_id as varchar) as source_id, platform,
        coalesce(nullif({_sql_strip('caption')}, ''), {_sql_strip('content')}) as text from posts
      union all
      select 'comment', comment_id, platform, {_sql_strip('content')} from comments)
    where text is not null and text <> '')"""


@register("embeddable_items", f"""
    select source_type, source_id, platform, sha256(text) as checksum from {ITEMS_SQL}""")
def embeddable_items(t):
    """Post and comment texts to embed (caption else content; blanks dropped)."""
    it = E.embeddable_items(t.posts, t.comments)
    return it.select("source_type", "source_id", "platform", F.sha2("text", 256).alias("checksum"))


EXISTING_SQL = f"""(select source_type, source_id, 'm1' as model,
      case when cast(source_id as bigint) % 3 = 0 then sha256(text) else 'stale' end as checksum
    from {ITEMS_SQL} where source_type = 'post' and cast(source_id as bigint) % 3 <> 2)"""


def _existing(t):
    it = E.embeddable_items(t.posts, t.comments).where(
        (F.col("source_type") == "post") & (F.col("source_id").cast("bigint") % 3 != 2))
    return it.select("source_type", "source_id", F.lit("m1").alias("model"),
                     F.when(F.col("source_id").cast("bigint") % 3 == 0, fn.checksum("text"))
                     .otherwise(F.lit("stale")).alias("checksum"))


@register("embed_pending", f"""
    select i.source_type, i.source_id, sha256(i.text) as checksum, case when x.checksum is null then 'new' else 'changed' end as reason
    from {ITEMS_SQL} i left join {EXISTING_SQL} x on x.source_type = i.source_type and x.source_id = i.source_id
    where x.checksum is distinct from sha256(i.text)""")
def embed_pending(t):
    """Only new or changed (by checksum) items go to the provider."""
    p = E.pending(E.embeddable_items(t.posts, t.comments), _existing(t), "m1")
    return p.select("source_type", "source_id", "checksum", "reason")


@register("embed_hashing", f"""
    with items as (select i.source_type, i.source_id, i.text
                   from {ITEMS_SQL} i left join {EXISTING_SQL} x on x.source_type = i.source_type and x.source_id = i.source_id
                   where x.checksum is distinct from sha256(i.text)),
    toks as (select source_type, source_id, unnest(regexp_extract_all(lower(text), {TOK})) as tok from items),
    hv as (select source_type, source_id, ('0x' || substr(md5(tok), 2, 8))::bigint % 64 as b,
             case when ('0x' || substr(md5(tok), 1, 1))::int % 2 = 0 then 1 else -1 end as s from toks),
    agg as (select source_type, source_id, b, sum(s) as v from hv group by source_type, source_id, b),
    per as (select source_type, source_id, count(*) filter (where v <> 0) as nnz, max(abs(v)) as top_abs,
              sum(v * v) as sq from agg group by source_type, source_id),
    arg as (select a.source_type, a.source_id, min(a.b) as top_bucket from agg a
            join per p on p.source_type = a.source_type and p.source_id = a.source_id and abs(a.v) = p.top_abs
            where p.top_abs > 0 group by a.source_type, a.source_id)
    select i.source_type, i.source_id, 'hashing-v1' as model, 64 as dimensions,
      cast(coalesce(p.nnz, 0) as bigint) as nnz, cast(coalesce(g.top_bucket, 0) as bigint) as top_bucket,
      cast(case when coalesce(p.sq, 0) > 0 then 1.0 else 0.0 end as double) as norm2
    from items i left join per p on p.source_type = i.source_type and p.source_id = i.source_id
    left join arg g on g.source_type = i.source_type and g.source_id = i.source_id""")
def embed_hashing(t):
    """Pending items embedded by the offline hashing provider (iterator pandas UDF, Arrow batches)."""
    p = E.pending(E.embeddable_items(t.posts, t.comments), _existing(t), "m1")
    out = E.embed(p, E.HashingProvider(64))
    mags = F.transform("vector", lambda x: F.abs(x))
    return out.select("source_type", "source_id", "model", "dimensions",
                      F.size(F.filter("vector", lambda x: x != 0)).cast("bigint").alias("nnz"),
                      (F.array_position(mags, F.array_max(mags)) - 1).cast("bigint").alias("top_bucket"),
                      F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm2"))


@register("embeddings_upsert", """
    with docs_cur as (select source_type, cast(source_id as varchar) as source_id from search_docs where source_id % 4 = 0),
    docs_new as (select source_type, cast(source_id as varchar) as source_id from search_docs),
    docs as (select coalesce(o.source_type, n.source_type) as source_type, coalesce(o.source_id, n.source_id) as source_id,
               sha256(coalesce(o.source_type, n.source_type) || ':' || coalesce(o.source_id, n.source_id)) as document_id
             from docs_cur o full outer join docs_new n on o.source_type = n.source_type and o.source_id = n.source_id),
    emb_cur as (select source_type, cast(source_id as varchar) as source_id, 'm1' as model from doc_embeddings
                where source_id % 4 = 0),
    emb_new as (select source_type, cast(source_id as varchar) as source_id, 'm1' as model, len(embedding) as dimensions
                from doc_embeddings)
    select coalesce(o.source_id, n.source_id) as source_id, coalesce(o.source_type, n.source_type) as source_type,
      coalesce(o.model, n.model) as model, d.document_id, n.dimensions,
      case when o.source_id is null then 'insert' when n.source_id is null then 'keep' else 'update' end as action
    from emb_cur o full outer join emb_new n on o.source_id = n.source_id and o.source_type = n.source_type and o.model = n.model
    left join docs d on d.source_type = coalesce(o.source_type, n.source_type) and d.source_id = coalesce(o.source_id, n.source_id)""")
def embeddings_upsert(t):
    """Documents upsert first; embeddings upsert keyed (source_id, source_type, model) to the persisted document."""
    sd = t.search_docs.select("source_type", F.col("source_id").cast("string").alias("source_id"),
                              F.col("source_id").alias("n"))
    did = F.sha2(F.concat_ws(":", "source_type", "source_id"), 256)
    docs_cur = sd.where(F.col("n") % 4 == 0).select("source_type", "source_id", did.alias("document_id"))
    docs_new = sd.select("source_type", "source_id", did.alias("document_id"))
    ve = t.doc_embeddings.select("source_type", F.col("source_id").cast("string").alias("source_id"),
                                 F.col("source_id").alias("n"), "embedding")
    emb_cur = ve.where(F.col("n") % 4 == 0).select("source_type", "source_id", F.lit("m1").alias("model"),
                                                  F.lit(None).cast("string").alias("document_id"),
                                                  F.lit(None).cast("int").alias("dimensions"))
    emb_new = ve.select("source_type", "source_id", F.lit("m1").alias("model"),
                                                  F.size("embedding").alias("dimensions"))
    docs, emb = E.upsert_documents_and_embeddings(docs_cur, docs_new, emb_cur, emb_new)
    ids = docs.select("source_type", "source_id", F.col("document_id").alias("_d"))
    emb = emb.join(ids, ["source_type", "source_id"], "left").withColumn("document_id", F.col("_d")).drop("_d")
    return emb.select("source_id", "source_type", "model", "document_id",
                      F.when(F.col("action") != "keep", F.col("dimensions")).cast("bigint").alias("dimensions"), "action")


@register("vector_dim_check", """
    select vec_id, len(v) as n_dims, len(v) in (0, 64) as valid
    from (select vec_id, case when vec_id % 11 = 0 then [] when vec_id % 7 = 0 then embedding[1:32] else embedding end as v
          from embeddings)""")
def vector_dim_check(t):
    """E5: vectors must have the declared 64 dimensions (empty allowed); others are quarantined."""
    e = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 11 == 0, F.array().cast("array<float>"))
                            .when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32))
                            .otherwise(F.col("embedding")).alias("vector"))
    ok, bad = E.dim_check(e, 64)
    return ok.select("vec_id", F.size("vector").cast("bigint").alias("n_dims"), F.lit(True).alias("valid")).unionByName(
        bad.select("vec_id", F.size("vector").cast("bigint").alias("n_dims"), F.lit(False).alias("valid")))


TRI_SQL = """list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'),
      lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@register("trigram_similarity", f"""
    select author_id, username, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as similarity
    from (select author_id, username, {TRI_SQL.format(x='username')} as a, {TRI_SQL.format(x="'customer 42'")} as b
          from authors)
    order by similarity desc, author_id limit 10""")
def trigram_similarity(t):
    """Fuzzy username match by trigram Jaccard similarity, top 10."""
    a = t.authors.select("author_id", "username",
                         F.round(E.trigram_similarity(F.col("username"), F.lit("customer 42")), 6).alias("similarity"))
    return a.orderBy(F.col("similarity").desc(), "author_id").limit(10)


def _trigram_index(t, df, id_col: str, text_col: str):
    import uuid

    from ...session import checkpoint_dir
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/trigrams-{uuid.uuid4().hex[:12]}"
    TG.write_index(df, path, id_col, text_col)
    return TG.open_index(t.spark, path)


@register("trigram_pairs", f"""
    with s as (select min(author_id) as id, username, count(*) as n_rows, any_value({TRI_SQL.format(x='username')}) as g from authors
               where username is not null group by username)
    select a.id as author_id, b.id as other_id, a.username, b.username as other_username, a.n_rows, b.n_rows as other_rows,
      round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) as similarity
    from s a join s b on a.id < b.id and 4 * len(list_intersect(a.g, b.g)) >= 3 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))""")
def trigram_pairs(t):
    """All pairs of different usernames at trigram similarity 0.75, by a prefix-filtered set join."""
    p = TG.similar_pairs(_trigram_index(t, t.authors, "author_id", "username"), 3, 4)
    return p.select(F.col("id").alias("author_id"), F.col("id2").alias("other_id"), F.col("text").alias("username"),
                    F.col("text2").alias("other_username"), "n_rows", F.col("n_rows2").alias("other_rows"), F.round("similarity", 6).alias("similarity"))


@register("trigram_lookup", f"""
    with s as (select min(post_id) as id, caption, count(*) as n_rows, any_value({TRI_SQL.format(x='caption')}) as g from posts
               where caption is not null group by caption),
    q as (select item_id, {TRI_SQL.format(x='text')} as g from benchmark where text is not null)
    select q.item_id, s.id as post_id, s.n_rows,
      round(len(list_intersect(s.g, q.g)) / (len(s.g) + len(q.g) - len(list_intersect(s.g, q.g))), 6) as similarity
    from q join s on len(s.g) > 0 and len(q.g) > 0 and 5 * len(list_intersect(s.g, q.g)) >= 2 * (len(s.g) + len(q.g) - len(list_intersect(s.g, q.g)))""")
def trigram_lookup(t):
    """For every benchmark text the post captions at trigram similarity 0.4, from the trigram index."""
    idx = _trigram_index(t, t.posts, "post_id", "caption")
    p = TG.lookup(idx, t.benchmark, 2, 5, "item_id", "text")
    return p.select(F.col("id2").alias("item_id"), F.col("id").alias("post_id"), "n_rows", F.round("similarity", 6).alias("similarity"))
