"""Keyword, semantic, hybrid and popularity retrieval with metadata filters.

Hits share one schema: (source_type, source_id, platform, content, score, match).
Filters are compiled into one predicate over a left-joined context, so they run
before the cut instead of over-fetching candidates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import functions as fn
from ..schema import HYBRID_OVERFETCH, KEYWORD_WEIGHT, SEMANTIC_WEIGHT
from . import vector

# --- fixed values: English stop words (Snowball list used by Postgres 'english') ----
STOP_WORDS = sorted(set("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now
""".split()))
# -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    negated: bool = False

    @property
    def phrase(self) -> bool:
        return len(self.words) > 1


@dataclass(frozen=True)
class WebQuery:
    """OR of AND-groups of terms (web-search syntax: words bind tighter than ``or``)."""
    groups: tuple[tuple[Term, ...], ...] = field(default_factory=tuple)

    @property
    def empty(self) -> bool:
        return not self.groups


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W]+", s.lower())


def parse_websearch(q: str) -> WebQuery:
    """Web-search syntax: words AND-ed, ``"a phrase"``, ``or`` between groups of words, ``-word``
    negates; ``a or b c`` is a | (b & c).

    Stop words are dropped from plain terms; a phrase keeps its word order.
    """
    tokens = re.findall(r'(-?)"([^"]*)"|(-?)([^\s"]+)', q)
    terms: list[Term | str] = []
    for neg_p, phrase, neg_w, word in tokens:
        if phrase or neg_p:
            ws = tuple(_words(phrase))
            if ws and not all(w in STOP_WORDS for w in ws):
                terms.append(Term(ws, bool(neg_p)))
        else:
            if word.lower() == "or":
                terms.append("or")
                continue
            for w in _words(word):
                if w not in STOP_WORDS:
                    terms.append(Term((w,), bool(neg_w)))
    groups: list[list[Term]] = [[]]
    for t in terms:
        if t != "or":
            groups[-1].append(t)
        elif groups[-1]:
            groups.append([])
    return WebQuery(tuple(tuple(g) for g in groups if g))


def _term_pred(t: Term, toks: Column, joined: Column) -> Column:
    if t.phrase:
        p = F.instr(joined, " " + " ".join(t.words) + " ") > 0
    else:
        p = F.array_contains(toks, t.words[0])
    return ~p if t.negated else p


def _tokens_pred(q: WebQuery, toks: Column) -> Column:
    joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    pred = None
    for g in q.groups:
        gp = None
        for t in g:
            tp = _term_pred(t, toks, joined)
            gp = tp if gp is None else (gp & tp)
        pred = gp if pred is None else (pred | gp)
    return pred


def keyword_predicate(q: WebQuery, text: Column) -> tuple[Column, Column | None]:
    """(exact predicate over tokens, cheap substring prefilter implied by it).

    The token array is bound once (``transform(array(tokens), t -> ...)``) so the tokenising regex
    runs once per document however many terms the query has."""
    toks = fn.tokens(text)
    pred = F.element_at(F.transform(F.array(toks), lambda x: _tokens_pred(q, x)), 1)
    pre = None
    low = F.lower(text)
    for g in q.groups:
        has = [low.contains(t.words[0]) for t in g if not t.negated]
        if not has:
            return pred, None  # a group of negated words alone implies no substring
        every = has[0]
        for c in has[1:]:
            every = every & c
        pre = every if pre is None else (pre | every)
    return pred, pre


def keyword_search(docs: DataFrame, query: str, platform: str | None = None, limit: int = 20,
                   text_col: str = "content", stemmed: bool = True) -> DataFrame:
    """Web-search match over the full text, by English stems and phrase positions (``text_index``) or, with
    ``stemmed=False``, by exact words; platform filter first; score 1.0; ordered by id (K12)."""
    if stemmed:
        from .text_index import search_texts
        return search_texts(docs, query, platform, limit, text_col)
    q = parse_websearch(query)
    d = docs
    if platform is not None:
        d = d.where(F.col("platform") == platform)
    if q.empty:
        return d.limit(0).select(*_hit_cols(F.lit(1.0), "keyword", text_col))
    pred, pre = keyword_predicate(q, F.col(text_col))
    if pre is not None:
        d = d.where(pre)  # exact superset filter: a token match implies a substring match
    hits = d.where(pred).orderBy("source_id").limit(limit)
    return hits.select(*_hit_cols(F.lit(1.0), "keyword", text_col))


def _hit_cols(score: Column, match: str, text_col: str = "content") -> list[Column]:
    return [F.col("source_type"), F.col("source_id").cast("string").alias("source_id"), F.col("platform"),
            F.col(text_col).alias("content"), score.cast("double").alias("score"), F.lit(match).alias("match")]


def semantic_search(vectors: DataFrame, docs: DataFrame, query_vec, platform: str | None = None,
                    limit: int = 20) -> DataFrame:
    """R2: top ``limit`` by cosine similarity, joined to their document text."""
    where = (F.col("platform") == platform) if platform is not None else None
    top = vector.cosine_topk(vectors, "embedding", query_vec, limit, ["source_type", "source_id"], where)
    # ``top`` has at most ``limit`` rows: the documents are scanned once, without a shuffle.
    j = docs.select("source_type", "source_id", "platform", "content").join(F.broadcast(top), ["source_type", "source_id"])
    return j.select(*_hit_cols(F.col("similarity"), "semantic"))


def hybrid(keyword_hits: DataFrame, semantic_hits: DataFrame) -> DataFrame:
    """0.4 x keyword + 0.6 x semantic per (source_type, source_id); match keyword/semantic/hybrid."""
    k = keyword_hits.select("source_type", "source_id", F.col("platform").alias("kp"), F.col("content").alias("kc"),
                            F.col("score").alias("ks"))
    s = semantic_hits.select("source_type", "source_id", F.col("platform").alias("sp"), F.col("content").alias("sc"),
                             F.col("score").alias("ss"))
    j = k.join(s, ["source_type", "source_id"], "full_outer")
    score = F.coalesce(F.col("ks") * KEYWORD_WEIGHT, F.lit(0.0)) + F.coalesce(F.col("ss") * SEMANTIC_WEIGHT, F.lit(0.0))
    match = (F.when(F.col("ks").isNotNull() & F.col("ss").isNotNull(), "hybrid")
             .when(F.col("ks").isNotNull(), "keyword").otherwise("semantic"))
    return j.select("source_type", "source_id", F.coalesce("kp", "sp").alias("platform"),
                    F.coalesce("kc", "sc").alias("content"), score.alias("score"), match.alias("match"))


@dataclass(frozen=True)
class Filters:
    """R6 filter bag; every field optional, all AND-ed."""
    platform: str | None = None
    author_username: str | None = None
    hashtag: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    min_likes: int | None = None
    content_types: tuple[str, ...] | None = None

    @property
    def post_filters_set(self) -> bool:
        return any(x is not None for x in (self.author_username, self.hashtag, self.date_from, self.date_to,
                                            self.min_likes, self.content_types))


def filter_context(hits: DataFrame, posts: DataFrame, authors: DataFrame, engagement: DataFrame) -> DataFrame:
    """Left-join each post hit with its post, author and engagement (one join each, not N lookups)."""
    from ..session import materialize
    hits = materialize(hits)  # computed once, used for the semi joins and the join
    wanted = hits.where(F.col("source_type") == "post").select(F.col("source_id").alias("_wanted")).distinct()
    of_hits = lambda df, c: df.join(wanted, F.col(c) == F.col("_wanted"), "left_semi")
    p = of_hits(posts.select(F.col("post_id").cast("string").alias("_pid"), "content_type", "hashtags", "posted_at",
                             "author_id", F.col("deleted_at").alias("_deleted")), "_pid")
    a = authors.select(F.col("author_id").alias("_aid"), F.col("username").alias("author_username"))
    a = a.join(p.select(F.col("author_id").alias("_aid")).distinct(), "_aid", "left_semi")
    e = of_hits(engagement.select(F.col("post_id").cast("string").alias("_eid"), F.col("likes").alias("_likes")), "_eid")
    j = hits.join(p, (F.col("source_type") == "post") & (F.col("source_id") == F.col("_pid")), "left")
    j = j.join(a, F.col("author_id") == F.col("_aid"), "left")
    return j.join(e, F.col("source_id") == F.col("_eid"), "left")


def filter_predicate(f: Filters) -> Column:
    """P7-P12 as one predicate over ``filter_context`` columns."""
    if not f.post_filters_set:
        return F.lit(True)
    conds = [F.col("_pid").isNotNull()]  # post hits whose post no longer exists drop
    if f.content_types:
        conds.append(F.col("content_type").isin(*f.content_types))
    if f.hashtag is not None:
        conds.append(F.array_contains("hashtags", f.hashtag.lstrip("#").lower()))
    if f.date_from is not None:
        conds.append(F.col("posted_at") >= F.lit(f.date_from).cast("timestamp_ntz"))
    if f.date_to is not None:
        conds.append(F.col("posted_at") <= F.lit(f.date_to).cast("timestamp_ntz"))
    if f.author_username is not None:
        conds.append(F.lower(F.col("author_username")) == f.author_username.lstrip("@").lower())
    if f.min_likes is not None:
        conds.append(F.col("_eid").isNotNull() & (F.coalesce("_likes", F.lit(0)) >= f.min_likes))
    post_ok = conds[0]
    for c in conds[1:]:
        post_ok = post_ok & F.coalesce(c, F.lit(False))
    return (F.col("source_type") != "post") | post_ok


def apply_filters(hits: DataFrame, f: Filters, posts: DataFrame, authors: DataFrame, engagement: DataFrame) -> DataFrame:
    """Keep hits passing the filters; non-post hits bypass post filters; no-op when none set."""
    if not f.post_filters_set:
        return hits
    ctx = filter_context(hits, posts, authors, engagement)
    return ctx.where(filter_predicate(f)).select(*hits.columns)


def allowed_posts(f: Filters, posts: DataFrame, authors: DataFrame, engagement: DataFrame) -> DataFrame:
    """Post ids passing the post filters (one pass over posts with its author and engagement)."""
    p = posts.select(F.col("post_id").cast("string").alias("_pid"), "content_type", "hashtags", "posted_at",
                     "author_id")
    a = authors.select(F.col("author_id").alias("_aid"), F.col("username").alias("author_username"))
    e = engagement.select(F.col("post_id").cast("string").alias("_eid"), F.col("likes").alias("_likes"))
    j = p.join(a, F.col("author_id") == F.col("_aid"), "left").join(e, F.col("_pid") == F.col("_eid"), "left")
    ctx = j.withColumn("source_type", F.lit("post"))
    return ctx.where(filter_predicate(f)).select(F.col("_pid").alias("allowed_id"))


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: str, query_vec, posts: DataFrame, authors: DataFrame,
                  engagement: DataFrame, filters: Filters = Filters(), limit: int = 10,
                  overfetch: int = HYBRID_OVERFETCH, prefilter: bool = False) -> DataFrame:
    """R4 end to end: keyword and semantic candidates, merged, filtered, ranked, cut.

    Default (parity): ``overfetch`` x limit candidates per mode, filters after the merge, as the
    reference does. ``prefilter=True`` applies the post filters to documents and vectors *before*
    ranking (a semi join with the allowed post ids), so filters can never starve the result."""
    if prefilter and filters.post_filters_set:
        ok = allowed_posts(filters, posts, authors, engagement)
        keep = lambda df: df.join(ok, df["source_id"].cast("string") == ok["allowed_id"], "left_semi")
        docs = keep(docs.where(F.col("source_type") == "post")).unionByName(docs.where(F.col("source_type") != "post"))
        vectors = keep(vectors.where(F.col("source_type") == "post")).unionByName(
            vectors.where(F.col("source_type") != "post"))
        kw = keyword_search(docs, query, filters.platform, limit)
        se = semantic_search(vectors, docs, query_vec, filters.platform, limit)
        return hybrid(kw, se).orderBy(F.col("score").desc(), F.col("source_type"), F.col("source_id")).limit(limit)
    kw = keyword_search(docs, query, filters.platform, limit * overfetch)
    se = semantic_search(vectors, docs, query_vec, filters.platform, limit * overfetch)
    merged = apply_filters(hybrid(kw, se), filters, posts, authors, engagement)
    return merged.orderBy(F.col("score").desc(), F.col("source_type"), F.col("source_id")).limit(limit)


# ----------------------------------------------------------------------------- batch form
def doc_terms(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """Inverted index rows (term, source_type, source_id): distinct tokens per document."""
    return docs.select("source_type", "source_id", "platform",
                       F.explode(F.array_distinct(fn.tokens(text_col))).alias("term"))


def question_words(text) -> Column:
    """All words of a question, each once, without stop words."""
    return F.array_except(F.array_distinct(fn.tokens(text)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def keyword_batch(docs: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """R7 keyword side: documents that hold every word of a question (qid, words); ``limit`` per question
    by id. A question without words finds nothing.

    One pass over the texts keeps the (document, word) rows of words that any question asks for. A
    question is joined on its rarest word alone, and its other words are looked up for those candidates
    only, so a common word never multiplies rows."""
    from ..session import materialize
    key = ["source_type", "source_id", "platform"]
    asked = questions.where(F.size("words") > 0).select("qid", "words")
    terms = asked.select(F.explode("words").alias("term")).distinct()
    held = materialize(doc_terms(docs).join(terms, "term"))
    freq = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    words = asked.select("qid", "words", F.explode("words").alias("term")).join(freq, "term", "left")
    rare = words.groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"), F.first("words").alias("words"))
    rare = rare.where("r.df > 0").select("qid", "words", F.col("r.term").alias("term"))
    found = held.join(rare, "term").select("qid", *key, F.size("words").alias("_n"), F.explode("words").alias("term"))
    j = found.join(held, [*key, "term"], "left_semi").groupBy("qid", *key, "_n").agg(F.count(F.lit(1)).alias("_c")).where("_c = _n")
    w = Window.partitionBy("qid").orderBy(F.col("source_id"))
    ranked = j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
    return ranked.select("qid", "source_type", F.col("source_id").cast("string").alias("source_id"), "platform",
                         F.lit(1.0).alias("score"))


def hybrid_batch(docs: DataFrame, vectors: DataFrame, questions: DataFrame, qvecs: DataFrame, limit: int = 5,
                 overfetch: int = HYBRID_OVERFETCH) -> DataFrame:
    """Many questions in one job; per question top ``limit`` of the weighted merge. ``qvecs`` (qid, q) holds
    the vectors of any number of questions; nothing is collected."""
    from . import vector_blocks
    kw = keyword_batch(docs, questions, limit * overfetch)
    se = vector_blocks.exact_topk(vectors, "embedding", ["source_type", "source_id", "platform"], qvecs, "qid", "q", limit * overfetch)
    se = se.select("qid", "source_type", F.col("source_id").cast("string").alias("source_id"), "platform",
                   F.col("similarity").alias("score"))
    k = kw.select("qid", "source_type", "source_id", F.col("platform").alias("kp"), F.col("score").alias("ks"))
    s = se.select("qid", "source_type", "source_id", F.col("platform").alias("sp"), F.col("score").alias("ss"))
    j = k.join(s, ["qid", "source_type", "source_id"], "full_outer")
    score = F.coalesce(F.col("ks") * KEYWORD_WEIGHT, F.lit(0.0)) + F.coalesce(F.col("ss") * SEMANTIC_WEIGHT, F.lit(0.0))
    match = (F.when(F.col("ks").isNotNull() & F.col("ss").isNotNull(), "hybrid")
             .when(F.col("ks").isNotNull(), "keyword").otherwise("semantic"))
    out = j.select("qid", "source_type", "source_id", F.coalesce("kp", "sp").alias("platform"), score.alias("score"),
                   match.alias("match"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("source_type"), F.col("source_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def question_context(hits: DataFrame, docs: DataFrame, max_hits: int = 8, snippet_chars: int = 500) -> DataFrame:
    """Per question, the top hits as citation lines and a source list (at most ``max_hits`` each)."""
    d = docs.select("source_type", F.col("source_id").cast("string").alias("source_id"), "content")
    h = hits.where(F.col("rank") <= max_hits).join(d, ["source_type", "source_id"], "left")
    cited = h.select("qid", "rank", fn.citation("platform", "source_type", "source_id", "content", snippet_chars)
                     .alias("line"), F.concat_ws(":", "source_type", "source_id").alias("src"))
    g = cited.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "line", "src"))).alias("xs"))
    return g.select("qid", F.size("xs").alias("n_hits"),
                    F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("context"),
                    F.array_join(F.transform("xs", lambda x: x["src"]), ",").alias("sources"))


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_inverted_index(docs: DataFrame, path: str, buckets: int = 64, text_col: str = "content") -> None:
    """Persist postings (term, source_type, source_id, platform) partitioned by a hash bucket of the
    term. Built once from the whole corpus; lookups then read only the buckets of their terms."""
    idx = doc_terms(docs, text_col).withColumn("bucket", term_bucket(F.col("term"), buckets))
    # Salted by document: a bucket holding a very common term is written by up to `salt` tasks.
    salt = 8
    idx.repartition("bucket", F.pmod(F.xxhash64("source_id"), F.lit(salt))) \
       .write.mode("overwrite").partitionBy("bucket").parquet(path)


def postings_for(index: DataFrame, questions: DataFrame, buckets: int = 64) -> DataFrame:
    """Join questions (qid, term) to the index on (bucket, term), reading only the index partitions
    of the questions' buckets. The bucket set is bounded by ``buckets`` (not by the data), so it is
    fetched and applied as a static partition filter."""
    q = questions.select("qid", "term").withColumn("bucket", term_bucket(F.col("term"), buckets))
    needed = sorted(r[0] for r in q.select("bucket").distinct().collect())
    return index.where(F.col("bucket").isin(needed)).join(q, ["bucket", "term"])
