"""Raw-item sources.

A raw item is one schemaless JSON object plus provenance: ``platform``, ``mode``,
``target`` and ``item_seq`` (scrape order). It is held as a VARIANT column ``v``
(``try_parse_json``), so drifting field names are read with ``try_variant_get``.
Landing files (JSON lines, text, Parquet) are read with ``read_raw``; the driver's
tables stand in for landed items through ``RawItems``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import check_scrape_mode
from .bindings import Tables, hours_after_base

RAW_COLUMNS = ["platform", "mode", "target", "item_seq", "raw", "v"]


def with_variant(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Attach the parsed VARIANT; malformed JSON gives a NULL ``v`` (quarantined later)."""
    return df.withColumn("v", F.try_parse_json(F.col(raw)))


def scrape_order(df: DataFrame) -> DataFrame:
    """``item_seq`` of rows read from landing files, a struct that sorts in scrape order: when the file
    landed, its path, the place of the block in the file, the row in the block. Row ids alone follow
    the order in which Spark plans files, not the order in which they came."""
    m = F.col("_metadata")
    return df.withColumn("item_seq", F.struct(m["file_modification_time"].alias("landed"), m["file_path"].alias("path"),
                                              m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")))


def read_raw(spark, path: str, platform: str, mode: str, target: str | None = None,
             fmt: str = "text") -> DataFrame:
    """Landing files as raw items in scrape order. ``fmt`` text = JSON lines; json/parquet need a
    ``raw`` column or are re-serialised row by row."""
    check_scrape_mode(platform, mode)
    if fmt == "text":
        df = spark.read.text(path).select(F.col("value").alias("raw"), "_metadata")
    elif fmt in ("json", "parquet"):
        src = getattr(spark.read, fmt)(path)
        raw = F.col("raw") if fmt == "parquet" and "raw" in src.columns else F.to_json(F.struct(*src.columns)).alias("raw")
        df = src.select(raw, "_metadata")
    else:
        raise ValueError(f"unsupported raw format {fmt!r}")
    return with_variant(scrape_order(df).select(F.lit(platform).alias("platform"), F.lit(mode).alias("mode"),
                                                F.lit(target).cast("string").alias("target"), "item_seq", "raw"))


def objects_only(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items that are JSON objects, and the rest with a ``reason``: text that does not parse, and JSON
    that is no object, normalize to nothing."""
    return quarantine_split(raw, _object_rules())


def object_fault() -> Column:
    """Why an item is no JSON object, NULL if it is one."""
    return first_fault(_object_rules())


def _object_rules() -> dict[str, Column]:
    return {"not_an_object": F.schema_of_variant("v").startswith("OBJECT")}


def _json(**fields: Column) -> Column:
    """JSON object text of the given fields; NULL fields are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _s(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _str(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


IG_TYPES = ["video", "clips", "igtv", "sidecar", "image", "feed", "Carousel", "CLIPS"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (idx + 1).cast("int"))


class RawItems:
    """Raw items landed from the driver's tables (stand-in for scraped JSON)."""

    def __init__(self, t: Tables):
        self.t = t

    def _docs(self, rem: int) -> DataFrame:
        d = self.t.documents.where(F.col("doc_id") % 3 == rem)
        return d.withColumn("k", (F.col("doc_id") / 3).cast("bigint")) \
                .withColumn("posted", hours_after_base("doc_id"))

    @cached_property
    def instagram_posts(self) -> DataFrame:
        d = self._docs(0)
        k, doc = F.col("k"), _str("doc_id")
        cap = _s(F.col("text"), " #", F.col("lang"), " #", F.upper("source"), " @", F.col("source"))
        iso = F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        child = "struct<displayUrl:string,videoUrl:string>"
        img = lambda n: _s("https://cdn.example.com/ig/", doc, n)
        raw = _json(
            id=F.when(k % 2 == 0, _s("ig", doc)),
            shortCode=_s("C", doc),
            caption=F.when(k % 3 != 2, cap),
            text=F.when(k % 3 == 2, cap),
            productType=F.when(k % 2 == 0, _pick(IG_TYPES, k % 8)),
            type=F.when(k % 2 == 1, _pick(IG_TYPES, k % 8)),
            ownerId=F.when(k % 5 != 0, _s("u", _str(F.col("doc_id") % 40))),
            ownerUsername=_s(F.col("source"), "_", _str(F.col("doc_id") % 40)),
            likesCount=F.when(k % 2 == 0, F.col("n_chars") % 1000),
            likeCount=F.when(k % 2 == 1, F.col("n_chars") % 1000),
            commentsCount=F.when(k % 3 == 0, F.col("n_chars") % 97),
            commentCount=F.when(k % 3 != 0, F.col("n_chars") % 97),
            timestamp=F.when(k % 2 == 0, iso),
            takenAt=F.when(k % 2 == 1, F.col("doc_id") * 3600 + 1704067200),
            displayUrl=F.when(k % 7 != 6, img(".jpg")),
            videoUrl=F.when(k % 4 == 1, img(".mp4")),
            childPosts=F.when(k % 5 == 2, F.array(F.struct(img("_c1.jpg").alias("displayUrl"),
                                                           F.lit(None).cast("string").alias("videoUrl")),
                                                  F.struct(F.lit(None).cast("string").alias("displayUrl"),
                                                           img("_c2.mp4").alias("videoUrl"))))
                       .when(k % 5 == 3, F.array(F.struct(img("_c1.jpg").alias("displayUrl"),
                                                          img("_c1.mp4").alias("videoUrl")))).cast(f"array<{child}>"),
            hashtags=F.when(k % 6 == 0, F.array(_s("#", F.upper("source")), F.col("lang")))
                      .when(k % 6 == 1, F.array().cast("array<string>")),
            mentions=F.when(k % 6 == 0, F.array(_s("@", F.col("source")))),
            videoViewCount=F.when(k % 4 == 0, F.lit(0)).when(k % 4 == 2, F.col("n_chars") * 3),
            videoPlayCount=F.when(k % 4 <= 1, F.col("n_chars") * 2),
            isSponsored=F.when(k % 7 == 0, F.lit(True)),
            locationName=F.when(k % 9 == 0, F.lit("Paris")),
            url=F.when(k % 4 == 3, _s("https://instagram.com/p/ig", doc)),
        )
        return self._frame(d, "instagram", "posts", raw)

    @cached_property
    def twitter_posts(self) -> DataFrame:
        d = self._docs(1)
        k, doc = F.col("k"), _str("doc_id")
        tid = _str(F.col("doc_id") + 1000000)
        body = _s(F.col("text"), " #", F.col("lang"), " @", F.col("source"), " https://t.co/", doc)
        native = F.date_format("posted", "EEE MMM dd HH:mm:ss +0000 yyyy")
        iso = F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        a = _str(F.col("doc_id") % 30)
        author = F.when(k % 5 != 0, F.struct(_s("a", a).alias("id"), _s(F.col("source"), "x", a).alias("userName"),
                                             F.upper("source").alias("name"),
                                             ((F.col("doc_id") % 30) * 10).alias("followers")))
        ents_obj = F.to_json(F.struct(
            F.array(F.parse_json(F.to_json(F.struct(_s("Tag", F.col("lang")).alias("text")))),
                    F.parse_json(_s('"plain', F.col("source"), '"'))).alias("hashtags"),
            F.array(F.struct(_s("m", F.col("source")).alias("username"))).alias("mentions"),
            F.array(F.struct(_s("https://ex.com/", doc).alias("expanded_url"))).alias("urls")))
        entities = F.when(k % 4 == 0, F.parse_json(ents_obj)) \
                    .when(k % 4 == 1, F.parse_json(F.lit('{"hashtags":[]}')))
        media_t = "struct<media_url_https:string,mediaUrl:string,type:string>"
        media = F.when(k % 4 == 2, F.array(
            F.struct(_s("https://pbs.example.com/", doc, ".jpg").alias("media_url_https"),
                     F.lit(None).cast("string").alias("mediaUrl"), F.lit("photo").alias("type")),
            F.struct(F.lit(None).cast("string").alias("media_url_https"),
                     _s("https://video.example.com/", doc, ".mp4").alias("mediaUrl"), F.lit("video").alias("type"))
        )).cast(f"array<{media_t}>")
        ext = F.when(k % 4 == 3, F.struct(F.array(F.struct(
            _s("https://pbs.example.com/", doc, ".gif").alias("url"), F.lit("animated_gif").alias("type"))).alias("media")))
        raw = _json(
            id=F.when(k % 2 == 0, tid), tweetId=F.when(k % 2 == 1, tid),
            fullText=F.when(k % 3 != 1, body), text=F.when(k % 3 == 1, body),
            createdAt=F.when(k % 2 == 0, native).otherwise(iso),
            author=author, entities=entities,
            isRetweet=F.when(k % 6 == 1, F.lit(True)), isQuote=F.when(k % 5 == 2, F.lit(True)),
            media=media, extendedEntities=ext, lang=F.col("lang"),
            likeCount=F.when(k % 2 == 0, F.col("n_chars") % 500),
            favorite_count=F.when(k % 2 == 1, F.col("n_chars") % 500),
            retweetCount=F.col("n_chars") % 41,
            replyCount=F.when(k % 3 != 2, F.col("n_chars") % 13),
            reply_count=F.when(k % 3 == 2, F.col("n_chars") % 13),
            viewCount=F.when(k % 3 == 0, F.col("n_chars") * 5), views=F.when(k % 3 == 1, F.col("n_chars") * 5),
            url=_s("https://x.com/i/status/", tid),
        )
        return self._frame(d, "twitter", "posts", raw)

    @cached_property
    def youtube_videos(self) -> DataFrame:
        d = self._docs(2)
        k, doc = F.col("k"), _str("doc_id")
        ch = _str(F.col("doc_id") % 20)
        secs = F.col("n_chars") % 200
        mmss = _s(_str((F.col("n_chars") / 60).cast("bigint")), ":", F.lpad(_str(F.col("n_chars") % 60), 2, "0"))
        duration = (F.when(k % 4 == 0, F.to_variant_object(F.struct(secs.alias("d"))))
                    .when(k % 4 == 1, F.to_variant_object(F.struct(mmss.alias("d"))))
                    .when(k % 4 == 2, F.to_variant_object(F.struct(_s("01:", mmss).alias("d"))))
                    .otherwise(F.to_variant_object(F.struct(F.lit("live").alias("d")))))
        iso = F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        vurl = _s("https://www.youtube.com/watch?v=yt", doc)
        desc = _s(F.col("text"), " #", F.col("source"), " @", F.col("lang"))
        raw = _json(
            id=F.when(k % 2 == 0, _s("yt", doc)), videoId=F.when(k % 2 == 1, _s("yt", doc)),
            title=F.split("text", "\n")[0],
            text=F.when(k % 3 == 0, desc), description=F.when(k % 3 != 0, desc),
            channelId=F.when(k % 4 != 3, _s("UC", ch)), channelUrl=_s("https://www.youtube.com/channel/UC", ch),
            channelName=F.upper("source"), numberOfSubscribers=(F.col("doc_id") % 20) * 1000,
            duration=F.variant_get(duration, "$.d", "variant"),
            date=F.when(k % 2 == 0, iso), uploadDate=F.when(k % 2 == 1, iso),
            url=F.when(k % 2 == 1, vurl), videoUrl=F.when(k % 2 == 0, vurl),
            viewCount=F.when(k % 3 == 0, F.col("n_chars") * 7), views=F.when(k % 3 != 0, F.col("n_chars") * 7),
            likes=F.col("n_chars") % 300, commentsCount=F.col("n_chars") % 31,
            hashtags=F.when(k % 5 == 0, F.array(F.col("source"))),
            thumbnailUrl=_s("https://i.ytimg.com/", doc, ".jpg"),
        )
        return self._frame(d, "youtube", "posts", raw)

    def _frame(self, d: DataFrame, platform: str, mode: str, raw: Column) -> DataFrame:
        out = d.select(F.lit(platform).alias("platform"), F.lit(mode).alias("mode"),
                       F.col("source").alias("target"), F.col("doc_id").alias("item_seq"), raw.alias("raw"))
        return with_variant(out)

    # -- comments, from conversations ------------------------------------------------
    def _turns(self, rem: int) -> DataFrame:
        c = self.t.conversations.where(F.col("conv_id") % 3 == rem)
        return c.withColumn("posted", hours_after_base("conv_id") + F.expr("make_dt_interval(0, 0, cast(turn as int))"))

    @cached_property
    def instagram_comments(self) -> DataFrame:
        """Root comments (turn % 3 = 0) carrying their next two turns nested as replies."""
        c = self._turns(0)
        cid = _s("c", _str("conv_id"), "_", _str("turn"))
        iso = F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        obj = F.struct(
            F.when(F.col("turn") % 2 == 0, cid).alias("id"), F.when(F.col("turn") % 2 == 1, cid).alias("commentId"),
            F.when(F.col("conv_id") % 4 != 1, F.col("text")).alias("text"),
            F.when(F.col("conv_id") % 4 == 1, F.col("text")).alias("content"),
            _s(F.col("role"), _str(F.col("conv_id") % 7)).alias("ownerUsername"),
            _s("o", F.col("role"), _str(F.col("conv_id") % 7)).alias("ownerId"),
            (F.length("text") % 50).alias("likesCount"),
            F.when(F.col("turn") % 2 == 0, iso).alias("timestamp"),
            F.when(F.col("turn") % 2 == 1, iso).alias("createdAt"))
        root = (F.col("turn") / 3).cast("bigint")
        grouped = c.withColumn("root", root).groupBy("conv_id", "root").agg(
            F.min_by(obj, F.col("turn")).alias("item"),
            F.filter(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn"), obj.alias("o")))),
                                 lambda s: F.when(s["turn"] % 3 != 0, s["o"])), lambda x: x.isNotNull()).alias("replies"),
            F.min("turn").alias("turn"))
        # Which nested key holds the replies alternates; an empty first list falls through to the second.
        rep_a = F.when(F.col("conv_id") % 2 == 0, F.col("replies")).when(F.col("conv_id") % 4 == 1,
                                                                          F.array().cast(grouped.schema["replies"].dataType))
        rep_b = F.when(F.col("conv_id") % 2 == 1, F.col("replies"))
        item = F.struct(*[F.col("item")[f].alias(f) for f in ["id", "commentId", "text", "content", "ownerUsername",
                                                               "ownerId", "likesCount", "timestamp", "createdAt"]],
                        rep_a.alias("replies"), rep_b.alias("childComments"))
        out = grouped.select(F.lit("instagram").alias("platform"), F.lit("comments").alias("mode"),
                             _s("p", _str("conv_id")).alias("target"),
                             (F.col("conv_id") * 100 + F.col("turn")).alias("item_seq"), F.to_json(item).alias("raw"))
        return with_variant(out)

    @cached_property
    def twitter_comments(self) -> DataFrame:
        """Conversation search results; turn 0 is the root tweet itself and must be excluded."""
        c = self._turns(1)
        tid = _str(F.col("conv_id") * 100 + F.col("turn") + 5000000)
        raw = _json(
            id=tid, fullText=F.when(F.col("turn") % 2 == 0, F.col("text")),
            text=F.when(F.col("turn") % 2 == 1, F.col("text")), lang=F.lit("en"),
            conversationId=_str(F.col("conv_id") * 100 + 5000000),
            inReplyToId=F.when(F.col("turn") > 0, _str(F.col("conv_id") * 100 + F.col("turn") - 1 + 5000000)),
            author=F.struct(_s("r", F.col("role")).alias("id"), F.col("role").alias("userName")),
            likeCount=F.length("text") % 50, replyCount=F.col("turn"),
            createdAt=F.date_format("posted", "EEE MMM dd HH:mm:ss +0000 yyyy"),
        )
        out = c.select(F.lit("twitter").alias("platform"), F.lit("comments").alias("mode"),
                       _str(F.col("conv_id") * 100 + 5000000).alias("target"),
                       (F.col("conv_id") * 100 + F.col("turn")).alias("item_seq"), raw.alias("raw"))
        return with_variant(out)

    @cached_property
    def youtube_comments(self) -> DataFrame:
        c = self._turns(2)
        cid = _s("yc", _str("conv_id"), "_", _str("turn"))
        pid = _s("yc", _str("conv_id"), "_", _str(F.col("turn") - 1))
        raw = _json(
            id=F.when(F.col("turn") % 2 == 0, cid), cid=F.when(F.col("turn") % 2 == 1, cid),
            text=F.when(F.col("turn") % 3 != 1, F.col("text")), comment=F.when(F.col("turn") % 3 == 1, F.col("text")),
            author=_s("@", F.col("role")), publishedAt=F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            voteCount=F.when(F.col("turn") % 2 == 0, F.length("text") % 50),
            likesCount=F.when(F.col("turn") % 2 == 1, F.length("text") % 50),
            replyCount=F.when(F.col("turn") == 0, F.lit(3)),
            isReply=F.col("turn") > 0, parentCommentId=F.when(F.col("turn") > 0, pid),
        )
        tgt = F.when(F.col("conv_id") % 2 == 0, _s("https://www.youtube.com/watch?v=yt", _str("conv_id"))) \
               .otherwise(_s("yt", _str("conv_id")))
        out = c.select(F.lit("youtube").alias("platform"), F.lit("comments").alias("mode"), tgt.alias("target"),
                       (F.col("conv_id") * 100 + F.col("turn")).alias("item_seq"), raw.alias("raw"))
        return with_variant(out)

    @cached_property
    def transcripts(self) -> DataFrame:
        """Transcript line items per video: one per sentence-like line of the document text."""
        d = self._docs(2)
        lines = d.select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        raw = _json(text=F.when(F.trim("line") != "", F.col("line")), start=F.col("line_no") * 5)
        out = lines.select(F.lit("youtube").alias("platform"), F.lit("transcript").alias("mode"),
                           _s("yt", _str("doc_id")).alias("target"),
                           (F.col("doc_id") * 100000 + F.col("line_no")).alias("item_seq"), raw.alias("raw"))
        return with_variant(out)

    @cached_property
    def all_posts(self) -> DataFrame:
        return self.instagram_posts.unionByName(self.twitter_posts).unionByName(self.youtube_videos)

    @cached_property
    def all_comments(self) -> DataFrame:
        return self.instagram_comments.unionByName(self.twitter_comments).unionByName(self.youtube_comments)


# ---------------------------------------------------------------------------------------
# Source operators over raw items.

def first_per_target(raw: DataFrame) -> DataFrame:
    """Profile scrapes keep only the first item of each (platform, target)."""
    w = Window.partitionBy("platform", "target").orderBy("item_seq")
    return raw.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def limit_per_target(raw: DataFrame, limit: int) -> DataFrame:
    """S3: at most ``limit`` items per (platform, target) in scrape order (plans WindowGroupLimit)."""
    w = Window.partitionBy("platform", "target").orderBy("item_seq")
    return raw.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def first_fault(required: dict[str, Column]) -> Column:
    """Name of the first rule that an item breaks, NULL if it keeps all."""
    reason = F.when(F.col("v").isNull(), F.lit("malformed_json"))
    for name, ok in required.items():
        reason = reason.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    return reason


def quarantine_split(raw: DataFrame, required: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """S12/DQ5: valid rows, and invalid rows with the first failing rule as ``reason``.

    ``required`` maps a rule name to a predicate that must hold; an unparsable
    item (NULL variant) always fails with ``malformed_json``.
    """
    tagged = raw.withColumn("reason", first_fault(required))
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def batch_union(*batches: DataFrame) -> DataFrame:
    """Merge batches; columns missing on one side become NULL."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def tasks_join(tasks: DataFrame, raw: DataFrame) -> DataFrame:
    """Many (platform, mode, target, limit) tasks in one job instead of a thread pool.

    Tasks are a small driver-side list; the join is on the provenance key and the
    per-task limit is applied with a window (WindowGroupLimit)."""
    j = raw.join(tasks, ["platform", "mode", "target"], "inner")
    w = Window.partitionBy("platform", "mode", "target").orderBy("item_seq")
    return j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("limit")).drop("_rn")


def transcript_text(lines: DataFrame) -> DataFrame:
    """Per target, non-empty line texts (stripped) joined by a space in line order."""
    from ..functions import py_strip
    txt = F.try_variant_get("v", "$.text", "string")
    from ..operators.concat import ordered_concat
    kept = lines.where(txt.isNotNull() & (txt != "")).select("target", "item_seq", py_strip(txt).alias("line"))
    joined = ordered_concat(kept, ["target"], "item_seq", "line", " ", "transcript")
    return joined.select("target", py_strip("transcript").alias("transcript"))
