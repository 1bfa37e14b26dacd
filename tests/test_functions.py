"""Scalar functions on the reference's edge cases."""

from pyspark.sql import functions as F

from contentlake import functions as fn


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).collect()[0]["r"]


def test_hashtags(spark):
    assert one(spark, fn.hashtags(F.col("x")), "#Sunset #sunset #SUNSET") == ["sunset"]
    assert one(spark, fn.hashtags(F.col("x")), "price is $5#not_a_tag") == []
    assert one(spark, fn.hashtags(F.col("x")), None) == []
    assert one(spark, fn.hashtags(F.col("x")), "##b #a#b $5#no été#x #Été") == ["b", "a", "été"]


def test_mentions_urls(spark):
    assert one(spark, fn.mentions(F.col("x")), "hi @Bob and @bob, mail@host") == ["bob"]
    assert one(spark, fn.urls(F.col("x")), "see (https://example.com/page).") == ["https://example.com/page"]


def test_language(spark):
    for text, exp in [("こんにちは", "und"), (None, "und"), ("   ", "und"), ("hello world", "en")]:
        assert one(spark, fn.guess_language(F.col("x")), text) == exp


def test_as_int(spark):
    assert one(spark, fn.as_int(F.col("x")), "42") == 42
    assert one(spark, fn.as_int(F.col("x")), "3.9") is None
    assert one(spark, fn.as_int(F.col("x")), "not-a-number") is None
    assert one(spark, fn.as_int(F.col("x")), 3.9, "x double") == 3


def test_clean_names(spark):
    assert one(spark, fn.lower_list(F.col("x")), ["#A", "@b", "#A"], "x array<string>") == ["a", "b", "a"]
    assert one(spark, fn.clean_username(F.col("x")), "  @Bob ") == "Bob"
    assert one(spark, fn.clean_tag(F.col("x"), "#"), " #Tag ") == "tag"


def test_timestamps_and_duration(spark):
    import datetime as dt
    assert one(spark, fn.parse_ts(F.col("x")), "2024-01-02T03:04:05Z") == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, fn.parse_ts(F.col("x")), "junk") is None
    assert one(spark, fn.parse_ts_native(F.col("x")), "Wed Oct 10 20:19:24 +0000 2018") == dt.datetime(2018, 10, 10, 20, 19, 24)
    assert one(spark, fn.duration_seconds(F.col("x")), "01:02:03") == 3723.0
    assert one(spark, fn.duration_seconds(F.col("x")), "1:x") is None


def test_engagement_maths(spark):
    df = spark.createDataFrame([(10, None, 2, None, 100, {"love": 3})],
                               "likes long, shares long, comments_count long, saves long, views long, reactions map<string,long>")
    r = df.select(fn.total_engagement(reactions="reactions").alias("t"),
                  fn.engagement_rate(fn.total_engagement(reactions="reactions"), "views").alias("r")).collect()[0]
    assert r["t"] == 15 and r["r"] == 0.15
    z = spark.createDataFrame([(1, 0)], "likes long, views long").select(
        fn.engagement_rate(F.col("likes"), "views").alias("r")).collect()[0]["r"]
    assert z is None


def test_checksum_strips(spark):
    import hashlib
    assert one(spark, fn.checksum(F.col("x")), "  hi\n") == hashlib.sha256(b"hi").hexdigest()


def test_question_intent(spark):
    assert one(spark, fn.question_intent(F.col("x")), "Show the TREND of likes") == "trend"
    assert one(spark, fn.question_intent(F.col("x")), "instagram vs twitter") == "comparison"
    assert one(spark, fn.question_intent(F.col("x")), "hello") is None


def test_tags_beside_other_characters(spark):
    import regex

    from contentlake import functions as fn
    texts = ["#a", "x#a", "#a#b", "##a", "é#a", "_#a", "-#a", "#é_1", "#", "a #", "²#a", "\U0001f600#Up", " @b@c @@d", "\n#n\t@t", "x@y @z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", fn.hashtags("t").alias("h"), fn.mentions("t").alias("m")).collect()
    for r in got:
        for mark, tags in (("#", r["h"]), ("@", r["m"])):
            want = regex.findall(rf"(?<![\p{{L}}\p{{N}}_]){mark}([\p{{L}}\p{{N}}_]+)", texts[r["i"]].lower())
            assert tags == list(dict.fromkeys(want)), texts[r["i"]]


def test_hashing_provider_takes_the_words_of_any_script():
    import hashlib

    import numpy as np
    import regex

    from contentlake.operators import embeddings as E
    texts = [None, "", " ..", "Ünï x_1 don’t x_1", "ΣΑΣ İstanbul ² Ⅷ", "一二三,四 a\x85b\x1cc", "\U0001d49cb ab", "x" * 200 + " é" * 100]
    for dims in (1, 8):
        for t, got in zip(texts, E.HashingProvider(dims).embed_texts(texts)):
            v = np.zeros(dims)
            for w in regex.findall(r"[\p{L}\p{N}_]+", (t or "").lower()):
                h = hashlib.md5(w.encode()).hexdigest()
                v[int(h[1:9], 16) % dims] += 1.0 if int(h[0], 16) % 2 == 0 else -1.0
            n = np.linalg.norm(v)
            assert got == (v / n if n else v).tolist(), t
