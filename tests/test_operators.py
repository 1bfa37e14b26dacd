"""Identity, merge, retrieval and SQL-guard operators on small fixtures (brute force where useful)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlake.operators import identity as I
from contentlake.operators import merge as M
from contentlake.operators import retrieval as RT
from contentlake.operators import vector as V
from contentlake.operators import vector_blocks as VB
from contentlake.schema import PlanError, check_scrape_mode


def test_dedupe_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, item_seq long, v string")
    out = {r["k"]: r["v"] for r in I.dedupe_last_wins(df, ["k"]).collect()}
    assert out == {"a": "z", "b": "y"}


def test_merge_prefer_non_null(spark):
    old = spark.createDataFrame([("a", "bio", ["t"], {"k": 1})], "k string, bio string, tags array<string>, m map<string,int>")
    new = spark.createDataFrame([("a", "", [], {})], "k string, bio string, tags array<string>, m map<string,int>")
    r = I.merge_prefer_non_null(old, new, ["k"]).collect()[0]
    assert r["bio"] == "bio" and r["tags"] == ["t"] and r["m"] == {"k": 1}


def test_upsert_overwrites_with_null(spark):
    cur = spark.createDataFrame([("a", "id1", "old"), ("b", "id2", "keep")], "k string, id string, v string")
    bat = spark.createDataFrame([("a", "new-id", None), ("c", "id3", "ins")], "k string, id string, v string")
    out = {r["k"]: (r["id"], r["v"], r["action"]) for r in M.upsert(cur, bat, ["k"]).collect()}
    assert out == {"a": ("id1", None, "update"), "b": ("id2", "keep", "keep"), "c": ("id3", "ins", "insert")}


def test_hybrid_weights(spark):
    kw = spark.createDataFrame([("post", "p1", "x", "c", 1.0, "keyword"), ("post", "p2", "x", "c", 1.0, "keyword")],
                               "source_type string, source_id string, platform string, content string, score double, match string")
    se = spark.createDataFrame([("post", "p1", "x", "c", 0.8, "semantic"), ("post", "p3", "x", "c", 0.5, "semantic")],
                               kw.schema)
    out = {r["source_id"]: (round(r["score"], 6), r["match"]) for r in RT.hybrid(kw, se).collect()}
    assert out == {"p1": (0.88, "hybrid"), "p2": (0.4, "keyword"), "p3": (0.3, "semantic")}


def test_websearch_parse():
    q = RT.parse_websearch('the cat -dog "big fish" or bird')
    words = [[(t.words, t.negated) for t in g] for g in q.groups]
    assert words == [[(("cat",), False), (("dog",), True), (("big", "fish"), False)], [(("bird",), False)]]
    assert RT.parse_websearch("the of and").empty


def test_cosine_topk_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 16))
    df = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(200)], "id long, v array<double>") \
        .repartition(5)
    q = rng.normal(size=16)
    got = [r["id"] for r in V.cosine_topk(df, "v", q.tolist(), 7, ["id"]).collect()]
    sims = (m @ q) / (np.linalg.norm(m, axis=1) * np.linalg.norm(q))
    assert got == list(np.argsort(-sims)[:7])
    asked = spark.createDataFrame([(1, q.tolist())], "qid long, q array<double>")
    cents = VB.train(df, "v", 4)
    lists = VB.pack(VB.assign(df, "v", cents), "v", ["id"], "list_id")
    full = VB.lists_topk(lists, cents, ["id"], asked, "qid", "q", 7, probes=4)
    assert [r["id"] for r in full.orderBy("rank").collect()] == got  # probing every list is exact


def test_scrape_modes():
    check_scrape_mode("twitter", "keyword")
    with pytest.raises(PlanError):
        check_scrape_mode("youtube", "hashtag")
    with pytest.raises(PlanError):
        check_scrape_mode("myspace", "posts")


def test_sql_guard(spark, sf_dir):
    from contentlake.plans.registry import tables
    from contentlake.plans.safe_sql import guard, register_views
    register_views(spark, tables(spark, sf_dir))
    for ok in ["select created_at, updated_at from chats", "with r as (select * from posts) select count(*) from r",
               "select extract(day from created_at) from query_logs",
               "with recursive t(a) as (select 1 union all select a + 1 from t where a < 3) select * from t"]:
        guard(spark, ok)
    for bad in ["drop table posts", "insert into posts select * from posts", "select 1; select 2",
                "select * from secrets", "delete from posts"]:
        with pytest.raises(PlanError):
            guard(spark, bad)


def test_thread_roots_deep_chain(spark):
    from contentlake.operators.chat import thread_roots
    rows = [(str(i), None if i == 0 else str(i - 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "comment_id string, parent_comment_id string")
    out = {r["comment_id"]: (r["root_id"], r["depth"]) for r in thread_roots(df).collect()}
    assert all(out[str(i)] == ("0", i) for i in range(40))


def test_keyword_search_brute_force(spark):
    import re
    docs = [("post", i, "x", t) for i, t in enumerate(
        ["The cat sat", "dog and cat", "big fish swim", "a big dog", "fish big"])]
    df = spark.createDataFrame(docs, "source_type string, source_id long, platform string, content string")
    got = [int(r["source_id"]) for r in RT.keyword_search(df, 'cat -dog or "big fish"', limit=10).collect()]

    def match(t):
        toks = re.findall(r"\w+", t.lower())
        joined = " " + " ".join(toks) + " "
        return ("cat" in toks and "dog" not in toks) or " big fish " in joined  # words bind tighter than "or"
    assert got == [i for i, (_, _, _, t) in enumerate(docs) if match(t)]


def test_english_stems():
    from contentlake.operators.stemmer import common_prefix, stem
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
             "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
             "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit",
             "generalization": "general", "hopeful": "hope", "goodness": "good", "revival": "reviv",
             "adjustment": "adjust", "adoption": "adopt", "controll": "control", "running": "run",
             "consistency": "consist", "consolingly": "consol", "conspiracy": "conspiraci", "knackeries": "knackeri", "ties": "tie",
             "cries": "cri", "dying": "die", "says": "say", "enjoy": "enjoy", "generously": "generous", "hoping": "hope", "gas": "gas",
             "kiwis": "kiwi", "proceeding": "proceed", "apology": "apolog", "abilities": "abil", "possibly": "possibl", "skies": "sky",
             "exceedingly": "exceed", "youth": "youth", "by": "by", "x2s": "x2s", "a_ing": "a_ing", "éclairs": "éclair"}
    for w, exp in cases.items():
        assert stem(w) == exp, (w, stem(w), exp)
        assert w.startswith(common_prefix(exp))


def test_words_begin_like_their_stems(spark, sf_dir):
    from contentlake.operators.stemmer import common_prefix, stem
    ends = ["", "s", "es", "ed", "ing", "ly", "y", "ied", "ability", "ibility", "bly", "ation", "ational", "izer", "iveness", "ogy", "ency", "ally", "fully", "lessly", "e", "ble"]
    text = " ".join(r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lower("text")).where("text is not null").collect())
    words = set(text.split()) | {a + b for a in ("hop", "stat", "cry", "sk", "d", "possi", "nation", "apol", "tri", "fl", "ba") for b in ends}
    assert [w for w in words if w.isalpha() and not w.startswith(common_prefix(stem(w)))] == []


def test_keyword_search_by_stems(spark):
    docs = spark.createDataFrame([("post", 1, "x", "Running nations"), ("post", 2, "x", "the runner"),
                                  ("post", 3, "y", "a nation runs")],
                                 "source_type string, source_id long, platform string, content string")
    ids = lambda q, **k: [int(r["source_id"]) for r in RT.keyword_search(docs, q, **k).collect()]
    assert ids("run nation") == [1, 3] and ids("run nation", platform="y") == [3] and ids("run nation", stemmed=False) == []
    assert ids('"ran nation"') == [] and ids('"runs nation"') == [1] and ids('"the of"') == ids("the") == ids("") == []


def test_upsert_prefer_non_null(spark):
    cur = spark.createDataFrame([("a", "id1", "old", "bio")], "k string, id string, v string, bio string")
    bat = spark.createDataFrame([("a", "id9", None, ""), ("c", "id3", "ins", None)], "k string, id string, v string, bio string")
    out = {r["k"]: (r["id"], r["v"], r["bio"], r["action"])
           for r in M.upsert(cur, bat, ["k"], mode="prefer_non_null").collect()}
    assert out == {"a": ("id1", "old", "bio", "update"), "c": ("id3", "ins", None, "insert")}


def test_threads_with_orphans_and_cycles(spark):
    import datetime as dt

    from contentlake.operators.chat import thread_participants, thread_roots, threads
    start = dt.datetime(2024, 1, 1)
    rows = [(f"c{i}", None if i % 50 == 0 else f"c{i - 1}", start + dt.timedelta(hours=5 * i), f"u{i % 7}") for i in range(400)]
    rows += [("orphan", "gone", start, "u1"), ("child", "orphan", start, "u2"), ("x", "y", start, "u1"), ("y", "z", start, "u1"),
             ("z", "x", start, "u1"), ("into", "x", start, "u1")]
    c = spark.createDataFrame(rows, "comment_id string, parent_comment_id string, posted_at timestamp_ntz, author string")
    roots = {r["comment_id"]: (r["root_id"], r["depth"]) for r in thread_roots(c).collect()}
    assert len(roots) == len(rows) and roots["c149"] == ("c100", 49) and roots["orphan"] == ("orphan", 0) and roots["child"] == ("orphan", 1)
    assert {roots[i] for i in ("x", "y", "z", "into")} == {(None, None)}  # a cycle of parents has no root
    got = {r["comment_id"]: (r["root_id"], r["position"], r["thread_size"]) for r in threads(c).collect()}
    assert len(got) == 402 and got["c149"] == ("c100", 50, 50) and got["c100"] == ("c100", 1, 50) and got["child"][2] == 2
    assert {r["root_id"]: r["participants"] for r in thread_participants(c).collect()}["orphan"] == 2


def test_sql_guard_quirks(spark, sf_dir):
    from contentlake.plans.registry import tables
    from contentlake.plans.safe_sql import guard, register_views
    register_views(spark, tables(spark, sf_dir))
    with pytest.raises(PlanError):
        guard(spark, "select * from posts, secrets")          # K18: every table in a comma list is checked
    guard(spark, "select 1 as x -- drop table posts")           # K13: a comment is not a statement
    guard(spark, "select * from match_embeddings((select embedding from embeddings where vec_id = 1), null) limit 3")
    with pytest.raises(PlanError):
        guard(spark, "WITH x AS (SELECT 1) INSERT INTO posts SELECT * FROM x")


def test_read_raw_landing(spark, tmp_path):
    import json

    from contentlake.operators.normalize import instagram
    from contentlake.sources.raw import quarantine_split, read_raw
    lines = [json.dumps({"id": "1", "caption": "hello #a"}), "{not json", json.dumps({"shortCode": "s2", "text": "x"})]
    (tmp_path / "items.jsonl").write_text("\n".join(lines) + "\n")
    raw = read_raw(spark, str(tmp_path / "items.jsonl"), "instagram", "posts", "acct")
    good, bad = quarantine_split(raw, {})
    assert bad.count() == 1 and [r.reason for r in bad.collect()] == ["malformed_json"]
    posts = {r.platform_post_id: r.hashtags for r in instagram.post(good).collect()}
    assert posts == {"1": ["a"], "s2": []}
    with pytest.raises(PlanError):
        read_raw(spark, str(tmp_path), "youtube", "hashtag")


def test_keyword_search_over_index_equals_scan_and_brute_force(spark, tmp_path):
    import random
    import re

    from contentlake.operators import text_index as TI
    from contentlake.operators.stemmer import stem
    r = random.Random(11)
    words = ["cat", "cats", "dog", "dogs", "the", "of", "big", "fish", "fishing", "running", "run", "über", "x2"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(r.randrange(0, 25))) for _ in range(120)] + [None, "", "THE of"]
    docs = spark.createDataFrame([("post", i, "xy"[i % 2], t) for i, t in enumerate(texts)],
                                 "source_type string, source_id long, platform string, content string")
    TI.write_index(docs, str(tmp_path / "idx"), buckets=4)
    index = spark.read.parquet(str(tmp_path / "idx"))

    def held(text):
        return [None if w in RT.STOP_WORDS else stem(w) for w in re.findall(r"\w+", (text or "").lower())]

    def at(xs, ws):
        return any(all(i + k < len(xs) and xs[i + k] == s for s, k in ws) for i in range(len(xs)))

    def plain(q, platform=None):
        groups = TI._terms(RT.parse_websearch(q))
        return [i for i, t in enumerate(texts) if groups and platform in (None, "xy"[i % 2])
                and any(all(at(held(t), ws) != neg for neg, ws in g) for g in groups)]

    for q, p in [("cat", None), ("cats -dogs", None), ("cat dog fished", "x"), ('"big fish"', None), ("cat or dog", "y"), ("fish -big", None),
                 ('"cat of the dog"', None), ('"cat the dog" -"big run"', None), ("-cat", None), ("-cat or fish", None), ("the", None),
                 ('"runs cat dogs" or ÜBER', None), ("x2", None), ("nothing", None)]:
        a = [int(x["source_id"]) for x in RT.keyword_search(docs, q, p, limit=500).collect()]
        b = [int(x["source_id"]) for x in TI.search_index(index, docs, q, p, limit=500, buckets=4).collect()]
        assert a == b == plain(q, p), q


def test_index_keeps_runs_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    from contentlake.operators import text_index as TI
    texts = ["cats and a cat", None, "", "the of", "x2 cat Über", "dogs dog cat dog"] * 40
    docs = spark.createDataFrame([(None if i == 7 else "post", i // 2, None if i == 4 else "x", t) for i, t in enumerate(texts)],
                                 "source_type string, source_id long, platform string, content string").coalesce(1)
    want = sorted(((s, k, i // 2, p, at) for i, t in enumerate(texts) for k, p in [(None if i == 7 else "post", None if i == 4 else "x")] for s, at in
                   ({"cat": [0, 3]}, {}, {}, {}, {"x2": [0], "cat": [1], "über": [2]}, {"dog": [0, 1, 3], "cat": [2]})[i % 6].items()), key=str)
    for places in (TI.PLACES, 3):
        monkeypatch.setattr(TI, "PLACES", places)
        TI.write_index(docs, str(tmp_path / f"i{places}"), buckets=4)
        index = spark.read.parquet(str(tmp_path / f"i{places}"))
        assert sorted((tuple(r) for r in TI.entries(index).collect()), key=str) == want
        if places > 3:
            assert index.count() == 4 < len(want)  # one row a stem, not one for each document


def test_sql_guard_reads_the_plan(spark, sf_dir):
    import pytest

    from contentlake.plans.registry import tables
    from contentlake.plans.safe_sql import guard, register_views
    from contentlake.schema import PlanError
    register_views(spark, tables(spark, sf_dir))
    refused = ["with secret as (select * from secret) select * from secret",
               "with posts2 as (select * from b), b as (select 1) select * from posts2",
               "select * from otherdb.posts", "select * from json.`posts`", "select reflect('java.lang.System', 'getenv', 'HOME')",
               "select try_reflect('java.lang.System', 'getenv', 'HOME')", "select (select max(x) from hidden) from posts",
               "select * from posts where exists (select 1 from hidden)", "select 1; drop table posts", "create table t as select 1",
               "select system.builtin.reflect('a', 'b')", "select * from posts join (select * from hidden)", "set x = 1", "from posts select 1"]
    for sql in refused:
        with pytest.raises(PlanError):
            guard(spark, sql)
    for sql in ["select 1 as CreatedBy", "select 'a;b', 'DropTable', 'insert'", "select 1;", "select `update` from (select 1 as `update`)",
                "with a as (select * from posts), b as (select * from a) select count(*) from b",
                "with recursive r as (select 1 as n union all select n + 1 from r where n < 5) select * from r",
                "with a as (select 1) select * from (with a as (select 2) select * from a) x, posts where post_id in (select post_id from posts)"]:
        guard(spark, sql)
    zero = "select * from match_embeddings(array_repeat(cast(0 as float), 64), null) limit 3"
    assert [r["similarity"] for r in spark.sql(guard(spark, zero)).collect()] == [None] * 3
