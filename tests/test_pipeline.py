"""End-to-end ingest: a second run of the same batch changes nothing (reference integration test)."""

import __spark_entry__ as E


def test_pipeline_idempotent(spark, sf_dir):
    df = E.queries()["pipeline_run"](spark, sf_dir)
    m = {(r["run"], r["metric"]): r["value"] for r in df.collect()}
    assert m[(1, "errors")] == 0 and m[(2, "errors")] == 0
    assert m[(1, "rows:posts")] > 0 and m[(1, "rows:embeddings")] > 0
    for (run, metric), v in m.items():
        if run == 2 and metric.startswith("rows:"):
            assert v == m[(1, metric)], metric
        if run == 2 and metric.startswith("inserted:"):
            assert v == 0, metric
    assert m[(2, "embeddings_generated")] == 0  # checksums unchanged -> nothing re-embedded
    assert m[(2, "media_created")] == 0 and m[(2, "hashtags_linked")] == 0


def test_lake_upsert_merges_on_read(spark, tmp_path):
    from contentlake.operators.pipeline import Lake
    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.read("t") is None
    first = spark.createDataFrame([(f"k{i}", f"id{i}", "v1") for i in range(40)], "k string, id string, v string")
    assert lake.upsert("t", first, ["k"], "id") == (40, 0)
    second = spark.createDataFrame([("k3", "other", "v2", 7), ("k99", "id99", "new", 8)], "k string, id string, v string, extra int")
    assert lake.upsert("t", second, ["k"], "id") == (1, 1)
    for _ in range(2):  # before and after compaction
        rows = {r["k"]: r for r in lake.read("t").collect()}
        assert len(rows) == 41 and rows["k3"][:4] == ("k3", "id3", "v2", 7) and rows["k99"]["id"] == "id99"
        assert rows["k3"]["updated_at"] > rows["k3"]["created_at"] and rows["k5"]["updated_at"] == rows["k5"]["created_at"]
        assert all((rows[f"k{i}"]["id"], rows[f"k{i}"]["v"]) == (f"id{i}", "v1") for i in range(40) if i != 3)
        lake.compact("t")
    assert lake.vacuum("t") == 3 and lake.read("t").count() == 41
    assert lake.append_new("m", spark.createDataFrame([("a", 1), ("a", 1)], "p string, x int"), ["p"]) == 1
    assert lake.append_new("m", spark.createDataFrame([("a", 2), ("b", 1)], "p string, x int"), ["p"]) == 1


def test_lake_loses_nothing_when_a_step_fails(spark, tmp_path, monkeypatch):
    import pytest

    from contentlake.operators.pipeline import Lake
    from contentlake.schema import PlanError
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = spark.createDataFrame([(i, i) for i in range(100)], "k int, id int")
    lake.upsert("t", rows, ["k"], "id")
    lake.append_new("m", rows, ["k"])

    def broken(*_):
        raise OSError("the store did not answer")

    with monkeypatch.context() as m:
        m.setattr(lake, "_rows", broken)
        for attempt in (lambda: lake.upsert("t", rows.limit(6), ["k"], "id"), lambda: lake.read("t"), lambda: lake.append_new("m", rows, ["k"]),
                        lambda: lake.read_rows("m")):
            with pytest.raises(OSError):
                attempt()
    with pytest.raises(PlanError, match="twice"):
        lake.upsert("t", rows.union(rows), ["k"], "id")
    with pytest.raises(Exception, match="(?i)divi"):  # fails while its rows are written
        spark.conf.set("spark.sql.ansi.enabled", "true")
        lake.upsert("t", rows.selectExpr("k", "id", "1 / (k - 5) as x"), ["k"], "id")
    assert lake.read("t").count() == 100 and lake.read_rows("m").count() == 100
    live = [p.name for p in (tmp_path / "lake" / "t").iterdir() if p.name.startswith("data-")]
    assert len(live) == 1  # nothing of the failed writes is left


def test_comment_post_refs_resolve(spark, tmp_path):
    import json

    from contentlake.operators.pipeline import Lake, ingest
    from contentlake.sources.raw import with_variant

    def raw(items, target):
        rows = [(json.dumps(x), i, target, "instagram", "posts") for i, x in enumerate(items)]
        return with_variant(spark.createDataFrame(rows, "raw string, item_seq long, target string, platform string, mode string"))
    posts = raw([{"id": "111", "shortCode": "ABC", "caption": "hi", "ownerId": "u1", "ownerUsername": "u"}], "acct")
    by_url = raw([{"id": "c1", "text": "nice", "ownerId": "u2"}], "https://www.instagram.com/p/ABC/")
    lake = Lake(spark, str(tmp_path / "lake"))
    rep = ingest(spark, lake, {"instagram": posts}, {"instagram": by_url})
    assert not rep.errors
    post_id = lake.read("posts").collect()[0]["post_id"]
    assert lake.read("comments").collect()[0]["post_id"] == post_id   # resolved through the post URL


def test_ingest_step_isolation(spark, tmp_path):
    import json

    from contentlake.operators.pipeline import Lake, ingest
    from contentlake.sources.raw import with_variant
    rows = [(json.dumps({"id": "1", "caption": "x #t", "ownerId": "u"}), 0, "acct", "instagram", "posts")]
    posts = with_variant(spark.createDataFrame(rows, "raw string, item_seq long, target string, platform string, mode string"))
    broken = spark.createDataFrame([("not a raw item",)], "value string")   # comments step cannot read this
    lake = Lake(spark, str(tmp_path / "lake"))
    rep = ingest(spark, lake, {"instagram": posts}, {"instagram": broken})
    assert rep.status == "partial" and any(e.startswith("authors") or e.startswith("comments") for e in rep.errors)
    assert lake.read("posts").count() == 1 and lake.read("engagement").count() == 1
    job = lake.jobs().collect()[0]
    assert job["status"] == "partial" and job["error"].count("; ") == len(rep.errors) - 1


def test_profile_scrape_adds_first_author_only(spark, tmp_path):
    import json

    from contentlake.operators.pipeline import Lake, ingest
    from contentlake.sources.raw import with_variant

    def raw(items, mode):
        rows = [(json.dumps(x), i, "acct", "instagram", mode) for i, x in enumerate(items)]
        return with_variant(spark.createDataFrame(rows, "raw string, item_seq long, target string, platform string, mode string"))
    posts = raw([{"id": "p1", "caption": "x", "ownerId": "u1"}], "posts")
    profiles = raw([{"id": "42", "username": "first"}, {"id": "43", "username": "second"}], "profile")
    lake = Lake(spark, str(tmp_path / "lake"))
    from contentlake.operators.embeddings import HashingProvider
    rep = ingest(spark, lake, {"instagram": posts}, {}, HashingProvider(8), profiles_raw={"instagram": profiles})
    assert rep.status == "succeeded", rep.errors
    users = {r["platform_user_id"] for r in lake.read("authors").collect()}
    assert users == {"u1", "42"}


def test_landing_order_and_quarantine(spark, tmp_path):
    import json
    import os

    from contentlake.operators.pipeline import Lake, ingest
    from contentlake.sources.raw import read_raw
    old = [json.dumps({"id": "p1", "caption": "old", "ownerId": "u"}), "{broken", "[1, 2]", "7", "null"]
    new = [json.dumps({"id": f"q{i}", "caption": "x" * 200, "ownerId": "u"}) for i in range(300)] + [
        json.dumps({"id": "p1", "caption": "new", "ownerId": "u"}), json.dumps({"id": "p1", "caption": "newest", "ownerId": "u"})]
    for n, (name, lines) in enumerate((("z-old", old), ("a-new", new))):  # the older file is small and sorts last
        (tmp_path / name).write_text("\n".join(lines))
        os.utime(tmp_path / name, (1_700_000_000 + n, 1_700_000_000 + n))
    for split in ("128m", "4k"):  # also with files cut into many pieces
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            lake = Lake(spark, str(tmp_path / f"lake-{split}"))
            rep = ingest(spark, lake, {"instagram": read_raw(spark, f"{tmp_path}/*-*[wd]", "instagram", "posts", target="acct")}, {})
            assert not rep.errors and rep.counters["quarantined"] == 4
            posts = {r["platform_post_id"]: r["caption"] for r in lake.read("posts").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert posts["p1"] == "newest" and len(posts) == 301 and "" not in posts
        bad = {r["raw"]: r["reason"] for r in lake.read_rows("quarantine").collect()}
        assert bad == {"{broken": "malformed_json", "[1, 2]": "not_an_object", "7": "not_an_object", "null": "not_an_object"}


def test_lake_reads_only_what_is_asked_for(spark, tmp_path):
    from contentlake.operators.pipeline import Lake
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = spark.createDataFrame([(f"k{i}", f"id{i}", "v1", "long text") for i in range(20)], "k string, id string, v string, text string")
    lake.upsert("t", rows, ["k"], "id")

    def shuffles(df):
        return "Exchange" in df._jdf.queryExecution().executedPlan().toString()

    one = lake.read("t", ["v"])
    assert not shuffles(one) and not shuffles(lake.read("t"))  # one batch has no key twice
    assert one.columns == ["k", "id", "v", "created_at", "updated_at"] and one.count() == 20
    lake.upsert("t", rows.where("k < 'k2'").selectExpr("k", "'other' as id", "'v2' as v", "text"), ["k"], "id")
    for _ in range(2):  # before and after compaction, where a changed key has two rows in one folder
        two = lake.read("t", ["v"])
        assert shuffles(two) and "text" not in two.columns
        got = {r["k"]: (r["id"], r["v"], r["updated_at"] > r["created_at"]) for r in two.collect()}
        assert got == {f"k{i}": (f"id{i}", "v2", True) if f"k{i}" < "k2" else (f"id{i}", "v1", False) for i in range(20)}
        lake.compact("t")


def _raw(spark, items, mode="posts"):
    import json

    from contentlake.sources.raw import with_variant
    rows = [(x if isinstance(x, str) else json.dumps(x), i, "acct", "instagram", mode) for i, x in enumerate(items)]
    return with_variant(spark.createDataFrame(rows, "raw string, item_seq long, target string, platform string, mode string"))


def test_ingest_normalizes_each_item_once(spark, tmp_path, monkeypatch):
    from contentlake.operators.normalize import instagram
    from contentlake.operators.pipeline import Lake, ingest
    calls = []
    for name in ("post", "comment"):
        def counted(raw, *keep, _f=getattr(instagram, name), _name=name):
            calls.append(_name)
            return _f(raw, *keep)
        monkeypatch.setattr(instagram, name, counted)
    posts = _raw(spark, [{"id": "p1", "caption": "old #one @ann", "ownerId": "u1", "ownerUsername": "first", "likesCount": 1, "displayUrl": "http://x/1"},
                         "{broken", {"id": "p2", "caption": "two #Two", "ownerId": "u2"}, "7",
                         {"id": "p1", "caption": "new #Three @bob", "ownerId": "u1", "ownerUsername": "later", "likesCount": 5, "displayUrl": "http://x/2"}])
    comments = _raw(spark, [{"id": "c1", "text": "hi", "ownerId": "u3", "replies": [{"id": "c2", "text": "re", "ownerId": "u4"}]}, "[1]"], "comments")
    lake = Lake(spark, str(tmp_path / "lake"))
    rep = ingest(spark, lake, {"instagram": posts}, {"instagram": comments})
    assert not rep.errors and sorted(calls) == ["comment", "post"]
    assert rep.counters["quarantined"] == 3
    p = {r["platform_post_id"]: r for r in lake.read("posts").collect()}
    assert set(p) == {"p1", "p2"} and p["p1"]["caption"] == p["p1"]["content"] == "new #Three @bob"
    # All tables take the last item of a key that comes twice; authors the first.
    assert {r["tag"] for r in lake.read_rows("hashtags").collect()} == {"three", "two"}
    assert [r["username"] for r in lake.read_rows("mentions").collect()] == ["bob"]
    assert [r["url"] for r in lake.read_rows("media").collect()] == ["http://x/2"]
    assert {r["post_id"]: r["likes"] for r in lake.read("engagement").collect()} == {p["p1"]["post_id"]: 5, p["p2"]["post_id"]: None}
    assert {r["platform_user_id"]: r["username"] for r in lake.read("authors").collect()} == {
        "u1": "first", "u2": "unknown", "u3": "unknown", "u4": "unknown"}
    c = {r["platform_comment_id"]: r for r in lake.read("comments").collect()}
    assert c["c2"]["parent_comment_id"] == c["c1"]["comment_id"] and c["c1"]["parent_comment_id"] is None


def test_only_changed_texts_are_embedded_anew(spark, tmp_path, monkeypatch):
    import pytest

    from contentlake.operators import embeddings as E
    from contentlake.operators.pipeline import Lake, ingest
    provider, lake = E.HashingProvider(16), Lake(spark, str(tmp_path / "lake"))

    def run(**texts):
        rep = ingest(spark, lake, {"instagram": _raw(spark, [{"id": k, "caption": v, "ownerId": "u"} for k, v in texts.items()])}, {}, provider)
        assert not rep.errors
        ids = {r["post_id"]: r["platform_post_id"] for r in lake.read("posts").collect()}
        return rep.counters["embeddings_generated"], {ids[r["source_id"]]: list(r["vector"]) for r in lake.read("embeddings").collect()}

    def vector(text):
        return pytest.approx(provider.embed_texts([text])[0], abs=1e-6)

    assert run(a="one", b="two", c="three")[0] == 3
    n, got = run(a="one", b="two changed", c="  ", d="four")  # c has no text now; its vector stays
    assert n == 2 and got == {"a": vector("one"), "b": vector("two changed"), "c": vector("three"), "d": vector("four")}
    # An older text that comes back is a change; texts are compared after merging, also over compacted changes.
    lake.compact("posts")
    n, got = run(b="two", e="five")
    assert n == 2 and got["b"] == vector("two") and got["e"] == vector("five")
    assert run(a="one")[0] == 0
    # Texts of a run whose embeddings failed are embedded by the next one.
    with monkeypatch.context() as m:
        m.setattr(E, "embed", lambda *_: 1 / 0)
        assert ingest(spark, lake, {"instagram": _raw(spark, [{"id": "f", "caption": "six", "ownerId": "u"}])}, {}, provider).errors
    n, got = run(a="one")
    assert n == 1 and got["f"] == vector("six")
