"""The trigram join against all pairs on small tables."""

import random
import re

import pytest

from contentlake.operators import trigrams as TG


def grams(text):
    out = set()
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        p = f"  {w} "
        out |= {p[i:i + 3] for i in range(len(p) - 2)}
    return out


def near(a, b, num, den):
    both = len(a & b)
    return both > 0 and both * den >= len(a | b) * num


@pytest.fixture(scope="module")
def names(spark):
    r = random.Random(4)
    parts = ["anna", "Anna", "ann", "bob", "bobby", "smith", "smyth", "é", "x", "42", "4242"]
    rows = [(i, r.choice(["", "@"]) + "".join(r.choice(parts) + r.choice(["", "_", " "]) for _ in range(r.randrange(1, 4)))) for i in range(150)]
    return rows + [(200 + i, "the same name") for i in range(40)] + [(300, None), (301, ""), (302, "!!"), (303, "a"), (304, "A."), (305, "a" * 5000)]


@pytest.mark.parametrize("num, den, least", [(3, 4, 3), (1, 2, 1), (3, 10, 5), (1, 1, 2)])
def test_pairs_and_lookups_equal_all_pairs(spark, names, tmp_path, num, den, least):
    df = spark.createDataFrame(names, "id long, name string").repartition(3)
    path = str(tmp_path / "t")
    TG.write_index(df, path, "id", "name")
    index = TG.open_index(spark, path)
    texts = {}
    for i, t in names:
        if t is not None:
            texts.setdefault(t, []).append(i)
    sets = {min(ids): (t, grams(t), len(ids)) for t, ids in texts.items()}
    want = {(a, b, sets[a][2], sets[b][2]) for a in sets for b in sets if a < b and near(sets[a][1], sets[b][1], num, den)}
    got = TG.similar_pairs(index, num, den, least).collect()
    assert len(got) == len(want) and {(x["id"], x["id2"], x["n_rows"], x["n_rows2"]) for x in got} == want
    for x in got[:50]:
        a, b = sets[x["id"]][1], sets[x["id2"]][1]
        assert x["similarity"] == pytest.approx(len(a & b) / len(a | b))
    asked = [(1, "anna smith"), (2, "qqq zzz"), (3, None), (4, ""), (5, "the same name"), (6, "a")]
    got = TG.lookup(index, spark.createDataFrame(asked, "q long, t string"), num, den, "q", "t", least).collect()
    want = {(q, a) for q, t in asked for a in sets if near(grams(t), sets[a][1], num, den)}
    assert len(got) == len(want) and {(x["id2"], x["id"]) for x in got} == want


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "e")
    TG.write_index(spark.createDataFrame([], "id long, name string"), path, "id", "name")
    assert TG.similar_pairs(TG.open_index(spark, path), 1, 2).collect() == []


def test_postings_are_runs_and_lookup_finds_from_them(spark, tmp_path):
    r = random.Random(7)
    words = ["red", "green", "blue", "İz", "ñandú", "77", "ab", "x"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for i in range(500)]
    path = str(tmp_path / "r")
    TG.write_index(spark.createDataFrame(rows, "id long, name string").repartition(2), path, "id", "name")
    index = TG.open_index(spark, path)
    # One row for all texts of a run that hold a trigram, not one for each trigram of each text.
    n = {x["id"]: x["n"] for x in index.sets.collect()}
    held = index.postings.collect()
    assert sum(len(x["ids"]) for x in held) == sum(n.values()) > 10 * len(held)
    places = sorted((i, p) for x in held for i, p in zip(x["ids"], x["places"]))
    assert places == sorted((i, p) for i in n for p in range(n[i]))
    texts = {x["id"]: x["text"] for x in index.sets.collect()}
    asked = [(1, "red ñandú 77"), (2, "green"), (3, "x x blue ab")]
    got = {(x["id2"], x["id"]) for x in TG.lookup(index, spark.createDataFrame(asked, "q long, t string"), 2, 5, "q", "t").collect()}
    assert got == {(q, i) for q, t in asked for i in texts if near(grams(t), grams(texts[i]), 2, 5)}


def test_long_lists_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TG, "SPLIT", 1)  # small lists, too
    r = random.Random(3)
    rows = list(enumerate(sorted({"Customer#" + "".join(r.choice("012") for _ in range(11)) for _ in range(1000)})))
    path = str(tmp_path / "l")
    TG.write_index(spark.createDataFrame(rows, "id long, name string").repartition(2), path, "id", "name")
    index = TG.open_index(spark, path)
    plain = TG._prefix(index.postings, 3, 4, 1).groupBy("gram").count().selectExpr("sum(count * count)").first()[0]
    lists = TG._lists(index, 3, 4, 10).groupBy("sig", "d").count().selectExpr("sum(count * count)").first()[0]
    assert lists < plain
    sets = [grams(t) for _, t in rows]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if near(sets[a], sets[b], 3, 4)}
    got = TG.similar_pairs(index, 3, 4, 10).select("id", "id2").collect()
    assert len(got) == len(want) > 100 and {(x["id"], x["id2"]) for x in got} == want
