"""Packed vector search against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlake.operators import vector_blocks as VB


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 16))
    m = np.concatenate([centres[i % 8] + 0.2 * r.normal(size=16) if i % 3 else centres[0] + 0.2 * r.normal(size=16) for i in range(600)]).reshape(600, 16)
    rows = [(i, f"k{i % 7}", m[i].tolist()) for i in range(600)] + [(600, "k", None), (601, "k", [0.0] * 16), (602, "k", [1.0, 2.0]), (5, "k5", m[5].tolist())]
    return m, spark.createDataFrame(rows, "id long, kind string, v array<double>").repartition(5)


def plain(m, q, k):
    u, w = m / np.linalg.norm(m, axis=1, keepdims=True), q / np.linalg.norm(q)
    s = u @ w
    ids = list(range(len(m))) + [5]
    return [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(float(s[ids[j]]), 12), f"k{ids[j] % 7}", ids[j]))[:k]]


def asked(spark, m):
    return spark.createDataFrame([(f"q{i}", m[i].tolist()) for i in range(0, 60, 7)] + [("short", [1.0]), ("null", None), ("zero", [0.0] * 16)], "name string, q array<double>")


def answers(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: (x["qid"], x["rank"])):
        out.setdefault(x["qid"], []).append(x["id"])
    return out


def test_exact_topk_equals_numpy(spark, table):
    m, df = table
    got = answers(VB.exact_topk(df, "v", ["kind", "id"], asked(spark, m), "name", "q", 9))
    assert got == {f"q{i}": plain(m, m[i], 9) for i in range(0, 60, 7)}


def test_lists_reach_their_recall_and_take_new_batches(spark, table, tmp_path):
    m, df = table
    qs = asked(spark, m)
    exact = VB.exact_topk(df, "v", ["kind", "id"], qs, "name", "q", 9).cache()
    dims = df.where(F.size("v") == 16)
    centres = VB.train(dims, "v", 8)
    VB.write_lists(VB.assign(df.where("id % 4 > 0"), "v", centres), str(tmp_path / "l"), "v", ["kind", "id"])
    VB.write_lists(VB.assign(df.where("id % 4 = 0"), "v", centres), str(tmp_path / "l"), "v", ["kind", "id"], mode="append")
    lists = spark.read.parquet(str(tmp_path / "l"))
    assert lists.select(F.sum(F.size("keys"))).first()[0] == 601
    every = VB.lists_topk(lists, centres, ["kind", "id"], qs, "name", "q", 9, len(centres))
    assert answers(every) == answers(exact)
    probes, reached = VB.calibrate(lists, centres, ["kind", "id"], qs, "name", "q", 9, 0.9, exact)
    assert probes < 8 and reached >= 0.9
    found = VB.lists_topk(lists, centres, ["kind", "id"], qs, "name", "q", 9, probes)
    assert VB.recall(found, exact, ["kind", "id"]).agg(F.avg("recall")).first()[0] == pytest.approx(reached)


def test_without_vectors_or_questions(spark, table):
    m, df = table
    none = df.where("id < 0")
    assert VB.exact_topk(none, "v", ["id"], asked(spark, m), "name", "q", 3).collect() == []
    assert VB.exact_topk(df, "v", ["id"], asked(spark, m).where("false"), "name", "q", 3).collect() == []
