"""Signed partial sums equal the aggregates of the last rows, after every batch."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contentlake.operators.rollup import Rollup, dashboard_cells

SCHEMA = "id long, platform string, day string, tags array<string>, deleted boolean, likes long, version long, cells string"


def make(spark, path):
    return Rollup(spark, str(path), "id", "version", dashboard_cells(), {"likes": F.col("likes")}, ~F.col("deleted"), "n")


def plain(rows):
    n, likes = Counter(), Counter()
    for _, platform, day, tags, deleted, x, _, _ in rows:
        if deleted is False:
            for cell in {("platform", platform, None, None), ("day", platform, day, None)} | {("tag", platform, None, t) for t in tags or []}:
                n[cell] += 1
                likes[cell] += x or 0
    return {c: (n[c], likes[c]) for c in n}


def got(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[:4]: r[4:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_the_last_rows_after_each_batch(spark, tmp_path):
    r, kept, last, after = random.Random(4), make(spark, tmp_path), {}, {}
    for run in range(1, 5):
        batch = []
        for i in r.sample(range(300), 300 if run == 1 else 40):
            # A third of all rows is in one group; versions may be stale or null, and rows repeat.
            row = (i, r.choice(["hot", "hot", "x", None]), r.choice(["d1", "d2", None]), r.choice([None, [], ["a"], ["a", "b", "a"], ["c", None]]),
                   r.choice([False, False, True, None]), r.choice([None, 1, 5]), r.choice([run * 10, run * 10, run * 10 - 15, None]), "own")
            batch += [row] * r.choice([1, 2])
            if i not in last or (row[6] is not None and (last[i][6] is None or row[6] > last[i][6])):
                last[i] = row
        batch.append((None, "x", "d1", ["a"], False, 1, run, "a null key"))
        df = spark.createDataFrame(batch, SCHEMA).repartition(3)
        kept.apply(df, run)
        after[run] = plain(last.values())
        assert got(kept.read()) == after[run]
        moved = spark.read.parquet(f"{tmp_path}/images/run={run}").count()
        assert moved <= len({x[0] for x in batch})
    kept.apply(df, 4)  # a repeated run changes nothing
    assert got(kept.read()) == after[4] and got(kept.read(2)) == after[2]
    with pytest.raises(ValueError):
        kept.apply(df, 3)


def test_empty_batches_and_the_greatest_version_of_a_batch(spark, tmp_path):
    kept = make(spark, tmp_path)
    assert kept.read() is None
    kept.apply(spark.createDataFrame([], SCHEMA), 1)
    assert kept.read().collect() == []
    rows = [(1, "x", "d", ["a"], False, 1, 1, ""), (1, "y", "d", ["b"], False, 2, 2, ""), (1, "z", "d", ["c"], False, 3, None, "")]
    kept.apply(spark.createDataFrame(rows, SCHEMA), 2)
    assert got(kept.read()) == plain(rows[1:2])
    kept.apply(spark.createDataFrame([(1, "y", "d", ["b"], True, 9, 3, "")], SCHEMA), 3)
    assert kept.read().collect() == []
