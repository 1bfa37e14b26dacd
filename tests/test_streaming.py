"""Streaming jobs on a small events file: dedup across replays, closed windows only."""

import datetime as dt

from contentlake.streaming import jobs as S


def _events(spark, path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i * 5), i % 3, ["click", "view"][i % 2], float(i)) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double") \
         .coalesce(1).write.mode("overwrite").parquet(path)


def test_dedup_and_windows(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    _events(spark, str(folder / "events.parquet"))
    path = str(folder / "events.parquet")
    d = S.dedup_stream(spark, path)
    assert d.count() == 40 and d.select("event_id").distinct().count() == 40   # replayed copy dropped
    w = S.windowed_counts(spark, path, "1 day")
    rows = {(r["window_start"], r["event_type"]): r["n"] for r in w.collect()}
    # events span 2024-01-01 .. 2024-01-09 03:00; with a 1 hour delay the last day's window stays open
    last_day = dt.datetime(2024, 1, 9)
    assert all(k[0] < last_day for k in rows) and sum(rows.values()) == sum(1 for i in range(40)
                                                                             if i * 5 < 8 * 24)
