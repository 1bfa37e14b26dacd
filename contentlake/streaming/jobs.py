"""Structured Streaming jobs.

Sources are file streams (Parquet tables or JSON-lines landing folders); every
query keeps its checkpoint and output under the shared ``spark.checkpoint.dir``,
runs with ``availableNow`` and writes to a file sink, so a lost executor or a
restarted driver resumes from the checkpoint instead of recomputing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def event_stream(spark: SparkSession, path: str, replays: int = 1) -> DataFrame:
    """Events as a stream (``ts`` cast to TIMESTAMP for watermarks); ``replays`` > 1 unions the
    source with itself to model re-delivered files."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    is_dir = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hpath).isDirectory()
    folder, _, name = path.rstrip("/").rpartition("/")

    def one():
        # A file stream source watches a folder: a table folder is watched as is; a single file is
        # watched through its parent folder with a glob that keeps it to this file.
        reader = spark.readStream.schema(schema)
        src = reader.parquet(path) if is_dir else reader.option("pathGlobFilter", name).parquet(folder)
        return src.withColumn("ts", F.col("ts").cast("timestamp"))

    out = one()
    for _ in range(replays - 1):
        out = out.unionByName(one())
    return out


def run_to_parquet(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame to completion (availableNow) into Parquet; return the sink as a batch frame."""
    spark = df.sparkSession
    d = _run_dir(spark, name)
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{d}/_checkpoint")
         .option("path", f"{d}/out").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{d}/out")


def dedup_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Replayed events dropped within the watermark (first copy kept)."""
    s = event_stream(spark, path, replays=2)
    out = s.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return run_to_parquet(out.select("event_id", "user_id", "event_type", "ts"), "dedup")


def windowed_counts(spark: SparkSession, path: str, duration: str, slide: str | None = None,
                    delay: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) event-time windows per event type; late data beyond ``delay`` is dropped,
    windows are emitted once the watermark passes their end (append mode)."""
    s = event_stream(spark, path).withWatermark("ts", delay)
    w = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    agg = s.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n",
                     "total")
    return run_to_parquet(out, "windows")


def _parquet_files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, [st for st in fs.listStatus(path) if st.getPath().getName().endswith(".parquet")]


def late_data_counts(spark: SparkSession, path: str, duration: str = "1 day", delay: str = "1 hour",
                     late_shift: str = "5 days") -> DataFrame:
    """T3 with late data. Three landings, one micro-batch each: (1) the events; (2) copies of the
    newest event, whose window stays open (never emitted) -- this batch carries the watermark that
    the late-row filter uses next; (3) every tenth event replayed ``late_shift`` in the past. Spark
    drops rows older than the previous batch's watermark, so landing 3 is dropped and the output
    equals the on-time result."""
    d = _run_dir(spark, "late")
    events = spark.read.parquet(path)
    landing = f"{d}/landing"
    events.write.mode("append").parquet(landing)
    fs, first = _parquet_files(spark, landing)
    seen = {st.getPath().toString() for st in first}
    k = len(seen)
    newest = max(st.getModificationTime() for st in first)
    last_ts = events.agg(F.max("ts")).collect()[0][0]
    tick = (events.where(F.col("ts") == F.lit(last_ts)).limit(1)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(k)))).drop("_copy").repartition(k))
    late = events.where(F.col("event_id") % 10 == 0).withColumn("ts", F.col("ts") - F.expr(f"interval {late_shift}"))
    # The file source orders files by modification time: stamp each landing strictly after the last.
    for step, df in enumerate((tick, late), start=1):
        df.write.mode("append").parquet(landing)
        _, now = _parquet_files(spark, landing)
        for st in now:
            if st.getPath().toString() not in seen:
                fs.setTimes(st.getPath(), newest + step * 60_000, -1)
                seen.add(st.getPath().toString())
    on_time_files = k
    # One micro-batch per landing: the first holds every on-time file, the second the late replays.
    s = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", on_time_files)
         .parquet(f"{d}/landing").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay))
    agg = s.groupBy(F.window("ts", duration).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"),
                                                                          F.sum("value").alias("total"))
    out = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n",
                     "total")
    return run_to_parquet(out, "late-windows")


def session_counts(spark: SparkSession, path: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Per-user session windows (a gap of ``gap`` closes a session)."""
    s = event_stream(spark, path).withWatermark("ts", delay)
    agg = s.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    out = agg.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
    return run_to_parquet(out, "sessions")


def ingest_stream(spark: SparkSession, landing: str, normalize, keys: list[str], state_dir: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """Landing JSON-lines files -> per micro-batch split off bad items, normalize, de-duplicate (last in
    scrape order wins) and upsert into a lake table (the batch is added as one change). Each applied
    batch id is recorded in the lake's run log; a replayed batch id is skipped (idempotent).
    ``files_per_batch`` bounds a micro-batch (default: everything that has landed)."""
    from ..operators.identity import dedupe_last_wins
    from ..operators.pipeline import Lake
    from ..sources.raw import objects_only, scrape_order, with_variant

    d = state_dir or _run_dir(spark, "ingest")
    lake = Lake(spark, f"{d}/lake")
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(landing).select("value", "_metadata")

    def process(batch: DataFrame, batch_id: int) -> None:
        run = batch_id + 1
        if lake._next_run() > run:
            return  # already applied: replay after a restart
        lake.run_id = run
        raw = with_variant(scrape_order(batch).select(F.col("value").alias("raw"), "item_seq")
                           .withColumn("platform", F.lit(None).cast("string"))
                           .withColumn("mode", F.lit("posts")).withColumn("target", F.lit(None).cast("string")))
        good, bad = objects_only(raw)
        lake.quarantine(bad)
        fresh = dedupe_last_wins(normalize(good), keys).drop("first_seq")
        if "item_seq" in fresh.columns:
            fresh = fresh.withColumn("item_seq", F.col("item_seq").cast("string"))  # its order is settled
        lake.upsert("snapshot", fresh, keys, id_col=keys[-1])
        lake.end_run()

    q = (stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{d}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return lake.read("snapshot")
