"""Dashboard aggregates kept up to date by signed partial aggregates.

A ``Rollup`` belongs to a keyed table that receives batches of upserts. Each batch adds one set of
signed partial sums: the new image of every changed row counts plus one, the image it replaces minus
one, so an update moves a row from its old groups to its new ones and a soft delete only takes it
away. Reading adds up the partial sums of all runs; the rows themselves are not read again. Sums are
mergeable in any order, so nothing depends on the order in which runs are read.

Every run writes two immutable folders, ``images/run=<r>`` (key, version, groups and measures of the
changed rows, no texts) and ``deltas/run=<r>`` (one row per touched group). A run reads only the images
of smaller runs, so a repeated run replaces its own folders with the same rows. A batch shuffles its own rows
and the stored images of its keys; of the other images only key and version are scanned and joined.

Defined results: of a key's rows in one batch the one with the greatest version counts (a null
version is the least; among equal ones the greatest image). A row that is not newer than the stored one
changes nothing. Rows with a null key are left out. A row whose ``live`` is false or null
is in no group, one without groups is only remembered. Null measures count as 0. An empty
batch writes empty folders; without any run the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rollup:
    """``cells``: array of structs, the groups of a row (each once); ``measures``: name -> long column to be
    summed; ``live``: whether the row counts."""

    def __init__(self, spark: SparkSession, path: str, key: str, version: str, cells: Column, measures: dict[str, Column],
                 live: Column, count: str = "n_rows"):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version
        self.cells, self.measures, self.live, self.count = cells, measures, live, count
        self.runs: list[int] = []

    def _image(self, batch: DataFrame) -> DataFrame:
        """``key, version, image`` of the batch, one row a key."""
        measures = F.struct(*(F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in self.measures.items()))
        cells = F.array_distinct(F.when(self.live, self.cells))  # null: the row counts nowhere
        rows = batch.where(F.col(self.key).isNotNull()).select(
            F.col(self.key).alias("key"), F.struct(F.col(self.version).cast("long").alias("version"), cells.alias("cells"),
                                                   measures.alias("measures")).alias("image"))
        return rows.groupBy("key").agg(F.max("image").alias("image"))

    def _stored(self, before: int) -> DataFrame | None:
        """``key, old``: the newest stored image of every key."""
        paths = [f"{self.path}/images/run={r}" for r in self.runs if r < before]
        if not paths:
            return None
        return self.spark.read.parquet(*paths).groupBy("key").agg(F.max("image").alias("old"))

    def apply(self, batch: DataFrame, run: int) -> None:
        """Add one batch as run ``run`` (greater than every run before, or a repeated last one)."""
        if self.runs and run < self.runs[-1]:
            raise ValueError(f"run {run} comes after run {self.runs[-1]}")
        new, stored = self._image(batch), self._stored(run)
        if stored is None:
            changed = new.withColumn("old", F.lit(None).cast(new.schema["image"].dataType))
        else:
            changed = new.join(stored, "key", "left")
            at, was = F.col("image.version"), F.col("old.version")
            changed = changed.where(F.col("old").isNull() | (at > was) | (at.isNotNull() & was.isNull()))
        images, deltas = f"{self.path}/images/run={run}", f"{self.path}/deltas/run={run}"
        changed.select("key", "image", "old").write.mode("overwrite").parquet(images)
        both = F.array(F.struct(F.lit(1).alias("sign"), F.col("image").alias("of")), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("of")))
        signed = self.spark.read.parquet(images).select(F.explode(both).alias("x")).select("x.sign", "x.of.measures", F.explode("x.of.cells").alias("cell"))
        sums = [F.sum("sign").cast("long").alias(self.count)]
        sums += [F.sum(F.col("sign") * F.col(f"measures.{n}")).cast("long").alias(n) for n in self.measures]
        moved = signed.groupBy("cell").agg(*sums)
        some = F.greatest(*(F.abs(F.col(n)) for n in [self.count, *self.measures])) > 0
        moved.where(some).write.mode("overwrite").parquet(deltas)
        if run not in self.runs:
            self.runs.append(run)

    def read(self, run: int | None = None) -> DataFrame | None:
        """One row per group that has rows (as of ``run``): the fields of the group, count and measures."""
        paths = [f"{self.path}/deltas/run={r}" for r in self.runs if run is None or r <= run]
        if not paths:
            return None
        names = [self.count, *self.measures]
        found = self.spark.read.parquet(*paths).groupBy("cell").agg(*(F.sum(n).alias(n) for n in names))
        return found.where(F.col(self.count) != 0).select("cell.*", *names)


def dashboard_cells(platform: str = "platform", day: str = "day", tags: str = "tags") -> Column:
    """The dashboard's groups of a post: its platform, its platform's day, and its platform's tags."""
    def cell(grain: str, d: Column, tag: Column) -> Column:
        return F.struct(F.lit(grain).alias("grain"), F.col(platform).alias("platform"), d.cast("string").alias("day"), tag.cast("string").alias("tag"))

    no = F.lit(None)
    own = F.array(cell("platform", no, no), cell("day", F.col(day), no))
    return F.concat(own, F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: cell("tag", no, t)))
