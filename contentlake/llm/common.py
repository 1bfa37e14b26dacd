"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

#: White space between words: space and the ASCII controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def begin(spark: SparkSession) -> None:
    """Session settings that bound a task's memory: long texts travel in small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def split_words(text: Column) -> Column:
    """Words of a text that has no nulls (runs without white space)."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the class ``chars`` (as between brackets in a pattern) a text holds."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
