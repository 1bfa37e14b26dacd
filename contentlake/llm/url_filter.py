"""URL filter as a sort-merge range join (operator 1).

A rule is a host with a path prefix; it fits the host and its subdomains. The canonical key of a host
and path is the host's labels in reverse order, each followed by a dot, then the path, so that a
rule's prefix is one interval of keys. A url has one key for each suffix of its host (as the rule's
host may be any of them). Keys and rules are dealt to ranges of the key order, sorted inside a range
and swept once: a stack holds the rules whose interval contains the current key, each nested in the
one below, and the top of the stack is the longest rule of that host suffix that fits. Of the hits
of a url's suffixes the longest rule wins (host and path characters together; then the longer host,
then the rule that sorts first).

Only distinct (host, path) pairs are swept, so that a url that many rows share is judged once; the
verdicts are joined back by host and path, and urls without a host take no part in that join. A rule
is copied only to the ranges its interval touches. Range borders come from a sample of keys: they
decide the balance, never the result.

Defined results: a url that is null or has no ``://`` has an empty host and path and gets the
default verdict. A host suffix is compared label by label. Rows repeat as given; rules that
repeat count once, and of an allow and a block for the same prefix the block wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, free_name, n_tasks

#: Sampled keys per range: 64 keys of a sorted sample stand for one range.
SAMPLE_PER_RANGE = 64
MAX_CHAR = "\U0010ffff"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written, both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def reversed_key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."), path)


def _borders(keys: DataFrame, ranges: int) -> list[str]:
    """Border keys from a sample of at most about ``2 * ranges * SAMPLE_PER_RANGE`` keys."""
    n = keys.count()
    every = max(1, n // (ranges * SAMPLE_PER_RANGE))
    some = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64("key", F.lit("border")), F.lit(every)) == 0).select("key").collect())
    step = max(1, len(some) // ranges)
    return sorted(set(some[step::step]))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches sorted by (range, key, rules first) -> the longest rule of every key that has one."""
    stack: list[tuple[str, dict]] = []
    at = None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["range"] != at:
                at, stack = r["range"], []
            while stack and not r["key"].startswith(stack[-1][0]):
                stack.pop()  # its interval has ended
            if r["rule_host"] is not None:
                stack.append((r["key"], r))
            elif stack:
                top = stack[-1][1]
                out.append({"host": r["host"], "path": r["path"]} | {c: top[c] for c in ("rule_host", "rule_path", "verdict")})
        yield pa.RecordBatch.from_pylist(out, schema=SWEPT)


SWEPT = pa.schema([(c, pa.string()) for c in ("host", "path", "rule_host", "rule_path", "verdict")])


def match(urls: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """``host, path, rule_host, rule_path, verdict`` for the (host, path) pairs of ``urls`` that a
    rule (``host, path, verdict``) fits."""
    spark = urls.sparkSession
    ranges = ranges or 8 * n_tasks(spark)
    rules = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).groupBy(
        "host", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict",
                         reversed_key(F.col("host"), F.col("path")).alias("key"))
    pairs = urls.where(F.col("host") != "").select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                   lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keys = pairs.select("host", "path", suffix.alias("suffix"))
    keys = keys.select("host", "path", reversed_key(F.col("suffix"), F.col("path")).alias("key"))
    borders = _borders(keys, ranges)

    @F.arrow_udf("int")
    def range_of(key: pa.Array) -> pa.Array:
        return pa.array([bisect_right(borders, k) for k in key.to_pylist()], pa.int32())

    keys = keys.select("host", "path", "key", *[F.lit(None).cast("string").alias(c) for c in ("rule_host", "rule_path", "verdict")],
                       range_of("key").alias("range"))
    spread = rules.select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", "rule_host",
                          "rule_path", "verdict", range_of("key").alias("first"), range_of(F.concat("key", F.lit(MAX_CHAR))).alias("last"))
    spread = spread.select("host", "path", "key", "rule_host", "rule_path", "verdict",
                           F.explode(F.sequence("first", "last")).alias("range"))
    rows = keys.unionByName(spread).repartition(n_tasks(spark), "range").sortWithinPartitions(
        "range", "key", F.col("rule_host").isNull())
    hits = rows.mapInArrow(_sweep, "host string, path string, rule_host string, rule_path string, verdict string")
    best = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"),
                    "rule_host", "rule_path", "verdict")
    return hits.groupBy("host", "path").agg(F.max(best).alias("b")).select("host", "path", "b.rule_host", "b.rule_path", "b.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> tuple[DataFrame, str]:
    """``pages`` with one more struct column (its name is returned): ``host, path, rule, verdict``."""
    name = free_name(pages, "judged")
    host, path = host_path(F.col(url))
    rows = pages.withColumn(f"{name}_h", host).withColumn(f"{name}_p", path)
    found = match(rows.select(F.col(f"{name}_h").alias("host"), F.col(f"{name}_p").alias("path")), rules, ranges)
    found = found.select(F.col("host").alias(f"{name}_k"), F.col("path").alias(f"{name}_q"),
                         F.concat("rule_host", "rule_path").alias(f"{name}_r"), F.col("verdict").alias(f"{name}_v"))
    rows = rows.join(found, (F.nullif(F.col(f"{name}_h"), F.lit("")) == F.col(f"{name}_k")) & (F.col(f"{name}_p") == F.col(f"{name}_q")), "left")
    return rows.select(*pages.columns, F.struct(F.col(f"{name}_h").alias("host"), F.col(f"{name}_p").alias("path"),
                                                F.col(f"{name}_r").alias("rule"),
                                                F.coalesce(f"{name}_v", F.lit(default)).alias("verdict")).alias(name)), name
