"""Fuzzy text (E7): a trigram index with a set-similarity join.

A text's trigrams are those of its padded words (``functions.trigrams``), each held as one number (three code
points of 21 bits); similarity is the Jaccard index of two texts' sets. The threshold is a fraction
``num / den``. No step looks at all pairs:

* every set is sorted by one order of all trigrams, the rarest first (counts of the whole table by ``BINS``
  hash bins, so their number does not grow); of the trigrams that two sets at the threshold share, the k-th
  is among the first ``n - ceil(t * n) + k`` of each (prefix filter),
* the smaller set has at least ``t`` times the trigrams of the larger (length filter), and what stands before
  and after a shared trigram in both bounds the overlap (position filter),
* what is left is verified by the sets themselves.

``lookup`` needs ``least`` shared trigrams among the prefixes (count filter). ``similar_pairs`` lists texts by
their first shared trigram; a list of more than ``longest`` texts is told apart by the next shared trigram
of each, and so on, so that lists stay short where many texts are made of few trigrams. Two bitmaps of 64
bits bound the difference of two sets before a candidate pair leaves its list.

Equal texts are one entry with a number of rows: a text that a third of all rows hold is compared once.

The index is three written tables: ``sets`` (id, text, n_rows, n, grams), ``counts`` (bin, c) and ``postings``
(gram, ids, ns, places): each task writes the postings of its texts in runs sorted by trigram, one row for all
texts of a run that hold it, so nothing but the texts is shuffled. Null texts and texts without a letter or
digit have no trigrams: they are not in the index and similar to nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..session import checkpoint_dir, ship_package

#: Shared trigrams that a candidate pair of a lookup needs among the prefixes (fewer where it needs fewer at all).
LEAST_LOOKUP = 4
#: Texts in a list of ``similar_pairs`` before it is told apart by a further trigram.
LONGEST = 512
#: A list is told apart only if it has more texts than this many times the further trigrams of one.
SPLIT = 16
#: Hash bins in which trigrams are counted.
BINS = 1 << 18
#: Postings that a task collects before it writes them as one run.
RUN = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class TrigramIndex:
    sets: DataFrame
    postings: DataFrame
    counts: DataFrame


def _ceil(a, b: int) -> Column:
    return F.expr(f"({a} + {b} - 1) div {b}")


def _hash(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams.astype(np.uint64) * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of an Arrow array of lists of numbers."""
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)


@F.arrow_udf(ArrayType(LongType()))
def _numbers(padded: pa.Array) -> pa.Array:
    """Ascending distinct trigrams of words that have three spaces around them."""
    out, ends = [], [0]
    for x in padded:
        u = np.frombuffer(x.as_py().encode("utf-32-le"), np.uint32).astype(np.int64)
        a, b, c = u[:-2], u[1:-1], u[2:]
        grams = np.unique((a << 42 | b << 21 | c)[(b != 32) | ((a == 32) & (c != 32))])
        out.append(grams)
        ends.append(ends[-1] + len(grams))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64()))


def _with_grams(texts: DataFrame) -> DataFrame:
    """Adds n and grams to rows with a text; those without a trigram go."""
    ship_package(texts.sparkSession)
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")  # long texts travel in small batches
    padded = F.concat(F.lit("   "), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "   "), F.lit("   "))
    return texts.withColumn("grams", _numbers(padded)).withColumn("n", F.size("grams").cast("long")).where("n > 0")


def _counted(sets: DataFrame) -> DataFrame:
    """(bin, c): how many sets hold a trigram of the bin, counted once for each such trigram."""
    def count(batches):
        c = np.zeros(BINS, np.int64)
        for b in batches:
            c += np.bincount(_hash(_flat(b.column(0))[1], 18), minlength=BINS)
        held = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(c[held])], names=["bin", "c"])

    return sets.select("grams").mapInArrow(count, "bin long, c long").groupBy("bin").agg(F.sum("c").alias("c"))


def _weights(counts: DataFrame) -> np.ndarray:
    """The counts by bin: at most ``BINS`` numbers, whatever the table's size."""
    out, rows = np.zeros(BINS, np.int64), counts.toPandas()
    out[rows["bin"].to_numpy(np.int64)] = rows["c"].to_numpy(np.int64)
    return out


def _order(lengths: np.ndarray, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Permutation that sorts each set of ``grams`` by the index's order, the rarest first."""
    return np.lexsort((grams, weights[_hash(grams, 18)], np.repeat(np.arange(len(lengths)), lengths)))


def _ranked(sets: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, n, grams, b0, b1): trigrams in the index's order, and bitmaps of 64 hash bits each."""
    def rank(batches):
        for b in batches:
            lists = b.column(2)
            lengths, grams = _flat(lists)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            grams = grams[_order(lengths, grams, weights)]
            bits = _hash(grams, 7)
            one = np.uint64(1) << (bits & 63).astype(np.uint64)
            maps = [np.bitwise_or.reduceat(np.where(bits >> 6 == k, one, np.uint64(0)), ends[:-1]).view(np.int64) for k in (0, 1)] if len(lists) else [[], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams)),
                                              *(pa.array(m, pa.int64()) for m in maps)], names=["id", "n", "grams", "b0", "b1"])

    return sets.select("id", "n", "grams").mapInArrow(rank, f"id {sets.schema['id'].dataType.simpleString()}, n long, grams array<long>, b0 long, b1 long")


def _postings(sets: DataFrame, weights: np.ndarray) -> DataFrame:
    """(gram, ids, ns, places): runs of the postings of some texts each, sorted by trigram."""
    def run(held):
        ids = pa.concat_arrays([h[0] for h in held])
        lengths, grams = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        texts, starts = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
        places = np.arange(len(grams)) - np.repeat(starts, lengths)
        grams = grams[_order(lengths, grams, weights)]
        by = np.argsort(grams, kind="stable")
        grams, texts = grams[by], texts[by]
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        at = pa.array(np.append(first, len(grams)), pa.int32())
        lists = [ids.take(pa.array(texts)), pa.array(lengths[texts], pa.int32()), pa.array(places[by], pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(grams[first]), *(pa.ListArray.from_arrays(at, x) for x in lists)], names=["gram", "ids", "ns", "places"])

    def index(batches):
        held, size = [], 0
        for b in batches:
            held.append((b.column(0), *_flat(b.column(1))))
            size += len(held[-1][2])
            if size >= RUN:
                yield run(held)
                held, size = [], 0
        if size:
            yield run(held)

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "grams").mapInArrow(index, f"gram long, ids array<{kind}>, ns array<int>, places array<int>")


def write_index(df: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Store the index of the distinct texts; the smallest id stands for rows with the same text."""
    spark = df.sparkSession
    texts = df.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")) \
              .agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n_rows"))
    _with_grams(texts).select("id", "text", "n_rows", "n", "grams").write.mode("overwrite").parquet(f"{path}/sets")
    sets = spark.read.parquet(f"{path}/sets")
    _counted(sets).write.mode("overwrite").parquet(f"{path}/counts")
    _postings(sets, _weights(spark.read.parquet(f"{path}/counts"))).write.mode("overwrite").parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str) -> TrigramIndex:
    return TrigramIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("sets", "postings", "counts")))


def _prefix(postings: DataFrame, num: int, den: int, least: int) -> DataFrame:
    """(gram, id, n, pos) of the first trigrams of each set."""
    rows = postings.select("gram", F.inline(F.arrays_zip("ids", "ns", "places"))).toDF("gram", "id", "n", "pos")
    return rows.where(F.col("pos") < F.col("n") - _ceil(f"n * {num}", den) + least)


def _need(num: int, den: int) -> Column:
    return _ceil(f"(n + n2) * {num}", num + den)


def _sizes_fit(num: int, den: int) -> Column:
    return F.least("n", "n2") * den >= F.greatest("n", "n2") * num


def _candidates(a: DataFrame, b: DataFrame, num: int, den: int, least: int) -> DataFrame:
    """(id, id2) of rows (gram, id, n, pos) and (gram, id2, n2, pos2) that pass the filters."""
    need = _need(num, den)
    rest = F.least("pos", "pos2") + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    j = a.join(b, "gram").where(_sizes_fit(num, den) & (rest >= need))
    shared = j.groupBy("id", "id2", "n", "n2").agg(F.count(F.lit(1)).alias("c"))
    return shared.where(F.col("c") >= F.least(F.lit(least), need)).select("id", "id2")


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    r = right.withColumnsRenamed({c: f"{c}2" for c in right.columns})
    j = pairs.join(left, "id").join(r, "id2")
    both = F.size(F.array_intersect("grams", "grams2"))
    j = j.withColumn("_both", both).withColumn("_all", F.col("n") + F.col("n2") - F.col("_both"))
    return j.where(F.col("_both") * den >= F.col("_all") * num).withColumn("similarity", F.col("_both") / F.col("_all")) \
            .drop("_both", "_all", "grams", "grams2")


def _lists(index: TrigramIndex, num: int, den: int, longest: int) -> DataFrame:
    """(sig, id, n, pos, d): each text in lists by the first d trigrams that it shares with another, pos being the
    place of the last of them. A long list is told apart by the next trigram where that at least halves the pairs
    to compare; texts that are all alike stay in one list."""
    spark = index.sets.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/lists-{uuid.uuid4().hex[:12]}"

    def stored(df: DataFrame, name: str) -> DataFrame:  # its size is known when it is joined
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    grams, least, d, kept = _ranked(index.sets, _weights(index.counts)).select("id", "grams"), _ceil(f"n * {num}", den), 1, []
    rows = stored(_prefix(index.postings, num, den, 1).select(F.col("gram").alias("sig"), "id", "n", "pos"), "1")
    while True:
        # Trigrams by which a row may go on: the next shared one is among them, if there is one.
        rows = rows.withColumn("more", F.greatest(F.lit(0), F.least(F.col("n"), F.col("n") - least + d + 1) - F.col("pos") - 1))
        long = stored(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.sum("more").alias("m"))
                      .where((F.col("c") > longest) & (F.col("c") * F.col("c") > SPLIT * F.col("m"))).select("sig", "c"), f"{d}-long")
        nexts = rows.join(long, "sig", "left_semi").join(grams, "id").select(
            F.col("sig").alias("up"), "id", "n", "pos", F.posexplode(F.expr("slice(grams, cast(pos + 2 as int), cast(more as int))")).alias("i", "gram"))
        nexts = stored(nexts.select("up", F.xxhash64("up", "gram").alias("sig"), "id", "n", (F.col("pos") + F.col("i") + 1).alias("pos")), f"{d + 1}")
        pairs = nexts.groupBy("up", "sig").agg(F.count(F.lit(1)).alias("k")).groupBy("up").agg(F.sum(F.col("k") * F.col("k")).alias("s"))
        apart = stored(long.join(pairs, F.col("sig") == F.col("up")).where("2 * s < c * c").select("sig"), f"{d}-apart")
        found = apart.take(1)
        # Two sets that need no more than d shared trigrams may share no other: those rows stay in their list, too.
        stay = rows.join(apart, "sig", "left_semi").where(least <= d) if found else None
        kept += [x.drop("more").withColumn("d", F.lit(d)) for x in (rows.join(apart, "sig", "left_anti"), stay) if x is not None]
        if not found:
            return reduce(DataFrame.unionByName, kept)
        rows, d = nexts.join(apart.withColumnRenamed("sig", "up"), "up", "left_semi").drop("up"), d + 1


def similar_pairs(index: TrigramIndex, num: int, den: int, longest: int = LONGEST) -> DataFrame:
    """All pairs of different texts of the index at ``num / den``, each once (id < id2), with both texts, how
    many rows hold each (n_rows, n_rows2) and their similarity."""
    rows = _lists(index, num, den, longest).join(_ranked(index.sets, _weights(index.counts)).select("id", "b0", "b1"), "id")
    r = rows.withColumnsRenamed({c: f"{c}2" for c in ("id", "n", "pos", "b0", "b1")})
    need = _need(num, den)
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) - 1 + F.col("d")
    apart = sum(F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"b{k}2"))) for k in (0, 1))
    j = rows.join(r, ["sig", "d"]).where((F.col("id") < F.col("id2")) & _sizes_fit(num, den) & (rest >= need)
                                         & (apart <= F.col("n") + F.col("n2") - 2 * need))
    return _verified(j.select("id", "id2").distinct(), index.sets, index.sets, num, den)


def lookup(index: TrigramIndex, questions: DataFrame, num: int, den: int, id_col: str, text_col: str, least: int = LEAST_LOOKUP) -> DataFrame:
    """Per question (id_col, text_col; ids are keys) the texts of the index at ``num / den``: question as id2,
    text2, n2."""
    asked = _with_grams(questions.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")) \
        .select("id", "n", "grams", "text")
    q = _ranked(asked, _weights(index.counts)).select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.posexplode("grams").alias("pos2", "gram"))
    q = q.where(F.col("pos2") < F.col("n2") - _ceil(f"n2 * {num}", den) + least)
    # Texts that are too short or too long for every question stay where they are.
    least_n, most_n = asked.agg(F.min("n"), F.max("n")).first()
    fits = (F.col("n") * den >= F.lit(least_n) * num) & (F.col("n") * num <= F.lit(most_n) * den)
    return _verified(_candidates(_prefix(index.postings, num, den, least).where(fits), q, num, den, least), index.sets.where(fits), asked, num, den)
