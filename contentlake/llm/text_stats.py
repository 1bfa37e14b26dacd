"""Per-document text statistics as Spark columns (no Python): shared by the quality operators.

Every statistic is defined for null and empty texts (all counts are 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, count_of, split_words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Counts that ``with_stats`` puts into its struct, in order.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
         "n_upper", "n_exclaim", "n_digits", "n_stops")


def _windows(words: Column, n: Column) -> Column:
    """64-bit hash of each window of five words, in order."""
    at = lambda i, j: F.get(words, i + F.lit(j))
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW),
                                           lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)])))


def _repeated_words(words: Column, n: Column) -> Column:
    """Words covered by windows that occur twice or more, compared by their words, not by hashes.

    Windows are sorted with their position, equal neighbours are kept and the covered lengths are
    added up from left to right."""
    rows = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(
        F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i"))))

    def covered(sorted_rows: Column) -> Column:
        twice = F.filter(sorted_rows, lambda x, i: (F.get(sorted_rows, i - 1)["w"] == x["w"])
                         | (F.get(sorted_rows, i + 1)["w"] == x["w"]))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(starts, F.struct(F.lit(0).alias("c"), F.lit(-WINDOW).alias("last")),
                           lambda a, p: F.struct((a["c"] + F.least(F.lit(WINDOW), p - a["last"])).alias("c"), p.alias("last")),
                           lambda a: a["c"])

    # An array of one element binds the sorted windows once for both of their uses.
    return F.element_at(F.transform(F.array(rows), covered), 1)


def with_stats(df: DataFrame, text: str, into: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a struct column ``into`` of the counts in ``STATS``.

    Windows are compared by a 64-bit hash first (equal windows have equal hashes, so a text whose
    hashes all differ has no repeat); only other texts take the exact comparison. Each step is its
    own projection, so that no array is built twice."""
    w, h, n, t = f"{into}_w", f"{into}_h", f"{into}_n", f"{into}_t"
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(w, split_words(F.col(t)))
    out = out.withColumn(n, F.size(w)).withColumn(h, _windows(F.col(w), F.size(w)))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(WORD))
    out = out.withColumn(f"{into}_l", lines)
    t_, w_ = F.col(t), F.col(w)
    stops = F.size(F.filter(w_, lambda x: x.isin(*stop_words))).cast("long") if stop_words else F.lit(0).cast("long")
    counts = F.struct(
        F.col(n).cast("long").alias("n_words"),
        F.length(F.array_join(w_, "")).cast("long").alias("word_chars"),
        count_of(t_, SYMBOLS).alias("n_symbols"),
        (F.size(f"{into}_l") - F.size(F.array_distinct(f"{into}_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated_words(w_, F.col(n)))
         .otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(f"{into}_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        count_of(t_, "A-Z").alias("n_upper"),
        count_of(t_, "!").alias("n_exclaim"),
        count_of(t_, "0-9").alias("n_digits"),
        stops.alias("n_stops"))
    # explode of one element: a boundary over which the optimizer copies neither filters nor projections,
    # which would otherwise compute the counts again for every place that uses them.
    return out.select(*df.columns, F.explode_outer(F.array(counts)).alias(into))
