"""License scan by diagonal voting (operator 3).

Templates are word sequences. Spark joins the rolling hashes of all word pairs of all texts to the
template positions of the same pairs; a hit votes for the diagonal ``text position - template
position``. Votes are added up per (document, template, diagonal); for long templates, diagonals that
lie next to each other and overlap (a word inserted or left out) are merged; a merged run is a span
when it covers enough of the template. Hits are verified by their words before they vote, so that
equal hashes alone never count.

Documents are keyed by content (id, 64-bit hash and length of the text), never by a row number:
a lost task may be computed again in another order. Rows that repeat are counted and given back as
often as they came. Null and empty texts have no words. A text with one word has no pair and no hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What stands between words of a lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases that must be found, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Opening or identifying lines of public licence texts, with the labels of this operator.
LINES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("released under the mit license", "mit-notice"),
    ("licensed under the apache license version 2 0", "apache-notice"),
    ("you may not use this file except in compliance with the license", "apache-text"),
    ("this work is licensed under the gnu general public license version 3", "gpl-notice"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution", "cc-notice"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Neighbouring diagonals of long templates that still belong together, and the share to be covered.
NEAR, COVER = 2, 0.8
#: A template's hits are kept as bits of one long.
MAX_WORDS = 63
KEY = ("id", "h", "chars")


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is a base phrase, words)."""
    return [(i, label, i < len(PHRASES), text.split()) for i, (text, label) in enumerate(PHRASES + LINES)]


def pairs_table(spark: SparkSession, rows: list[tuple[int, str, bool, list[str]]]) -> DataFrame:
    """One row per word pair of every template: its size is fixed by the list of templates. A long
    template's pair also names a third word beside it, so that common pairs seldom vote."""
    out = []
    for number, label, base, w in rows:
        if not 2 <= len(w) <= MAX_WORDS:
            raise ValueError(f"a template has 2 to {MAX_WORDS} words: {label}")
        for i in range(len(w) - 1):
            beside = None if base or len(w) < 3 else 2 if i + 2 < len(w) else -1
            out.append((number, label, base, len(w), i, w[i], w[i + 1], beside, None if beside is None else w[i + beside]))
    df = spark.createDataFrame(out, "template int, label string, base boolean, n_template int, at int, a string, b string, "
                                    "beside int, third string")
    return df.withColumn("pair", F.xxhash64("a", "b"))


def _words(text: Column) -> Column:
    """Lower-cased words. The Kelvin sign is the one character that ``lower`` would turn into A-Z."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138"))), SEPARATORS), "")


def votes(docs: DataFrame, id_col: str, text: str, rows: list[tuple[int, str, bool, list[str]]]) -> DataFrame:
    """One row per (document, template, diagonal) with the template positions that were hit as bits,
    and one row per document whose template is null, with the word count and the number of copies."""
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select("id", F.xxhash64("t").alias("h"), F.length("t").alias("chars"), _words(F.col("t")).alias("w"))
    n = F.size("w")
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2),
                                       lambda i: F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1))))
    none = F.array().cast("array<bigint>")
    # Besides its pairs a document has one row without a pair: it brings the word count.
    t = t.select(*KEY, "w", n.alias("n_words"), F.concat(F.coalesce(pairs, none), F.array(F.lit(None).cast("long"))).alias("p"))
    # The array is never empty; "outer" keeps the optimizer from testing its size on a copy of all the above.
    grams = t.select(*KEY, "w", "n_words", F.posexplode_outer("p").alias("pos", "pair"))
    joined = grams.join(F.broadcast(pairs_table(docs.sparkSession, rows)), "pair", "left")
    word = lambda i: F.get(F.col("w"), F.col("pos") + i)
    hit = (word(0) == F.col("a")) & (word(1) == F.col("b")) & (
        F.col("beside").isNull() | (F.get(F.col("w"), F.greatest(F.col("pos") + F.col("beside"), F.lit(0))) == F.col("third")))
    return joined.where(F.col("pair").isNull() | hit).groupBy(
        *KEY, "template", "label", "base", "n_template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, coalesce(at, 0))")).alias("bits"),
        F.count_if(F.col("pair").isNull()).alias("copies"), F.max("n_words").alias("n_words"))


def spans(voted: DataFrame) -> DataFrame:
    """Merged and verified spans (``first`` and ``last`` word, ``cover``) beside the documents' own rows."""
    w = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(w) > NEAR)
    runs = voted.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("long")).over(w))
    low = F.col("diagonal") + F.length(F.substring_index(F.reverse(F.bin("bits")), "1", 1))
    high = F.col("diagonal") + F.length(F.bin("bits"))
    merged = runs.groupBy(*KEY, "template", "label", "base", "n_template", "run").agg(
        F.bit_or("bits").alias("bits"), F.min(low).alias("first"), F.max(high).alias("last"),
        F.max("copies").alias("copies"), F.max("n_words").alias("n_words"))
    merged = merged.withColumn("cover", F.bit_count("bits") / (F.col("n_template") - 1))
    return merged.where(F.col("template").isNull() | (F.col("cover") >= F.when(F.col("base"), 1.0).otherwise(COVER)))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
         rows: list[tuple[int, str, bool, list[str]]] | None = None) -> DataFrame:
    """One row per document: its id and ``n_words, n_base, first_word, last_word, base_labels, labels,
    score`` (the best cover of a template) and ``spans`` (label, first and last word)."""
    found = spans(votes(docs, id_col, text, templates() if rows is None else rows))
    named = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    base = F.col("base")
    out = found.groupBy(*KEY).agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"),
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        named(F.when(base, F.col("label"))).alias("base_labels"), named(F.col("label")).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("template").isNotNull(), F.struct("first", "last", "label")))).alias("spans"))
    return out.select(F.col("id").alias(id_col), *[c for c in out.columns if c not in (*KEY, "copies")],
                      F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
