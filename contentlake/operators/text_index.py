"""Keyword search by English stems and positions (R1): over texts, or over a positional inverted index.

A document's words are its tokens, numbered from 0; stop words keep their numbers but are not indexed. A
plain term matches a document that holds its stem, a phrase one where the stems of its words stand at the
distances they have in the phrase (stop words inside a phrase count for the distance only). Query syntax is
that of ``retrieval.parse_websearch``.

``search_texts`` reads the texts once and shuffles nothing: only tokens that begin like a stem of the query
are stemmed. ``write_index`` stores runs: a task collects the words of some documents and keeps one row per stem
with the documents that hold it and their sorted positions. Each task writes its runs by buckets of stems, without a
shuffle: a stem in a third of all documents is written by all tasks, and rows of a stem lie together in each file.
``entries`` gives one row per (stem, document). ``search_index`` reads the buckets of the query's stems only;
phrases are intersections of shifted position lists.

A null text holds no words and matches negated terms only. A query without terms finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..session import ship_package
from .retrieval import STOP_WORDS, WebQuery, _hit_cols, parse_websearch
from .stemmer import cached_stem, common_prefix, stem, stems_udf

BUCKETS = 64
#: Places of words that a task collects before it passes them on as a run.
PLACES = 1_000_000
KEY = ["source_type", "source_id"]


def _terms(q: WebQuery) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """Groups of (negated, [(stem, offset)]): the words of each term that are no stop words."""
    groups = []
    for g in q.groups:
        terms = [(t.negated, [(stem(w), i) for i, w in enumerate(t.words) if w not in STOP_WORDS]) for t in g]
        groups.append([(neg, ws) for neg, ws in terms if ws])
    return [g for g in groups if g]


def _shift(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(by))


def _places(both: Column, wanted: str) -> Column:
    return F.transform(F.filter(both, lambda x: x["s"] == wanted), lambda x: x["i"])


def _may_hold(held: dict[str, Column], negated: bool, words) -> Column:
    """Whether a term can match, from the stems alone (a negated phrase always can)."""
    every = reduce(lambda a, b: a & b, [held[s] for s, _ in words])
    return every if not negated else ~every if len(words) == 1 else F.lit(True)


def _predicate(groups, positions: dict[str, Column]) -> Column:
    """The query over each stem's position list (null: the document does not hold the stem)."""
    none = F.array().cast("array<int>")

    def holds(ws) -> Column:
        lists = [F.coalesce(positions[s], none) for s, _ in ws]
        if len(ws) == 1:
            return F.size(lists[0]) > 0
        shifted = [_shift(c, at) for c, (_, at) in zip(lists, ws)]
        return F.size(reduce(F.array_intersect, shifted)) > 0

    group = lambda g: reduce(lambda a, b: a & b, [~holds(ws) if neg else holds(ws) for neg, ws in g])
    return reduce(lambda a, b: a | b, [group(g) for g in groups])


def search_texts(docs: DataFrame, query: str, platform: str | None = None, limit: int = 20, text_col: str = "content") -> DataFrame:
    """Hits of a web-search query by stems, ordered by id; platform filter first; score 1.0."""
    ship_package(docs.sparkSession)
    groups = _terms(parse_websearch(query))
    d = docs if platform is None else docs.where(F.col("platform") == platform)
    if not groups:
        return d.limit(0).select(*_hit_cols(F.lit(1.0), "keyword", text_col))
    wanted = sorted({s for g in groups for _, ws in g for s, _ in ws})
    low = F.lower(F.col(text_col))
    needed = [[s for neg, ws in g if not neg for s, _ in ws] for g in groups]
    if all(needed):  # every group asks for some stem: its words' beginnings are somewhere in the text
        d = d.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [low.contains(common_prefix(s)) for s in ss]) for ss in needed]))
    # The words that begin like a stem of the query, each once: the only ones that are stemmed.
    begins = "|".join(sorted({common_prefix(s) for s in wanted}))
    cand = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{begins})[\p{{L}}\p{{N}}_]*"), F.lit(0)))
    d = d.withColumn("_held", stems_udf(F.coalesce(cand, F.array().cast("array<string>"))))
    held = {s: F.array_contains("_held", s) for s in wanted}
    d = d.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [_may_hold(held, neg, ws) for neg, ws in g]) for g in groups])).drop("_held")
    if any(len(ws) > 1 for g in groups for _, ws in g):
        # Phrases: the places of the words, in the documents that hold them all.
        numbered = F.transform(F.coalesce(fn.tokens(text_col), F.array().cast("array<string>")), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        d = d.withColumn("_cand", F.filter(numbered, lambda x: x["w"].rlike(f"^(?:{begins})")))
        d = d.withColumn("_stems", stems_udf(F.transform("_cand", lambda x: x["w"])))
        both = F.zip_with("_cand", "_stems", lambda c, s: F.struct(c["i"].alias("i"), s.alias("s")))
        d = d.where(_predicate(groups, {s: _places(both, s) for s in wanted})).drop("_cand", "_stems")
    hits = d.orderBy("source_id").limit(limit)
    return hits.select(*_hit_cols(F.lit(1.0), "keyword", text_col))


# ------------------------------------------------------------------------------------------- index
def stem_bucket(col, buckets: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """(stem, source_type, source_id, platform, positions): for each run and stem the documents that hold it,
    as lists of equal length."""
    ship_package(docs.sparkSession)
    stop = frozenset(STOP_WORDS)
    keys = [*KEY, "platform"]

    def index(batches):
        import numpy as np
        import pyarrow as pa

        codes: dict[str, int] = {}  # of the run's stems

        def code(word: str) -> int:
            return -1 if word in stop else codes.setdefault(cached_stem(word), len(codes))

        def packed(held):
            rows = [pa.concat_arrays([h[0][k] for h in held]) for k in range(len(keys))]
            at = np.cumsum([0] + [len(h[0][0]) for h in held])
            text = np.concatenate([h[1] + a for h, a in zip(held, at)])
            place, stem_ = (np.concatenate([h[i] for h in held]) for i in (2, 3))
            by = np.argsort(stem_, kind="stable")  # documents and positions are in order
            text, place, stem_ = text[by], place[by], stem_[by]
            new = np.concatenate(([True], stem_[1:] != stem_[:-1]))
            entry = np.flatnonzero(new | np.concatenate(([True], text[1:] != text[:-1])))
            first = np.flatnonzero(new[entry])
            ends = lambda starts, n: pa.array(np.append(starts, n), pa.int32())
            places = pa.ListArray.from_arrays(ends(entry, len(place)), pa.array(place, pa.int32()))
            take = pa.array(text[entry])
            words = pa.array(list(codes), pa.string()).take(pa.array(stem_[entry[first]]))
            lists = [pa.ListArray.from_arrays(ends(first, len(entry)), x) for x in (*(r.take(take) for r in rows), places)]
            return pa.RecordBatch.from_arrays([words, *lists], names=["stem", *keys, "positions"])

        held, n = [], 0
        for b in batches:
            words = b.column(len(keys))
            lengths = np.diff(words.offsets.to_numpy())
            each = words.flatten().dictionary_encode()  # each word of the batch is stemmed once
            stem_ = np.array([code(w) for w in each.dictionary.to_pylist()], np.int64)[each.indices.to_numpy()]
            text = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            kept = stem_ >= 0
            held.append(([b.column(i) for i in range(len(keys))], text[kept], place[kept], stem_[kept]))
            n += int(kept.sum())
            if n > PLACES:
                yield packed(held)
                held, n = [], 0
                codes.clear()
        if n:
            yield packed(held)

    rows = docs.select(*keys, F.coalesce(fn.tokens(text_col), F.array().cast("array<string>")).alias("words"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(index, f"stem string, {', '.join(f'{k} array<{types[k]}>' for k in keys)}, positions array<array<int>>")


def entries(index: DataFrame) -> DataFrame:
    """(stem, source_type, source_id, platform, positions) of an index: one row per stem that a document holds."""
    lists = [*KEY, "platform", "positions"]
    return index.select("stem", F.inline(F.arrays_zip(*lists))).toDF("stem", *lists)


def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS, text_col: str = "content") -> None:
    """Store the postings of ``docs``, partitioned by a hash bucket of the stem and sorted by stem inside."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")  # long texts travel in small batches
    rows = postings(docs, text_col).withColumn("bucket", stem_bucket("stem", buckets))
    # Each task writes its own runs: nothing is shuffled, and a bucket with a stem that a third of all documents
    # hold is written by all tasks.
    rows.sortWithinPartitions("bucket", "stem").write.mode("overwrite").partitionBy("bucket").parquet(path)


def matching(index: DataFrame, query: str, platform: str | None = None, buckets: int = BUCKETS) -> DataFrame | None:
    """(source_type, source_id) of the documents that match, from the postings alone; None where some group
    of the query has negated terms only, so that documents without any posting match too."""
    groups = _terms(parse_websearch(query))
    if any(all(neg for neg, _ in g) for g in groups):
        return None
    wanted = sorted({s for g in groups for _, ws in g for s, _ in ws})
    if not wanted:
        return entries(index).select(*KEY).limit(0)
    spark = index.sparkSession
    numbers = spark.createDataFrame([(s,) for s in wanted], "s string").select(stem_bucket("s", buckets)).distinct().collect()
    rows = entries(index.where(F.col("bucket").isin([r[0] for r in numbers]) & F.col("stem").isin(wanted)))  # at most one bucket per stem of the query
    rows = rows if platform is None else rows.where(F.col("platform") == platform)
    held = rows.groupBy(*KEY).agg(*[F.first(F.when(F.col("stem") == s, F.col("positions")), ignorenulls=True).alias(f"_p{i}")
                                    for i, s in enumerate(wanted)])
    return held.where(_predicate(groups, {s: F.col(f"_p{i}") for i, s in enumerate(wanted)})).select(*KEY)


def search_index(index: DataFrame, docs: DataFrame, query: str, platform: str | None = None, limit: int = 20,
                 buckets: int = BUCKETS) -> DataFrame:
    """R1 over an index of ``write_index``: equal to ``search_texts``. The postings give the matching
    documents and the first ``limit`` of them; texts are read for those alone."""
    found = matching(index, query, platform, buckets)
    if found is None:
        return search_texts(docs, query, platform, limit)
    top = found.orderBy("source_id", "source_type").limit(limit)
    hits = docs.join(F.broadcast(top), KEY, "left_semi")  # at most ``limit`` keys
    return hits.orderBy("source_id").limit(limit).select(*_hit_cols(F.lit(1.0), "keyword"))
