"""Target-distribution importance resampling of documents by hashed word n-grams.

Byte translate and split: a 256-byte table lower-cases A-Z and blanks every separator of a text's UTF-8
bytes, ``bytes.split`` gives the words, and ``zlib.crc32`` extends a run by its next word from the run's
own checksum as the seed, so the three n-grams that begin at a word cost three short checksums. Features
fall into ``BUCKETS`` buckets; Counters add the buckets of a task, Spark adds the Counters.

Two passes over the texts, none of them shuffled: the first counts the buckets of the corpus and of the
target texts (at most ``BUCKETS`` rows a task, ``BUCKETS`` rows in all, whatever the input), the second
sums each document's gains. The draw orders documents by weight plus Gumbel noise of their id, which is
sampling without replacement in proportion to exp(weight); the order is cut into ranges of sampled
borders, so no task holds all documents.

Results: a null or empty text, or one without any letter or digit, has no feature and weight 0. Very long
texts go through in pieces of ``PIECE`` bytes that end at a word's end; runs reach across. Equal scores go
to the smaller id; repeated rows are drawn one by one, a null id counts as smallest and its noise is that of
the empty id. Without any document all results are empty; without target texts T and t are 0. New columns
are in one struct of a free name.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order_stats import statistics
from ..session import materialize
from .common import free_name

BUCKETS = 10_000
#: Bytes of a text that are split at once (a word is never cut).
PIECE = 1 << 20
#: Every byte: letters and digits stay, A-Z become a-z, what UTF-8 uses beyond ASCII stays, the rest is blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CRC = zlib.crc32


def runs(text: bytes | None, buckets: int = BUCKETS, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the runs of one to three words that end there) per piece of a text."""
    data = (text or b"").translate(TABLE)
    at, one, two = 0, None, None  # the checksums of the last word and of the last two words
    while at < len(data):
        end = len(data) if len(data) - at <= piece else data.find(b" ", at + piece)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        at = end
        if not words:
            continue
        # A run that goes on is extended by a blank and the next word.
        more = [b" " + w for w in words]
        single = list(map(_CRC, words))
        pairs = list(map(_CRC, more, chain([one], single))) if one is not None else list(map(_CRC, more[1:], single))
        before = pairs[:-1] if two is None else [two, *pairs[:-1]]
        triples = list(map(_CRC, more[len(more) - len(before):], before))
        one, two = single[-1], pairs[-1] if pairs else None
        found = np.fromiter(chain(single, pairs, triples), np.uint32, len(single) + len(pairs) + len(triples))
        yield len(words), found % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts."""

    def count(batches):
        import pyarrow as pa
        total: Counter = Counter()
        for b in batches:
            found = np.zeros(buckets, np.int64)
            for text in b.column(0):
                for _, at in runs(text.as_py(), buckets):
                    found += np.bincount(at, minlength=buckets)
            seen = np.flatnonzero(found)
            total.update(dict(zip(seen.tolist(), found[seen].tolist())))
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("binary")).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket from its counts (at most ``buckets`` rows each)."""
    s, t = ({r["bucket"]: r["n"] for r in x.collect()} for x in (corpus, target))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    return [math.floor(1000 * math.log((t.get(i, 0) + 1.0) * (all_s + buckets) / ((s.get(i, 0) + 1.0) * (all_t + buckets))))
            for i in range(buckets)]


def weigh(docs: DataFrame, gain: Sequence[int], columns: Sequence[str], text_col: str = "text") -> DataFrame:
    """``columns`` of the documents with ``n_words``, ``n_features`` and ``weight``; the text stays behind."""
    table = np.asarray(gain, np.int64)
    buckets = len(table)
    kept = docs.select(*columns)

    def score(batches):
        import pyarrow as pa
        for b in batches:
            got = np.zeros((3, b.num_rows), np.int64)
            for i, text in enumerate(b.column(b.num_columns - 1)):
                for n, at in runs(text.as_py(), buckets):
                    got[:, i] += n, len(at), table[at].sum()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, got)],
                                             schema=pa.schema([*list(b.schema)[:-1], *(pa.field(c, pa.int64()) for c in ("_w", "_f", "_g"))]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    rows = docs.select(*columns, F.col(text_col).cast("binary").alias("_text"))
    out = rows.mapInArrow(score, f"{fields}, `_w` long, `_f` long, `_g` long")
    return out.withColumnsRenamed({"_w": "n_words", "_f": "n_features", "_g": "weight"})


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text", columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, str]:
    """Every row of ``docs`` (its ``columns``, by default all) and the name of a new struct column:
    ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1 in the order of the draw; null where
    not drawn). Of the N documents with at least ``least_words`` words, floor(percent * N / 100) are drawn."""
    columns = list(docs.columns if columns is None else columns)
    v = free_name(docs, "draw")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets), buckets)
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = weigh(docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                 gain, [*names.values(), "id"])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    rows = materialize(rows.withColumn("score", (F.col("weight") + noise).cast("long")))
    fit = F.col("n_words") >= least_words
    drawn = rows.where(fit).count() * percent // 100
    at = statistics(rows.where(fit), [], [("score", False)], ["id", "n_features"], position="rank")
    ranked = at.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))) \
               .unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return ranked.select(*[F.col(n).alias(c) for c, n in names.items()], F.struct("n_words", "n_features", "weight", "score", "rank").alias(v)), v
