"""Language identification by compression (operator 2).

Each language has a raw-content zstandard dictionary made of its sampled text, lower-cased as every
text is. A text is cut into
pieces of ``PIECE`` bytes; each piece is compressed with every language's dictionary, and the sizes
are added up. The language with the smallest total wins; the score falls with the margin to the
next, and a text whose relative margin is below ``min_margin`` is rejected (``accepted`` false).

Defined results: null, empty and letterless texts get ``und``, score 0 and are not accepted. Ties go
to the language that sorts first. Without any learnable row every text is ``und``. Whole texts are
used, however long; a text is one value and its pieces are compressed one after another. Added
columns never replace a column of the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UND = "und"
#: Bytes compressed at once: small pieces keep the dictionary, not the text itself, the main context.
PIECE = 4096
#: Follows every piece: a run that always shrinks, so that no short piece is stored uncompressed.
PAD = b" " * 64
#: Matches of four bytes and more: words of a language share short stems and endings.
SEARCH = {"strategy": "greedy", "window_log": 20, "chain_log": 18, "hash_log": 17, "search_log": 4, "min_match": 4}


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order and one raw dictionary each."""
    langs: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def fit(train: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = 256, chars: int = 512,
        spans: int = 16384) -> LanguageModel:
    """Dictionaries of all languages, each from at most ``docs_per_lang`` spans of ``chars`` characters, and
    from fewer (one at least) where the languages would share more than ``spans`` (8 million characters):
    this is all that reaches the driver. Rows are taken in the order of a hash of their text, and each gives a span
    at a place that the hash decides; equal texts count once."""
    h = F.xxhash64(text)
    rows = train.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("l"), h.alias("h"),
        F.substring(F.col(text), (1 + F.pmod(F.shiftright(h, 8), F.greatest(F.length(text) - chars, F.lit(1)))).cast("int"),
                    F.lit(chars)).alias("t"))
    docs_per_lang = max(1, min(docs_per_lang, spans // max(1, rows.select("l").distinct().count())))
    # The least hashes of each language, first within sixteen parts of it: no task gets a whole language.
    part = Window.partitionBy("l", F.pmod("h", F.lit(16))).orderBy("h")
    rows = rows.dropDuplicates(["l", "h"]).withColumn("r", F.row_number().over(part)).where(F.col("r") <= docs_per_lang)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h")))
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in rows.where(F.col("r") <= docs_per_lang).select("l", "r", "t").collect():
        parts.setdefault(r["l"], []).append((r["r"], r["t"]))
    langs = tuple(sorted(parts))
    return LanguageModel(langs, tuple("\n".join(t for _, t in sorted(parts[k])).lower().encode() for k in langs))


def classify(model: LanguageModel, min_margin: float):
    """The Arrow function of one column of texts -> struct(lang, score, accepted)."""
    out = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
    state: list = []

    def compressors():
        if not state:  # once in each Python worker
            import zstandard as zstd
            for d in model.dictionaries:
                z = zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                params = zstd.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, write_checksum=False, **(
                    SEARCH | {"strategy": getattr(zstd, f"STRATEGY_{SEARCH['strategy'].upper()}")}))
                z.precompute_compress(compression_params=params)
                state.append(zstd.ZstdCompressor(compression_params=params, dict_data=z))
        return state

    def one(text: str | None):
        if not text or not model.langs or not any(map(str.isalpha, text)):
            return UND, 0.0, False
        raw = text.lower().encode()
        pieces = [raw[i:i + PIECE] + PAD for i in range(0, len(raw), PIECE)]
        sizes = [sum(len(z.compress(p)) for p in pieces) for z in compressors()]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        if len(order) == 1:
            return model.langs[order[0]], 1.0, True
        margin = (sizes[order[1]] - best) / sizes[order[1]]
        score = 1.0 / sum(math.exp(-60.0 * (x - best) / best) for x in sizes)
        return model.langs[order[0]], score, margin >= min_margin

    def apply(texts: pa.Array) -> pa.Array:
        lang, score, ok = zip(*(one(t.as_py()) for t in texts), strict=True) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())],
                                          fields=list(out))

    return apply


def predict(model: LanguageModel, text: Column, min_margin: float = 0.002) -> Column:
    """struct(lang, score, accepted) of each text."""
    def apply(texts: pa.Array) -> pa.Array:
        return run(texts)

    run = classify(model, min_margin)
    apply.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, "lang string, score double, accepted boolean")(text)


def filter_languages(docs: DataFrame, train: DataFrame, min_margin: float = 0.002) -> DataFrame:
    """The documents whose language is accepted, with their own columns."""
    verdict = predict(fit(train), F.col("text"), min_margin)
    return docs.where(verdict["accepted"])
