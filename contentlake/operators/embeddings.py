"""Checksum-guarded embeddings.

Only new or changed texts reach the provider (anti-join on key + checksum).
The provider is an iterator pandas UDF over Arrow batches; the default offline
provider is signed feature hashing with L2 normalisation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .. import functions as fn
from .merge import upsert


def post_text() -> Column:
    return fn.embeddable_text("caption", "content")


def comment_text() -> Column:
    return fn.py_strip("content")


def embeddable_items(posts: DataFrame, comments: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """(source_type, source_id, platform, text) from posts (caption else content), comments and
    transcripts; blank texts dropped."""
    p = posts.select(F.lit("post").alias("source_type"), F.col("post_id").cast("string").alias("source_id"), "platform",
                     post_text().alias("text"))
    c = comments.select(F.lit("comment").alias("source_type"), F.col("comment_id").cast("string").alias("source_id"),
                        "platform", comment_text().alias("text"))
    out = p.unionByName(c)
    if transcripts is not None:
        out = out.unionByName(transcripts.select(F.lit("transcript").alias("source_type"),
                                                 F.col("source_id").cast("string").alias("source_id"), "platform",
                                                 fn.py_strip("transcript").alias("text")))
    return out.where(F.col("text").isNotNull() & (F.col("text") != ""))


def pending(items: DataFrame, existing: DataFrame | None, model: str) -> DataFrame:
    """Items whose (source_type, source_id, model) has no embedding, or whose checksum changed. Items may bring
    their checksum instead of their text. Without embeddings (None) all are new."""
    it = items if "checksum" in items.columns else items.withColumn("checksum", fn.checksum("text"))
    if existing is None:
        return it.withColumn("reason", F.lit("new"))
    cur = existing.where(F.col("model") == model).select("source_type", "source_id",
                                                         F.col("checksum").alias("_old"))
    j = it.join(cur, ["source_type", "source_id"], "left")
    return j.where(~F.col("_old").eqNullSafe(F.col("checksum"))) \
            .withColumn("reason", F.when(F.col("_old").isNull(), "new").otherwise("changed")).drop("_old")


class _Slots(dict):
    """Token (UTF-8) -> its bucket, plus ``dimensions`` where the sign is -. Keeps up to ``KEPT`` tokens of up to
    ``LONGEST`` bytes. A key that is no ASCII token may hold several: their slots go to ``rest``."""

    KEPT, LONGEST = 1 << 18, 64

    def __init__(self, dimensions: int):
        import regex
        super().__init__()
        self.dimensions, self.rest = dimensions, []
        self.words = regex.compile(r"[\p{L}\p{N}_]+")

    def __missing__(self, token: bytes) -> int:
        if not token.isascii():
            text = token.decode()
            words = self.words.findall(text)
            if words != [text]:
                self.rest += [self[w.encode()] for w in words]
                return 2 * self.dimensions
        h = hashlib.md5(token).hexdigest()
        slot = int(h[1:9], 16) % self.dimensions + (self.dimensions if int(h[0], 16) % 2 else 0)
        if len(token) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[token] = slot
        return slot


#: Bytes that are no part of an ASCII token become blanks; those of other characters stay.
_BLANKED = bytes(i if i >= 128 or chr(i).isalnum() or i == ord("_") else 32 for i in range(256))


class HashingProvider:
    """X1 default provider: signed feature hashing of word tokens, L2-normalised (offline, deterministic).

    Each lower-case word token (letters, digits, underscore) adds +1 or -1 to one bucket: with
    ``h = md5(token)`` in hex, the bucket is ``int(h[1:9], 16) % dimensions`` and the sign is + when
    ``int(h[0], 16)`` is even."""

    def __init__(self, dimensions: int = 64, model_name: str = "hashing-v1"):
        self.dimensions = dimensions
        self.model_name = model_name

    def _vectors(self, texts: list[str], slots: _Slots) -> np.ndarray:
        """One row a text."""
        d = self.dimensions
        out = np.zeros((len(texts), d))
        for i, t in enumerate(texts):
            parts = (t or "").lower().encode("utf-8").translate(_BLANKED).split()
            slots.rest = []
            found = list(map(slots.__getitem__, parts))
            if found:
                n = np.bincount(found + slots.rest, minlength=2 * d + 1)
                out[i] = n[:d] - n[d:2 * d]
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        return self._vectors(texts, _Slots(self.dimensions)).tolist()

    def udf(self):
        provider = self

        @F.pandas_udf(ArrayType(FloatType()))
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            slots = _Slots(provider.dimensions)  # words recur from batch to batch
            for s in batches:
                yield pd.Series(list(provider._vectors(s.tolist(), slots).astype(np.float32)))

        return embed


def embed(items: DataFrame, provider) -> DataFrame:
    """Vectors for the pending items, with model and dimensions recorded."""
    from ..session import ship_package
    ship_package(items.sparkSession)  # the provider's UDF runs in executor Python workers
    return items.withColumn("vector", provider.udf()(F.col("text"))) \
                .withColumn("model", F.lit(provider.model_name)) \
                .withColumn("dimensions", F.lit(provider.dimensions))


def dim_check(vectors: DataFrame, dims: int, col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """E5: a vector's length must equal the declared dimensions (empty allowed); others quarantined."""
    ok = F.size(col).isin(0, dims)
    return vectors.where(ok), vectors.where(~ok).withColumn("reason", F.lit("dimension_mismatch"))


def upsert_documents_and_embeddings(docs_current: DataFrame, docs_batch: DataFrame, emb_current: DataFrame,
                                    emb_batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents upserted on (source_type, source_id); embeddings upserted on
    (source_id, source_type, model) pointing at the persisted document id."""
    docs = upsert(docs_current, docs_batch, ["source_type", "source_id"], id_col="document_id")
    ids = docs.select("source_type", "source_id", F.col("document_id").alias("_doc"))
    eb = emb_batch.join(ids, ["source_type", "source_id"], "left") \
                  .withColumn("document_id", F.col("_doc")).drop("_doc")
    emb = upsert(emb_current, eb, ["source_id", "source_type", "model"], id_col="embedding_id")
    return docs, emb


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of padded word trigram sets."""
    ta, tb = fn.trigrams(a), fn.trigrams(b)
    inter = F.size(F.array_intersect(ta, tb))
    union = F.size(F.array_union(ta, tb))
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
