"""Vector search for one or a few questions: exact cosine top-k (R2, J8). Many questions, and inverted
lists, are in ``vector_blocks``.

Scoring runs in Arrow batches with numpy (``mapInArrow``): each task keeps a
running top-k per query over all of its rows and emits at most ``k`` rows per
query, so the shuffle after scoring is ``k x partitions`` rows, not the table.
The query matrix is the only thing shipped to executors; its size is checked
and larger query sets are processed in chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

MAX_QUERY_BYTES = 64 * 1024 * 1024
#: Scores held at once by a task (64 MB): queries meet a batch of rows in blocks of this many cells.
SCORE_CELLS = 8 * 1024 * 1024


def _normalise(q: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q, axis=-1, keepdims=True)
    n[n == 0] = np.nan
    return q / n


def _topk_fn(queries: np.ndarray, qids: Sequence, k: int, key_cols: list[str], vec_col: str):
    """Per-task scorer for ``mapInArrow``: the vector column is flattened zero-copy into a
    rows x dims matrix; each query keeps its running top-k (all ties at the k-th score kept until
    the final keyed tie-break)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    qn = _normalise(queries)
    dims = queries.shape[1]

    def keep_top(cand: pd.DataFrame) -> pd.DataFrame:
        cand = cand.sort_values(["similarity"] + key_cols, ascending=[False] + [True] * len(key_cols),
                                na_position="last")
        return cand.head(k)

    def run(batches):
        best: list[pd.DataFrame | None] = [None] * len(qids)
        for b in batches:
            if b.num_rows == 0:
                continue
            col = b.column(b.schema.get_field_index(vec_col))
            ok = pc.fill_null(pc.equal(pc.list_value_length(col), dims), False)
            b2 = b.filter(ok)
            if b2.num_rows == 0:
                continue
            vals = b2.column(b2.schema.get_field_index(vec_col)).flatten()
            m = vals.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)
            norms = np.linalg.norm(m, axis=1)
            norms[norms == 0] = np.nan
            keys = b2.select(key_cols)
            step = max(1, SCORE_CELLS // len(m))
            for first in range(0, len(qids), step):
                sims = (m @ qn[first:first + step].T) / norms[:, None]
                for i in range(sims.shape[1]):
                    s, j = np.nan_to_num(sims[:, i], nan=-np.inf), first + i
                    if len(s) > k:
                        kth = np.partition(-s, k - 1)[k - 1]
                        idx = np.nonzero(s >= -kth)[0]
                    else:
                        idx = np.arange(len(s))
                    cand = keys.take(pa.array(idx)).to_pandas().assign(similarity=sims[idx, i])
                    best[j] = keep_top(cand if best[j] is None else pd.concat([best[j], cand], ignore_index=True))
        for j, q in enumerate(qids):
            if best[j] is not None and len(best[j]):
                out = best[j].assign(qid=np.int64(q))
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return run


def cosine_topk(df: DataFrame, vec_col: str, query: Sequence[float], k: int, key_cols: Sequence[str],
                where: Column | None = None) -> DataFrame:
    """Exact top-k by ``1 - cosine distance`` for one query vector (ties by key)."""
    out = batch_topk(df, vec_col, [(0, list(query))], k, key_cols, where, rank=False)
    return out.drop("qid").orderBy(F.col("similarity").desc(), *[F.col(c) for c in key_cols]).limit(k)


def batch_topk(df: DataFrame, vec_col: str, queries: Sequence[tuple], k: int, key_cols: Sequence[str],
               where: Column | None = None, rank: bool = True) -> DataFrame:
    """Top-k per query for many queries in one pass over the vectors (qid, keys..., similarity)."""
    key_cols = list(key_cols)
    src = df.where(where) if where is not None else df
    src = src.select(*key_cols, vec_col)
    if not queries:
        return None
    dims = len(queries[0][1])
    per_chunk = max(1, MAX_QUERY_BYTES // (8 * max(dims, 1)))
    schema = StructType([src.schema[c] for c in key_cols] + [StructField("similarity", DoubleType()),
                                                              StructField("qid", LongType())])
    parts = []
    for start in range(0, len(queries), per_chunk):
        chunk = queries[start:start + per_chunk]
        qm = np.asarray([q[1] for q in chunk], dtype=np.float64)
        fn = _topk_fn(qm, [int(q[0]) for q in chunk], k, key_cols, vec_col)
        parts.append(src.mapInArrow(fn, schema))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    if not rank:
        return scored  # at most k rows per query per task; the caller cuts globally
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), *[F.col(c) for c in key_cols])
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def query_vector(df: DataFrame, key: str, value, vec_col: str) -> list[float]:
    """Fetch one stored vector to use as a query (one bounded row)."""
    row = df.where(F.col(key) == F.lit(value)).select(vec_col).limit(1).collect()
    if not row:
        raise ValueError(f"no vector for {key}={value!r}")
    return [float(x) for x in row[0][0]]
