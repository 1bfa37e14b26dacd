"""Exact top-k by inner product with a bit-sliced index (operator 8).

Every component x becomes floor(scale * x). Rows are dealt to blocks; a block keeps, for each
dimension, its values above the block's minimum as bit slices: slice j of a dimension is a bitmap of
the rows whose value has bit j. The ``DROP`` lowest slices are left out of the sums (quantisation).

For a query, the slices are added with bitmap arithmetic: slice j of dimension d enters with weight
2^(j+i) for every bit i of the query's component (of the complemented slice for a negative one), and
full adders turn three bitmaps of one weight into one of that weight and one carry of the next. The
sums, themselves bit slices, are searched from the most significant slice downward for the k-th
largest sum; rows within the quantisation error of it are the boundary, and their scores are
computed exactly. Each block yields at most k rows per query, and the k best of all blocks remain.

The rows of a block and a run of query blocks meet in one task, sorted so that the rows come first: the
index of a block is built once for ``passes`` query blocks, which then stream past it in batches.

The slices hold components below 2^20 in size. A row with a larger one is kept beside them: it is a
boundary row of every query, and its score is computed exactly, in limbs of 20 bits. So is every score
of a query with such a component.

Defined results: a vector that is null, empty or holds a null or non-finite component (before or after
scaling) takes no part; nor does a row without an id. Vectors are compared only with vectors of the same
length. Rows that repeat (id and vector) are stored once with their number, and each of them
counts as a candidate; rows with the query's own id are no candidates. Query rows that share an id are one query,
whose pairs are ranked together. Ties go to the smaller id. A score beyond 64 bits is given as the
nearest long, but ranked by its exact value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lowest slices left to the exact step.
DROP = 2
#: Sizes of components from here on are not sliced; a limb has as many bits.
LIMB = 20
LIMIT = 1 << LIMB
LONG = 1 << 63


def usable(vector: Column, scale: int) -> Column:
    """Whether the vector takes part."""
    scaled = lambda x: F.abs(x.cast("double")) * F.lit(float(scale))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (scaled(x) < F.lit(float("inf")))), F.lit(False))


def limbs(v: np.ndarray) -> list[np.ndarray]:
    """Whole-numbered doubles as limbs of ``LIMB`` bits, lowest first; the last one has the sign."""
    out = []
    while np.abs(v).max(initial=0) >= LIMIT:
        high = np.floor(v / LIMIT)  # exact, as LIMIT is a power of two
        out.append((v - high * LIMIT).astype(np.int64))
        v = high
    return [*out, v.astype(np.int64)]


def dots(rows: list[np.ndarray], query: list[np.ndarray]) -> list[int]:
    """Inner products of every row with the query, each given in limbs, as Python integers."""
    total = np.zeros(len(rows[0]), dtype=object)
    for i, a in enumerate(rows):
        for j, b in enumerate(query):
            total += (a @ b).astype(object) << LIMB * (i + j)
    return total.tolist()


def beyond(score: int) -> bytes:
    """Orders scores that are given as the same longest long: empty within 64 bits."""
    if -LONG < score < LONG - 1:
        return b""
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    key = len(size).to_bytes(2, "big") + size
    return key if score > 0 else bytes(255 - x for x in key)


def _slices(x: np.ndarray) -> np.ndarray:
    """Bit slices (bits, dims, bytes) of non-negative values (rows, dims)."""
    bits = max(1, int(x.max(initial=0)).bit_length())
    return np.stack([np.packbits(((x >> j) & 1).astype(np.uint8), axis=0).T for j in range(bits)])


def _add(bins: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps by weight -> bit slices of the sums, lowest first. Full adders work on all
    triples of one weight at once; a last pair goes through a half adder."""
    out, w = [], 0
    while bins:
        todo = bins.pop(w, [])
        maps = np.concatenate(todo) if todo else np.zeros((0, 0), np.uint8)
        carries = []
        while len(maps) > 1:
            if len(maps) == 2:
                a, b = maps[0:1], maps[1:2]
                carries.append(a & b)
                maps = a ^ b
                continue
            m = len(maps) // 3
            a, b, c = maps[:m], maps[m:2 * m], maps[2 * m:3 * m]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            maps = np.concatenate([ab ^ c, maps[3 * m:]])
        out.append(maps[0] if len(maps) else None)
        if carries:
            bins.setdefault(w + 1, []).extend(carries)
        w += 1
    return out


def _ones(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _at_least(sums: list[np.ndarray | None], least: int, everything: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose sum is ``least`` or more, from the most significant slice down."""
    if least <= 0:
        return everything
    if least >> len(sums):
        return np.zeros_like(everything)
    above, same = np.zeros_like(everything), everything
    for j in reversed(range(len(sums))):
        s = sums[j] if sums[j] is not None else np.zeros_like(everything)
        if least >> j & 1:
            same = same & s
        else:
            above = above | (same & s)
            same = same & ~s
    return above | same


def _kth(sums: list[np.ndarray | None], k: int, rows: np.ndarray) -> int:
    """The k-th largest sum among ``rows`` (the smallest if there are fewer), from the top slice down."""
    value, left, k = 0, rows, min(k, _ones(rows))
    for j in reversed(range(len(sums))):
        if sums[j] is None:
            continue
        high = left & sums[j]
        n = _ones(high)
        if n >= k:
            value, left = value | 1 << j, high
        else:
            k, left = k - n, left & ~sums[j]
    return value


class Block:
    """The index of one block: bit slices of the rows within range, limbs of the others."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, v: np.ndarray):
        wide = (np.abs(v) >= LIMIT).any(axis=1)
        self.v, self.ids, self.copies, self.x = v, ids[~wide], copies[~wide], v[~wide].astype(np.int64)
        self.every_id, self.every_copies = ids, copies
        self.wide_ids, self.wide_copies, self.wide = ids[wide], copies[wide], limbs(v[wide]) if wide.any() else []
        self.slices = _slices(self.x - self.x.min(axis=0))[DROP:] if len(self.x) else None
        self.everything = np.packbits(np.ones(len(self.x), np.uint8))

    def boundary(self, q_id: int, q: np.ndarray, k: int) -> np.ndarray:
        """Positions of the sliced rows that may be among the k best."""
        own = np.packbits((self.ids != q_id).astype(np.uint8)) & self.everything
        if not own.any():
            return np.zeros(0, np.int64)
        bins: dict[int, list[np.ndarray]] = {}
        for sign in (1, -1):
            size = np.maximum(q * sign, 0)
            for i in range(int(size.max()).bit_length()):
                on = np.flatnonzero(size >> i & 1)
                if len(on):
                    for j in range(len(self.slices)):
                        s = self.slices[j][on]
                        bins.setdefault(i + j, []).append(s if sign == 1 else ~s)
        sums = _add(bins) if bins else []
        # A left-out part is between 0 and 2^DROP - 1 in each dimension: the sums are off by less than this.
        error = (int(np.abs(q).sum()) * ((1 << DROP) - 1) >> DROP) + 1
        rows = _at_least(sums, _kth(sums, k, own) - error, self.everything) & own
        return np.flatnonzero(np.unpackbits(rows, count=len(self.x)))

    def search(self, q_id: int, q: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """Ids and exact scores of the query's k best rows, copies included."""
        if (np.abs(q) >= LIMIT).any():
            found = zip(self.every_id.tolist(), dots(limbs(self.v), limbs(q)), self.every_copies.tolist(), strict=True)
        else:
            whole = q.astype(np.int64)
            at = self.boundary(q_id, whole, k) if len(self.x) else np.zeros(0, np.int64)
            score = self.x[at] @ whole
            at = at[best := np.lexsort((self.ids[at], -score))[:k]]
            found = list(zip(self.ids[at].tolist(), score[best].tolist(), self.copies[at].tolist(), strict=True))
            if self.wide:
                found += zip(self.wide_ids.tolist(), dots(self.wide, [whole]), self.wide_copies.tolist(), strict=True)
        ids, scores = [], []
        for score, i, n in sorted((-score, i, n) for i, score, n in found if i != q_id):
            n = min(n, k - len(ids))
            ids += [i] * n
            scores += [-score] * n
            if len(ids) == k:
                break
        return ids, scores


OUT = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])
KEY = ("dims", "block", "pass")


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) * float(scale))


def _search(k: int, scale: int):
    """Arrow function over partitions sorted by ``KEY`` and ``is_query``: a block's rows, then its queries."""
    def answers(block: Block, part: pa.RecordBatch) -> pa.RecordBatch:
        q = _matrix(part.column("v"), scale)
        out: tuple[list, list, list] = [], [], []
        for n, q_id in enumerate(part.column("id").to_pylist()):
            ids, scores = block.search(q_id, q[n], k)
            for column, values in zip(out, ([q_id] * len(ids), ids, scores), strict=True):
                column += values
        score = [max(-LONG, min(LONG - 1, x)) for x in out[2]]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(score, pa.int64()),
                                           pa.array(map(beyond, out[2]), pa.binary())], schema=OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*KEY, "is_query")])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)] if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                now = tuple(part.column(c)[0].as_py() for c in KEY)
                if now != key:
                    key, held, block = now, [], None
                if not part.column("is_query")[0].as_py():
                    held.append(part)
                elif held or block:
                    if block is None:
                        block = Block(*(np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in held]) for c in ("id", "copies")),
                                      np.concatenate([_matrix(p.column("v"), scale) for p in held]))
                        held = []
                    yield answers(block, part)

    return run


def topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, scale: int = 1024, block: int = 16384,
         query_block: int = 512, passes: int = 16) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the k best rows of every query. ``block`` bounds the rows that a
    task holds; they are copied once for every ``passes * query_block`` queries."""
    def prepared(df: DataFrame) -> DataFrame:
        kind = df.schema[vector].dataType.elementType.simpleString()
        v = F.col(vector) if kind in ("float", "double") else F.col(vector).cast("array<double>")
        v = df.where(F.col(id_col).isNotNull() & usable(v, scale)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        return v.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn("dims", F.size("v"))

    # The numbers of blocks follow from the tables' lengths; a hash deals rows to them evenly.
    n_rows, n_passes = (max(1, -(-df.count() // size)) for df, size in ((rows, block), (queries, passes * query_block)))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = prepared(rows).withColumn("is_query", F.lit(False)).withColumn("block", deal(n_rows)).withColumn("pass", every(n_passes))
    # A query given in n rows has each of its pairs n times.
    q = prepared(queries).withColumn("copies", F.explode(F.array_repeat("copies", F.least("copies", F.lit(k)).cast("int"))))
    q = q.withColumn("is_query", F.lit(True)).withColumn("pass", deal(n_passes)).withColumn("block", every(n_rows))
    both = x.unionByName(q).repartition(*KEY).sortWithinPartitions(*KEY, "is_query")
    found = both.mapInArrow(_search(k, scale), "query_id long, id long, score long, beyond binary")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
