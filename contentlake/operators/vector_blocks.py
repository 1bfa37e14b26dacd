"""Many vector questions in one job (R3, R7): packed blocks, inverted lists, measured recall.

Vectors travel as packed rows: up to ``BLOCK`` vectors of one list with their keys, the numbers as one binary.
Questions are rows like any other, packed the same way: nothing is collected, no matrix sits in a closure, and
there is no bound on how many questions come. A packed question row meets a packed vector row in one matrix
product, whose best ``k`` per question go on; Spark cuts them to the best ``k`` of all.

* ``exact_topk``: every question against every vector. Question rows are copied to every part of the vectors
  (as many parts as the shuffle has), vectors move once.
* ``train`` fits list centres on a bounded sample (``SAMPLE_PER_LIST`` vectors a list), ``assign`` gives every
  vector of the table, and any later batch, its nearest list by matrix products without training again.
* ``write_lists`` stores packed rows, dealt out by ranges of (list, key): a list that holds a third of all vectors
  is many rows in many files.
* ``lists_topk``: each question is joined to the packed rows of its ``probes`` nearest lists.
* ``recall`` compares any answer with the exact one, per question; ``calibrate`` finds the smallest number of
  probes that reaches a target on a stated set of questions.

Vectors that are null, of other length than the centres, or zero have no direction: they are in no list, are
found by no question and find nothing. Ties go to the smaller key. Repeated keys are entries of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, ship_package

BLOCK = 512
SAMPLE_PER_LIST = 256


def _length(col: str):
    return F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _usable(df: DataFrame, col: str, dims: int | None) -> DataFrame:
    ok = _length(col) > 0
    return df.where(ok if dims is None else ok & (F.size(col) == dims))


def pack(df: DataFrame, vec_col: str, keys: Sequence[str], list_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """(list_id, dims, keys, m): packed rows of unit vectors. With ``list_col`` the rows are expected to lie
    together by list; a task packs what it has of each list and keeps one open row per list."""
    keys = list(keys)
    src = _usable(df, vec_col, None)
    src = src.select(*keys, (F.col(list_col) if list_col else F.lit(0)).cast("int").alias("list_id"), F.size(vec_col).alias("dims"),
                     F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    n_keys = len(keys)

    def run(batches):
        import pyarrow as pa
        open_: dict[tuple, list] = {}

        def row(name, parts):
            ks = pa.concat_arrays([p[0] for p in parts])
            m = np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int32()), pa.array([name[1]], pa.int32()),
                                               pa.ListArray.from_arrays(pa.array([0, len(ks)], pa.int32()), ks), pa.array([m.tobytes()], pa.binary())],
                                              names=["list_id", "dims", "keys", "m"])

        for b in batches:
            if not b.num_rows:
                continue
            ks = pa.StructArray.from_arrays([b.column(i) for i in range(n_keys)], names=keys)
            lists, dims = (b.column(i).to_numpy(zero_copy_only=False) for i in (n_keys, n_keys + 1))
            vecs, ends = b.column(n_keys + 2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
            for name in sorted(set(zip(lists.tolist(), dims.tolist()))):
                at = np.flatnonzero((lists == name[0]) & (dims == name[1]))
                m = vecs[(ends[at][:, None] + np.arange(name[1])).ravel()].reshape(len(at), name[1])
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                for lo in range(0, len(at), block):
                    parts = open_.setdefault(name, [])
                    parts.append((ks.take(pa.array(at[lo:lo + block])), m[lo:lo + block]))
                    if sum(len(p[1]) for p in parts) >= block:
                        yield row(name, open_.pop(name))
        for name, parts in open_.items():
            yield row(name, parts)

    key_type = ", ".join(f"{k}: {types[k]}" for k in keys)
    return src.mapInArrow(run, f"list_id int, dims int, keys array<struct<{key_type}>>, m binary")


def _best(pairs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(qid, keys..., similarity, rank) from rows of a packed question row (qids, qm) beside a packed vector row."""
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema["keys"].dataType.elementType.fields}

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                dims = b.column("dims")[i].as_py()
                q = np.frombuffer(b.column("qm")[i].as_buffer(), np.float64).reshape(-1, dims)
                m = np.frombuffer(b.column("m")[i].as_buffer(), np.float64).reshape(-1, dims)
                s = q @ m.T
                if s.shape[1] > k:  # every row at or above the k-th score: ties are cut by key later
                    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    at_q, at_m = np.nonzero(s >= kth[:, None])
                else:
                    at_q, at_m = (x.ravel() for x in np.indices(s.shape))
                found = b.column("keys")[i].values.take(pa.array(at_m))
                qids = b.column("qids")[i].values.take(pa.array(at_q))
                yield pa.RecordBatch.from_arrays([qids.field(0), *(found.field(c) for c in fields), pa.array(s[at_q, at_m])],
                                                 names=["qid", *fields, "similarity"])

    qid = pairs.schema["qids"].dataType.elementType.fields[0].dataType.simpleString()
    rows = pairs.select("dims", "qids", "qm", "keys", "m").mapInArrow(
        run, f"qid {qid}, {', '.join(f'{c} {t}' for c, t in fields.items())}, similarity double")
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), *[F.col(c) for c in keys])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _questions(questions: DataFrame, qid: str, vec_col: str, list_col: str | None = None) -> DataFrame:
    packed = pack(questions.withColumnRenamed(qid, "qid"), vec_col, ["qid"], list_col, block=128)
    return packed.select("list_id", F.col("dims").alias("qdims"), F.col("keys").alias("qids"), F.col("m").alias("qm"))


def exact_topk(vectors: DataFrame, vec_col: str, keys: Sequence[str], questions: DataFrame, qid: str, q_col: str, k: int) -> DataFrame:
    """(qid, keys..., similarity, rank): the ``k`` nearest vectors of each question by cosine."""
    ship_package(vectors.sparkSession)
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pack(vectors, vec_col, keys).withColumn("part", F.pmod(F.xxhash64("m"), F.lit(n)))
    asked = _questions(questions, qid, q_col).withColumn("part", F.explode(F.expr(f"sequence(0L, {n - 1}L)"))).drop("list_id")
    return _best(rows.join(asked, "part").where("dims = qdims"), keys, k)


def train(vectors: DataFrame, vec_col: str, n_lists: int, seed: int = 42, max_iter: int = 15) -> np.ndarray:
    """Unit list centres from at most about ``SAMPLE_PER_LIST`` vectors a list, drawn by a hash of the vector."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    ok = _usable(vectors, vec_col, None)
    n = ok.count()
    share = min(1.0, n_lists * SAMPLE_PER_LIST / max(n, 1))
    norm = _length(vec_col)
    pick = F.pmod(F.xxhash64(F.col(vec_col), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = materialize(ok.where(pick).select(array_to_vector(F.transform(vec_col, lambda x: x.cast("double") / norm)).alias("features")))
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter).fit(sample)
    c = np.asarray(model.clusterCenters(), dtype=np.float64)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


def nearest_lists(df: DataFrame, vec_col: str, centres: np.ndarray, probes: int) -> DataFrame:
    """``df`` with ``list_id``: one row for each of the ``probes`` nearest lists."""
    names = df.columns
    src = _usable(df, vec_col, centres.shape[1])
    at = names.index(vec_col)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                m = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                best = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes]
                rows = b.take(pa.array(np.repeat(np.arange(b.num_rows), best.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(best.ravel().astype(np.int32))], names=[*names, "list_id"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(run, f"{types}, list_id int")


def assign(vectors: DataFrame, vec_col: str, centres: np.ndarray) -> DataFrame:
    """Every vector with its nearest list; new batches are assigned to the same centres."""
    return nearest_lists(vectors, vec_col, centres, 1)


def write_lists(assigned: DataFrame, path: str, vec_col: str, keys: Sequence[str], mode: str = "overwrite") -> None:
    """Store (or, with mode ``append``, add a batch to) the packed lists."""
    dealt = assigned.repartitionByRange("list_id", F.xxhash64(*keys)).sortWithinPartitions("list_id")
    pack(dealt, vec_col, keys, "list_id").write.mode(mode).partitionBy("list_id").parquet(path)


def lists_topk(lists: DataFrame, centres: np.ndarray, keys: Sequence[str], questions: DataFrame, qid: str, q_col: str, k: int, probes: int) -> DataFrame:
    """(qid, keys..., similarity, rank): the best ``k`` among the vectors of each question's ``probes`` nearest lists."""
    near = nearest_lists(questions.select(qid, q_col), q_col, centres, probes)
    asked = _questions(near.repartition("list_id").sortWithinPartitions("list_id"), qid, q_col, "list_id")
    return _best(lists.join(asked, "list_id").where("dims = qdims"), keys, k)


def recall(found: DataFrame, exact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(qid, recall): the share of each question's exact answer that was found."""
    hit = found.select("qid", *keys, F.lit(1).alias("_hit"))
    return exact.join(hit, ["qid", *keys], "left").groupBy("qid").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def calibrate(lists: DataFrame, centres: np.ndarray, keys: Sequence[str], questions: DataFrame, qid: str, q_col: str, k: int,
              target: float, exact: DataFrame) -> tuple[int, float]:
    """(probes, recall): the smallest number of probes, by halving steps, whose mean recall reaches ``target``."""
    low, high, reached = 1, len(centres), 1.0
    while low < high:
        mid = (low + high) // 2
        got = recall(lists_topk(lists, centres, keys, questions, qid, q_col, k, mid), exact, keys).agg(F.avg("recall")).first()[0] or 0.0
        if got >= target:
            high, reached = mid, got
        else:
            low = mid + 1
    return high, reached
