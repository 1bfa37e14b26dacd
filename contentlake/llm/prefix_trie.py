"""Conversation prefix trie by time-forward processing.

Conversations are first rebuilt: the first turns of each come from the first one of its block of
``BLOCK`` ids. Every distinct sequence of first turns is a node; the conversations that begin with it are
its members, the smallest one names it: (conv_id, depth) identifies a node, since a conversation that is
the smallest member of a node is so in all of its own deeper nodes. These form its chain.

1. Turns get their positions (``order_stats``: a conversation of any length is cut into ranges). A
   prefix is told by sums of the position-wise checksums of its turns, four numbers of 32 bits each, so it
   is a running sum and a long conversation is summed in bands of ``BAND`` turns.
2. Nodes are one grouped aggregate of the turns; parents and children are two joins on prefix keys.
3. Nodes of a chain that have one child, which is in the chain, have the same leaves as that child: each
   such run of nodes becomes one, so the tree that is left has about two nodes per different conversation,
   however long one is.
4. Time-forward processing in shards: a shard is the subtree under a topmost node of at most ``SHARD``
   members. Its nodes are sorted in reverse level order by Spark's external sort and read as a stream; totals
   go to parents through a priority queue that spills to disk, and are popped when the stream reaches the
   parent. Shard roots send theirs, added up per parent, to the next round, where a shard is a subtree of at
   most ``SHARD`` squared members and holds only nodes of more than ``SHARD``; and so on to the root.

A shard holds at most about 2 x ``SHARD`` nodes of each round plus the square root of twice the number of
turns. Members of a node are listed in pieces of ``2 ** CHUNK`` ids made in parallel; only the digest
over the pieces, which is sequential by definition, is one stream per node.

Results: a null role or text is empty; null turns come first, equal turns of a conversation in the order of
their checksums, repeated rows are turns of their own; rows without conv_id take no part. Without any
conversation there is no node, not even the root. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.order_stats import statistics
from ..session import materialize
from .common import WORD

BLOCK = 20
HEADS = 4
BAND = 1024
SHARD = 4096
CHUNK = 16
#: Messages that a priority queue holds in memory.
QUEUE = 100_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SUMS = ["s1", "s2", "s3", "s4"]


def running(df: DataFrame, key: str, at: str, band: Column, sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """``df`` with running sums per key in the order of ``at`` (up to the row, or before it), summed inside
    (key, band) and carried over the bands of the keys that have several; ``band`` rises with ``at``."""
    names = list(sums)
    rows = df.withColumn("_band", band).withColumns({f"_{n}": c for n, c in sums.items()})
    w = Window.partitionBy(key, "_band").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)) for n in names})
    held = rows.groupBy(key, "_band").agg(*[F.sum(f"_{n}").alias(f"b_{n}") for n in names])
    past = Window.partitionBy(key).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    carry = held.select(F.col(key).alias("_key"), F.col("_band").alias("_b"), *[F.sum(f"b_{n}").over(past).alias(f"c_{n}") for n in names])
    carry = carry.where(F.col(f"c_{names[0]}").isNotNull())
    out = rows.join(carry, (F.col(key) == F.col("_key")) & (F.col("_band") == F.col("_b")), "left")
    return out.select(*df.columns, *[(F.col(n) + F.coalesce(F.col(f"c_{n}"), F.lit(0))).alias(n) for n in names])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, i, words, digest, len) of every rebuilt turn, and (conv_id, len) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"))
    rows = materialize(statistics(rows, ["conv_id"], [("turn", True)], ["digest"], position="pos").drop("turn"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h) \
                .withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = materialize(convs.withColumn("len", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))

    first = rows.where((F.col("pos") < HEADS) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "base")
    heads = first.join(convs.select("base", "conv_id", "h", "len"), "base").where("pos <= h") \
                 .select("conv_id", F.col("pos").alias("i"), "words", "digest", "len")
    # A long conversation meets its own row in as many parts as it has bands.
    band = F.expr(f"(pos - 1) div {BAND}")
    parts = convs.select("conv_id", "h", "head", "len", F.explode(F.expr(f"sequence(0L, (n - 1) div {BAND})")).alias("band"))
    tails = rows.withColumn("band", band).join(parts, ["conv_id", "band"]).where("pos > h") \
                .select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("i"), "words", "digest", "len")
    return heads.unionByName(tails), convs.select("conv_id", "len")


def _keys(depth: Column, sums: list[Column], names: tuple[str, str]) -> list[Column]:
    return [F.xxhash64(depth, *sums).alias(names[0]), F.xxhash64(*sums[::-1], depth).alias(names[1])]


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, i, words, len, k1, k2, p1, p2): each rebuilt turn with the keys of the prefix that it ends
    and of the one before it."""
    low, a, b = F.lit(0xFFFFFFFF).cast("long"), F.xxhash64("i", "digest"), F.xxhash64("digest", "i")
    part = {"s1": a.bitwiseAND(low), "s2": F.shiftrightunsigned(a, 32), "s3": b.bitwiseAND(low), "s4": F.shiftrightunsigned(b, 32)}
    summed = running(rows, "conv_id", "i", F.expr(f"(i - 1) div {BAND}"), part)
    here, above = [F.col(s) for s in SUMS], [F.col(s) - part[s] for s in SUMS]
    return summed.select("conv_id", "i", "words", "len", *_keys(F.col("i"), here, ("k1", "k2")), *_keys(F.col("i") - 1, above, ("p1", "p2")))


def node_table(path: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: k1, k2, p1, p2, conv_id, depth, n_convs, own (its saved tokens), and whether its
    smallest member ends there. The root has no parent key."""
    mine = lambda at: F.coalesce(F.min(F.when(at, F.col("conv_id"))) == F.min("conv_id"), F.lit(False)).alias("owner_ends")
    nodes = path.groupBy("k1", "k2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.min("i").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), mine(F.col("i") == F.col("len")))
    zero = [F.lit(0).cast("long")] * len(SUMS)
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), mine(F.col("len") == 0)).where("n_convs > 0")
    root = root.select(*_keys(F.lit(0).cast("long"), zero, ("k1", "k2")), none.alias("p1"), none.alias("p2"), "conv_id",
                       F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"), "owner_ends")
    return nodes.unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("words")).drop("words")


class MessageQueue:
    """Priority queue of tuples of four integers. Beyond ``limit`` entries in memory the larger half is
    written as a sorted run to a scratch file of the task, which is gone when the task ends."""
    ROW = struct.Struct("<4q")

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.heads, self.files = limit, [], [], []

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.limit:
            self.heap.sort()
            keep = self.limit // 2
            f = tempfile.TemporaryFile(buffering=1 << 16)
            for x in self.heap[keep:]:
                f.write(self.ROW.pack(*x))
            f.seek(0)
            del self.heap[keep:]
            self.files.append(f)
            self._next(len(self.files) - 1)

    def _next(self, run: int) -> None:
        row = self.files[run].read(self.ROW.size)
        if row:
            heapq.heappush(self.heads, (self.ROW.unpack(row), run))
        else:
            self.files[run].close()

    def least(self) -> tuple | None:
        first = [q[0] for q in (self.heap, [h[0] for h in self.heads[:1]]) if q]
        return min(first) if first else None

    def pop(self) -> tuple:
        if not self.heads or (self.heap and self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        entry, run = heapq.heappop(self.heads)
        self._next(run)
        return entry


def forward(stream, limit: int = QUEUE):
    """(conv_id, end, n_leaves, saved) of the nodes of a stream (shard, end, conv_id, parent, parent_end, own,
    leaves, saved) that lists each shard's nodes with falling ``end``; leaves and saved are what came from
    other shards. Totals travel to the parent through the queue."""
    shard, queue = None, MessageQueue(limit)
    for s, end, conv, parent, parent_end, own, leaves, saved in stream:
        if s != shard:
            shard, queue = s, MessageQueue(limit)
        saved += own
        while (m := queue.least()) is not None and m[:2] <= (-end, conv):
            queue.pop()
            if m[:2] == (-end, conv):  # an earlier one is for a node outside the shard: its root's parent
                leaves, saved = leaves + m[2], saved + m[3]
        yield conv, end, leaves, saved
        if parent is not None:
            queue.push((-parent_end, parent, leaves, saved))


def totals(runs: DataFrame, path: DataFrame, nodes: DataFrame, n_convs: int, shard: int = SHARD, limit: int = QUEUE) -> DataFrame:
    """(conv_id, end, n_leaves, total) of every run of nodes, in rounds of shards of shard, shard ** 2, ... members."""

    def process(batches):
        import pyarrow as pa
        names = ["conv_id", "end", "n_leaves", "total"]
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for x in forward(rows, limit):
            out.append(x)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    done, low, high = None, 0, shard
    while True:
        now = runs.where((F.col("n") > low) & (F.col("n") <= high))
        if n_convs <= high:
            now = now.withColumn("shard", F.lit(0).cast("long"))
        else:
            # A conversation's heavy prefixes come first on its path: their number is the depth of its shard's root.
            heavy = nodes.where((F.col("n_convs") > high) & F.col("p1").isNotNull()).select("k1", "k2")
            deep = path.join(heavy, ["k1", "k2"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("m"))
            owners = now.select("conv_id").distinct().join(deep, "conv_id", "left") \
                        .select("conv_id", (F.coalesce("m", F.lit(0)) + 1).alias("i"))
            tops = path.join(owners, ["conv_id", "i"]).select("conv_id", F.col("k1").alias("shard"))
            now = now.join(tops, "conv_id")
        empty = [F.lit(0).cast("long").alias(c) for c in ("n_leaves", "total")]
        if done is None:
            now = now.select("*", *empty)
        else:
            sent = done.join(runs, ["conv_id", "end"]).groupBy(F.col("parent").alias("conv_id"), F.col("parent_end").alias("end")) \
                       .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("total").alias("total"))
            now = now.join(sent, ["conv_id", "end"], "left")
        leaves = F.coalesce("n_leaves", F.lit(0)) + F.col("leaf")
        rows = now.select("shard", "end", "conv_id", "parent", "parent_end", "own", leaves.alias("leaves"), F.coalesce("total", F.lit(0)).alias("saved"))
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("end").desc(), "conv_id")
        got = materialize(rows.mapInArrow(process, "conv_id long, `end` long, n_leaves long, total long"))
        done = got if done is None else done.unionByName(got)
        if n_convs <= high:
            return done
        low, high = high, high * shard


def member_digests(path: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(k1, k2, sha): per node the digest of the ids of the conversations that end there."""
    zero = [F.lit(0).cast("long")] * len(SUMS)
    ends = path.where("i = len").select("k1", "k2", "conv_id").unionByName(
        convs.where("len = 0").select(*_keys(F.lit(0).cast("long"), zero, ("k1", "k2")), "conv_id"))
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("k1", "k2", F.shiftright("conv_id", chunk).alias("chunk")).agg(piece.alias("ids"))

    def digest(batches):
        import pyarrow as pa
        key, sha = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if (k1, k2) == key:
                    sha.update(b"," + ids.encode())
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k1", "k2", "sha"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, sha.hexdigest())], names=["k1", "k2", "sha"])

    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk").mapInArrow(digest, "k1 long, k2 long, sha string")


def build(turns: DataFrame, shard: int = SHARD, limit: int = QUEUE) -> DataFrame:
    """The trie over ``turns`` (conv_id, turn, role, text): one row per node, see ``op11_prefix_trie``."""
    rows, convs = rebuilt(turns)
    path = materialize(paths(rows))
    nodes = materialize(node_table(path, convs))
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(children, ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left") \
                .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    bottom = F.when((F.col("n_children") != 1) | F.col("owner_ends"), 1).otherwise(0).cast("long")
    tree = tree.select("k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "own", bottom.alias("bottom"))
    tree = materialize(running(tree, "conv_id", "depth", F.expr(f"depth div {BAND}"), {"run": F.col("bottom"), "above": F.col("own")}, inclusive=False))

    runs = tree.groupBy("conv_id", "run").agg(
        F.max("depth").alias("end"), (F.min("depth") - 1).alias("parent_end"), F.min_by("parent_conv_id", "depth").alias("parent"),
        F.sum("own").alias("own"), F.min("above").alias("above0"), F.max("n_convs").alias("n"),
        F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf"))
    runs = materialize(runs)
    n_convs = convs.count()
    if n_convs == 0:
        done = runs.select("conv_id", "end", F.col("n").alias("n_leaves"), F.col("own").alias("total"))
    else:
        done = totals(runs, path, nodes, n_convs, shard, limit)
    of_run = runs.select("conv_id", "run", "end", "above0").join(done, ["conv_id", "end"]).drop("end")
    out = tree.join(of_run, ["conv_id", "run"]).join(member_digests(path, convs), ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      (F.col("total") - (F.col("above") - F.col("above0"))).alias("saved_tokens"),
                      F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))
