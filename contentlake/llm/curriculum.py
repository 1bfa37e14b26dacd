"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule: knots (time, weight) between time 0 and 1, straight lines between
them. The integral of a schedule is the source's weight: the words of the mix are shared by these
weights, no source gets more than ``most`` times its own size, and the excess is shared again by weight
until none is above (``targets``). The running integral of the schedule, scaled to the source's target,
is the number of the source's words that training has asked for by then: its cumulative demand.

A source's documents stand in an order of keyed hashes, copy after copy, so every copy begins at a known
number of the source's words. Inverting the cumulative demand at that number gives the time at which
training reaches the copy; the token position is the demand of all sources together by then. Documents
are range-sorted by the position of their first copy (``mix``), and every copy by its own (``in_order``).

A source may hold any share of the rows: the hash order is cut into ``BUCKETS`` parts, a window numbers
words inside (source, part), and the parts' sums are added up per source (at most ``BUCKETS`` rows each).

Results: a null or empty text has size 0 and is never taken; a null source is a source of its own, the
last one. The copy in which a source's demand ends is cut there, so a source's taken words are its target,
rounded. Repeated rows are documents of their own. No column of the input is changed, new ones take free
names. Everything is a function of the rows, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.order_stats import statistics
from ..session import materialize
from .common import WORD, free_name

#: Hex digits of the order hash that name a part of a source, and the number of parts.
DIGITS = 3
BUCKETS = 16 ** DIGITS

Knots = Sequence[tuple[float, float]]


def segments(knots: Knots) -> list[tuple[float, float, float, float]]:
    """(start, weight at start, slope, integral before) of each straight piece of a schedule."""
    knots = sorted((float(t), float(w)) for t, w in knots)
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs knots from time 0 to time 1 and no negative weight")
    out, area = [], 0.0
    for (t, w), (t2, w2) in zip(knots, knots[1:]):
        if t2 > t:
            out.append((t, w, (w2 - w) / (t2 - t), area))
            area += (w + w2) / 2 * (t2 - t)
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    return out


def integral(knots: Knots) -> float:
    """The weight of a schedule."""
    knots = sorted(knots)
    return sum((w + w2) / 2 * (t2 - t) for (t, w), (t2, w2) in zip(knots, knots[1:]))


def _when_reached(segs: list, part: Column) -> Column:
    """Time at which a schedule has reached ``part`` (0 to 1) of its integral."""
    last = segs[-1]
    whole = last[3] + last[1] * (1 - last[0]) + last[2] * (1 - last[0]) ** 2 / 2
    asked = part * F.lit(whole)
    out = None
    for t, w, slope, before in segs:
        need = asked - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * need, F.lit(0.0)))
        here = F.lit(t) + F.when(need <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * need / F.greatest(F.lit(w) + root, F.lit(1e-300)))
        out = here if out is None else F.when(asked >= F.lit(before), here).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def _reached(segs: list, time: Column) -> Column:
    """Part (0 to 1) of its integral that a schedule has reached at a time."""
    last = segs[-1]
    whole = last[3] + last[1] * (1 - last[0]) + last[2] * (1 - last[0]) ** 2 / 2
    out = None
    for t, w, slope, before in segs:
        dt = time - F.lit(t)
        here = F.lit(before) + F.lit(w) * dt + F.lit(slope / 2) * dt * dt
        out = here if out is None else F.when(time >= F.lit(t), here).otherwise(out)
    return out / F.lit(whole)


def _pick(choice: Column, options: list[Column]) -> Column:
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(choice == i, options[i]).otherwise(out)
    return out


def targets(sources: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """``sources`` (source, source_size) with ``choice`` (which weight, by code point order of the sources,
    null last) and ``target``: the words of all sources shared by weight, none above ``most`` times its size.

    The level of the sharing (words per unit of weight) rises with each source that is full; every round
    marks the sources that are full at the level, until none is new. A round reads one aggregate row."""
    numbered = statistics(sources.withColumn("_null", F.col("source").isNull()), [], [("_null", True), ("source", True)], position="_at").drop("_null")
    numbered = numbered.withColumn("choice", ((F.col("_at") - 1) % len(weights)).cast("int"))
    numbered = materialize(numbered.withColumn("_w", _pick(F.col("choice"), [F.lit(float(w)) for w in weights])).drop("_at"))
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(most)
    rest, open_weight = float(total), numbered.agg(F.sum("_w")).first()[0] or 1.0
    seen = 0
    while True:
        full = cap * F.lit(open_weight) < F.lit(rest) * F.col("_w")
        n, used, weight = numbered.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_w")))).first()
        if (n or 0) == seen or not weight:
            break
        seen, rest, open_weight = n, float(total) - float(used or 0), weight
    share = F.lit(rest) * F.col("_w") / F.lit(open_weight)
    return numbered.select("source", "source_size", "choice", F.least(cap.cast("double"), share).alias("target"))


def mix(docs: DataFrame, schedules: Sequence[Knots], most: int = 3, seed: int = 13, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", columns: Sequence[str] | None = None) -> tuple[DataFrame, str]:
    """One row per row of ``docs`` (with ``columns``, by default all), range-sorted by training position, and
    the name of a new struct column: ``size``, ``source_size``, ``target``, ``taken`` (words of all copies),
    ``position`` (of the first copy, in words of the whole mix; null where nothing is taken) and ``copies``,
    an array of (position, time, words). Sources in code point order use the schedules in turn."""
    columns = list(docs.columns if columns is None else columns)
    v = free_name(docs, "mix")
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), size.alias("size"), order.alias("order"))
    rows = materialize(rows.withColumn("bucket", F.substring("order", 1, DIGITS)))

    # Words before each document in its source: inside its bucket, and in the buckets before.
    w = Window.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
    sums = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    weights = [integral(k) for k in schedules]
    goal = materialize(targets(sizes, weights, most))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))) \
               .join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))) \
               .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before", "source_size", "choice", "target")
    j = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))

    # Copy after copy: the words of a copy that lie below the target are taken.
    asked = F.floor(F.col("target") + 0.5)
    j = j.withColumn("start", F.col("before") + F.col("inside"))
    copies = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.struct(
        (e * F.col("source_size") + F.col("start")).alias("start"),
        F.greatest(F.lit(0), F.least(F.col("size"), asked - e * F.col("source_size") - F.col("start"))).cast("long").alias("words")))
    j = j.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))

    # Inverted demand: when the source's schedule has asked for the words before the copy. The demand of
    # all sources by then: per schedule, the targets of the sources that use it (one row).
    segs = [segments(k) for k in schedules]
    shares = goal.agg(*[F.coalesce(F.sum(F.when(F.col("choice") == i, F.col("target"))), F.lit(0.0)) for i in range(len(segs))]).first()

    def timed(c: Column) -> Column:
        part = F.least(c["start"] / F.col("target"), F.lit(1.0))
        time = _pick(F.col("choice"), [_when_reached(s, part) for s in segs])
        return F.struct(time.alias("time"), c["words"].alias("words"))

    def placed(c: Column) -> Column:
        demand = sum((F.lit(float(n)) * _reached(s, c["time"]) for s, n in zip(segs, shares)), F.lit(0.0))
        return F.struct(demand.alias("position"), c["time"].alias("time"), c["words"].alias("words"))

    j = j.withColumn("copies", F.transform("copies", timed)).withColumn("copies", F.transform("copies", placed))
    first = F.get(F.col("copies"), F.lit(0))["position"]
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    j = j.withColumn("taken", taken).withColumn("position", first)
    # The order hash spreads the documents without a position over ranges.
    j = j.orderBy(F.col("position").asc_nulls_last(), "order")
    return j.select("row.*", F.struct("size", "source_size", "target", "taken", "position", "copies").alias(v)), v


def in_order(mixed: DataFrame, v: str) -> DataFrame:
    """The training order: one row per taken copy with ``position``, ``time``, ``words`` and ``copy`` (from 0)
    in the struct column ``v``, range-sorted by position; columns as in ``mix``."""
    kept = [F.col(c) for c in mixed.columns if c != v]
    rows = mixed.select(*kept, F.posexplode(F.col(v)["copies"]).alias("copy", "c"))
    out = rows.select(*kept, F.struct("c.position", "c.time", "c.words", F.col("copy").cast("int").alias("copy")).alias(v))
    return out.orderBy(F.col(v)["position"])
