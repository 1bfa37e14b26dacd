"""Quality rules with risk-controlled cutoffs (operator 5), DataFrame functions only.

Every rule rejects a text whose statistic lies above a cutoff. The cutoffs of all rules stand on one
ladder of steps from lax to strict, fixed beforehand, so the texts rejected at a step are among those of the next. Per
stratum (band of text length), a step is tested on labelled good documents: among n good holdout texts, those that
any rule rejects are counted, and the step is certified if the exact
binomial test shows that the joint false-rejection rate is at most ``risk`` -- that is, if
P(Binomial(n, risk) <= false rejections) <= delta / strata (Bonferroni over the strata). This is the
Clopper-Pearson upper bound written as a test. The steps are tested in order and the first failure
ends the sequence: by fixed-sequence testing this needs no correction over steps, and by the union
bound, with probability 1 - delta no stratum loses more than ``risk`` of its good
documents. A stratum whose holdout is too small (under 436 texts at the defaults) certifies nothing and rejects nothing.

Defined results: null and empty texts have all counts 0; they fail the base rule (fewer than 10
words). Rows repeat as they are given. Labels that are null are ignored; a document with both
labels counts as not good. Exact copies count once in the holdout, since the test needs independent
draws. Columns of ``docs`` may have any names; added columns never replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name
from .text_stats import with_stats

#: Cutoffs of every rule by step, the same for all data.
LADDER = {
    "symbols": (0.8, 0.5, 0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02, 0.01, 0.005),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeats": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "same_words": (0.995, 0.99, 0.985, 0.98, 0.975, 0.97, 0.965, 0.96, 0.955, 0.95, 0.945),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "shouting": (0.8, 0.5, 0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02, 0.01, 0.005),
}
STEPS = len(LADDER["symbols"])
#: Upper word counts of the strata; the last stratum has no upper end.
STRATA = (100, 300, 1000)


def rule_values(s: Column) -> dict[str, Column]:
    """Ratio of each rule, from 0 to about 1; larger is worse."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbols": ratio(s["n_symbols"], s["word_chars"]),
        "dup_lines": ratio(s["n_dup_lines"], s["n_lines"]),
        "repeats": ratio(s["n_repeat_words"], s["n_words"]),
        "same_words": F.lit(1.0) - F.when(s["n_words"] > 0, s["n_distinct_words"] / s["n_words"]).otherwise(F.lit(1.0)),
        "capitals": ratio(s["n_upper"], s["word_chars"]),
        "shouting": ratio(s["n_exclaim"], s["word_chars"]),
    }


def stratum_of(s: Column) -> Column:
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(s["n_words"] <= STRATA[i], F.lit(i)).otherwise(out)
    return out


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) by its terms from 0 to k, in logarithms until they are added.

    ``k`` above n * p is given as 1.0: the tail is then far over any test level."""
    q = 1.0 - p
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct((n * F.log(F.lit(q))).alias("t"), F.exp(n * F.log(F.lit(q))).alias("s")),
        lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i * F.lit(p / q))).alias("t"),
                              (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i * F.lit(p / q)))).alias("s")),
        lambda a: a["s"])
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(n * F.log(F.lit(q)))).otherwise(terms)


def holdout(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Statistics of all good labelled texts, exact copies once: columns ``s`` (struct).

    ``rows`` holds ``g_id``, ``h`` (hash of the text) and ``s`` of every document: statistics are
    computed before the shuffle, so that only small rows move."""
    good = (labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("g_id")).agg(F.min("quality").alias("g")).where("g = 1").select("g_id"))
    return rows.join(good, "g_id", "left_semi").groupBy("h").agg(F.min("s").alias("s")).select("s")


def certify(good: DataFrame, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per stratum with a struct of certified cutoffs per rule (null: the rules stay silent).

    One aggregation counts the joint rejections of all steps at once; its result has at most as many rows
    as there are strata."""
    rules = rule_values(F.col("s"))
    step = F.lit(0)  # steps that reject the text are the last ones
    for i in reversed(range(STEPS)):
        hit = F.lit(False)
        for r, v in rules.items():
            hit = hit | (v > LADDER[r][i])
        step = F.when(hit, F.lit(STEPS - i)).otherwise(step)
    rows = good.where(~base_failed(F.col("s"))).select(stratum_of(F.col("s")).alias("stratum"), step.alias("strict"))
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("strict") >= STEPS - i).alias(f"k{i}") for i in range(STEPS)])
    level = delta / (len(STRATA) + 1)
    failed = F.array(*[binomial_cdf(F.col(f"k{i}"), F.col("n"), risk) > level for i in range(STEPS)])
    first = F.array_position(failed, True)
    certified = counts.select("stratum", F.when(first == 0, F.lit(STEPS)).otherwise(first - 1).cast("int").alias("step"))
    return certified.select("stratum", F.struct(*[
        F.when(F.col("step") > 0, F.get(F.array(*map(F.lit, LADDER[r])), F.col("step") - 1)).alias(r) for r in rules]).alias("cut"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", risk: float = 0.01,
          delta: float = 0.05, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (its name is returned): the counts of ``STATS``,
    ``base_failed``, ``rejected_by`` (comma-joined rule names, '' if none) and ``kept``.

    ``columns`` names the columns of ``docs`` to return (all by default). Without the text among them
    the statistics are written once, and cutoffs and verdicts are taken from that table; with it they
    are computed for each of the two, so that no text is written. The table of cutoffs has one row per
    stratum (four), so it is broadcast."""
    name = free_name(docs, "verdict")
    columns = docs.columns if columns is None else columns
    s, st, cut = f"{name}_s", f"{name}_stratum", f"{name}_cut"
    h, g_id = free_name(docs, f"{name}_h"), free_name(docs, f"{name}_id")
    rows = with_stats(docs, text, s).select(*columns, s, F.col(id_col).alias(g_id), F.xxhash64(text).alias(h))
    if text not in columns:
        rows = materialize(rows)
    cuts = certify(holdout(rows.select(F.col(g_id).alias("g_id"), F.col(h).alias("h"), F.col(s).alias("s")), labels, id_col), risk, delta)
    rows = rows.withColumn(st, stratum_of(F.col(s)))
    cuts = cuts.select(F.col("stratum").alias(st), F.col("cut").alias(cut))
    rows = rows.join(F.broadcast(cuts), st, "left")
    fired = F.array_compact(F.array(*[F.when(v > F.col(cut)[r], F.lit(r)) for r, v in rule_values(F.col(s)).items()]))
    rows = rows.withColumn(name, F.struct(f"{s}.*", base_failed(F.col(s)).alias("base_failed"),
                                          F.concat_ws(",", fired).alias("rejected_by")))
    v = F.col(name)
    rows = rows.withColumn(name, v.withField("kept", ~v["base_failed"] & (v["rejected_by"] == "")))
    return rows.select(*columns, name), name


def filter_quality(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    rows, name = judge(docs, labels, **kw)
    return rows.where(F.col(name)["kept"]).select(*docs.columns)
