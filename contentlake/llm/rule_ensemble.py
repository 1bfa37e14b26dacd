"""Sparse rule ensemble for text quality (operator 7).

Trees are grown over text statistics of labelled documents; every path from a root to a node is a
rule, the conjunction of its comparisons. A logistic regression with an L1 penalty over the rules'
0/1 values leaves a small set with weights, and those are compiled into one Spark column expression:
scoring needs no Python and no model files.

Learning uses at most about ``max_train`` labelled documents, taken by a hash of their id; the
statistics of that sample are all that is trained on. Scoring covers every row.

Defined results: null and empty texts have all counts 0 and are scored like any other. Without
labels of both classes every score is the share of label 1 (0.5 without any label). Null labels are
ignored, a document with both labels is left out, documents that repeat count as often as they
come. Added columns never replace a column of the input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name
from .text_stats import with_stats

#: Comparison of one statistic with a value: (number of the statistic, at most?, value).
Test = tuple[int, bool, float]
STOP_WORDS = ("the", "of", "and", "to", "in", "la", "de", "le", "les", "et", "un", "une", "des", "est", "que", "y", "el", "los",
              "del", "der", "die", "das", "und", "ist", "zu", "im", "von", "den", "für")


def features(s: Column) -> dict[str, Column]:
    """Statistics that the trees see, doubles, from the counts of ``text_stats``."""
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    return {
        "words": F.log1p(s["n_words"]), "word_length": per(s["word_chars"], s["n_words"]),
        "symbols": per(s["n_symbols"], s["word_chars"]), "dup_lines": per(s["n_dup_lines"], s["n_lines"]),
        "repeats": per(s["n_repeat_words"], s["n_words"]), "distinct": per(s["n_distinct_words"], s["n_words"]),
        "capitals": per(s["n_upper"], s["word_chars"]), "shouting": per(s["n_exclaim"], s["n_words"]),
        "digits": per(s["n_digits"], s["word_chars"]), "line_words": per(s["n_words"], s["n_lines"]),
        "stops": per(s["n_stops"], s["n_words"]),
    }


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[frozenset[Test], float], ...] = field(default=())

    def score(self, feature: dict[str, Column]) -> Column:
        """Probability of label 1."""
        cols = list(feature.values())
        z = F.lit(self.intercept)
        for tests, weight in self.rules:
            z = z + F.when(_holds(tests, cols), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        names = list(features(F.lit(None)))
        return [f"{w:+.3f} if " + " and ".join(f"{names[i]} {'<=' if low else '>'} {v:.4g}" for i, low, v in sorted(t)) for t, w in self.rules]


def _holds(tests: frozenset[Test], cols: list[Column]) -> Column:
    out = F.lit(True)
    for i, low, v in sorted(tests):
        out = out & ((cols[i] <= v) if low else (cols[i] > v))
    return out


def paths(debug: str) -> list[frozenset[Test]]:
    """Rules of all paths in the printed form of a tree ensemble. Of two bounds of one statistic in one
    direction the tighter stays."""
    found: dict[frozenset[Test], None] = {}
    at: list[tuple[int, Test]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth, test = len(m[1]), (int(m[2]), m[3] == "<=", float(m[4]))
        at = [(d, t) for d, t in at if d < depth] + [(depth, test)]
        tight: dict[tuple[int, bool], float] = {}
        for _, (i, low, v) in at:
            tight[i, low] = (min if low else max)(tight.get((i, low), v), v)
        found[frozenset((i, low, v) for (i, low), v in tight.items())] = None
    return list(found)


def with_features(docs: DataFrame, text: str, into: str) -> DataFrame:
    rows = with_stats(docs, text, f"{into}_s", STOP_WORDS)
    values = F.struct(*[v.alias(k) for k, v in features(F.col(f"{into}_s")).items()])
    return rows.select(*docs.columns, F.explode_outer(F.array(values)).alias(into))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, max_train: int) -> DataFrame:
    """``f`` (features) and ``label`` of the labelled sample; only small rows are shuffled."""
    marked = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("t_id")).agg(
        F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    rate = min(1.0, max_train / max(labels.count(), 1))
    rows = docs.select(F.col(id_col).alias("t_id"), F.col(text).alias("t_text"))
    if rate < 1:
        rows = rows.where(F.pmod(F.xxhash64("t_id", F.lit("train")), F.lit(1_000_000)) < int(rate * 1_000_000))
    return with_features(rows, "t_text", "f").select("t_id", "f").join(marked, "t_id").select("f", F.col("label").cast("double").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_train: int = 20_000, trees: int = 20,
        depth: int = 3, penalty: float = 0.001) -> RuleModel:
    """Rules and weights learned from the labelled sample."""
    rows = materialize(sample(docs, labels, id_col, text, max_train)).coalesce(4)
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return RuleModel({0.0: -30.0, 1.0: 30.0}[next(iter(seen))] if seen else 0.0)
    names = rows.schema["f"].dataType.names
    data = rows.select("label", array_to_vector(F.array(*[F.col("f")[n] for n in names])).alias("features")).cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", seed=7).fit(data)
    data.unpersist()
    found = paths(forest.toDebugString)
    if not found:
        return RuleModel(0.0)
    cols = [F.col("f")[n] for n in names]
    hits = rows.select("label", array_to_vector(F.array(*[_holds(t, cols).cast("double") for t in found])).alias("features")).cache()
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(hits)
    hits.unpersist()
    weights = fitted.coefficients.toArray().tolist()
    return RuleModel(float(fitted.intercept), tuple((t, w) for t, w in zip(found, weights, strict=True) if w))


def score(docs: DataFrame, model: RuleModel, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned): the score from 0 to 1."""
    name = free_name(docs, "quality_score")
    rows = with_features(docs, text, f"{name}_f")
    names = list(features(F.lit(None)))
    return rows.select(*docs.columns, model.score({n: F.col(f"{name}_f")[n] for n in names}).alias(name)), name
