"""Guarded read-only SQL over the registered views (Q1-Q3, Q6).

The guard reads Spark's own parsed plan, never the text: every operator of the plan, of its
subqueries and of its common table expressions must be one that only reads (an allow-list of node
classes), every relation must be a registered view or a table expression in scope at that place,
and functions that run code or read files are refused. A plan that cannot be read is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..schema import PlanError
from ..sources.bindings import DRIVER_TABLES, Tables

MODEL_VIEWS = ["posts", "authors", "engagement", "comments", "messages", "chats", "query_logs", "scrape_jobs",
               "saved_searches", "search_docs", "doc_embeddings"]
KNOWN_VIEWS = set(MODEL_VIEWS) | set(DRIVER_TABLES)
# Node classes of a parsed query that only read.
READING = frozenset("""
    Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias
    OneRowRelation UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedInlineTable LocalRelation
    UnresolvedHaving WithWindowDefinition Generate Pivot Unpivot UnresolvedTableValuedFunction UnresolvedHint ResolvedHint Sample
    UnresolvedTVFAliases UnresolvedOrdinal Deduplicate Window Expand UnionLoop UnionLoopRef RepartitionByExpression""".split())
# Functions that call other code, or read what is not a registered view.
REFUSED_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect", "read_files", "sql_keywords", "input_file_name",
                               "input_file_block_start", "input_file_block_length"})


COSINE = """try_divide(aggregate(zip_with(embedding, query_embedding, (a, b) -> cast(a as double) * b), 0D, (acc, x) -> acc + x),
      (sqrt(aggregate(embedding, 0D, (acc, x) -> acc + cast(x as double) * x))
         * sqrt(aggregate(query_embedding, 0D, (acc, x) -> acc + cast(x as double) * x))))"""

MATCH_EMBEDDINGS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION match_embeddings(query_embedding ARRAY<FLOAT>, filter_platform STRING)
RETURNS TABLE (source_type STRING, source_id BIGINT, platform STRING, similarity DOUBLE)
RETURN SELECT source_type, source_id, platform, {COSINE} AS similarity
  FROM doc_embeddings WHERE filter_platform IS NULL OR platform = filter_platform"""


def register_views(spark: SparkSession, t: Tables) -> list[str]:
    """Register the model bindings and driver tables as temp views, and the ``match_embeddings``
    table function (Q6: cosine similarity of every vector; the caller's ``ORDER BY similarity DESC
    LIMIT k`` becomes a per-partition top-k). Returns the view names."""
    for name in MODEL_VIEWS:
        getattr(t, name).createOrReplaceTempView(name)
    for name in DRIVER_TABLES:
        t.table(name).createOrReplaceTempView(name)
    spark.sql(MATCH_EMBEDDINGS)
    return sorted(KNOWN_VIEWS)


def _seq(value) -> list:
    """Elements of a Scala collection."""
    out, it = [], value.iterator()
    while it.hasNext():
        out.append(it.next())
    return out


class _Reader:
    """Walks a parsed plan with the names that are visible at each place."""

    def __init__(self, allowed: set[str]):
        self.allowed = allowed

    def plan(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in READING:
            raise PlanError(f"{kind} is no part of a reading query")
        if kind == "UnresolvedRelation":
            name = [x.lower() for x in _seq(node.multipartIdentifier())]
            if len(name) != 1 or name[0] not in self.allowed | scope:
                raise PlanError(f"{'.'.join(name)} is no registered view")
        elif kind == "UnresolvedTableValuedFunction":
            self.function(_seq(node.name()))
        elif kind == "UnresolvedWith":
            recursive = bool(node.allowRecursion())
            for pair in _seq(node.cteRelations()):
                name, query = str(pair._1()).lower(), pair._2()
                # A table expression sees those before it; itself only where recursion is asked for.
                self.plan(query, scope | {name} if recursive else scope)
                scope = scope | {name}
        for e in _seq(node.expressions()):
            self.expression(e, scope)
        for child in _seq(node.children()):
            self.plan(child, scope)

    def expression(self, e, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.function(_seq(e.nameParts()))
        elif kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            self.plan(e.plan(), scope)
        elif kind != "InSubquery" and kind.endswith(("Subquery", "SubqueryExpression")):
            raise PlanError(f"{kind} is no part of a reading query")
        for child in _seq(e.children()):
            self.expression(child, scope)

    @staticmethod
    def function(parts: list[str]) -> None:
        if len(parts) != 1 or parts[0].lower() in REFUSED_FUNCTIONS:
            raise PlanError(f"function {'.'.join(parts)} is not available here")


def guard(spark: SparkSession, sql: str, allowed: set[str] | None = None) -> str:
    """Q1: raise PlanError unless ``sql`` is one SELECT or WITH query that only reads allowed views."""
    if not re.match(r"\s*(?:select|with)\b", sql, re.IGNORECASE):
        raise PlanError("a query starts with SELECT or WITH")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001 - whatever the parser says, the query is refused
        raise PlanError(f"the query could not be parsed: {str(e).splitlines()[0]}") from e
    _Reader({a.lower() for a in (allowed or KNOWN_VIEWS)}).plan(plan, frozenset())
    return sql.strip().rstrip(";")


def safe_sql(spark: SparkSession, sql: str, t: Tables | None = None, args: dict | None = None,
             limit: int | None = None) -> DataFrame:
    """Q2: guard, then run through Catalyst; lazy DataFrame. ``limit`` mirrors the prompt's default cap."""
    if t is not None:
        register_views(spark, t)
    body = guard(spark, sql)
    df = spark.sql(body, args=args) if args else spark.sql(body)
    return df.limit(limit) if limit is not None else df


def schema_catalog(spark: SparkSession, t: Tables) -> DataFrame:
    """Q3: (view, column, type, n_rows) for every registered view. Column metadata comes from the
    views' schemas; row counts are one union of per-view counts (a job over every table)."""
    from pyspark.sql import functions as F
    register_views(spark, t)
    rows = []
    counts = None
    for name in sorted(KNOWN_VIEWS):
        for f in spark.table(name).schema.fields:
            rows.append((name, f.name, f.dataType.simpleString()))
        c = spark.table(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view"), "n_rows")
        counts = c if counts is None else counts.unionByName(c)
    meta = spark.createDataFrame(rows, "view string, column string, type string")
    return meta.join(counts, "view")
