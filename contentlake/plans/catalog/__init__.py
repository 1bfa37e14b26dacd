"""Registered queries, grouped as in SURVEY section 2."""

from . import analytics, chat, functions, ingest, normalize, pipeline, raw_oracle, relational, retrieval, rollup, sql, streaming  # noqa: F401
