"""Conversation helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

DEFAULT_TITLE = "New conversation"
TITLE_CHARS = 60

# --- fixed values: question intent keywords, checked in this order -----------
INTENT_KEYWORDS = [
    ("trend", ["trend", "trending", "over time", "time-series", "timeseries"]),
    ("sentiment", ["sentiment", "feel about", "opinion", "controversial"]),
    ("comparison", ["compare", "comparison", " vs ", "versus", "cross-platform"]),
    ("summary", ["summarize", "summary", "sum up", "tl;dr"]),
]
# -----------------------------------------------------------------------------


def display_title(title) -> Column:
    return F.coalesce(F.nullif(_col(title), F.lit("")), F.lit(DEFAULT_TITLE))


def title_from_question(q) -> Column:
    return F.substring(_col(q), 1, TITLE_CHARS)


def question_intent(q) -> Column:
    """First matching intent by substring of the lower-cased question, else NULL."""
    low = F.lower(_col(q))
    out = None
    for intent, words in INTENT_KEYWORDS:
        cond = None
        for w in words:
            c = low.contains(w)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(intent)) if out is None else out.when(cond, F.lit(intent))
    return out
