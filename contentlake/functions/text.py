"""Text scalar functions (F4-F12, F21, F25): Column -> Column, all JVM built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: text patterns (word characters in the Unicode sense) -------------
WORD = r"[\p{L}\p{N}_]"
# The marker comes first, so that other positions of a text fail at once; what stands before it is looked up then.
HASHTAG_RE = r"#(?<![\p{L}\p{N}_]#)([\p{L}\p{N}_]+)"
MENTION_RE = r"@(?<![\p{L}\p{N}_]@)([\p{L}\p{N}_]+)"
URL_RE = r"https?://[^\s\x1c-\x1f\x85\p{Z}<>\"']+"
URL_TRAILING = ").,"
ASCII_RE = r"^[\x00-\x7F]*$"
# -------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hashtags(text) -> Column:
    """Distinct lower-case hashtags in first-seen order; NULL text gives []."""
    t = _col(text)
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(HASHTAG_RE), 1)),
                      F.array().cast("array<string>"))


def mentions(text) -> Column:
    t = _col(text)
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(MENTION_RE), 1)),
                      F.array().cast("array<string>"))


def urls(text) -> Column:
    """Distinct http(s) URLs with trailing ')', '.', ',' removed."""
    t = _col(text)
    found = F.regexp_extract_all(t, F.lit(URL_RE), 0)
    cleaned = F.transform(found, lambda x: F.regexp_replace(x, r"[).,]+$", ""))
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


def guess_language(text) -> Column:
    """'und' for NULL/blank, 'en' for pure ASCII, else 'und'."""
    t = _col(text)
    return (F.when(t.isNull() | (py_strip(t) == ""), F.lit("und"))
            .when(t.rlike(ASCII_RE), F.lit("en"))
            .otherwise(F.lit("und")))


def lower_list(xs) -> Column:
    """Strip leading '#'/'@', lower-case every element; duplicates kept."""
    return F.transform(_col(xs), lambda x: F.lower(F.regexp_replace(x, r"^[#@]+", "")))


def clean_username(x) -> Column:
    """Strip a leading '@' and surrounding blanks; case kept."""
    return F.trim(F.regexp_replace(F.trim(_col(x)), r"^@+", ""))


def clean_tag(x, prefix: str = "#") -> Column:
    """Hashtag or mention name: strip the leading marker, trim, lower-case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(_col(x)), "^" + "\\" + prefix + "+", "")))


def natural_key(platform, native_id) -> Column:
    return F.concat_ws(":", _col(platform), _col(native_id))


def checksum(text) -> Column:
    """SHA-256 hex of the stripped UTF-8 text."""
    return F.sha2(py_strip(text), 256)


def bare_post_id(x) -> Column:
    """Last path segment of a status URL, query string cut; other values unchanged."""
    c = _col(x)
    last = F.element_at(F.split(c, "/"), -1)
    return F.when(c.contains("/status/"), F.split_part(last, F.lit("?"), F.lit(1))).otherwise(c)


def snippet(text, n: int = 500) -> Column:
    return F.substring(F.coalesce(_col(text), F.lit("")), 1, n)


def citation(platform, source_type, source_id, text, n: int = 500) -> Column:
    """``[platform/type/first8ofid] snippet`` label used in assistant context."""
    return F.format_string("[%s/%s/%s] %s", _col(platform), _col(source_type),
                           F.substring(_col(source_id).cast("string"), 1, 8), snippet(text, n))


def tokens(text) -> Column:
    """Lower-case word tokens in order (letters, digits, underscore)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD + "+"), 0)


def trigrams(text) -> Column:
    """Set of character 3-grams of the padded lower-case words (trigram similarity)."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(
        F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)))
    return F.array_distinct(F.flatten(grams))


# Whitespace as Python's str.strip() sees it (ASCII blanks, separators, C1 next-line), as a regex
# class and as the explicit character set (derived by rule from str.isspace).
PY_WS = r"[\s\p{Z}\x1c-\x1f\x85]"
PY_WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def py_strip(x) -> Column:
    """Strip leading/trailing whitespace with Python ``str.strip()`` semantics (``btrim`` with the
    whitespace set: only the ends of the string are touched)."""
    return F.btrim(_col(x), F.lit(PY_WS_CHARS))
