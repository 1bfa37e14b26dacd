"""Shared pieces of the per-platform normalizers (raw VARIANT -> typed entity)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import first_present, lower_list, py_strip, vget


def fp(keys, typ: str = "string", default=None) -> Column:
    """First present key of the item's VARIANT ``v``."""
    return first_present(F.col("v"), keys, typ, default)


def sfp(keys, default=None) -> Column:
    """First present key as stripped text (string fields are stripped on the model)."""
    return py_strip(fp(keys, "string", default))


def flag(keys) -> Column:
    """Python ``bool(first_present(..., default=False))`` for JSON booleans."""
    return F.coalesce(fp(keys, "boolean"), F.lit(False))


def explicit_or(extracted: Column, path: str) -> Column:
    """Explicit tag list when non-empty, else the extracted one; cleaned with F8."""
    explicit = vget(F.col("v"), path, "array<string>")
    return lower_list(F.when(F.size(explicit) > 0, explicit).otherwise(extracted))


def media_struct(media_type: Column | str, url: Column) -> Column:
    mt = F.lit(media_type) if isinstance(media_type, str) else media_type
    return F.struct(mt.alias("media_type"), url.alias("url"))


def indexed(media: Column) -> Column:
    """Add ``order_index`` (0-based position) to an array of media structs."""
    return F.transform(media, lambda m, i: F.struct(m["media_type"].alias("media_type"), m["url"].alias("url"),
                                                    i.alias("order_index")))


def media_text(media: str = "media") -> Column:
    """``type|url`` list joined by commas (stable text form for comparisons)."""
    return F.array_join(F.transform(F.col(media), lambda m: F.concat_ws("|", m["media_type"], m["url"])), ",")


EMPTY_MEDIA = "array<struct<media_type:string,url:string>>"
