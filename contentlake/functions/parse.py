"""Typed reads of drifting raw values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def vget(v, path: str, typ: str = "string") -> Column:
    """Typed field of a VARIANT; NULL when missing or not castable."""
    return F.try_variant_get(_col(v), path, typ)


def first_present(v, keys: Sequence[str], typ: str = "string", default=None) -> Column:
    """First non-null among ``$.key`` paths of a VARIANT, else ``default``. The key is picked before
    its value is cast: a present value that cannot be cast gives NULL, not the next key."""
    paths = [k if k.startswith("$") else f"$.{k}" for k in keys]
    if typ == "string":  # what is present is read already
        found = [vget(v, p) for p in paths]
        if default is not None:
            found.append(default if isinstance(default, Column) else F.lit(default))
        return F.coalesce(*found)
    typed, missing = vget(v, paths[-1], typ), F.lit(True)
    for i, p in reversed(list(enumerate(paths))):
        there = vget(v, p, "string").isNotNull()
        missing = missing & ~there
        typed = F.when(there, vget(v, p, typ)).otherwise(typed) if i < len(paths) - 1 else typed
    if default is None:
        return typed
    return F.when(missing, default if isinstance(default, Column) else F.lit(default)).otherwise(typed)


def as_int(x) -> Column:
    """Python int(): numeric strings ok, floats truncate, '3.9' and junk give NULL."""
    return _col(x).try_cast("bigint")


def as_float(x) -> Column:
    return _col(x).try_cast("double")


def variant_int(v, keys: Sequence[str]) -> Column:
    """First present key read as an integer with Python int() rules."""
    return first_present(v, keys, "bigint")


def parse_ts(x) -> Column:
    """ISO-8601 text (``Z`` allowed) or epoch seconds to a UTC wall-clock TIMESTAMP_NTZ."""
    c = _col(x)
    s = c.cast("string")
    as_num = s.try_cast("double")
    from_epoch = F.timestamp_seconds(as_num)
    from_iso = F.try_to_timestamp(s)
    ts = F.when(s.rlike(r"^-?\d+(\.\d+)?$"), from_epoch).otherwise(from_iso)
    return ts.cast("timestamp_ntz")


def parse_ts_native(x) -> Column:
    """ISO text, else the native ``Wed Oct 10 20:19:24 +0000 2018`` form."""
    s = _col(x).cast("string")
    native = F.try_to_timestamp(F.substring(s, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))
    iso = F.when(s.rlike(r"^\d{4}-"), F.try_to_timestamp(s))
    return F.coalesce(iso, native).cast("timestamp_ntz")


def duration_seconds(x, is_number: Column | None = None) -> Column:
    """Seconds from a number, or ``H:M:S`` / ``M:S`` digit groups; else NULL."""
    s = _col(x).cast("string")
    parts = F.split(s, ":")
    hms = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.cast("double"))
    num = s.try_cast("double")
    out = F.when(s.rlike(r"^\d+(:\d+)*$"), hms)
    if is_number is not None:
        out = F.when(is_number, num).otherwise(out)
    return out


def variant_duration(v, path: str) -> Column:
    """Duration field of a VARIANT: numbers as is, strings as ``H:M:S``."""
    field = F.try_variant_get(_col(v), path, "variant")
    is_num = F.schema_of_variant(field).isin("BIGINT", "DOUBLE", "FLOAT", "INT") | \
        F.schema_of_variant(field).startswith("DECIMAL")
    return duration_seconds(F.try_variant_get(_col(v), path, "string"), is_num)


def parse_vector(x) -> Column:
    """``'[0.1,0.2]'`` text to array<float>."""
    return F.from_json(_col(x), "array<float>")


def filters_json(**cols: Column) -> Column:
    """JSON object of the set filters only (NULL fields are dropped)."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]))
