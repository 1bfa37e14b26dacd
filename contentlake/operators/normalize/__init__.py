"""Per-platform normalizers (X2 registry): raw items -> typed entity DataFrames.

Adding a platform = one module with ``author``/``post``/``comment``/``engagement``
functions registered here with ``@platform``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import instagram, twitter, youtube

NORMALIZERS: dict[str, object] = {}


def platform(name: str):
    def deco(module):
        NORMALIZERS[name] = module
        return module
    return deco


for _name, _mod in (("instagram", instagram), ("twitter", twitter), ("youtube", youtube)):
    platform(_name)(_mod)


def normalizer(name: str):
    from ...schema import PlanError
    if name not in NORMALIZERS:
        raise PlanError(f"no normalizer for platform {name!r}")
    return NORMALIZERS[name]


def engagement_all(posts_by_platform: dict[str, DataFrame]) -> DataFrame:
    """Engagement rows for every platform; a platform without a builder becomes per-row errors."""
    out = None
    for plat, posts in posts_by_platform.items():
        mod = NORMALIZERS.get(plat)
        if mod is None:
            part = posts.select(F.lit(plat).alias("platform"), F.col("platform_post_id"),
                                *[F.lit(None).cast("bigint").alias(c) for c in
                                  ("likes", "views", "shares", "comments_count", "saves")]) \
                        .withColumn("error", F.lit(f"unknown platform {plat}"))
        else:
            part = mod.engagement(posts).withColumn("error", F.lit(None).cast("string"))
        out = part if out is None else out.unionByName(part)
    return out


Builder = Callable[[DataFrame], DataFrame]
