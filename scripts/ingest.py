"""Ingest landing JSON-lines files into a lake (the write path, without any network fetch).

Usage:
  python scripts/ingest.py LAKE_DIR --posts PLATFORM=GLOB[@TARGET] ... --comments PLATFORM=GLOB@POST_REF ...
                           [--profiles PLATFORM=GLOB@TARGET ...]
Example:
  python scripts/ingest.py /shared/lake --posts instagram=landing/ig/*.jsonl@some_account \\
      --comments instagram=landing/ig_c/*.jsonl@https://www.instagram.com/p/CODE/
Prints the run report (counters, errors, status).
"""

from __future__ import annotations

import argparse
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def parse(spec: str):
    plat, rest = spec.split("=", 1)
    glob, _, target = rest.partition("@")
    return plat, glob, (target or None)


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("lake")
    ap.add_argument("--posts", action="append", default=[])
    ap.add_argument("--comments", action="append", default=[])
    ap.add_argument("--profiles", action="append", default=[], help="PLATFORM=GLOB@TARGET profile scrapes")
    ap.add_argument("--dims", type=int, default=64)
    a = ap.parse_args()
    from contentlake.operators.embeddings import HashingProvider
    from contentlake.operators.pipeline import Lake, ingest
    from contentlake.session import get_spark
    from contentlake.sources.raw import batch_union, read_raw
    spark = get_spark()

    def load(specs, mode):
        out = {}
        for spec in specs:
            plat, glob, target = parse(spec)
            df = read_raw(spark, glob, plat, mode, target)
            out[plat] = df if plat not in out else batch_union(out[plat], df)
        return out
    lake = Lake(spark, a.lake)
    rep = ingest(spark, lake, load(a.posts, "posts"), load(a.comments, "comments"), HashingProvider(a.dims),
                 profiles_raw=load(a.profiles, "profile"))
    print(json.dumps({"run": lake.run_id, "status": rep.status, "total_records": rep.total_records,
                      "counters": rep.counters, "errors": rep.errors}))


if __name__ == "__main__":
    main()
