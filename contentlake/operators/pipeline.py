"""Dependency-ordered ingest of a raw batch into Parquet snapshots.

authors -> channels -> posts -> videos -> comments (parents relinked) -> media -> hashtags/links
-> mentions -> engagement -> embeddings. Each step is one set of DataFrame jobs writing a new
snapshot version of its table; a failing step is recorded and the run continues (per-entity
isolation). Ids are deterministic (sha2 of the natural key), so a re-run of the same batch
changes no id and adds no row.
"""

from __future__ import annotations

import traceback
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bare_post_id, checksum
from ..schema import JOB_ERRORS_KEPT, NATURAL_KEYS, PlanError
from ..session import checkpoint_dir
from ..sources.raw import object_fault, objects_only
from . import embeddings as E
from .identity import dedupe_last_wins, entity_id
from .merge import insert_new
from .normalize import instagram, twitter, youtube


class Lake:
    """Versioned Parquet tables under one root.

    A table is a folder of change files and a log of versions. Every write puts its rows into a new
    folder ``root/<table>/data-<id>`` and then adds one version file ``root/<table>/_versions/<n>``
    that names the live folders: until that file exists, readers see the version before, so a write
    that fails half-way changes nothing (its folder is removed) and nothing is ever overwritten. The
    cost of a write is that of its batch.

    * ``upsert`` tables are merged on read: of all changes of a key the last one counts, the id and
      ``created_at`` come from the first, ``updated_at`` from the last. ``compact`` rewrites a table
      into one folder; ``upsert`` calls it every ``COMPACT_AFTER`` changes.
    * insert-only tables (media, hashtags, links, mentions) take the rows whose key is new.

    A table that has no version yet is told from the file system; any other error is raised."""

    COMPACT_AFTER = 16

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.last_counts: dict[str, dict[str, int]] = {}
        self.run_id = self._next_run()

    # --- versions ------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return sorted(st.getPath().getName() for st in fs.listStatus(path)) if fs.exists(path) else []

    def _version(self, table: str) -> tuple[int, list[str]]:
        """(number, live folders) of a table; (0, []) before its first write."""
        versions = [int(n) for n in self._names(table, "_versions") if n.isdigit()]
        if not versions:
            return 0, []
        fs, path = self._path(table, "_versions", f"{max(versions):010d}")
        size = fs.getFileStatus(path).getLen()
        stream = fs.open(path)
        try:
            text = bytes(stream.readNBytes(int(size))).decode()
        finally:
            stream.close()
        return max(versions), text.split()

    def _commit(self, table: str, before: int, folders: list[str]) -> None:
        """Adds the version after ``before``; an existing one means that another writer was faster."""
        fs, path = self._path(table, "_versions", f"{before + 1:010d}")
        _, temp = self._path(table, "_versions", f"_{uuid.uuid4().hex}")
        stream = fs.create(temp, False)
        stream.write("\n".join(folders).encode())
        stream.close()
        if fs.exists(path) or not fs.rename(temp, path):
            fs.delete(temp, False)
            raise PlanError(f"table {table} was changed by another writer")

    def _write(self, table: str, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        try:
            rows.write.option("compression", "zstd").parquet(f"{self.root}/{table}/{folder}")
        except Exception:
            self._remove(table, folder)
            raise
        return folder

    def _remove(self, table: str, folder: str) -> None:
        fs, path = self._path(table, folder)
        fs.delete(path, True)

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{table}/{f}" for f in folders])

    # --- runs and jobs -------------------------------------------------------------------------------

    def _next_run(self) -> int:
        _, folders = self._version("_runs")
        return 1 + (self._rows("_runs", folders).agg(F.max("run")).first()[0] if folders else 0)

    def begin_run(self) -> int:
        self.run_id = self._next_run()
        return self.run_id

    def _append(self, table: str, rows: DataFrame) -> None:
        n, folders = self._version(table)
        self._commit(table, n, [*folders, self._write(table, rows)])

    def end_run(self) -> None:
        self._append("_runs", self.spark.createDataFrame([(self.run_id,)], "run long"))

    def job_event(self, seq: int, status: str, records: int | None = None, error: str | None = None) -> None:
        """Append a job event (running -> succeeded / partial / failed) to ``job_events``."""
        self._append("job_events", self.spark.createDataFrame(
            [(self.run_id, seq, status, records, error)],
            "job_id long, event_seq int, status string, records_scraped long, error string"))

    def jobs(self) -> DataFrame | None:
        """Current state of every job: its last event."""
        from .merge import latest_status
        _, folders = self._version("job_events")
        return latest_status(self._rows("job_events", folders), "job_id", "event_seq") if folders else None

    def quarantine(self, bad: DataFrame) -> int:
        """Keeps items that cannot be normalized, with their reason; returns how many."""
        name = "quarantine_rows"
        n, folders = self._version(name)
        folder = self._write(name, bad.select("platform", "target", "raw", "reason", F.lit(self.run_id).alias("run")))
        count = self._rows(name, [folder]).count()
        if count:
            self._commit(name, n, [*folders, folder])
        else:
            self._remove(name, folder)
        return count

    # --- upserted tables -----------------------------------------------------------------------------

    def _merged(self, table: str, folders: list[str], columns: list[str] | None = None) -> DataFrame:
        """Last change per key. Keys and id column travel with the rows, so that any reader can merge. Of other
        columns only the given ones are merged (all, if None): what nobody reads is not shuffled."""
        rows = self._rows(table, folders)
        mark = rows.schema["_keys"].metadata
        keys, id_col = mark["keys"], mark["id"]
        if columns is not None:
            rows = rows.select(*[c for c in rows.columns if c in {*columns, *keys, id_col, "_keys", "_seq", "_at"}])
        if len(folders) == 1 and not mark.get("compacted"):  # one batch, which has no key twice
            return rows.select(*[c for c in rows.columns if c not in ("_keys", "_seq", "_at")], F.col("_at").alias("created_at"),
                               F.col("_at").alias("updated_at"), "_seq")
        plain = [c for c in rows.columns if c not in keys and c not in (id_col, "_keys", "_seq", "_at")]
        agg = [F.max_by(F.struct(*plain), "_seq").alias("_last")] if plain else []
        first = [] if id_col in keys else [F.min_by(id_col, "_seq").alias(id_col)]
        out = rows.groupBy(*keys).agg(*first, *agg, F.min("_at").alias("created_at"), F.max("_at").alias("updated_at"),
                                      F.max("_seq").alias("_seq"))
        return out.select(*[c if c in keys or c == id_col else F.col(f"_last.{c}") for c in rows.columns
                            if c not in ("_keys", "_seq", "_at")], "created_at", "updated_at", "_seq")

    def read(self, table: str, columns: list[str] | None = None) -> DataFrame | None:
        _, folders = self._version(table)
        return self._merged(table, folders, columns).drop("_seq") if folders else None

    def changes(self, table: str, columns: list[str]) -> tuple[DataFrame | None, list[str], str]:
        """All changes of a table, not merged: keys, id, ``_seq`` and the given columns; with the names of keys and id."""
        _, folders = self._version(table)
        if not folders:
            return None, [], ""
        rows = self._rows(table, folders)
        mark = rows.schema["_keys"].metadata
        return rows.select(*mark["keys"], mark["id"], "_seq", *columns), mark["keys"], mark["id"]

    def upsert(self, table: str, batch: DataFrame, keys: list[str], id_col: str) -> tuple[int, int]:
        """Upsert ``batch`` into ``table``; returns (inserted, updated). A key that occurs twice in the
        batch is refused. Columns that only the batch has are added to the table."""
        n, folders = self._version(table)
        mark = F.lit(None).cast("string").alias("_keys", metadata={"keys": list(keys), "id": id_col})
        rows = batch.drop("created_at", "updated_at").select("*", mark, F.lit(n + 1).cast("long").alias("_seq"),
                                                             F.current_timestamp().alias("_at"))
        folder = self._write(table, rows)
        try:
            new = self._rows(table, [folder]).select(*keys)
            most, total = new.groupBy(*keys).count().agg(F.max("count"), F.coalesce(F.sum("count"), F.lit(0))).first()
            if total and most > 1:
                raise PlanError(f"{table}: the batch has a key twice: {new.groupBy(*keys).count().where('count > 1').first().asDict()}")
            known = new.join(self._rows(table, folders).select(*keys), list(keys), "left_semi").count() if folders else 0
            self._commit(table, n, [*folders, folder])
        except Exception:
            self._remove(table, folder)
            raise
        self.last_counts[table] = {"insert": total - known, "update": known}
        if len(folders) + 1 >= self.COMPACT_AFTER:
            self.compact(table)
        return total - known, known

    def compact(self, table: str) -> None:
        """One folder instead of many changes; both times and ids are kept as two rows where they differ.
        Folders of earlier versions stay for readers that are under way; ``vacuum`` removes them."""
        n, folders = self._version(table)
        rows = self._rows(table, folders)
        mark = rows.schema["_keys"].metadata
        merged = self._merged(table, folders)
        kept = [c for c in merged.columns if c not in ("created_at", "updated_at", "_seq")]
        tag = F.lit(None).cast("string").alias("_keys", metadata=mark | {"compacted": True})
        last = merged.select(*kept, tag, F.col("_seq"), F.col("updated_at").alias("_at"))
        first = merged.where("created_at <> updated_at").select(*kept, tag, F.lit(0).cast("long").alias("_seq"),
                                                                F.col("created_at").alias("_at"))
        self._commit(table, n, [self._write(table, last.unionByName(first))])

    def vacuum(self, table: str) -> int:
        """Removes folders that the current version does not name; returns how many."""
        _, live = self._version(table)
        dead = [f for f in self._names(table) if f.startswith("data-") and f not in live]
        for f in dead:
            self._remove(table, f)
        return len(dead)

    # --- insert-only tables --------------------------------------------------------------------------

    def read_rows(self, table: str) -> DataFrame | None:
        """An insert-only table."""
        _, folders = self._version(f"{table}_rows")
        return self._rows(f"{table}_rows", folders) if folders else None

    def append_new(self, table: str, batch: DataFrame, keys: list[str]) -> int:
        """Insert rows whose key is absent (media by url, mentions by username, tag links): an anti join
        with the keys stored before; returns the rows added."""
        name = f"{table}_rows"
        n, folders = self._version(name)
        fresh = insert_new(self._rows(name, folders), batch, keys)[0] if folders else batch.dropDuplicates(keys)
        folder = self._write(name, fresh)
        self._commit(name, n, [*folders, folder])
        return self._rows(name, [folder]).count()


@dataclass
class Report:
    counters: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    @property
    def total_records(self) -> int:
        return sum(self.counters.get(k, 0) for k in ("authors_upserted", "channels_upserted", "posts_upserted",
                                                    "videos_upserted", "comments_upserted"))

    steps_ok: int = 0

    @property
    def status(self) -> str:
        if self.errors and self.steps_ok == 0:
            return "failed"
        return "partial" if self.errors else "succeeded"


MODULES = {"instagram": instagram, "twitter": twitter, "youtube": youtube}
POST_COLUMNS = ["item_seq", "platform", "platform_post_id", "author_native_id", "content_type", "caption", "content",
                "url", "hashtags", "mentions", "urls", "media", "posted_at"]
COMMENT_COLUMNS = ["item_seq", "platform", "platform_comment_id", "post_ref", "author_native_id", "parent_native_id",
                   "content", "likes", "posted_at"]


def _post_items(platform: str, raw: DataFrame) -> DataFrame:
    """All that the steps take from a platform's post items, by one pass over them. A content that repeats the caption
    is left out (``_same``)."""
    mod, keep = MODULES[platform], {"_author": F.struct(*MODULES[platform].author_key())}
    if platform == "youtube":
        keep |= {"_channel": F.struct(*youtube.channel_columns()), "_video": F.struct(*youtube.video_columns())}
    p = _tagged(mod.post, raw, keep)
    same = F.col("caption").eqNullSafe(F.col("content"))
    counts = [c for c in p.columns if c.endswith("_count") and c not in POST_COLUMNS]
    return p.select(*[c for c in POST_COLUMNS if c != "content"], F.when(~same, F.col("content")).alias("content"),
                    same.alias("_same"), *counts, *keep, "_target", "_raw", "_reason")


def _comment_items(platform: str, raw: DataFrame) -> DataFrame:
    """All that the steps take from a platform's comment items, by one pass over them."""
    c = _tagged(MODULES[platform].comment, raw, {"_author": F.struct(*twitter.author_key())} if platform == "twitter" else {})
    if platform == "instagram":
        author = F.struct(F.col("author_native_id").alias("platform_user_id"),
                          F.coalesce("owner_username", F.lit("unknown")).alias("username"))
    elif platform == "youtube":
        # Comment items carry no channel id: the display name is the author key (K7).
        c = c.withColumn("author_native_id", F.col("author_display_name"))
        author = F.when(F.col("author_native_id").isNotNull(),
                        F.struct(F.col("author_native_id").alias("platform_user_id"), F.col("author_native_id").alias("username")))
    else:
        author = F.col("_author")
    return c.select(*COMMENT_COLUMNS, author.alias("_author"), "_target", "_raw", "_reason")


def _tagged(normalize, raw: DataFrame, keep: dict) -> DataFrame:
    """``normalize`` over all items, with their fault (``_reason``; none in an object) and the text of faulty ones."""
    none = F.lit(None).cast("string")
    reason = object_fault() if {"v", "raw"} <= set(raw.columns) else none  # any other frame fails in the steps that read it
    keep = keep | {"_reason": reason} | {f"_{c}": F.when(reason.isNotNull(), F.col(c)) if c in raw.columns else none for c in ("target", "raw")}
    return normalize(raw.select("*", *[c.alias(name) for name, c in keep.items()]), *keep)


class Items:
    """The items of a batch, normalized once: each platform's items are written to the shared folder by one pass, and
    the steps read the columns that they use. Items that cannot be written are normalized anew by each step that
    reads them, which then fails by itself."""

    def __init__(self, spark: SparkSession, posts_raw: dict[str, DataFrame], comments_raw: dict[str, DataFrame]):
        self.spark, self.path = spark, f"{checkpoint_dir(spark).rstrip('/')}/items-{uuid.uuid4().hex}"
        self._twice: dict[str, DataFrame | None] = {}
        self._lock = Lock()
        todo = [(kind, make, plat, raws[plat]) for kind, make, raws in (("posts", _post_items, posts_raw), ("comments", _comment_items, comments_raw))
                for plat in MODULES if plat in raws]
        with ThreadPoolExecutor(max_workers=max(len(todo), 1)) as pool:
            done = list(pool.map(lambda x: self._stage(*x), todo))
        self._parts = {(kind, plat): get for (kind, _, plat, _), get in zip(todo, done)}
        self._checked = {(kind, plat) for kind, _, plat, raw in todo if {"v", "raw"} <= set(raw.columns)}

    def _stage(self, kind: str, make, plat: str, raw: DataFrame):
        try:
            path = f"{self.path}/{kind}-{plat}"
            make(plat, raw).write.option("compression", "zstd").parquet(path)
            df = self.spark.read.parquet(path)
            return lambda: df
        except Exception:  # noqa: BLE001 - the steps that read these items fail, not the run
            return lambda: make(plat, raw)

    def faulty(self) -> list[DataFrame]:
        """The items that are no JSON object, as (platform, target, raw, reason)."""
        return [get().where(F.col("_reason").isNotNull()).select(F.lit(plat).alias("platform"), F.col("_target").alias("target"),
                                                              F.col("_raw").alias("raw"), F.col("_reason").alias("reason"))
                for (kind, plat), get in self._parts.items() if (kind, plat) in self._checked]

    def part(self, kind: str, plat: str) -> DataFrame:
        """The items of one platform that are JSON objects."""
        d = self._parts[kind, plat]().where(F.col("_reason").isNull())
        return d if kind == "comments" else d.withColumn("content", F.when(F.col("_same"), F.col("caption")).otherwise(F.col("content")))

    def platforms(self, kind: str) -> list[str]:
        return [plat for k, plat in self._parts if k == kind]

    def _rows(self, kind: str, columns: list[str]) -> DataFrame:
        def rows(plat):
            d = self.part(kind, plat)
            if (kind, plat) == ("comments", "twitter"):
                d = twitter.exclude_root(d)
            return d.select(*columns)

        return reduce(DataFrame.unionByName, [rows(plat) for plat in self.platforms(kind)])

    def one_per_key(self, kind: str, rows: DataFrame) -> DataFrame:
        """D1 on rows of posts or comments. Rows are not shuffled unless their key comes twice in the batch."""
        keys = NATURAL_KEYS[kind]
        with self._lock:
            if kind not in self._twice:
                path = f"{self.path}/twice-{kind}"
                self._rows(kind, keys).groupBy(*keys).count().where("count > 1") \
                    .select(*[F.col(k).alias(f"_{k}") for k in keys]).write.mode("overwrite").parquet(path)
                twice = self.spark.read.parquet(path)
                self._twice[kind] = None if twice.isEmpty() else twice
            twice = self._twice[kind]
        if twice is None:
            return rows
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        return rows.join(twice, same, "left_anti").unionByName(
            dedupe_last_wins(rows.join(twice, same, "left_semi"), keys).drop("first_seq").select(*rows.columns))

    def posts(self, columns: list[str]) -> DataFrame:
        """The batch's posts, one per key, with their ids and the given columns."""
        cols = [c for c in POST_COLUMNS if c in {*columns, *POST_COLUMNS[:4]}]
        return self.one_per_key("posts", self._rows("posts", cols)).select(
            entity_id("platform", "platform_post_id").alias("post_id"), entity_id("platform", "author_native_id").alias("author_id"),
            *[c for c in cols[1:] if c != "author_native_id"])

    def comments(self, columns: list[str]) -> DataFrame:
        """The batch's comments, one per key, with the given columns."""
        return self.one_per_key("comments", self._rows("comments", [c for c in COMMENT_COLUMNS if c in {*columns, *COMMENT_COLUMNS[:3]}]))

    def authors(self, profiles_raw: dict[str, DataFrame] | None = None) -> DataFrame:
        from ..sources.raw import first_per_target
        from .identity import canonical_first_seen
        cols = ["item_seq", "platform", "platform_user_id", "username"]
        # A profile scrape keeps only the first item of each target.
        parts = [MODULES[plat].author(first_per_target(df)).select(*cols) for plat, df in (profiles_raw or {}).items()]
        for kind, plat in self._parts:
            d = self.part(kind, plat).where(F.col("_author").isNotNull())
            parts.append(d.select("item_seq", "platform", "_author.platform_user_id", "_author.username"))
        # Canonical first-seen attributes per key, as the scrapers register authors.
        a = canonical_first_seen(reduce(DataFrame.unionByName, parts), ["platform", "platform_user_id"])
        return a.select(entity_id("platform", "platform_user_id").alias("author_id"), "platform", "platform_user_id", "username")

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ingest(spark: SparkSession, lake: Lake, posts_raw: dict[str, DataFrame], comments_raw: dict[str, DataFrame],
           provider=None, profiles_raw: dict[str, DataFrame] | None = None) -> Report:
    """Run one batch through every step; returns counters, errors and the job status.
    ``profiles_raw`` (profile scrapes) contribute authors only, first item per target."""
    rep = Report()
    lake.begin_run()
    lake.job_event(0, "running")
    items = Items(spark, posts_raw, comments_raw)
    split: list[DataFrame] = []

    def good_items(raws: dict[str, DataFrame] | None, staged=()) -> dict[str, DataFrame]:
        out = {}
        for plat, raw in (raws or {}).items():
            if plat not in staged and {"v", "raw"} <= set(raw.columns):  # any other frame fails in the steps that read it
                raw, bad = objects_only(raw)
                split.append(bad.select(F.lit(plat).alias("platform"), "target", "raw", "reason"))
            out[plat] = raw
        return out

    posts_raw, comments_raw, profiles_raw = good_items(posts_raw, MODULES), good_items(comments_raw, MODULES), good_items(profiles_raw)

    def do_quarantine():
        parts = items.faulty() + split
        if parts:
            rep.counters["quarantined"] = lake.quarantine(reduce(DataFrame.unionByName, parts))

    def step(name: str, fn) -> None:
        try:
            fn()
            rep.steps_ok += name != "quarantine"
        except Exception as e:  # noqa: BLE001 - isolate the entity, keep going
            rep.errors.append(f"{name}: {type(e).__name__}: {str(e).splitlines()[0][:200]}")
            traceback.print_exc()

    def do_authors():
        ins, upd = lake.upsert("authors", items.authors(profiles_raw), NATURAL_KEYS["authors"],
                               "author_id")
        rep.counters["authors_upserted"] = ins + upd

    def do_channels():
        if "youtube" not in posts_raw:
            return
        ch = items.part("posts", "youtube").select("item_seq", "platform", "_channel.*")
        ch = dedupe_last_wins(ch, NATURAL_KEYS["channels"]).drop("first_seq")
        ch = ch.select(entity_id("platform", "platform_channel_id").alias("channel_id"),
                       entity_id("platform", "author_native_id").alias("author_id"), "platform", "platform_channel_id",
                       "name", "subscriber_count")
        ins, upd = lake.upsert("channels", ch, NATURAL_KEYS["channels"], "channel_id")
        rep.counters["channels_upserted"] = ins + upd

    def do_posts():
        if not posts_raw:
            return
        p = items.posts([c for c in POST_COLUMNS if c not in ("media", "mentions")])
        ins, upd = lake.upsert("posts", p, NATURAL_KEYS["posts"], "post_id")
        rep.counters["posts_upserted"] = ins + upd

    def do_videos():
        if "youtube" not in posts_raw:
            return
        v = items.part("posts", "youtube").select("item_seq", "platform", "_video.*")
        v = dedupe_last_wins(v, NATURAL_KEYS["videos"]).drop("first_seq")
        v = v.select(entity_id("platform", "platform_video_id").alias("video_id"),
                     entity_id("platform", "channel_native_id").alias("channel_id"),
                     entity_id("platform", "post_native_id").alias("post_id"), "platform", "platform_video_id",
                     "title", "duration_seconds", "video_url", "published_at")
        ins, upd = lake.upsert("videos", v, NATURAL_KEYS["videos"], "video_id")
        rep.counters["videos_upserted"] = ins + upd

    def do_comments():
        if not comments_raw:
            return
        # References are resolved on rows without texts, which join the comments by their key in the end.
        c = items.comments(["post_ref", "parent_native_id"])
        stored = lake.read("posts", ["url"])
        # Post reference (K5): a bare id, or a URL -- watch?v=<id>, /status/<id>, /p/<code>/, /reel/<code>/ --
        # resolved by natural key, else by the stored post URL; unresolved references are kept as given.
        ref = (F.when(F.col("post_ref").contains("watch?v="),
                      F.split_part(F.split_part("post_ref", F.lit("v="), F.lit(2)), F.lit("&"), F.lit(1)))
               .when(F.col("post_ref").rlike("/(p|reel)/[^/?#]+"), F.regexp_extract("post_ref", "/(?:p|reel)/([^/?#]+)", 1))
               .otherwise(bare_post_id(F.col("post_ref"))))
        by_id = stored.select("platform", F.col("platform_post_id").alias("_ref"), F.col("post_id").alias("_by_id"))
        by_url = stored.select("platform", F.col("url").alias("post_ref"), F.col("post_id").alias("_by_url"))
        c = c.withColumn("_ref", ref).join(by_id, ["platform", "_ref"], "left").join(by_url, ["platform", "post_ref"], "left")
        c = c.withColumn("post_id", F.coalesce("_by_id", "_by_url", F.col("post_ref")))
        # Parent link only when the parent is part of the stored set (D6), on native ids.
        known = items.comments([]).select(F.col("platform").alias("_pp"), F.col("platform_comment_id").alias("_pn"))
        prev = lake.read("comments", [])
        if prev is not None:
            known = known.unionByName(prev.select(F.col("platform").alias("_pp"), F.col("platform_comment_id").alias("_pn")))
        known = known.distinct()
        c = c.join(known, (F.col("platform") == F.col("_pp")) & (F.col("parent_native_id") == F.col("_pn")), "left") \
             .withColumn("parent_comment_id", F.when(F.col("_pn").isNotNull(), entity_id("platform", "parent_native_id")))
        c = c.select(*NATURAL_KEYS["comments"], "post_id", "parent_comment_id")
        c = items.comments(["author_native_id", "content", "likes", "posted_at"]).join(c, NATURAL_KEYS["comments"]) \
            .withColumn("comment_id", entity_id("platform", "platform_comment_id")) \
            .withColumn("author_id", entity_id("platform", "author_native_id"))
        c = c.select("comment_id", "platform", "platform_comment_id", "post_id", "author_id", "parent_comment_id",
                     "content", "likes", "posted_at")
        ins, upd = lake.upsert("comments", c, NATURAL_KEYS["comments"], "comment_id")
        rep.counters["comments_upserted"] = ins + upd

    def do_media():
        if not posts_raw:
            return
        m = items.posts(["media"]).select("post_id", F.explode("media").alias("m")).select(
            "post_id", F.col("m.media_type").alias("media_type"), F.col("m.url").alias("url"),
            F.col("m.order_index").alias("order_index"))
        rep.counters["media_created"] = lake.append_new("media", m, ["post_id", "url"])

    def do_hashtags():
        if not posts_raw:
            return
        links = items.posts(["hashtags"]).select("post_id", F.explode("hashtags").alias("tag")).where(F.col("tag") != "").distinct()
        tags = links.select("tag").distinct().withColumn("hashtag_id", F.sha2("tag", 256))
        lake.append_new("hashtags", tags, ["tag"])
        l2 = links.withColumn("hashtag_id", F.sha2("tag", 256)).select("post_id", "hashtag_id")
        rep.counters["hashtags_linked"] = lake.append_new("post_hashtags", l2, ["post_id", "hashtag_id"])

    def do_mentions():
        if not posts_raw:
            return
        m = items.posts(["mentions"]).select("post_id", F.explode("mentions").alias("username")).where(F.col("username") != "")
        rep.counters["mentions_created"] = lake.append_new("mentions", m, ["post_id", "username"])

    def do_engagement():
        if not posts_raw:
            return
        parts = []
        for plat, mod in (("instagram", instagram), ("twitter", twitter), ("youtube", youtube)):
            if plat in posts_raw:
                p = items.part("posts", plat)
                p = p.select("item_seq", *NATURAL_KEYS["posts"], *[x for x in p.columns if x.endswith("_count")])
                parts.append(mod.engagement(items.one_per_key("posts", p)))
        e = parts[0]
        for p in parts[1:]:
            e = e.unionByName(p)
        e = e.select(entity_id("platform", "platform_post_id").alias("post_id"), "likes", "views", "shares",
                     "comments_count", "saves")
        ins, upd = lake.upsert("engagement", e, ["post_id"], "post_id")
        rep.counters["engagement_upserted"] = ins + upd

    def changed_texts(existing: DataFrame) -> DataFrame | None:
        """The pending items of the stored posts and comments. Changes are merged and compared by their checksums; texts
        are taken from the changes that are pending."""
        out = []
        for table, columns, source_type, text in (("posts", ["caption", "content"], "post", E.post_text()),
                                                  ("comments", ["content"], "comment", E.comment_text())):
            rows, keys, id_col = lake.changes(table, columns)
            if rows is None:
                continue
            rows = rows.select(*keys, F.col(id_col).cast("string").alias("_id"), "_seq", text.alias("text"))
            last = rows.select(*keys, "_id", "_seq", checksum(F.nullif("text", F.lit(""))).alias("checksum")).groupBy(*keys).agg(
                F.min_by("_id", "_seq").alias("source_id"), F.max_by("checksum", "_seq").alias("checksum"), F.max("_seq").alias("_seq"))
            last = last.where(F.col("checksum").isNotNull()).withColumn("source_type", F.lit(source_type))
            path = f"{items.path}/pending-{table}"
            E.pending(last, existing.select("source_type", "source_id", "model", "checksum"), provider.model_name).write.parquet(path)
            pend = spark.read.parquet(path)
            first = pend.agg(F.min("_seq")).first()[0]
            if first is None:
                rows, pend = rows.where(F.lit(False)), pend.where(F.lit(False))
            pend = pend.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_seq").alias("_s"), "source_type", "source_id", "checksum")
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            out.append(rows.where(F.col("_seq") >= F.lit(first)).join(pend, same & (F.col("_seq") == F.col("_s")))
                       .select("source_type", "source_id", "checksum", "text"))
        return reduce(DataFrame.unionByName, out) if out else None

    def do_embeddings():
        if provider is None:
            return
        existing = lake.read("embeddings", ["checksum"])
        if existing is not None:
            pend = changed_texts(existing)
            if pend is None:
                return
        else:  # all texts are new
            sp, sc = lake.read("posts", ["caption", "content"]), lake.read("comments", ["content"])
            if sp is None and sc is None:
                return
            p = (sp.select("post_id", "platform", "caption", "content") if sp is not None else
                 spark.createDataFrame([], "post_id string, platform string, caption string, content string"))
            c = (sc.select("comment_id", "platform", "content") if sc is not None else
                 spark.createDataFrame([], "comment_id string, platform string, content string"))
            pend = E.pending(E.embeddable_items(p, c), None, provider.model_name)
        vecs = E.embed(pend, provider).select("source_type", "source_id", "model", "checksum", "dimensions", "vector")
        ins, upd = lake.upsert("embeddings", vecs, ["source_id", "source_type", "model"], "source_id")
        rep.counters["embeddings_generated"] = ins + upd

    # Dependency order: authors -> channels -> posts -> videos -> comments; then media, tags, mentions
    # and engagement depend only on the batch's posts and write different tables, so their Spark
    # jobs are submitted together; embeddings read the stored posts and comments last.
    for name, fn in (("quarantine", do_quarantine), ("authors", do_authors), ("channels", do_channels), ("posts", do_posts), ("videos", do_videos),
                     ("comments", do_comments)):
        step(name, fn)
    independent = (("media", do_media), ("hashtags", do_hashtags), ("mentions", do_mentions),
                   ("engagement", do_engagement))
    with ThreadPoolExecutor(max_workers=len(independent)) as pool:
        list(pool.map(lambda nf: step(*nf), independent))
    step("embeddings", do_embeddings)
    lake.job_event(1, rep.status, rep.total_records if rep.status != "failed" else None,
                   "; ".join(rep.errors[:JOB_ERRORS_KEPT]) or None)
    lake.end_run()
    items.remove()
    return rep
