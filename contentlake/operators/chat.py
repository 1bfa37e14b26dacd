"""Conversation operators.

Per-conversation text (history, memory, Markdown) is built from a window-ranked,
already-bounded set of rows per conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import display_title
from ..schema import HISTORY_FETCH, MAX_HISTORY_TURNS, PROMPT_LOG_CHARS
from .order_stats import statistics


def history(messages: DataFrame, limit: int = 200) -> DataFrame:
    """Messages per conversation in ascending time, at most ``limit`` each."""
    w = Window.partitionBy("conversation_id").orderBy("created_at", "turn")
    return messages.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def memory_window(messages: DataFrame, turns: int = MAX_HISTORY_TURNS, fetch: int = HISTORY_FETCH,
                  parity: bool = False) -> DataFrame:
    """The last ``turns`` messages as ``role: content`` lines.

    ``parity`` reproduces the reference: it fetches the *first* ``fetch`` messages and
    keeps the last ``turns`` of those (K8)."""
    base = messages
    if parity:
        wa = Window.partitionBy("conversation_id").orderBy("created_at", "turn")
        base = base.withColumn("_a", F.row_number().over(wa)).where(F.col("_a") <= fetch).drop("_a")
    wd = Window.partitionBy("conversation_id").orderBy(F.col("created_at").desc(), F.col("turn").desc())
    last = base.withColumn("_d", F.row_number().over(wd)).where(F.col("_d") <= turns)
    g = last.groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(F.struct("created_at", "turn", F.concat_ws(": ", "role", "content").alias("line"))))
        .alias("xs"))
    return g.select("conversation_id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("memory"))


def markdown_export(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """One Markdown text per conversation: title, then each message with speaker and time."""
    speaker = F.when(F.col("role") == "user", F.lit("**You**")).otherwise(F.lit("**Assistant**"))
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    block = F.concat(speaker, F.lit(" ("), iso, F.lit("+00:00):\n"), F.col("content"), F.lit("\n"))
    from .concat import ordered_concat
    # Order key: message time in microseconds, then turn (unique within a conversation).
    order = F.unix_micros(F.col("created_at").cast("timestamp")) * 1000 + F.col("turn")
    m = messages.select("conversation_id", order.alias("_o"), block.alias("block"))
    g = ordered_concat(m, ["conversation_id"], "_o", "block", "\n", "body", span=1024 * 1000 * 1000 * 60)
    c = chats.select("conversation_id", display_title("title").alias("display_title"))
    j = c.join(g, "conversation_id", "left")
    head = F.concat(F.lit("# "), F.col("display_title"), F.lit("\n"))
    return j.select("conversation_id", F.when(F.col("body").isNotNull(), F.concat(head, F.lit("\n"), F.col("body")))
                    .otherwise(head).alias("markdown"))


def turn_log_rows(turns: DataFrame) -> DataFrame:
    """One turn -> user message, assistant message, query log (ids without ``sql:``) and
    assistant log (prompt cut to 4000 chars), as rows tagged with their target table."""
    user = turns.select(F.lit("messages").alias("tbl"), "conversation_id", "turn", F.lit("user").alias("role"),
                        F.col("question").alias("content"), F.lit(None).cast("string").alias("retrieved_ids"),
                        F.lit(None).cast("string").alias("prompt"))
    asst = turns.select(F.lit("messages").alias("tbl"), "conversation_id", "turn", F.lit("assistant").alias("role"),
                        F.col("answer").alias("content"), F.array_join("sources", ",").alias("retrieved_ids"),
                        F.lit(None).cast("string").alias("prompt"))
    qlog = turns.select(F.lit("query_logs").alias("tbl"), "conversation_id", "turn", F.lit(None).cast("string").alias("role"),
                        F.col("question").alias("content"),
                        F.array_join(F.filter("sources", lambda s: ~s.startswith("sql:")), ",").alias("retrieved_ids"),
                        F.lit(None).cast("string").alias("prompt"))
    alog = turns.select(F.lit("assistant_logs").alias("tbl"), "conversation_id", "turn",
                        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"),
                        F.lit(None).cast("string").alias("retrieved_ids"),
                        F.substring("prompt", 1, PROMPT_LOG_CHARS).alias("prompt"))
    return user.unionByName(asst).unionByName(qlog).unionByName(alog)


def like_escape(q: str) -> str:
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_by_title(chats: DataFrame, q: str, include_archived: bool = False) -> DataFrame:
    """Case-insensitive substring on the title, newest first; ``%``/``_`` in ``q`` are literal."""
    c = chats if include_archived else chats.where(~F.col("is_archived"))
    pat = "%" + like_escape(q) + "%"
    return c.where(F.col("title").ilike(pat)).orderBy(F.col("updated_at").desc(), F.col("conversation_id"))


def failed_logs(logs: DataFrame, limit: int = 50, parity: bool = False) -> DataFrame:
    """Logs with an error, newest first. Parity (K16) cuts to ``limit`` first, then filters."""
    order = [F.col("created_at").desc(), F.col("log_id").desc()]
    if parity:
        return logs.orderBy(*order).limit(limit).where(F.col("error").isNotNull())
    return logs.where(F.col("error").isNotNull()).orderBy(*order).limit(limit)


def thread_roots(comments: DataFrame) -> DataFrame:
    """A6 helper: (comment_id, root_id, depth) by pointer jumping: log2(depth) self-joins.

    A comment whose parent is not there is the root of its own thread. Each round replaces the
    ancestor of the comments that are still under way by their ancestor's ancestor; only those
    rows are carried on, and every round is checkpointed into the shared ``spark.checkpoint.dir``.
    Each round doubles the depth that is resolved, so rows left after log2(rows) + 1 rounds lead
    into a cycle of parents: they have no root, and their ``root_id`` and ``depth`` are null."""
    from ..session import materialize
    known = comments.select(F.col("comment_id").alias("parent_comment_id"), F.lit(True).alias("_there"))
    start = comments.select("comment_id", "parent_comment_id").join(known, "parent_comment_id", "left")
    open_ = materialize(start.select("comment_id", F.when(F.col("_there"), F.col("parent_comment_id")).alias("anc"),
                                     F.lit(1).alias("depth")))
    done = open_.where("anc is null").select("comment_id", F.col("comment_id").alias("root_id"), F.lit(0).alias("depth"))
    roots = done.select(F.col("comment_id").alias("anc"), F.lit(True).alias("_root"))
    open_ = open_.where("anc is not null")
    n = open_.count()
    for _ in range(n.bit_length() + 1):
        marked = materialize(open_.join(roots, "anc", "left"))
        done = done.unionByName(marked.where("_root").select("comment_id", F.col("anc").alias("root_id"), "depth"))
        open_ = marked.where("_root is null").select("comment_id", "anc", "depth")
        if open_.isEmpty():
            return done
        # The ancestor of a comment under way is under way too, or hangs on a root since this round.
        steps = marked.select(F.col("comment_id").alias("anc"), F.col("anc").alias("_next"), F.col("depth").alias("_steps")) \
                      .unionByName(done.where("depth > 0").select(F.col("comment_id").alias("anc"), F.col("root_id").alias("_next"),
                                                                  F.col("depth").alias("_steps"))).dropDuplicates(["anc"])
        open_ = open_.join(steps, "anc").select("comment_id", F.col("_next").alias("anc"), (F.col("depth") + F.col("_steps")).alias("depth"))
    return done.unionByName(open_.select("comment_id", F.lit(None).cast(done.schema["root_id"].dataType).alias("root_id"),
                                         F.lit(None).cast("int").alias("depth")))


def thread_participants(comments: DataFrame) -> DataFrame:
    """A5: distinct authors per thread (root and all replies)."""
    roots = thread_roots(comments)
    j = comments.select("comment_id", "author").join(roots.where("root_id is not null"), "comment_id")
    return j.groupBy("root_id").agg(F.countDistinct("author").alias("participants"),
                                    F.count(F.lit(1)).alias("n_comments"))


def threads(comments: DataFrame, ranges: int | None = None) -> DataFrame:
    """Thread materialised as rows: each comment with its root, position in time and thread size.

    Positions come from ranges of (root, time, comment): a thread that holds a third of all comments is cut
    into as many ranges as it needs, even if all its comments have one time or none."""
    roots = thread_roots(comments).where("root_id is not null")
    j = comments.select("comment_id", "posted_at").join(roots, "comment_id")
    out = statistics(j, ["root_id"], [("posted_at", True)], ["comment_id"], position="position", group_size="thread_size", ranges=ranges)
    return out.select("root_id", "comment_id", "depth", "position", "thread_size")
