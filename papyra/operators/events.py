"""Event log and keyed state (H1-H8): the realtime page's in-memory logic as table operators.

Ordering is ``(ts, event_id)``.  Sequence work uses the bucketed primitives of
``papyra.functions.sequence`` so that one very active session or track does not land in a single task;
last-write-wins state is a partial aggregate (``max_by``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.columns import blank_to_null
from papyra.functions.sequence import bucketed, running_sum, with_summary

# UI placeholders for items without displayable text.
AWAITING_TRANSCRIPT = "(awaiting transcript)"
ITEM_SENT = "(item sent)"
TRUNCATED = "(truncated)"


def micros(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def collapse_runs(events: DataFrame, session: str = "user_id", kind: str = "event_type",
                  width: int | None = None, buckets: int | None = None) -> DataFrame:
    """H1: consecutive events of one type (NULL is a type too) in a session become one row.  ``repeat_count`` follows the UI
    (run length - 1: the first event has no count, each repeat adds one); ``run_length`` is also given.

    Gaps-and-islands in one bucketed pass: inside each ``(session, bucket)`` a window gives the previous type and a
    running count of run starts; one summary row per bucket (first type, last type, starts) carries the decision for
    the bucket's first row and the start count across buckets.  Buckets are ranges of equal row numbers (``width``:
    of the time, in microseconds), so a very active session is spread over many; only the summaries are ordered per
    session.
    """
    order = ["ts", "event_id"]
    e = bucketed(events.select(session, kind, *order), [session], order, micros("ts"), width, buckets)
    w = Window.partitionBy(session, "_b").orderBy(*order)
    prev = F.lag(kind).over(w)
    first_in_bucket = F.row_number().over(w) == 1
    local = F.when(first_in_bucket, F.lit(0)).when(~prev.eqNullSafe(F.col(kind)), F.lit(1)).otherwise(F.lit(0))
    e = (e.withColumn("_start", local.cast("long"))
          .withColumn("_lrs", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    key = F.struct(*[F.col(c) for c in order])
    summ = e.groupBy(session, "_b").agg(F.min_by(F.col(kind), key).alias("_first"),
                                        F.max_by(F.col(kind), key).alias("_last"),
                                        F.sum("_start").alias("_local"))
    wb = Window.partitionBy(session).orderBy("_b")
    prev_last = F.lag("_last").over(wb)
    summ = summ.withColumn("_fs", F.when((F.row_number().over(wb) == 1) | ~prev_last.eqNullSafe(F.col("_first")), F.lit(1))
                           .otherwise(F.lit(0)).cast("long"))
    summ = summ.withColumn("_before", F.coalesce(
        F.sum(F.col("_local") + F.col("_fs")).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = with_summary(e, summ, [session], ["_fs", "_before"]).withColumn(
        "run_no", F.col("_before") + F.col("_fs") + F.col("_lrs"))
    return (numbered.groupBy(session, "run_no")
            .agg(F.min_by(F.col(kind), key).alias(kind),
                 F.min("ts").alias("run_start"),
                 F.min_by(F.col("event_id"), key).alias("first_event_id"),
                 F.count(F.lit(1)).alias("run_length"))
            .withColumn("repeat_count", F.col("run_length") - 1))


def elapsed_label(events: DataFrame, session: str = "user_id") -> DataFrame:
    """H2: ``mm:ss.hh`` since the session's first event; minutes wrap at 60 (integer microsecond math)."""
    start = events.groupBy(session).agg(F.min(micros("ts")).alias("_t0"))
    d = events.join(start, session).withColumn("_d", micros("ts") - F.col("_t0"))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    hs = F.floor(F.col("_d") / 10_000) % 100
    s = F.floor(F.col("_d") / 1_000_000) % 60
    m = F.floor(F.col("_d") / 60_000_000) % 60
    return d.select(*events.columns, F.concat(pad(m), F.lit(":"), pad(s), F.lit("."), pad(hs)).alias("elapsed"))


def latest_kv(df: DataFrame, keys: list[str], value: str = "value", order: list[str] | None = None) -> DataFrame:
    """H3: keyed memory, last write wins: ``max_by(value, order)`` per key (partial aggregate)."""
    order = order or ["ts", "event_id"]
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def latest_items(items: DataFrame, deleted: DataFrame | None = None, key: str = "item_id",
                 seq: str = "seq") -> DataFrame:
    """H4: the current version of each item after updates; deleted items removed."""
    cols = [c for c in items.columns if c != key]
    cur = items.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_r")).select(key, "_r.*")
    if deleted is not None:
        cur = cur.join(deleted.select(key).distinct(), key, "left_anti")
    return cur


def item_text(items: DataFrame) -> DataFrame:
    """H5: the text the conversation panel shows for an item; empty strings count as missing."""
    tr, tx = blank_to_null("transcript"), blank_to_null("text")
    tool = F.when(blank_to_null("tool_name").isNotNull(),
                  F.concat(F.col("tool_name"), F.lit("("), F.coalesce(F.col("tool_arguments"), F.lit("")), F.lit(")")))
    user = F.coalesce(tr, F.when(F.col("has_audio"), F.lit(AWAITING_TRANSCRIPT)), tx, F.lit(ITEM_SENT))
    assistant = F.coalesce(tr, tx, F.lit(TRUNCATED))
    shown = (F.when(F.col("type") == "function_call_output", F.col("text"))
             .when(tool.isNotNull(), tool)
             .when(F.col("role") == "user", user)
             .when(F.col("role") == "assistant", assistant))
    base = items
    for c in ("tool_name", "tool_arguments"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string"))
    return base.select(*items.columns, shown.alias("display_text"))


def speaker_label(items: DataFrame) -> DataFrame:
    """H6: role, else type, with ``_`` shown as a space."""
    return items.select(*items.columns,
                        F.replace(F.coalesce(blank_to_null("role"), F.col("type")), F.lit("_"), F.lit(" "))
                        .alias("speaker"))


def exclude_interrupted(writes: DataFrame, track: str = "track_id", flag: str = "is_interrupt") -> DataFrame:
    """H7: once a track is interrupted, its later writes are dropped.  The first interrupt per track is a
    partial aggregate; the filter is a left join on the track."""
    first = (writes.filter(F.col(flag)).groupBy(track)
             .agg(F.min(F.struct("ts", "event_id")).alias("_cut")))
    j = writes.filter(~F.col(flag)).join(first, track, "left")
    keep = F.col("_cut").isNull() | (F.struct("ts", "event_id") < F.col("_cut"))
    return j.filter(keep).drop("_cut")


def track_offsets(writes: DataFrame, track: str = "track_id", length: str = "length",
                  width: int | None = None, buckets: int | None = None) -> DataFrame:
    """H8: samples played per track so far (inclusive running sum in write order)."""
    return running_sum(writes, track, micros("ts"), ["ts", "event_id"], length, "offset", width)
