"""Grouping activity into sessions by start-end pairing.

RANGE frames find the events without a neighbour within the gap before
(session starts) or after (session ends). Starts and ends are numbered
separately per user, and the n-th start belongs to the n-th end; the event
count is the difference of their event ranks.

A user may hold a third of all events, so no step works on a whole user at
once: frames run within (user, time bucket), and ranks are ranks within the
bucket plus a running total over the user's buckets. The number of buckets of
one user is bounded by the calendar, not by the events. Only the starts and ends
are written out, once, and read by both sides of the pairing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslake.session import StagedTable

MINUTE_US = 60_000_000


def sessions(
    df: DataFrame,
    user: str = "user_id",
    event: str = "impression_id",
    timestamp: str = "timestamp",
    gap_us: int = 30 * MINUTE_US,
    bucket_us: int = 24 * 60 * MINUTE_US,
) -> DataFrame:
    """One row per session: (user, session_start_us, session_end_us, n_events).

    A session goes on while the pause to the next event is at most ``gap_us``.
    Each ``event`` id counts once: of repeated ids the earliest (timestamp,
    user) is kept. Rows with a NULL user, timestamp or id are left out. Equal
    timestamps belong together. Extra columns are ignored. An empty table gives
    no session.
    """
    if bucket_us < gap_us:
        raise ValueError("a bucket must be at least as long as the gap")
    ts = F.unix_micros(F.col(timestamp).cast("timestamp"))
    once = (
        df.select(F.col(event).alias("e"), F.struct(ts.alias("ts"), F.col(user).alias("u")).alias("v"))
        .filter("e IS NOT NULL AND v.ts IS NOT NULL AND v.u IS NOT NULL")
        .groupBy("e")
        .agg(F.min("v").alias("v"))
        .select("v.u", "v.ts")
    )
    # One exchange serves the moments, the frames and the totals of a bucket, which all are keyed by (user, bucket).
    spread = once.withColumn("b", F.expr(f"(ts - pmod(ts, {bucket_us}L)) div {bucket_us}L")).repartition("u", "b")
    moments = spread.groupBy("u", "b", "ts").agg(F.count(F.lit(1)).alias("n"))

    per_bucket = Window.partitionBy("u", "b").orderBy("ts")
    so_far = per_bucket.rowsBetween(Window.unboundedPreceding, 0)
    framed = moments.select(
        "u",
        "b",
        "ts",
        "n",
        (F.count(F.lit(1)).over(per_bucket.rangeBetween(-gap_us, -1)) == 0).alias("starts"),
        (F.count(F.lit(1)).over(per_bucket.rangeBetween(1, gap_us)) == 0).alias("ends"),
        F.sum("n").over(so_far).alias("events"),
    ).filter("starts OR ends")
    number = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    # Starts and ends only, numbered within their bucket; the first and the last moment of a bucket are always among them.
    local = framed.select("*", number("starts").over(so_far).alias("start"), number("ends").over(so_far).alias("end"))
    edges = local.groupBy("u", "b").agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.max("events").alias("events"), F.max("start").alias("start"), F.max("end").alias("end")
    )
    # A bucket's first start is none if the user's bucket before ends within the gap; likewise its last end.
    order = Window.partitionBy("u").orderBy("b")
    edges = edges.select(
        "*",
        F.coalesce(F.col("lo") - F.lag("hi").over(order) <= gap_us, F.lit(False)).alias("continued"),
        F.coalesce(F.lead("lo").over(order) - F.col("hi") <= gap_us, F.lit(False)).alias("continues"),
    )
    before = lambda c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(
        "u",
        "b",
        "lo",
        "hi",
        "continued",
        "continues",
        F.coalesce(before(F.col("events")), F.lit(0)).alias("events_before"),
        (F.coalesce(before(F.col("start") - F.col("continued").cast("int")), F.lit(0)) - F.col("continued").cast("int")).alias("starts_before"),
        F.coalesce(before(F.col("end") - F.col("continues").cast("int")), F.lit(0)).alias("ends_before"),
    )
    marked = StagedTable(
        local.join(edges, ["u", "b"]).select(
            "u",
            "ts",
            "n",
            (F.col("events") + F.col("events_before")).alias("rank"),
            F.when(F.col("starts") & ~(F.col("continued") & (F.col("ts") == F.col("lo"))), F.col("start") + F.col("starts_before")).alias("start"),
            F.when(F.col("ends") & ~(F.col("continues") & (F.col("ts") == F.col("hi"))), F.col("end") + F.col("ends_before")).alias("end"),
        )
    )
    starts = marked.read().filter("start IS NOT NULL").select("u", F.col("start").alias("k"), F.col("ts").alias("session_start_us"), (F.col("rank") - F.col("n")).alias("r0"))
    ends = marked.read().filter("end IS NOT NULL").select("u", F.col("end").alias("k"), F.col("ts").alias("session_end_us"), F.col("rank").alias("r1"))
    return starts.join(ends, ["u", "k"]).select(
        F.col("u").alias(user), "session_start_us", "session_end_us", (F.col("r1") - F.col("r0")).alias("n_events")
    )
