"""Interval statistics of event series: gaps, rates, and the worst second.

Input ``events(series, ts)`` with ``ts`` in whole milliseconds. A series may be
arbitrarily long, so it is never handled as one group. Equal instants are first
folded into one row with a count; then a series is cut into time buckets, and a
bucket can hold no more rows than it has milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1000
BUCKET_MS = 600_000
MINUTE_MS = 60_000


def _bucket_of(ts: str, size: int) -> Column:
    return F.floor(F.col(ts) / size)


def _instants(events: DataFrame, size: int = BUCKET_MS) -> DataFrame:
    return (
        events.groupBy("series", "ts")
        .agg(F.count("*").alias("n"))
        .withColumn("bucket", _bucket_of("ts", size))
    )


def _buckets(instants: DataFrame) -> DataFrame:
    """Per bucket: the last instant before it, and the ends of its series."""
    ends = instants.groupBy("series", "bucket").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    # one row per bucket, so a series has few however many events it holds
    in_order = Window.partitionBy("series").orderBy("bucket")
    whole = Window.partitionBy("series")
    return ends.select(
        "series", "bucket",
        F.lag("last").over(in_order).alias("before"),
        F.max("last").over(whole).alias("series_last"),
    )


def gaps(events: DataFrame) -> DataFrame:
    """``(series, gap, n)``: how often each gap between consecutive events occurs."""
    instants = _instants(events)
    in_bucket = Window.partitionBy("series", "bucket").orderBy("ts")
    placed = instants.join(_buckets(instants), ["series", "bucket"]).withColumn(
        "gap", F.col("ts") - F.coalesce(F.lag("ts").over(in_bucket), F.col("before"))
    )
    # n events at one instant: one gap to the instant before, n - 1 gaps of zero
    split = F.array(
        F.struct(F.col("gap"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("n")),
    )
    return (
        placed.select("series", F.inline(split))
        .where(F.col("gap").isNotNull() & (F.col("n") > 0))
        .groupBy("series", "gap")
        .agg(F.sum("n").alias("n"))
    )


def _gap_quantiles(gap_counts: DataFrame) -> DataFrame:
    """Median, 95th percentile and maximum at index ``floor(p * n)``.

    The gaps of a series add up to its duration, so it has at most
    ``sqrt(2 * duration)`` distinct ones: a bounded window.
    """
    running = Window.partitionBy("series").orderBy("gap")
    ranked = gap_counts.withColumn("upto", F.sum("n").over(running))
    total = F.max("upto").over(Window.partitionBy("series"))
    placed = ranked.withColumn("total", total)

    def at(numerator: int) -> Column:
        index = F.least(
            F.col("total") - 1, F.floor(F.col("total") * numerator / F.lit(100))
        )
        return F.min(F.when(F.col("upto") > index, F.col("gap")))

    return placed.groupBy("series").agg(
        at(50).alias("median_gap"), at(95).alias("p95_gap"), F.max("gap").alias("max_gap")
    )


def _spans(events: DataFrame) -> DataFrame:
    return events.groupBy("series").agg(
        (F.count("*") - 1).alias("frames"),
        (F.max("ts") - F.min("ts")).alias("duration"),
    )


def _average() -> Column:
    """Events per second over the whole span."""
    return (
        F.when(F.col("frames") == 0, 0.0)
        .when(F.col("duration") == 0, float("inf"))
        .otherwise(F.col("frames") / F.col("duration") * SECOND)
    )


def interval_stats(events: DataFrame) -> DataFrame:
    """Frames, duration, average rate and gap quantiles per series."""
    spans = _spans(events)
    zero = F.lit(0).cast("long")
    return spans.join(_gap_quantiles(gaps(events)), "series", "left").select(
        "series", "frames", "duration", _average().alias("avg_rate"),
        *[F.coalesce(c, zero).alias(c) for c in ("median_gap", "p95_gap", "max_gap")],
    )


def worst_second(events: DataFrame, width: int = SECOND) -> DataFrame:
    """Fewest events in any sliding window that starts at an event.

    A window counts what follows its first event within ``width``, and only
    windows that end by the last event count; without one the average is used.
    No group is longer than a minute, however wide the window.
    """
    instants = _instants(events, MINUTE_MS)
    in_bucket = Window.partitionBy("series", "bucket").orderBy("ts")
    placed = instants.withColumn("within", F.sum("n").over(in_bucket))
    # a window is the difference of two counts: up to its end, and up to its start
    ends = placed.select(
        "series", F.floor((F.col("ts") + width) / MINUTE_MS).alias("bucket"),
        (F.col("ts") + width).alias("ts"), F.col("bucket").alias("start_bucket"), "within",
    )
    whole = Window.partitionBy("series")
    in_order = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per minute with an event or an end, whatever the events
    totals = (
        instants.select("series", "bucket", "n", F.col("ts").alias("last"))
        .unionByName(ends.select("series", "bucket", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last")))
        .groupBy("series", "bucket")
        .agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        .select(
            "series", "bucket", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("earlier"),
            F.max("last").over(whole).alias("series_last"),
        )
    )
    marks = instants.select(
        "series", "bucket", "ts", "n", F.lit(None).cast("long").alias("start_bucket"),
        F.lit(None).cast("long").alias("start_within"),
    ).unionByName(ends.select(
        "series", "bucket", "ts", F.lit(0).cast("long").alias("n"), "start_bucket",
        F.col("within").alias("start_within"),
    ))
    until_end = Window.partitionBy("series", "bucket").orderBy("ts")  # equal instants count
    counted = marks.withColumn("within", F.sum("n").over(until_end)).where("start_bucket IS NOT NULL")
    at_end = counted.join(totals, ["series", "bucket"]).where(F.col("ts") <= F.col("series_last"))
    at_start = totals.select(
        "series", F.col("bucket").alias("start_bucket"), F.col("earlier").alias("start_earlier")
    )
    following = F.col("earlier") + F.col("within") - F.col("start_earlier") - F.col("start_within")
    lows = (
        at_end.join(at_start, ["series", "start_bucket"])
        .groupBy("series")
        .agg(F.min(following).alias("lowest"))
    )
    spans = _spans(events)
    return spans.join(lows, "series", "left").select(
        "series", "frames",
        F.coalesce(F.col("lowest").cast("double"), _average()).alias("worst_rate"),
    )
