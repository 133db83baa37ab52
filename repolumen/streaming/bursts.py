"""Typing bursts of a query log: only the query before a pause is kept."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolumen.functions.times import micros_of, span_of

PAUSE = timedelta(milliseconds=300)
SPAN_PAUSES = 4096


def _interval(delta: timedelta) -> str:
    return f"{delta // timedelta(microseconds=1)} microseconds"


def collapse_bursts(
    log: DataFrame, pause: timedelta = PAUSE, span_pauses: int = SPAN_PAUSES
) -> DataFrame:
    """Queries followed by at least ``pause`` of silence of their user.

    Rows are looked at per user and time span, so a busy user is spread over
    tasks. The last row of a span looks at the first row of the next span; one
    further away is more than a pause away in any case.
    """
    pause_us = pause // timedelta(microseconds=1)
    rows = log.select(
        "user_id", "ts", "event_id", "query", micros_of(F.col("ts")).alias("_us")
    ).withColumn("_span", span_of(F.col("_us"), pause_us * span_pauses))
    firsts = rows.groupBy("user_id", "_span").agg(F.min("_us").alias("_after"))
    order = Window.partitionBy("user_id", "_span").orderBy("ts", "event_id")
    following = F.coalesce(F.lead("_us").over(order), F.col("_after"))
    after = firsts.select(
        F.col("user_id").alias("_user"), (F.col("_span") - 1).alias("_before"), "_after"
    )
    # A missing user is one user, too.
    same = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_span") == F.col("_before"))
    return (
        rows.join(after, same, "left")
        .withColumn("_next", following)
        .where(F.col("_next").isNull() | (F.col("_next") - F.col("_us") >= pause_us))
        .select("user_id", "ts", "event_id", "query")
    )


def stream_bursts(
    log: DataFrame, pause: timedelta = PAUSE, late: timedelta = timedelta(minutes=1)
) -> DataFrame:
    """The same on a stream: a session per burst, closed by the watermark."""
    row = F.struct("ts", "event_id", "query")
    return (
        log.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", _interval(late))
        .groupBy("user_id", F.session_window("ts", _interval(pause)))
        .agg(F.max_by(row, F.struct("ts", "event_id")).alias("r"))
        .select("user_id", "r.ts", "r.event_id", "r.query")
    )
