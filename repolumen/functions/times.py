"""Date parsing, look-back and freshness."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

STATS_TTL = timedelta(hours=1)
REPO_INFO_TTL = timedelta(hours=24)


def parse_day(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd"))


def days_before(ts: Column, days: int) -> Column:
    return ts - F.make_dt_interval(F.lit(days))


def is_fresh(fetched_at: Column, as_of: Column, ttl: timedelta) -> Column:
    """True while the entry is younger than ``ttl``; at exactly ``ttl`` it is stale."""
    zero = F.lit(0)
    return fetched_at > as_of - F.make_dt_interval(zero, zero, zero, F.lit(ttl.total_seconds()))


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def span_of(micros: Column, width: int) -> Column:
    """Number of the fixed-width time span, in whole numbers throughout."""
    return ((micros - F.pmod(micros, F.lit(width))) / width).cast("long")
