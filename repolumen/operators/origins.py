"""Crawl visits and origin URLs: host filter, recency, last visit, slices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolumen.functions.text import HOST_PREFIX
from repolumen.functions.times import days_before

DEFAULT_MIN_DATE = "2023-01-01"


def on_host(df: DataFrame, column: str, prefix: str = HOST_PREFIX) -> DataFrame:
    """Rows whose URL starts with the prefix; reaches the scan as ``StringStartsWith``."""
    return df.where(F.col(column).startswith(prefix))


def _as_date_of(df: DataFrame, value: datetime | str | Column) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast(df.schema["date"].dataType)


def recent(df: DataFrame, min_date: datetime | str = DEFAULT_MIN_DATE) -> DataFrame:
    """Visits on or after ``min_date``; the bound is a literal, so it reaches the scan."""
    return df.where(F.col("date") >= _as_date_of(df, min_date))


def count_recent(df: DataFrame, min_date: datetime | str = DEFAULT_MIN_DATE) -> DataFrame:
    return recent(df, min_date).agg(F.count("*").alias("cnt"))


def active_visits(
    visits: DataFrame, days: int, reference_date: datetime | str | None = None
) -> DataFrame:
    """Visits of the last ``days`` days before the reference.

    Without a reference it is the newest date of *all* visits, before any host
    filter. It stays inside the plan as a scalar subquery of one row.
    """
    if reference_date is not None:
        cutoff = days_before(_as_date_of(visits, reference_date), days)
        return visits.where(F.col("date") >= cutoff)
    newest = visits.agg(F.max("date").alias("newest"))
    cutoff = newest.select(days_before(F.col("newest"), days)).scalar()
    return visits.where(F.col("date") >= cutoff)


def active_origins(
    visits: DataFrame,
    days: int,
    reference_date: datetime | str | None = None,
    prefix: str | None = None,
) -> DataFrame:
    """Distinct origins visited in the look-back window, optionally of one host."""
    found = active_visits(visits, days, reference_date).select("origin")
    if prefix:
        found = on_host(found, "origin", prefix)
    return found.distinct()


def last_visits(visits: DataFrame, prefix: str | None = HOST_PREFIX) -> DataFrame:
    """Newest visit per origin. Partial maxima absorb an origin with very many visits."""
    found = on_host(visits, "origin", prefix) if prefix else visits
    return found.groupBy("origin").agg(F.max("date").alias("date"))


def visit_range(visits: DataFrame) -> DataFrame:
    return visits.agg(
        F.count("*").alias("visits"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def slice_rows(df: DataFrame, order_by: str, limit: int | None, offset: int = 0) -> DataFrame:
    """Rows ``offset .. offset + limit`` in a stated order.

    ``None`` means no limit, 0 means none at all. For paging through a big table
    number it once (:mod:`repolumen.operators.numbering`) and slice by id.
    """
    if limit is None and not offset:
        return df
    ordered = df.orderBy(order_by)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)
