"""Crawl archive to work list to fetched documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repolumen.functions.text import HOST, HOST_PREFIX
from repolumen.operators import fetch
from repolumen.operators.origins import active_origins, last_visits, on_host, recent
from repolumen.sources import schemas
from repolumen.sources.readers import read_or_empty, read_origins, read_visits
from repolumen.sources.writers import write_outcomes, write_sorted_lines, write_zstd_parquet


def convert_origins(
    spark: SparkSession, source: str, target: str, prefix: str = HOST_PREFIX
) -> None:
    """ORC origins to Parquet URLs of one host; duplicates are kept."""
    write_zstd_parquet(on_host(read_origins(spark, source), "url", prefix), target)


def convert_visits(
    spark: SparkSession, source: str, target: str, prefix: str = HOST_PREFIX
) -> None:
    """ORC visits to the last visit per origin of one host."""
    write_zstd_parquet(last_visits(read_visits(spark, source), prefix), target)


def list_active(
    spark: SparkSession, source: str, target: str, days: int = 365, prefix: str | None = None
) -> None:
    """Sorted text file of the origins visited in the last ``days`` days."""
    found = active_origins(read_visits(spark, source), days, prefix=prefix)
    write_sorted_lines(found, "origin", target)


def plan_fetch(
    visits: DataFrame, outcomes: DataFrame, min_date: str, host: str = HOST
) -> DataFrame:
    """Repositories to fetch: recent, well-formed, and without any outcome yet."""
    work = fetch.work_list(recent(visits, min_date).select("origin"), host=host)
    return fetch.to_fetch(work, fetch.finished_keys(outcomes))


def run_fetch(
    visits: DataFrame,
    outcome_path: str,
    make_fetch: Callable[[], fetch.Fetch],
    min_date: str,
    partitions: int | None = None,
    **options,
) -> DataFrame:
    """Fetch what has no outcome yet and append the outcomes; the outcome table.

    Running it again continues where committed output ends.
    """
    spark = visits.sparkSession
    done = read_or_empty(spark, outcome_path, schemas.FETCH_OUTCOME)
    todo = plan_fetch(visits, done, min_date)
    results = fetch.fetch_readmes(todo, make_fetch, partitions=partitions, **options)
    write_outcomes(fetch.classify_outcomes(results), outcome_path)
    return read_or_empty(spark, outcome_path, schemas.FETCH_OUTCOME)
