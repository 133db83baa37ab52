"""README fetching: candidates, attempts, outcome classes, reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolumen.functions.text import (
    HOST,
    MAX_FILE_KEY_CHARS,
    MAX_README_CHARS,
    MIN_README_CHARS,
    file_key,
    finished_file_key,
    repo_from_url,
    truncate_marked,
)
from repolumen.sources import schemas

# Candidate file names by frequency, branches, and the raw-file address.
README_NAMES = (
    "README.md", "readme.md", "README.rst", "README", "Readme.md", "README.markdown",
    "README.txt", "README.adoc", "readme.txt", "README.MD", "README.rdoc", "ReadMe.md",
)
WIDE_BRANCHES = ("main", "master")
HEAD_ONLY = ("HEAD",)
RAW_PREFIX = "https://raw.githubusercontent.com/"
RETRY_STATUSES = (429, 500, 502, 503, 504)
STATUS_LABELS = {0: "timeout/connection", 404: "not found", 451: "DMCA"}

OUTCOME_COLUMNS = [f.name for f in schemas.FETCH_OUTCOME.fields]

# (status, body) of one URL; raises on a connection error or timeout.
Fetch = Callable[[str], tuple[int, str]]


@dataclass(frozen=True)
class FetchPolicy:
    """How often a URL is tried and how long to wait in between."""

    tries: int = 5
    wait_after_error: bool = False
    sleep: Callable[[float], None] = time.sleep


def work_list(origins: DataFrame, url_col: str = "origin", host: str = HOST) -> DataFrame:
    """Repository, file key and first verdict per origin.

    ``no_match`` has no repository in its URL, ``skipped`` an over-long key.
    """
    repo = repo_from_url(F.col(url_col), host)
    keyed = origins.select(
        F.col(url_col).alias("origin"), repo.alias("repo_name"), file_key(repo).alias("file_key")
    )
    verdict = (
        F.when(F.col("repo_name").isNull(), "no_match")
        .when(F.char_length("file_key") > MAX_FILE_KEY_CHARS, "skipped")
        .otherwise("fetch")
    )
    return keyed.withColumn("verdict", verdict)


def finished_keys(outcomes: DataFrame, stored_names: DataFrame | None = None) -> DataFrame:
    """File keys that need no fetch: all outcomes, failed ones too, and imported files."""
    done = outcomes.select(file_key(F.col("repo_name")).alias("file_key"))
    if stored_names is not None:
        done = done.unionByName(
            stored_names.select(finished_file_key(F.col("name")).alias("file_key"))
        )
    return done.where(F.col("file_key").isNotNull()).distinct()


def to_fetch(work: DataFrame, finished: DataFrame) -> DataFrame:
    """Distinct repositories still to fetch: an anti join resumes after any crash."""
    todo = work.where(F.col("verdict") == "fetch").select("repo_name", "file_key").distinct()
    return todo.join(finished, "file_key", "left_anti")


def candidate_urls(
    repos: DataFrame,
    names: Sequence[str] = README_NAMES,
    branches: Sequence[str] = WIDE_BRANCHES,
    prefix: str = RAW_PREFIX,
) -> DataFrame:
    """All URLs to try per repository; names are the outer loop, branches the inner."""
    by_name = repos.select(
        "repo_name", F.posexplode(F.array(*map(F.lit, names))).alias("i", "filename")
    )
    by_branch = by_name.select(
        "*", F.posexplode(F.array(*map(F.lit, branches))).alias("j", "branch")
    )
    url = F.concat(
        F.lit(prefix), F.concat_ws("/", F.col("repo_name"), F.col("branch"), F.col("filename"))
    )
    return by_branch.select(
        "repo_name",
        (F.col("i") * len(branches) + F.col("j")).alias("priority"),
        "branch",
        "filename",
        url.alias("url"),
    )


def fetch_from_archive(
    repos: DataFrame,
    archive: DataFrame,
    names: Sequence[str] = README_NAMES,
    branches: Sequence[str] = WIDE_BRANCHES,
    prefix: str = RAW_PREFIX,
) -> DataFrame:
    """One README per repository out of a stored crawl (``url``, ``body``; each URL once).

    The first candidate that the archive holds wins, none is a 404. Addresses are
    matched without the bodies; only those that won are then looked up. Columns are those
    of :func:`fetch_readmes`; nothing is requested, so no time is taken.
    """
    wanted = repos.select("repo_name").distinct()
    there = candidate_urls(wanted, names, branches, prefix).join(
        archive.select("url").distinct(), "url", "left_semi"
    )
    first = there.groupBy("repo_name").agg(
        F.min_by(F.struct("url", "branch", "filename"), "priority").alias("hit")
    )
    named = wanted.join(first.select("repo_name", "hit.*"), "repo_name", "left")
    bodies = archive.select("url", F.col("body").alias("content"))
    return named.join(bodies, "url", "left").select(
        "repo_name",
        "content",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("branch", "filename")],
        F.when(F.col("url").isNotNull(), 200).otherwise(404).cast("int").alias("status"),
        F.lit(len(names)).cast("int").alias("candidates_tried"),
        F.lit(0).cast("long").alias("fetch_ms"),
    )


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """One result per repository out of its logged attempts.

    The first 200 wins unless a 451 came before it; without either the last
    status other than 404 stays, else 404.
    """
    status, priority = F.col("status"), F.col("priority")
    is_ok, is_blocked = status == 200, status == 451
    is_other = ~status.isin(200, 404, 451)
    hit = F.struct("branch", "filename", "body")
    grouped = attempts.groupBy("repo").agg(
        F.min(F.when(is_ok, priority)).alias("ok_at"),
        F.min(F.when(is_blocked, priority)).alias("blocked_at"),
        F.max_by(F.when(is_other, status), F.when(is_other, priority)).alias("other"),
        F.min_by(F.when(is_ok, hit), F.when(is_ok, priority)).alias("hit"),
        # File names come from the candidate list: a handful per repository.
        F.size(F.collect_set("filename")).alias("candidates_tried"),
        F.sum("ms").alias("fetch_ms"),
    )
    won = F.col("ok_at").isNotNull() & (
        F.col("blocked_at").isNull() | (F.col("ok_at") < F.col("blocked_at"))
    )
    final_status = (
        F.when(won, 200)
        .when(F.col("blocked_at").isNotNull(), 451)
        .otherwise(F.coalesce("other", F.lit(404)))
    )
    return grouped.select(
        F.col("repo").alias("repo_name"),
        F.when(won, F.col("hit.body")).alias("content"),
        F.when(won, F.col("hit.branch")).otherwise("").alias("branch"),
        F.when(won, F.col("hit.filename")).otherwise("").alias("filename"),
        final_status.cast("int").alias("status"),
        "candidates_tried",
        "fetch_ms",
    )


def _get_with_retry(fetch: Fetch, url: str, policy: FetchPolicy) -> tuple[int, str] | None:
    """Answer of one URL; None when all tries failed or kept asking for a retry."""
    for attempt in range(policy.tries):
        try:
            status, body = fetch(url)
        except Exception:  # any client error counts as no connection
            if policy.wait_after_error:
                policy.sleep(2**attempt)
            continue
        if status not in RETRY_STATUSES:
            return status, body
        policy.sleep(2**attempt)
    return None


def _fetch_repo(
    repo: str,
    fetch: Fetch,
    names: Sequence[str],
    branches: Sequence[str],
    prefix: str,
    policy: FetchPolicy,
) -> dict:
    started = time.monotonic()
    found = {"content": None, "branch": "", "filename": "", "status": 404}
    for name, branch in ((n, b) for n in names for b in branches):
        answer = _get_with_retry(fetch, f"{prefix}{repo}/{branch}/{name}", policy)
        status = answer[0] if answer else 0
        if status == 200:
            found = {"content": answer[1], "branch": branch, "filename": name, "status": 200}
            break
        if status != 404:
            found["status"] = status
        if status == 451:
            break
    elapsed = int((time.monotonic() - started) * 1000)
    return {"repo_name": repo, "candidates_tried": len(names), "fetch_ms": elapsed, **found}


def fetch_readmes(
    repos: DataFrame,
    make_fetch: Callable[[], Fetch],
    names: Sequence[str] = README_NAMES[:1],
    branches: Sequence[str] = HEAD_ONLY,
    prefix: str = RAW_PREFIX,
    policy: FetchPolicy = FetchPolicy(),
    partitions: int | None = None,
    threads: int = 1,
) -> DataFrame:
    """Fetch one README per repository with a client made once per task.

    ``partitions`` x ``threads`` bounds the open connections. Task retries may
    repeat a request; results are kept apart by the outcome table's anti join.
    """
    if partitions:
        repos = repos.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = partial(
            _fetch_repo,
            fetch=make_fetch(),
            names=names,
            branches=branches,
            prefix=prefix,
            policy=policy,
        )
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                rows = list(pool.map(one, batch["repo_name"]))
                yield pd.DataFrame(rows, columns=schemas.FETCH_RESULT.fieldNames())

    return repos.select("repo_name").mapInPandas(run, schemas.FETCH_RESULT)


def classify_outcomes(
    results: DataFrame,
    min_chars: int = MIN_README_CHARS,
    max_chars: int = MAX_README_CHARS,
) -> DataFrame:
    """Outcome class and stored content of fetch results.

    An empty body is an error that keeps its status; content is stored only
    when it is long enough, and cut with a mark when it is too long.
    """
    size = F.char_length("content")
    outcome = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "error")
        .when(size < min_chars, "too_small")
        .when(size > max_chars, "truncated")
        .otherwise("ok")
    )
    stored = F.when(size >= max(min_chars, 1), truncate_marked(F.col("content"), max_chars))
    return results.withColumn("outcome", outcome).withColumn("content", stored)


def error_key(status: Column, candidates_tried: Column) -> Column:
    """Key failures are filed under: a 404 tells how many names were tried."""
    return F.when(status == 404, F.concat(F.lit("404_"), candidates_tried.cast("string"))).otherwise(
        status.cast("string")
    )


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, status), status.cast("string"))


def fetch_report(outcomes: DataFrame) -> DataFrame:
    """All counters in one pass over the outcome column.

    Truncated documents count as success too; ``no_match`` is an error that was
    neither fetched nor processed.
    """
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(
        is_("ok", "truncated").alias("success"),
        is_("too_small").alias("too_small"),
        is_("truncated").alias("truncated"),
        is_("skipped").alias("skipped"),
        is_("ok", "truncated", "too_small", "error").alias("fetched"),
        is_("ok", "truncated", "too_small", "error", "skipped").alias("processed"),
        is_("error", "no_match").alias("errors"),
    )


def errors_by_status(outcomes: DataFrame) -> DataFrame:
    """Failures per status with label; a URL without repository counts as status 0."""
    status = F.when(F.col("outcome") == "no_match", 0).otherwise(F.col("status"))
    failed = outcomes.where(F.col("outcome").isin("error", "no_match"))
    counted = failed.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return counted.select("status", status_label(F.col("status")).alias("label"), "n").orderBy(
        "status"
    )


def fetch_speed(attempts: DataFrame) -> DataFrame:
    """Mean time per attempt, span and attempts per second of an attempt log."""
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(
        F.min("ts").cast("timestamp")
    )
    return attempts.agg(
        F.count("*").alias("attempts"),
        F.avg("ms").alias("avg_ms"),
        F.try_divide(F.count("*"), span / 1_000_000).alias("per_second"),
    )


def format_counts(stored: DataFrame) -> DataFrame:
    """README formats: per file name among API fallbacks, per branch and file overall.

    ``stored`` has ``branch`` and ``filename``. Grouping sets read it once.
    """
    branches = F.col("branch").isin("main", "master", "default")
    # The total is of all stored files, also those on other branches or with odd names.
    grouped = (
        stored.groupingSets([["branch", "filename"], ["branch"], []], "branch", "filename")
        .agg(F.count("*").alias("n"), F.grouping_id("branch", "filename").alias("level"))
        .where((F.col("level") == 3) | branches)
    )
    scope = (
        F.when(F.col("level") == 0, "branch_file")
        .when(F.col("level") == 1, "branch")
        .otherwise("all")
    )
    return grouped.select(scope.alias("scope"), "branch", "filename", "n").orderBy(
        "scope", F.desc("n"), "branch", "filename"
    )
