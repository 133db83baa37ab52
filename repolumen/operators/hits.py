"""What is attached to search hits, and how results are shown."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolumen.functions.numbers import compact_number, fixed_text, percent_text
from repolumen.functions.text import CONTENT_BRANCHES, HOST_PREFIX, repo_page_url
from repolumen.functions.times import REPO_INFO_TTL, is_fresh
from repolumen.functions.vectors import cosine, l2_norm

README_FILE = "README.md"
BROADCAST_HITS = 250_000  # rows of (repo_name) broadcast at most, some 20 MB
PAGE_SIZE = 20


def attach_content(
    hits: DataFrame,
    readmes: DataFrame,
    max_hits: int | None = None,
    branches: tuple[str, ...] = CONTENT_BRANCHES,
) -> DataFrame:
    """Content of each hit's repository, from the first branch that has it.

    ``max_hits`` is a known bound on the hits (queries x limit). If it is small
    enough the hit repositories are broadcast, and the corpus is filtered where
    it is read; without it the join strategy is left to run-time sizes.
    """
    wanted = hits.select("repo_name").distinct()
    if max_hits is not None and max_hits <= BROADCAST_HITS:
        wanted = F.broadcast(wanted)
    order = F.array_position(F.array(*map(F.lit, branches)), F.col("branch"))
    stored = readmes.where(F.col("branch").isin(*branches) & (F.col("filename") == README_FILE))
    best = (
        stored.select("repo_name", order.alias("order"), "content")
        .join(wanted, "repo_name", "left_semi")
        .groupBy("repo_name")
        # Two texts of one branch: the hash decides, alike in every run.
        .agg(F.min_by("content", F.struct("order", F.xxhash64("content"))).alias("content"))
    )
    return hits.join(best, "repo_name", "left")


def attach_content_by_hash(
    hits: DataFrame, corpus: DataFrame, max_hits: int | None = None
) -> DataFrame:
    """Content that was embedded: joined by ``content_hash`` instead of repository."""
    wanted = hits.select("content_hash").distinct()
    if max_hits is not None and max_hits <= BROADCAST_HITS:
        wanted = F.broadcast(wanted)
    texts = (
        corpus.select("content_hash", "content")
        .join(wanted, "content_hash", "left_semi")
        .groupBy("content_hash")
        .agg(F.any_value("content").alias("content"))
    )
    return hits.join(texts, "content_hash", "left")


def fresh_info(repo_info: DataFrame, as_of: Column, ttl: timedelta = REPO_INFO_TTL) -> DataFrame:
    """Repository details that are not stale yet."""
    return repo_info.where(is_fresh(F.col("fetched_at"), as_of, ttl))


def attach_info(hits: DataFrame, repo_info: DataFrame, as_of: Column) -> DataFrame:
    """Description, stars, language and forks; unknown or stale repositories stay null."""
    info = (
        fresh_info(repo_info, as_of)
        .groupBy("repo_name")
        .agg(F.max_by(F.struct("description", "stars", "language", "forks"), "fetched_at").alias("i"))
    )
    joined = hits.join(info, "repo_name", "left")
    return joined.select(
        *hits.columns,
        F.col("i.description").alias("description"),
        F.col("i.stars").alias("stars"),
        F.col("i.language").alias("language"),
        F.col("i.forks").alias("forks"),
        compact_number(F.col("i.stars")).alias("stars_text"),
        compact_number(F.col("i.forks")).alias("forks_text"),
    )


def shape_hits(hits: DataFrame, prefix: str = HOST_PREFIX) -> DataFrame:
    """Score, repository, page address and percentage."""
    return hits.select(
        "qid",
        "rank",
        "score",
        F.col("repo_name").alias("repo"),
        repo_page_url(F.col("repo_name"), prefix).alias("url"),
        percent_text(F.col("score")).alias("percent"),
    )


def ranked_table(hits: DataFrame) -> DataFrame:
    """Result table: rank, repository, score to two digits, content."""
    return hits.select(
        "qid",
        "rank",
        F.col("repo_name").alias("repo"),
        fixed_text(F.col("score"), 2).alias("score"),
        "content",
    )


def result_page(hits: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """Zero-based page of every query's hits."""
    return hits.where((F.col("rank") > page * size) & (F.col("rank") <= (page + 1) * size))


def has_more(hits: DataFrame, limit: int) -> DataFrame:
    """Per query: rows found, and whether another page may exist (limit reached)."""
    return hits.groupBy("qid").agg(
        F.count("*").alias("found"), (F.count("*") == limit).alias("has_more")
    )


def compare_vectors(left: DataFrame, right: DataFrame, agree_above: float = 0.9999) -> DataFrame:
    """Cosine and norms of two vector sets of the same texts (``id``, ``vector``)."""
    both = left.select("id", F.col("vector").alias("a")).join(
        right.select("id", F.col("vector").alias("b")), "id"
    )
    similarity = cosine(F.col("a"), F.col("b"))
    return both.select(
        "id",
        similarity.alias("cosine"),
        l2_norm(F.col("a")).alias("left_norm"),
        l2_norm(F.col("b")).alias("right_norm"),
    ).withColumn("agrees", F.coalesce(F.col("cosine") > agree_above, F.lit(False)))
