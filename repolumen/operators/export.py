"""Bulk export from warehouse tables: files, contents, commits."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.session import cut_lineage

README_PATH = "readme.md"


def root_readmes(files: DataFrame) -> DataFrame:
    """Files called README.md, in any case, at the root of their repository."""
    return files.where(F.lower("path") == README_PATH)


def text_contents(contents: DataFrame) -> DataFrame:
    """Blobs with content that are known not to be binary."""
    return contents.where(F.col("content").isNotNull() & (F.col("binary") == F.lit(False)))


def last_commits(commits: DataFrame) -> DataFrame:
    """Newest commit time (epoch seconds) per repository.

    Commits list the repositories they are in. One row per membership, folded to
    one per repository before any join, keeps the later join an equi join.
    """
    return (
        commits.select(
            F.explode("repo_name").alias("repo_name"),
            F.col("committer.date.seconds").alias("seconds"),
        )
        .groupBy("repo_name")
        .agg(F.max("seconds").alias("last_commit"))
    )


def with_place(df: DataFrame) -> DataFrame:
    """``df`` with ``place``: where each row stands in its Parquet files.

    What is not read from Parquet files has no such place; it is written out once.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.select("*", place.alias("place"))
    except AnalysisException:
        row = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
        return cut_lineage(df.withColumn("place", row), "placed-rows")


def export_readmes(files: DataFrame, contents: DataFrame, commits: DataFrame) -> DataFrame:
    """One record per distinct README, newest commit first, unknown commits last.

    Everything narrow is folded before content joins in: (blob, repository) pairs, one
    row per blob, and of the rows that hold a blob's text the first place. Only then
    are texts looked at: the row at that place passes a hash join, and no text is sorted
    or folded on the way. Sorting also by hash splits runs of equal dates.
    """
    pairs = root_readmes(files).select("id", "repo_name").distinct()
    per_blob = (
        pairs.join(last_commits(commits), "repo_name", "left")
        .groupBy("id")
        .agg(F.min("repo_name").alias("repo_name"), F.max("last_commit").alias("last_commit"))
    )
    texts = with_place(text_contents(contents).select("id", "content"))
    places = (
        texts.select("id", "place.file", "place.row")
        .groupBy("id")
        # Any row of a file will do: rows of one blob have one text.
        .agg(F.min("file").alias("file"), F.min_by("row", "file").alias("row"))
    )
    chosen = per_blob.join(places, "id").hint("shuffle_hash")
    found = texts.select("id", F.col("place.file").alias("file"), F.col("place.row").alias("row"), "content")
    return (
        found.join(chosen, ["id", "file", "row"])
        .select(F.col("id").alias("content_hash"), "repo_name", "content", "last_commit")
        .orderBy(F.desc_nulls_last("last_commit"), "content_hash")
    )
