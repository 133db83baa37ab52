"""README corpus: parse, key, deduplicate, leave out what is indexed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.functions.hashing import content_sha1, hash_to_uuid
from repolumen.functions.text import (
    MAX_EMBED_CHARS,
    MIN_EMBED_CHARS,
    STRICT_BRANCHES,
    stored_name_branch,
    stored_name_file,
    stored_name_repo,
    stored_name_repo_lenient,
    unicode_trim,
)
from repolumen.session import cut_lineage

BROADCAST_IDS = 1_000_000  # ids broadcast at most, some 60 MB


def parse_stored_names(
    files: DataFrame, branches: tuple[str, ...] = STRICT_BRANCHES
) -> DataFrame:
    """Repository, branch and file from imported names; rejects keep a null repository."""
    name = F.col("name")
    return files.select(
        "name",
        stored_name_repo(name, branches).alias("repo_name"),
        stored_name_branch(name, branches).alias("branch"),
        stored_name_file(name, branches).alias("filename"),
        *[c for c in files.columns if c != "name"],
    )


def readme_records(files: DataFrame) -> DataFrame:
    """Records of imported files with the lenient name rule and the whole content."""
    return files.select(
        content_sha1(F.col("content")).alias("content_hash"),
        stored_name_repo_lenient(F.col("name")).alias("repo_name"),
        "content",
    )


def keyed_items(records: DataFrame, max_chars: int = MAX_EMBED_CHARS) -> DataFrame:
    """Key and class of every record (``repo_name``, ``content``).

    The hash is over the raw content, the stored text is trimmed and cut: texts
    that differ only in outer white space keep two ids. The class is
    ``unparsable``, ``empty`` or ``candidate``; only candidates have an id.
    """
    # Trimming and hashing read the whole text: each is its own column, used by name.
    read = records.select(
        "repo_name",
        unicode_trim(F.col("content")).alias("trimmed"),
        content_sha1(F.col("content")).alias("content_hash"),
    )
    kind = (
        F.when(F.col("repo_name").isNull(), "unparsable")
        .when(F.char_length("trimmed") >= MIN_EMBED_CHARS, "candidate")
        .otherwise("empty")
    )
    is_candidate = F.col("kind") == "candidate"
    return read.withColumn("kind", kind).select(
        F.when(is_candidate, hash_to_uuid(F.col("content_hash"))).alias("id"),
        "repo_name",
        F.when(is_candidate, F.substring("trimmed", 1, max_chars)).alias("content"),
        "content_hash",
        "kind",
    )


def _fold_by_id(items: DataFrame) -> DataFrame:
    """One row per id; ids with any ``known`` row are left out, the null id too.

    The test comes after the aggregation on purpose: as a filter on the id it
    would be moved down to the scan, and read every text once more.
    """
    return (
        items.groupBy("id")
        .agg(
            F.min("repo_name").alias("repo_name"),
            F.any_value("content", True).alias("content"),
            F.any_value("content_hash", True).alias("content_hash"),
            F.bool_or("known").alias("known"),
        )
        .where(~F.col("known"))
        .drop("known")
    )


def first_per_id(items: DataFrame) -> DataFrame:
    """One row per content id: the lowest repository name keeps it.

    Content and hash are the same for all rows of an id, so any value will do.
    The partial aggregation folds copies before the shuffle, also when one
    text makes up a large part of the corpus.
    """
    return _fold_by_id(items.withColumn("known", F.col("id").isNull()))


def _all_ids(tables: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select("id") for t in tables])


def without_known(items: DataFrame, *known_ids: DataFrame) -> DataFrame:
    """Items whose id is in none of the given id tables (index, in flight, just done).

    Sort-merge or broadcast is left to the sizes seen at run time.
    """
    return items.join(_all_ids(known_ids), "id", "left_anti") if known_ids else items


def new_items(records: DataFrame, *known_ids: DataFrame) -> DataFrame:
    """Records to embed: keyed, one per id (see :func:`first_per_id`), not known yet.

    Known ids take part in the fold as rows without content, and ids that met
    one are left out after it. Deduplication and difference so share one shuffle
    by id. An anti join would do the same, but the optimizer moves it below the
    aggregation, where copies of a frequent text are not folded yet.
    """
    items = keyed_items(records).drop("kind").withColumn("known", F.col("id").isNull())
    if known_ids:
        nothing = [F.lit(None).cast("string").alias(c) for c in items.columns[1:-1]]
        known = _all_ids(known_ids).select("id", *nothing, F.lit(True).alias("known"))
        items = items.unionByName(known)
    return _fold_by_id(items)


def known_among(records: DataFrame, index_ids: DataFrame) -> DataFrame:
    """The ids of a big index that a small batch of records can meet.

    The ids of the batch are written out and counted. Up to a bound they are
    broadcast, so the index is scanned for its ids but not shuffled; a bigger
    batch is better off with all of them.
    """
    keyed = keyed_items(records).where(F.col("id").isNotNull())
    ids = cut_lineage(keyed.select("id").distinct(), "batch-ids")
    if ids.count() > BROADCAST_IDS:
        return index_ids
    return index_ids.join(F.broadcast(ids), "id", "left_semi")


def load_report(records: DataFrame, existing_ids: DataFrame) -> DataFrame:
    """Counts of new, existing, duplicate, empty and unparsable records.

    Rows are first folded to one per (class, id), so copies never travel.
    """
    folded = (
        keyed_items(records).select("kind", "id").groupBy("kind", "id").agg(F.count("*").alias("n"))
    )
    known = existing_ids.select("id", F.lit(True).alias("known")).distinct()
    n, is_candidate = F.col("n"), F.col("kind") == "candidate"
    fresh = is_candidate & F.col("known").isNull()
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0))
    return folded.join(known, "id", "left").agg(
        total(fresh, 1).alias("new"),
        total(is_candidate & F.col("known").isNotNull(), n).alias("existing"),
        total(fresh, n - 1).alias("duplicates"),
        total(F.col("kind") == "empty", n).alias("empty"),
        total(F.col("kind") == "unparsable", n).alias("unparsable"),
    )
