"""Exact duplicates: counting quotient filters find fingerprints seen twice, bytes decide.

Every partition builds a filter of its fingerprints, filters merge by blocks of
leading bits, and only rows whose fingerprint is counted more than once go on. Their
texts are grouped as bytes: Spark folds equal texts in each task first, so a text that
makes up a third of all rows travels once per task. Rows with a fingerprint of their
own are done without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolumen.llm.quotient_filter import (
    build_filters,
    fingerprint_column,
    list_counts,
    merge_filters,
    print_bits,
)
from repolumen.llm.simhash import few
from repolumen.session import cut_lineage

#: Repeated fingerprints (16 bytes each) and classes of copies (about 100) are broadcast up to these numbers.
BROADCAST_PRINTS, BROADCAST_CLASSES = 1_000_000, 200_000


def normalised(column: str = "text") -> Column:
    """The text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if few(df, limit) else df


def repeated_prints(prints: DataFrame, bits: int, block_bits: int) -> DataFrame:
    """``(print)`` of all fingerprints that more than one row of ``prints`` has."""
    merged = merge_filters(build_filters(prints, bits, block_bits))
    return list_counts(merged, block_bits, 2).select("print")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row of ``docs`` (doc_id, text).

    Texts are equal if they are after each run of ASCII white space is made one space;
    null is the empty text, and a text of white space is one space. The row with the
    smallest doc_id stays; rows without an id come last, and of equal rows of one id one
    stays. A group without any id has a null ``keep_id``. An empty table gives no rows;
    other columns are not looked at.
    """
    text = docs.select("doc_id", normalised().alias("norm"))
    hashed = text.select(
        "doc_id",
        F.xxhash64("norm").alias("hash"),
        F.sha2("norm", 256).alias("sha"),
        F.monotonically_increasing_id().alias("row"),
    )
    digest = cut_lineage(hashed, "digests")
    bits, block_bits = print_bits(digest.count())
    cut = F.shiftrightunsigned("hash", 64 - bits).alias("print")
    twice = cut_lineage(repeated_prints(digest.select(cut), bits, block_bits), "repeated-prints")
    side = _small(twice, BROADCAST_PRINTS)

    # The bytes decide: one group for each text among those of repeated fingerprints.
    asked = text.select("norm", fingerprint_column("norm", bits).alias("print")).join(side, "print", "left_semi")
    verified = asked.groupBy("print", "norm").count().where("count > 1").select(F.sha2("norm", 256).alias("sha"))
    verified = cut_lineage(verified, "verified-texts")

    again = digest.select("*", cut).join(side, "print", "left_semi")
    by_id = again.groupBy("sha", "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    groups = by_id.groupBy("sha").agg(
        F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
        F.sum("n").alias("group_size"),
    )
    classes = cut_lineage(groups.join(verified, "sha", "left_semi"), "classes")
    single = F.col("group_size").isNull()
    return digest.join(_small(classes, BROADCAST_CLASSES), "sha", "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
