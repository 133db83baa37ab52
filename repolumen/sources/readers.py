"""Readers. All are lazy and leave column pruning and filters to the scan."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolumen.operators.origins import recent, slice_rows
from repolumen.sources import schemas
from repolumen.sources.files import local_folder, path_exists
from repolumen.sources.stored import part_folders, read_part


def read_origins(spark: SparkSession, path: str) -> DataFrame:
    """Origin URLs of an ORC directory; only ``url`` is read."""
    return spark.read.schema(schemas.ORIGIN).orc(path).select("url")


def read_visits(
    spark: SparkSession, path: str, all_columns: bool = False, schema: T.StructType | None = None
) -> DataFrame:
    """Crawl visits of an ORC directory."""
    visits = spark.read.schema(schema or schemas.ORIGIN_VISIT).orc(path)
    return visits if all_columns else visits.select("origin", "date")


def read_host_origins(
    spark: SparkSession, path: str, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """URL list written by the conversion job, optionally one slice in URL order."""
    return slice_rows(spark.read.parquet(path).select("url"), "url", limit, offset)


def read_recent_origins(
    spark: SparkSession,
    path: str,
    min_date: datetime | str,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Origins whose last visit is not older than ``min_date``."""
    found = recent(spark.read.parquet(path), min_date).select("origin")
    return slice_rows(found, "origin", limit, offset)


def query_parquet(spark: SparkSession, sql: str, **paths: str) -> DataFrame:
    """Run SQL over Parquet paths named in braces: ``FROM {visits}``."""
    return spark.sql(sql, **{name: spark.read.parquet(path) for name, path in paths.items()})


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table; no column is read, only file footers."""
    return spark.read.parquet(path).count()


def read_stored_readmes(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """Directory of one-document files: whole file as ``content``, its name as ``name``.

    With ``folders``, documents are as ``write_stored_readmes`` leaves them: files
    ``name=<its name>`` in a folder per task, or each a file in a folder ``name=<its name>``,
    as Spark writes them. Hidden names are left out. An import format only: one file per
    document is too many files for a large corpus.
    """
    root = local_folder(spark, path) if folders else None
    parts = part_folders(root) if root else []
    if parts:
        return _read_parts(spark, parts)
    # Names come from the paths: no column is inferred from the folders.
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=folders)
    name = F.col("_metadata.file_name")
    if folders:
        name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/name=([^/]+)/[^/]+$", 1))
    return files.select(name.alias("name"), F.col("value").alias("content"))


def _read_parts(spark: SparkSession, parts: list[str]) -> DataFrame:
    """Every folder is listed and read by a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield from read_part(parts[part])

    found = spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "name binary, content binary")
    return found.select(F.col("name").cast("string"), F.col("content").cast("string"))


def read_readme_records(spark: SparkSession, path: str, dated: bool = False) -> DataFrame:
    """JSON lines of README records."""
    schema = schemas.DATED_README_RECORD if dated else schemas.README_RECORD
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of embedding result files with their order; blank lines are left out.

    ``line_no`` grows from file to file by name, inside a file by the offset of the
    split, and inside that by row: however files are cut into tasks, one line is the
    last. Folders ``batch_id=<id>`` give a column ``batch_id``.
    """
    files = spark.read.text(path)
    lines = files.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        *files.columns,
    )
    return lines.where(F.length(F.btrim("value")) > 0)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not have been written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_batch_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Items of batches in flight; entries without item metadata are dropped."""
    ledger = read_or_empty(spark, path, schemas.BATCH_ITEM)
    return ledger.where(F.col("id").isNotNull())


def read_open_object_store(spark: SparkSession, uri: str, schema: T.StructType) -> DataFrame:
    """ORC from a public bucket without credentials (``s3a://``; needs the Hadoop S3 jar)."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(
        "fs.s3a.aws.credentials.provider",
        "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider",
    )
    return spark.read.schema(schema).orc(uri)
