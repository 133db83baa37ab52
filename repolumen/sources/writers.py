"""Sinks. Every job writes in parallel and commits as a whole."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.operators.fetch import OUTCOME_COLUMNS
from repolumen.session import cut_lineage
from repolumen.sources.files import local_folder
from repolumen.sources.stored import write_part

# Spark's folder of rows without a name.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
# Repeated names that are broadcast, and files that one task makes of the rows it reads.
REPEATED_NAMES, TASK_FILES = 50_000, 200_000


def write_zstd_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_sorted_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """Text lines in order: sorted inside each file and across files by name."""
    df.select(F.col(column).cast("string").alias("value")).sort("value").write.mode(mode).text(path)


def write_readme_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; a missing ``last_commit`` is written as null, not left out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_stored_readmes(readmes: DataFrame, path: str) -> None:
    """A file for every ``name``, its ``content`` as lines; a missing text is an empty line.

    ``read_stored_readmes`` with ``folders`` reads them. Texts are written where they are;
    only those of repeated names meet, or all if these are many or a task had too many
    files to make. In a store that only Hadoop reads, files are in a folder per name, as
    Spark writes them.
    """
    root = local_folder(readmes.sparkSession, path)
    if root is None:
        files = readmes.select("name", F.col("content").alias("value"))
        writer = files.repartition("name").write.partitionBy("name")
        # Every task moves its own files into place; by default the driver moves all, one after the other.
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return

    os.makedirs(root)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(NO_NAME))
    files = readmes.select(name.alias("name"), "content")
    repeated = files.groupBy("name").count().where("count > 1").select("name")
    several = repeated.count()
    rows = files.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0
    if several > REPEATED_NAMES or rows > TASK_FILES:
        _write_parts(files.repartition("name"), root, "all")
    elif several:
        repeated = cut_lineage(repeated, "repeated-names")
        _write_parts(files.join(F.broadcast(repeated), "name", "left_anti"), root, "single")
        shared = files.join(F.broadcast(repeated), "name", "left_semi")
        _write_parts(shared.repartition("name"), root, "repeated")
    else:
        _write_parts(files, root, "single")


def _write_parts(files: DataFrame, root: str, kind: str) -> None:
    """Every task makes a folder of its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write_part(root, f"{kind}-{TaskContext.get().partitionId():05d}", batches)
        return iter(())

    written = files.select(F.col("name").cast("binary"), F.col("content").cast("binary"))
    written.mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def write_outcomes(outcomes: DataFrame, path: str, mode: str = "append") -> None:
    """Fetch outcomes partitioned by class: readers of failures never touch content."""
    outcomes.select(*OUTCOME_COLUMNS).write.mode(mode).option("compression", "zstd").partitionBy(
        "outcome"
    ).parquet(path)


def write_request_lines(requests: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Embedding requests (one JSON text per row, column ``value``)."""
    requests.select("value").write.mode(mode).text(path)


def append_ledger(items: DataFrame, path: str) -> None:
    items.write.mode("append").option("compression", "zstd").parquet(path)


def append_progress(progress: DataFrame, path: str) -> None:
    """One more progress row per key; readers take the latest."""
    progress.write.mode("append").parquet(path)
