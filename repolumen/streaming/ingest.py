"""Incremental ingest: a stream of README records into the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from repolumen.operators.embedding import Embedder
from repolumen.operators.index import BUCKET_ROWS, MOST_SEGMENTS, IndexConflict, compact
from repolumen.plans.ingest import ingest
from repolumen.sources import schemas


def read_record_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """New JSON-lines files of README records, as they arrive."""
    reader = spark.readStream.schema(schemas.README_RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def start_ingest(
    records: DataFrame, index_root: str, embedder: Embedder, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Embed and append new content of every micro-batch.

    A batch is deduplicated against the index it is written to: running one
    again after a failure adds nothing twice, and no watermark is needed. The
    stream checkpoint remembers which files are done.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        ingest(batch.select("repo_name", "content"), index_root, embedder, small_batch=True)

    writer = records.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def start_compaction(
    spark: SparkSession,
    index_root: str,
    checkpoint: str,
    once: bool = True,
    most_segments: int = MOST_SEGMENTS,
    bucket_rows: int = BUCKET_ROWS,
) -> StreamingQuery:
    """Compact crowded buckets whenever the index got new manifests.

    Runs beside the ingest stream. If the index is split by someone else meanwhile, this
    turn's work is left out; the next manifest calls for it again.
    """
    manifests = spark.readStream.option("pathGlobFilter", "*.json").option("wholetext", True)

    def one_turn(batch: DataFrame, batch_id: int) -> None:
        try:
            compact(spark, index_root, most_segments=most_segments, bucket_rows=bucket_rows)
        except IndexConflict:
            pass

    writer = (
        manifests.text(f"{index_root}/manifest")
        .writeStream.foreachBatch(one_turn)
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()
