"""Asynchronous embedding batches as tables: requests, results, ledger, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.functions.numbers import USD_PER_MILLION_TOKENS, token_cost
from repolumen.operators.embedding import EMBED_DIM
from repolumen.sources.schemas import BATCH_RESULT_ROW

# Request address, completeness rule and length of a kept error text.
REQUEST_URL = "/v1/embeddings"
DONE_RATE = 0.99
SMALL_BATCH = 50
ERROR_CHARS = 200


def request_lines(items: DataFrame, model: str, dimensions: int = EMBED_DIM) -> DataFrame:
    """One JSON request per item (``id``, ``content``), as column ``value``."""
    body = F.struct(
        F.lit(model).alias("model"),
        F.col("content").alias("input"),
        F.lit(dimensions).alias("dimensions"),
    )
    line = F.struct(
        F.col("id").cast("string").alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(REQUEST_URL).alias("url"),
        body.alias("body"),
    )
    return items.select(F.to_json(line).alias("value"))


def parse_results(lines: DataFrame) -> DataFrame:
    """Result lines to rows: vector and tokens, or the error text of a failed item.

    Malformed JSON fails the job. The error is the response, or the whole line
    if there is none, cut to its first characters.
    """
    row = F.from_json("value", BATCH_RESULT_ROW, {"mode": "FAILFAST"})
    parsed = lines.withColumn("row", row)
    batch = ["batch_id"] if "batch_id" in lines.columns else []
    vector = F.get(F.col("row.response.data"), F.lit(0))["embedding"]
    raw = F.coalesce(F.get_json_object("value", "$.response"), F.get_json_object("value", "$"))
    return parsed.select(
        "line_no",
        *batch,
        F.col("row.custom_id").alias("id"),
        vector.alias("vector"),
        F.when(vector.isNotNull(), F.coalesce("row.response.usage.prompt_tokens", F.lit(0)))
        .otherwise(0)
        .alias("tokens"),
        F.when(vector.isNull(), F.substring(raw, 1, ERROR_CHARS)).alias("error"),
    )


def good_results(results: DataFrame) -> DataFrame:
    """Last vector per id, in file order."""
    return (
        results.where(F.col("vector").isNotNull())
        .groupBy("id")
        .agg(F.max_by("vector", "line_no").alias("vector"))
    )


def points_of(results: DataFrame, items: DataFrame) -> DataFrame:
    """Index points of known items; results of unknown ids are dropped."""
    return good_results(results).join(_one_per_id(items), "id")


def _one_per_id(items: DataFrame) -> DataFrame:
    """The item of the lowest repository name of every id."""
    lowest = F.min(F.struct("repo_name", "content_hash")).alias("item")
    return items.groupBy("id").agg(lowest).select("id", "item.repo_name", "item.content_hash")


def failures(results: DataFrame, items: DataFrame) -> DataFrame:
    """Failed rows with the repository they belong to, or the bare id."""
    named = items.groupBy("id").agg(F.min("repo_name").alias("repo_name"))
    return (
        results.where(F.col("vector").isNull())
        .join(named, "id", "left")
        .select("id", F.coalesce("repo_name", "id").alias("repo"), "error")
    )


def result_totals(
    results: DataFrame, usd_per_million: float = USD_PER_MILLION_TOKENS["async_batch"]
) -> DataFrame:
    """Lines, failures, tokens and dollars. Every good line counts, also a repeated one."""
    totals = results.agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("vector").isNull()).alias("failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
    return totals.withColumn("cost", token_cost(F.col("tokens"), F.lit(usd_per_million)))


def completeness(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Upserted share per batch and whether the batch may leave the ledger.

    Where results tell their ``batch_id``, an item counts only if its own batch answered it.
    """
    keys = ["batch_id", "id"] if "batch_id" in results.columns else ["id"]
    done_ids = results.where(F.col("vector").isNotNull()).select(*keys).distinct()
    joined = ledger.select("batch_id", "id").join(
        done_ids.withColumn("done", F.lit(True)), keys, "left"
    )
    per_batch = joined.groupBy("batch_id").agg(
        F.count("id").alias("items"), F.count("done").alias("upserted")
    )
    rate = F.try_divide("upserted", "items")
    return per_batch.withColumn("rate", rate).withColumn(
        "finished", F.coalesce(F.col("rate") >= DONE_RATE, F.lit(False)) | (F.col("items") < SMALL_BATCH)
    )


def dispositions(ledger: DataFrame, statuses: DataFrame) -> DataFrame:
    """What to do with every batch in the ledger on resume.

    A batch whose status is not known is asked for again, never given up: it may be
    paid for already.
    """
    batches = ledger.groupBy("batch_id").agg(F.count("id").alias("items"))
    status = F.col("status")
    action = (
        F.when((status == "completed") & F.col("output_file_id").isNotNull(), "download")
        .when(status.isNull() | status.isin("in_progress", "validating"), "poll")
        .otherwise("remove")
    )
    return batches.join(
        statuses.withColumnRenamed("id", "batch_id"), "batch_id", "left"
    ).select("batch_id", "items", "status", action.alias("action"))


def in_flight_ids(ledger: DataFrame, statuses: DataFrame) -> DataFrame:
    """Ids of batches that are finished or still running: not to be submitted again."""
    live = dispositions(ledger, statuses).where(F.col("action") != "remove").select("batch_id")
    return ledger.join(live, "batch_id", "left_semi").select("id")


def open_ledger(ledger: DataFrame, finished_batches: DataFrame) -> DataFrame:
    """The ledger without finished or removed batches (column ``batch_id``)."""
    return ledger.join(finished_batches.select("batch_id"), "batch_id", "left_anti")


def ledger_rows(chunked_items: DataFrame, batch_ids: DataFrame) -> DataFrame:
    """Ledger entries of submitted chunks: metadata only, no content.

    ``batch_ids`` has one row per chunk: ``chunk``, ``batch_id``, ``created_at``.
    """
    return chunked_items.join(batch_ids, "chunk").select(
        "batch_id", "created_at", "id", "repo_name", "content_hash"
    )


def latest_progress(progress: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Last saved value per key of an append-only progress table."""
    return progress.groupBy(key).agg(F.max_by(value, at).alias(value))


def progress_total(polls: DataFrame) -> DataFrame:
    """Completed items over all batches, by the latest poll of each."""
    latest = latest_progress(polls, "batch_id", "completed", "ts")
    return latest.agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("completed"), F.lit(0)).alias("completed")
    )


def response_vectors(response: DataFrame) -> DataFrame:
    """Vectors of one realtime response in request order.

    ``data`` is an array of ``{embedding, index}`` in any order.
    """
    ordered = F.array_sort(F.transform("data", lambda d: F.struct(d["index"], d["embedding"])))
    return response.withColumn("vectors", F.transform(ordered, lambda d: d["embedding"]))
