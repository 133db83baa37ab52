"""README records to index points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.operators import batches
from repolumen.operators.corpus import keyed_items, new_items, without_known
from repolumen.operators.embedding import Embedder, embed_column, usage_totals
from repolumen.operators.index import append_points, ensure_index, existing_ids, known_ids, replace_points
from repolumen.operators.numbering import dense_ids, with_chunks
from repolumen.operators.packing import JOB_ROWS
from repolumen.session import cut_lineage, scratch_scope


#: Items that are embedded and committed together.
COMMIT_ROWS = 200_000


def ingest(
    records: DataFrame,
    index_root: str,
    embedder: Embedder,
    small_batch: bool = False,
    commit_rows: int = COMMIT_ROWS,
) -> DataFrame:
    """Embed what is new and append it; items, tokens and cost of this run, and items ``pending``.

    A ``small_batch`` reads its records twice: first for their ids, so that of the
    index only the buckets they hit are read. Items are written out and embedded in
    parts of about ``commit_rows``. The vectors of a part are written as the service
    returns them, then appended to the index in one commit: paid work is lost neither
    with a task nor with what comes after. When the service's budget is used up, the
    part's vectors are committed and the rest is pending; the next run finds it new.
    """
    spark = records.sparkSession
    base = ensure_index(spark, index_root)
    with scratch_scope(spark):
        if small_batch:
            ids = keyed_items(records).where("id is not null").select("id").distinct()
            known = known_ids(spark, index_root, cut_lineage(ids, "batch-ids"), base)
        else:
            known = existing_ids(spark, index_root, base)
        items = new_items(records, known)
        parts, total = [items], None
        if not small_batch:
            items = cut_lineage(items, "new-items")
            total = items.count()
            count = max(1, math.ceil(total / commit_rows))
            part = F.pmod(F.xxhash64("id"), F.lit(count))
            parts = [items.where(part == i) if count > 1 else items for i in range(count)]
        done = []
        for part in parts:
            embedded = cut_lineage(embed_column(part, embedder, pending_on_stop=True), "embedded")
            bought = embedded.where("vector is not null")
            base = append_points(spark, index_root, bought, embedder.dimension, new_since=base)
            done.append((*usage_totals(bought).first(), embedded.count()))
            if done[-1][0] < done[-1][3]:
                break
        count, tokens, cost, seen = (sum(values) for values in zip(*done))
        pending = (seen if total is None else total) - count
        return spark.createDataFrame(
            [(count, tokens, float(cost), pending)], "items long, tokens long, cost double, pending long"
        )


def plan_batches(
    records: DataFrame, index_ids: DataFrame, in_flight: DataFrame, rows: int = JOB_ROWS
) -> DataFrame:
    """New items cut into jobs of ``rows``: column ``chunk`` numbers the jobs.

    Only ids are numbered; content joins back by id, so it is sorted nowhere.
    """
    items = new_items(records, index_ids, in_flight)
    chunks = with_chunks(dense_ids(items.select("id"), "id", id_col="n"), rows, "n").drop("n")
    return items.join(chunks, "id")


def collect_batches(
    result_lines: DataFrame, ledger: DataFrame, index_root: str, dimension: int
) -> tuple[DataFrame, DataFrame]:
    """Upsert finished results; completeness per batch and the failed rows."""
    spark = result_lines.sparkSession
    results = cut_lineage(batches.parse_results(result_lines), "results")
    replace_points(spark, index_root, batches.points_of(results, ledger), dimension)
    return batches.completeness(ledger, results), batches.failures(results, ledger)


def remaining_items(
    items: DataFrame, index_ids: DataFrame, ledger: DataFrame, statuses: DataFrame
) -> DataFrame:
    """Items neither indexed nor in a live batch."""
    return without_known(items, index_ids, batches.in_flight_ids(ledger, statuses))
