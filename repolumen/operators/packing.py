"""Packing texts into calls bounded by rows and characters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL_ROWS = 64
CALL_CHARS = 120_000
JOB_ROWS = 25_000


def pack_bounds(sizes: Sequence[int], max_rows: int, max_chars: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of one call each: first runs of ``max_rows``, then by characters.

    A text over the budget goes alone.
    """
    for run in range(0, len(sizes), max_rows):
        start, used = run, 0
        stop = min(run + max_rows, len(sizes))
        for i in range(run, stop):
            if i > start and used + sizes[i] > max_chars:
                yield start, i
                start, used = i, 0
            used += sizes[i]
        yield start, stop


def assign_packs(items: DataFrame, max_chars: int = CALL_CHARS) -> DataFrame:
    """Pack number of every item inside its chunk, in id order.

    ``items`` has ``chunk``, ``id`` and ``n_chars``; a chunk is a fixed, small
    number of consecutive ids, so its list stays small. The fold keeps the
    characters of the open pack and the packs given so far.
    """
    ordered = F.array_sort(F.collect_list(F.struct("id", "n_chars")))
    start = F.struct(
        F.lit(0).cast("long").alias("used"),
        F.array().cast("array<struct<id:bigint,n_chars:bigint,pack:int>>").alias("done"),
    )

    def step(acc, item):
        full = (F.size(acc["done"]) > 0) & (acc["used"] + item["n_chars"] > max_chars)
        last = F.coalesce(F.get(acc["done"], F.size(acc["done"]) - 1)["pack"], F.lit(0))
        pack = F.when(full, last + 1).otherwise(last)
        row = F.struct(
            item["id"].alias("id"), item["n_chars"].alias("n_chars"), pack.alias("pack")
        )
        return F.struct(
            F.when(full, item["n_chars"]).otherwise(acc["used"] + item["n_chars"]).alias("used"),
            F.concat(acc["done"], F.array(row)).alias("done"),
        )

    rows = items.select(
        "chunk", F.col("id").cast("long").alias("id"), F.col("n_chars").cast("long").alias("n_chars")
    )
    return (
        rows.groupBy("chunk")
        .agg(F.aggregate(ordered, start, step, lambda acc: acc["done"]).alias("done"))
        .select("chunk", F.inline("done"))
    )
