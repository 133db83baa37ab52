"""Dense row numbers without a single-task window, and what is cut by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def dense_ids(
    df: DataFrame, *order_by: str, id_col: str = "id", partitions: int | None = None
) -> DataFrame:
    """Number the rows 1..n in the given order.

    The rows are range-partitioned and sorted, each with its place inside its
    partition, and written once to the shared folder. One counter per partition
    then shifts the places. Rows of equal order keys are told apart by where they come
    from, so a key that very many rows share is spread over partitions as well. Runs
    the write when called.
    """
    keys = [*[F.col(c) for c in order_by], F.col("_from")]
    traced = df.withColumn("_from", F.monotonically_increasing_id())
    ranged = traced.repartitionByRange(partitions, *keys) if partitions else traced.repartitionByRange(*keys)
    placed = cut_lineage(
        ranged.sortWithinPartitions(*keys).drop("_from").withColumn("_place", F.monotonically_increasing_id()),
        "dense-ids",
    )
    part = F.shiftright("_place", _ROW_BITS)
    counters = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()
    shifts, before = [], 0
    for row in sorted(counters, key=lambda r: r["_part"]):
        shifts.append((row["_part"], before))
        before += row["n"]
    # One small row per partition of the written table: bounded by its task count.
    shift_df = df.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    row_in_part = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(shift_df), "_part")
        .select((F.col("_shift") + row_in_part + 1).alias(id_col), *df.columns)
    )


def id_slice(numbered: DataFrame, offset: int, limit: int | None, id_col: str = "id") -> DataFrame:
    """Ids in ``(offset, offset + limit]``: the share of one parallel worker."""
    found = numbered.where(F.col(id_col) > offset)
    return found if limit is None else found.where(F.col(id_col) <= offset + limit)


def paged(
    numbered: DataFrame, offset: int, limit: int | None, batch_size: int, id_col: str = "id"
) -> DataFrame:
    """The rows of :func:`id_slice` with the zero-based ``batch`` of ``batch_size`` they fall in.

    Every batch of a paging loop at once: workers take batches, no rows are read again.
    """
    batch = F.floor((F.col(id_col) - 1 - offset) / batch_size).cast("long")
    return id_slice(numbered, offset, limit, id_col).withColumn("batch", batch)


def hash_share(df: DataFrame, key: str, shares: int, share: int) -> DataFrame:
    """One of ``shares`` disjoint parts when only disjointness matters, not order."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(shares)) == share)


def keyset_page(numbered: DataFrame, last_id: int, size: int, id_col: str = "id") -> DataFrame:
    """The next ``size`` rows after ``last_id``."""
    return numbered.where(F.col(id_col) > last_id).orderBy(id_col).limit(size)


def with_chunks(
    numbered: DataFrame, size: int, id_col: str = "id", chunk_col: str = "chunk"
) -> DataFrame:
    """Zero-based chunk of ``size`` consecutive ids."""
    return numbered.withColumn(chunk_col, F.floor((F.col(id_col) - 1) / size).cast("long"))


def with_round_robin(
    df: DataFrame, lanes: int, chunk_col: str = "chunk", lane_col: str = "lane"
) -> DataFrame:
    """Lane (for example an access key) of each chunk, in turn."""
    return df.withColumn(lane_col, F.pmod(F.col(chunk_col), F.lit(lanes)).cast("long"))
