"""Approximate search: the index split into cells around k-means centers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolumen.operators.scoring import PART_BYTES, grid_of, pairs_of_task, rank_hits, score_cells, unit_rows, vector_matrix
from repolumen.session import cut_lineage

MAX_CENTER_BYTES = 256 << 20  # centers are sent to every task


def _first_centers(index: DataFrame, n_cells: int, dimension: int) -> np.ndarray:
    """The rows of the lowest hashes, whose vector is not zero."""
    usable = index.where(F.exists("vector", lambda x: x != 0))
    rows = usable.select(F.xxhash64("id").alias("h"), "id", "vector").orderBy("h", "id").limit(n_cells)
    return unit_rows(np.array([row["vector"] for row in rows.collect()], dtype=float).reshape(-1, dimension))


def _means(celled: DataFrame, dimension: int) -> dict[int, np.ndarray]:
    """The unit mean of the unit vectors of every cell; each task sums up its own rows first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            units, cell = unit_rows(vector_matrix(batch["vector"], dimension)), batch["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1)) if len(cell) else []
            for c, total in zip(cell[order][first].tolist(), np.add.reduceat(units[order], first) if len(first) else []):
                sums[c] = sums[c] + total if c in sums else total
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))],
            ["cell", "total"],
        )

    parts = celled.select("vector", "cell").mapInArrow(partial, "cell int, total array<double>")
    places = parts.select("cell", F.posexplode("total").alias("at", "part"))
    sums = places.groupBy("cell", "at").agg(F.sum("part").alias("x"))
    rows = sums.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("mean"))
    return {r["cell"]: unit_rows(np.array([[p["x"] for p in r["mean"]]]))[0] for r in rows.collect()}


def fit_centers(index: DataFrame, n_cells: int, max_iter: int = 10) -> np.ndarray:
    """Unit centers of the cells: rounds of k-means by cosine over all rows.

    Every round is one pass in which tasks assign and add up their rows; the driver
    sees the centers only. A cell that loses all rows keeps its center.
    """
    head = index.select(F.size("vector").alias("n")).where("n > 0").head()
    if head is None:
        raise ValueError("an index without vectors has no cells")
    dimension = head["n"]
    if 8 * n_cells * dimension > MAX_CENTER_BYTES:
        raise ValueError(f"{n_cells} centers are too many to send to every task")
    centers = _first_centers(index, n_cells, dimension)
    for _ in range(max_iter):
        moved = centers.copy()
        for cell, mean in _means(with_cells(index, centers), dimension).items():
            if mean.any():
                moved[cell] = mean
        settled, centers = np.abs(moved - centers).max() < 1e-6, moved
        if settled:
            break
    return centers


def centers_of(celled: DataFrame) -> np.ndarray:
    """Unit centers of an index that has a ``cell`` already: the means of its cells, by ascending cell."""
    dimension = celled.select(F.size("vector").alias("n")).head()["n"]
    means = _means(celled.withColumn("cell", F.col("cell").cast("int")), dimension)
    return np.array([means[cell] for cell in sorted(means)])


def with_cells(index: DataFrame, centers: np.ndarray) -> DataFrame:
    """Nearest center of every row as ``cell``; narrow, one pass."""
    dimension = centers.shape[1]
    shared = index.sparkSession.sparkContext.broadcast(centers)
    schema = T.StructType([*index.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(vector_matrix(batch["vector"], dimension))
            cell = (units @ shared.value.T).argmax(axis=1).astype(np.int32)
            yield batch.append_column("cell", pa.array(cell))

    return index.mapInArrow(run, schema)


def write_cells(celled: DataFrame, path: str) -> None:
    """Index partitioned by cell.

    Rebalancing gathers small cells and splits crowded ones by their size at run
    time, so a cell with a third of all rows is written, and later read, by many tasks.
    """
    celled.hint("rebalance", F.col("cell")).write.option("compression", "zstd").partitionBy(
        "cell"
    ).parquet(path)


def probed_cells(queries: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """A row of the queries (``qid, k, vector``) for each of their ``probes`` nearest cells."""
    dimension, many = centers.shape[1], min(probes, len(centers))
    shared = queries.sparkSession.sparkContext.broadcast(centers)
    chosen = queries.select("qid", "k", "vector")
    schema = T.StructType([*chosen.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(vector_matrix(batch["vector"], dimension))
            nearest = np.argsort(-(units @ shared.value.T), axis=1, kind="stable")[:, :many]
            again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), many)))
            yield again.append_column("cell", pa.array(nearest.ravel().astype(np.int32)))

    return chosen.mapInArrow(run, schema)


def cell_top_k(
    queries: DataFrame,
    celled_index: DataFrame,
    centers: np.ndarray,
    probes: int,
    payload: tuple[str, ...] = (),
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Top-k over the ``probes`` nearest cells of each query.

    Only probed cells are read (partition pruning when stored by cell). A crowded cell is
    a grid of its own, by the scores to be computed in it. Probing all cells gives the
    exact result.
    """
    dimension, spark = centers.shape[1], queries.sparkSession
    asked = cut_lineage(probed_cells(queries, centers, probes), "probes")
    wanted = {r["cell"]: r for r in asked.groupBy("cell").agg(F.max("k").alias("k"), F.count("*").alias("n")).collect()}
    max_k = max((row["k"] for row in wanted.values()), default=0)
    rows = celled_index.where(F.col("cell").isin(list(wanted)))
    counts = {row["cell"]: row["count"] for row in rows.groupBy("cell").count().collect()}
    pairs = pairs_of_task(spark, sum(wanted[c]["n"] * n for c, n in counts.items()))
    # A row for each center at most; numbers the tasks of all cells.
    grids, cells = [], 0
    for cell, n in counts.items():
        groups, slabs = grid_of(wanted[cell]["n"], n, dimension, wanted[cell]["k"] or 0, len(payload), pairs)
        grids.append((cell, cells, groups, slabs))
        cells += groups * slabs
    table = F.broadcast(spark.createDataFrame(grids, "cell int, first int, groups int, slabs int"))
    first, groups, slabs = F.col("first"), F.col("groups"), F.col("slabs")
    slab, group = F.pmod(F.xxhash64("id"), slabs), F.pmod(F.xxhash64("qid"), groups)
    every_group = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: first + slab * groups + g)
    every_slab = F.transform(F.sequence(F.lit(0), slabs - 1), lambda s: first + s * groups + group)
    held = rows.join(table, "cell").withColumn("cell", F.explode(every_group))
    asking = asked.join(table, "cell").withColumn("cell", F.explode(every_slab))
    return rank_hits(score_cells(held, asking, dimension, list(payload), max(1, cells), part_bytes), max_k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, over all queries."""
    pairs = exact.select("qid", "id").join(
        found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left"
    )
    return pairs.agg(
        F.count("*").alias("exact_hits"),
        F.count("hit").alias("found_hits"),
        F.try_divide(F.count("hit"), F.count("*")).alias("recall"),
    )
