"""Exact top-k by cosine.

A few queries are a small side of checked size: they travel to every task once and
index rows stay where they are. Many queries meet the index in a grid: queries are cut
into groups that a task can hold with their hits, the index into slabs, and a task
streams its slab past its group, part by part. Either way a task keeps only the best k
rows per query, so what leaves it does not depend on how many rows it read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolumen.functions.vectors import cosine

BLOCK_BYTES = 64 << 20  # vectors of broadcast queries, in double precision
FEW_QUERIES = 256  # so many may always be broadcast
SMALL_SHARE = 16  # more only if the index has so many times their number of rows
PART_BYTES = 128 << 20  # vectors of an index part held by a task at once, in double precision
HELD_BYTES = 256 << 20  # queries and their best rows held by a task of the grid
LEAST_PAIRS, MOST_PAIRS = 1 << 22, 1 << 32  # scores computed by a task of the grid
SCORE_CELLS = 1 << 22  # scores held at once by a task (32 MB)
COMPACT_ROWS = 1 << 18  # candidates held before they are cut back to k per query, at least


@dataclass(frozen=True)
class QueryBlock:
    """Queries of one block: ids, wanted results and unit vectors."""

    qids: np.ndarray
    limits: np.ndarray
    units: np.ndarray

    @property
    def max_limit(self) -> int:
        return int(self.limits.max()) if len(self.limits) else 0


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero and so scores 0."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms == 0, 1.0, norms)[:, None]


def vector_matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """Rows of a list column as a double matrix; a wrong size is an error."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = array.value_lengths().to_numpy(zero_copy_only=False)
    if array.null_count or (sizes != dimension).any():
        raise ValueError(f"index holds vectors that do not have {dimension} components")
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def block_rows(dimension: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, block_bytes // (8 * dimension))


def as_block(table: pa.Table, dimension: int) -> QueryBlock:
    """A block of the rows ``qid, k, vector``."""
    if table.num_rows == 0:
        return QueryBlock(np.empty(0), np.empty(0, dtype=np.int64), np.empty((0, dimension)))
    return QueryBlock(
        qids=table["qid"].to_numpy(),
        limits=table["k"].to_numpy().astype(np.int64),
        units=unit_rows(vector_matrix(table["vector"], dimension)),
    )


class BestRows:
    """The best rows per query seen by one task; ties go to the lower id."""

    def __init__(self, block: QueryBlock, columns: list[str]):
        self.block = block
        self.columns = columns
        self.k = block.max_limit
        self.floor = np.full(len(block.qids), -np.inf)  # k-th best score so far
        self.parts: list[pd.DataFrame] = []
        self.held, self.bound = 0, COMPACT_ROWS

    def add(self, scores: np.ndarray, rows: pa.Table, queries: np.ndarray) -> None:
        """Scores of ``queries`` (positions in the block) against the table rows."""
        n = scores.shape[1]
        if n == 0 or self.k == 0:
            return
        floor = self.floor[queries]
        if n > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        at_query, at_row = np.nonzero(scores >= floor[:, None])
        if not len(at_query):
            return
        part = rows.take(pa.array(at_row)).to_pandas()
        part["_q"] = queries[at_query]
        part["_score"] = scores[at_query, at_row]
        self.parts.append(part)
        self.held += len(part)
        if self.held > self.bound:
            self.compact()
            # What must be held may be near the bound: wait until it has doubled.
            self.bound = max(COMPACT_ROWS, 2 * self.held)

    def compact(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame(columns=[*self.columns, "_q", "_score"])
        best = (
            pd.concat(self.parts, ignore_index=True)
            .sort_values(["_q", "_score", "id"], ascending=[True, False, True])
            .groupby("_q", sort=False)
            .head(self.k)
        )
        full = best.groupby("_q", sort=False)["_score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.floor[full.index.to_numpy(dtype=np.int64)] = full["min"].to_numpy()
        self.parts, self.held = [best], len(best)
        return best

    def result(self, schema: pa.Schema) -> pa.RecordBatch:
        best = self.compact()
        at = best["_q"].to_numpy(dtype=np.int64)
        arrays = {
            "qid": self.block.qids[at],
            "k": self.block.limits[at],
            "score": best["_score"].to_numpy(dtype=np.float64),
            **{c: best[c] for c in self.columns},
        }
        return pa.RecordBatch.from_arrays(
            [pa.array(arrays[f.name], type=f.type) for f in schema], schema=schema
        )


def _hit_schemas(index: DataFrame, columns: list[str]) -> tuple[T.StructType, pa.Schema]:
    """Schema of local hits, for Spark and for Arrow."""
    # Never null: a join on ``qid`` must not filter one use of the hits and so score twice.
    fields = [T.StructField(n, t, False) for n, t in (("qid", T.LongType()), ("k", T.LongType()), ("score", T.DoubleType()))]
    out = T.StructType([*fields, *(index.schema[c] for c in columns)])
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
    return out, pa.schema([(f.name, kinds[f.dataType]) for f in out])


def score_block(
    index: DataFrame, shared: Broadcast, dimension: int, payload: list[str]
) -> DataFrame:
    """Local top-k of every task for the broadcast :class:`QueryBlock`."""
    columns = ["id", *payload]
    out, arrow_out = _hit_schemas(index, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        best = BestRows(mine, columns)
        everyone = np.arange(len(mine.qids))
        step = max(1, SCORE_CELLS // max(1, len(everyone)))
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for start in range(0, table.num_rows, step):
                rows = table.slice(start, step)
                units = unit_rows(vector_matrix(rows["vector"], dimension))
                best.add(mine.units @ units.T, rows.select(columns), everyone)
        if len(everyone):
            yield best.result(arrow_out)

    return index.select(*columns, "vector").mapInArrow(run, out)


def score_cells(
    index: DataFrame, queries: DataFrame, dimension: int, payload: list[str], cells: int, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Local top-k of every cell (0 to ``cells`` - 1): its index rows against its queries.

    Both sides meet in one shuffle by cell, queries first. A task holds the queries of
    one cell, which the caller has bounded, with their best rows, and streams the index
    rows past them in parts of ``part_bytes`` at most.
    """
    columns = ["id", *payload]
    out, arrow_out = _hit_schemas(index, columns)
    kind = T.ArrayType(T.FloatType()) if index.schema["vector"].dataType == queries.schema["vector"].dataType == T.ArrayType(T.FloatType()) else T.ArrayType(T.DoubleType())
    nothing = F.lit(None)
    at, vector = F.col("cell").cast("int").alias("cell"), F.col("vector").cast(kind).alias("vector")
    held = index.select(at, F.lit(1).alias("side"), nothing.cast("long").alias("qid"), nothing.cast("long").alias("k"), *columns, vector)
    asked = queries.select(
        at, F.lit(0).alias("side"), F.col("qid").cast("long").alias("qid"), F.col("k").cast("long").alias("k"),
        *[nothing.cast(index.schema[c].dataType).alias(c) for c in columns], vector,
    )
    # A cell is a partition of its own: hashed, several could fall into one task.
    met = held.unionByName(asked).repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "side")
    part_rows = max(1, part_bytes // (8 * dimension))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asking, best = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cell, side = table["cell"].to_numpy(), table["side"].to_numpy()
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, table.num_rows]):
                piece = table.slice(start, end - start)
                if end == start:
                    continue
                if cell[start] != current:
                    if best is not None:
                        yield best.result(arrow_out)
                    current, asking, best = cell[start], [], None
                if side[start] == 0:
                    asking.append(piece.select(["qid", "k", "vector"]))
                    continue
                if best is None:
                    if not asking:
                        continue
                    best, asking = BestRows(as_block(pa.concat_tables(asking), dimension), columns), []
                    everyone = np.arange(len(best.block.qids))
                    step = min(part_rows, max(1, SCORE_CELLS // len(everyone)))
                for first in range(0, piece.num_rows, step):
                    rows = piece.slice(first, step)
                    units = unit_rows(vector_matrix(rows["vector"], dimension))
                    best.add(best.block.units @ units.T, rows.select(columns), everyone)
        if best is not None:
            yield best.result(arrow_out)

    return met.mapInArrow(run, out)


def rank_hits(hits: DataFrame, max_k: int) -> DataFrame:
    """Top-k per query: higher score first, then the lower id.

    The literal bound on the rank lets Spark cut every partition to ``max_k``
    rows per query before the shuffle; each query's own ``k`` is applied after.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max_k)
        .where(F.col("rank") <= F.col("k"))
        .withColumn("rank", F.col("rank").cast("long"))
        .drop("k")
    )


def grid_of(n_queries: int, n_rows: int, dimension: int, max_k: int, payload: int, pairs: int) -> tuple[int, int]:
    """Groups of queries and slabs of the index: a task scores about ``pairs`` of them.

    A group fits ``HELD_BYTES`` with its hits (``payload`` more columns each). Of the
    grids that do, the one that shuffles least: queries go to every slab and bring hits
    from it, index rows go to every group.
    """
    held = 8 * dimension + 2 * max_k * (48 + 80 * payload)
    least = max(1, math.ceil(n_queries * held / HELD_BYTES))
    cells = max(1, math.ceil(n_queries * n_rows / pairs))
    asked, found = 4 * dimension * n_queries, max_k * (32 + 16 * payload) * n_queries

    def shuffled(grid: tuple[int, int]) -> int:
        groups, slabs = grid
        return slabs * (asked + found) + groups * 4 * dimension * n_rows

    return min(((max(least, math.ceil(cells / slabs)), slabs) for slabs in range(1, cells + 1)), key=shuffled)


def pairs_of_task(spark: SparkSession, pairs: int) -> int:
    """Scores for each task of a grid: all cores work, and a task's time does not grow with the tables."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    return max(LEAST_PAIRS, min(MOST_PAIRS, math.ceil(pairs / tasks)))


def in_grid(
    queries: DataFrame, index: DataFrame, dimension: int, n_queries: int, n_rows: int, max_k: int, payload: int = 0
) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the ``cell`` in which they meet, and the number of cells.

    Queries are cut into groups by their id, the index into slabs; every group meets every slab.
    """
    pairs = pairs_of_task(queries.sparkSession, n_queries * n_rows)
    groups, slabs = grid_of(n_queries, n_rows, dimension, max_k, payload, pairs)
    slab, group = F.pmod(F.xxhash64("id"), F.lit(slabs)), F.pmod(F.xxhash64("qid"), F.lit(groups))
    to_groups = F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: slab * groups + g))
    to_slabs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(slabs - 1)), lambda s: s * groups + group))
    return queries.withColumn("cell", to_slabs), index.withColumn("cell", to_groups), slabs * groups


def exact_top_k(
    queries: DataFrame,
    index: DataFrame,
    dimension: int,
    payload: tuple[str, ...] = (),
    block_bytes: int = BLOCK_BYTES,
    n_queries: int | None = None,
    max_k: int | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Exact search: ``qid, score, id, payload.., rank`` for queries (``qid, k, vector``).

    ``n_queries`` and ``max_k``, the largest ``k``, save a look at the queries, and with
    it a second run of a stage that made the vectors. For many queries the rows of the
    index are counted: give a stored one.
    """
    if n_queries is None or max_k is None:
        size = queries.agg(F.count("*").alias("n"), F.max("k").alias("k")).first()
        n_queries, max_k = size["n"], size["k"] or 0
    fit = n_queries <= block_rows(dimension, block_bytes)
    n_rows = 0 if fit and n_queries <= FEW_QUERIES else index.count()
    if fit and (n_queries <= FEW_QUERIES or n_queries * SMALL_SHARE <= n_rows):
        block = as_block(queries.select("qid", "k", "vector").toArrow(), dimension)
        shared = queries.sparkSession.sparkContext.broadcast(block)
        return rank_hits(score_block(index, shared, dimension, list(payload)), block.max_limit)
    asked, held, cells = in_grid(queries, index, dimension, n_queries, n_rows, max_k, len(payload))
    return rank_hits(score_cells(held, asked, dimension, list(payload), cells, part_bytes), max_k)


def top_k_for_one(
    index: DataFrame, vector: list[float], k: int, payload: tuple[str, ...] = ()
) -> DataFrame:
    """Top-k of a single query as plain expressions: sorted limit, no shuffle of rows."""
    literal = F.array(*[F.lit(float(x)) for x in vector])
    score = F.coalesce(cosine(F.col("vector"), literal), F.lit(0.0))
    return (
        index.select("id", *payload, score.alias("score"))
        .orderBy(F.desc("score"), "id")
        .limit(k)
    )
