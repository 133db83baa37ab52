"""Health of fetch sources: exponential moving average of response times.

``t = 0.8 t + 0.2 x`` from a first estimate; a failed attempt counts as a fixed, slow
response. Any run of attempts is one linear step ``out = decay * in + gain``, and steps
compose. So the log is cut into ranges by source and time, whatever a source's share
of it: every range is folded alone, one row of each range and source is chained, and the
chained estimate is added to the rows of the range. Attempts without a source are one
source of their own; those without a time come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolumen.session import cut_lineage

# Smoothing, first estimate and penalty in milliseconds.
KEEP = 0.8
FIRST_ESTIMATE_MS = 1000.0
FAILURE_MS = 15_000.0


def response_ms(ms: Column, failed: Column) -> Column:
    return F.when(failed, F.lit(FAILURE_MS)).otherwise(ms.cast("double"))


def _runs(column: pa.Array) -> list[tuple[int, int, object]]:
    """``(start, end, value)`` of equal neighbours; nulls are equal."""
    if not len(column):
        return []
    coded = column.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(codes)) + 1
    starts = [0, *cuts.tolist()]
    names = coded.dictionary.to_pylist()
    return [(a, b, None if codes[a] < 0 else names[codes[a]]) for a, b in zip(starts, [*starts[1:], len(codes)])]


def _folded(ms: np.ndarray, before: float) -> np.ndarray:
    out, now = np.empty(len(ms)), before
    for i, x in enumerate(ms.tolist()):
        now = now * KEEP + x * (1 - KEEP)
        out[i] = now
    return out


def _local_folds(log: DataFrame) -> DataFrame:
    """Rows with their ``part``, place ``n`` in it among those of the source, and the fold from zero.

    Parts are ranges of (source, ts, event_id): a source with most of the rows is spread
    over many parts, and their numbers follow the order.
    """
    kept = log.select("source", "ts", "event_id", F.col("ms").cast("double").alias("ms"))
    # A given number keeps a busy source on many tasks, also where all rows would fit into one.
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        kept.repartitionByRange(tasks, "source", "ts", "event_id")
        .sortWithinPartitions("source", "ts", "event_id")
        .withColumn("part", F.spark_partition_id())
    )
    added = [T.StructField("n", T.LongType()), T.StructField("local", T.DoubleType())]
    schema = T.StructType([f for f in placed.schema if f.name != "ms"] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, n, now = object(), 0, 0.0
        for batch in batches:
            ms = batch["ms"].to_numpy(zero_copy_only=False)
            count, local = np.empty(len(ms), np.int64), np.empty(len(ms))
            for start, end, name in _runs(batch["source"]):
                if name != source or type(name) is not type(source):
                    source, n, now = name, 0, 0.0
                local[start:end] = _folded(ms[start:end], now)
                count[start:end] = np.arange(n + 1, n + 1 + end - start)
                n, now = n + end - start, float(local[end - 1])
            made = batch.drop_columns(["ms"])
            yield made.append_column("n", pa.array(count)).append_column("local", pa.array(local))

    return placed.mapInArrow(run, schema)


def _chained(steps: DataFrame) -> DataFrame:
    """``source``, ``part``, the estimate ``before`` the part and ``after`` it, from steps ``(n, local)``.

    There is a step for each part of a source: as many rows for a source as the log has
    parts, read in order without holding them.
    """
    ordered = steps.select("source", "part", "n", "local").repartition("source").sortWithinPartitions("source", "part")
    schema = T.StructType(
        [steps.schema["source"], steps.schema["part"], T.StructField("before", T.DoubleType()), T.StructField("after", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, now = object(), FIRST_ESTIMATE_MS
        for batch in batches:
            decay = KEEP ** batch["n"].to_numpy()
            gain = batch["local"].to_numpy()
            before, after = np.empty(len(gain)), np.empty(len(gain))
            for start, end, name in _runs(batch["source"]):
                if name != source or type(name) is not type(source):
                    source, now = name, FIRST_ESTIMATE_MS
                for i in range(start, end):
                    before[i] = now
                    after[i] = now = float(decay[i] * now + gain[i])
            made = batch.select(["source", "part"])
            yield made.append_column("before", pa.array(before)).append_column("after", pa.array(after))

    return ordered.mapInArrow(run, schema)


def _steps(folds: DataFrame) -> DataFrame:
    return folds.groupBy("source", "part").agg(F.max("n").alias("n"), F.max_by("local", "n").alias("local"))


def current_health(log: DataFrame) -> DataFrame:
    """Latest estimate per source (``source, ts, event_id, ms``)."""
    chained = _chained(_steps(_local_folds(log)))
    return chained.groupBy("source").agg(F.max_by("after", "part").alias("health_ms"))


def health_history(log: DataFrame) -> DataFrame:
    """``source``, ``ts``, ``event_id`` and the estimate ``health_ms`` after every attempt."""
    folds = cut_lineage(_local_folds(log), "health-folds")
    starts = _chained(_steps(folds)).select(F.col("source").alias("of"), F.col("part").alias("in_part"), "before")
    same = (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of"))
    return folds.join(starts, same).select(
        "source",
        "ts",
        "event_id",
        (F.pow(F.lit(KEEP), "n") * F.col("before") + F.col("local")).alias("health_ms"),
    )
