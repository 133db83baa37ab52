"""Columns computed in Python from one text column, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_INPUT = "_text_input"
#: Rows that are Python objects at once: a batch of texts takes several times its bytes as strings.
ROWS = 256
#: Rows made at once, and bytes of an Arrow batch between Spark and Python.
MADE_ROWS, BATCH_BYTES = 512, 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bound_batches(df: DataFrame) -> None:
    """Batches of long texts must not fill an executor: each is held on both sides."""
    conf = df.sparkSession.conf
    if int(str(conf.get(_BATCH_CONF)).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def with_text_columns(
    df: DataFrame,
    column: str,
    compute: Callable[[Sequence[str | None]], Sequence[Sequence]],
    fields: str,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` (all columns if None) and the columns ``fields`` that ``compute`` returns.

    ``compute`` gets the texts of a batch and returns one sequence per new column.
    New columns replace kept ones of the same name.
    """
    added = StructType.fromDDL(fields)
    names = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    schema = StructType([df.schema[c] for c in names] + list(added))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            made = compute(batch.column(len(names)).to_pylist())
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(len(names))]
            arrays += [
                pa.array(values, arrow.field(len(names) + i).type) for i, values in enumerate(made)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    _bound_batches(df)
    chosen = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{column}`").alias(_INPUT))
    return chosen.mapInArrow(run, schema)


def exploded_text_rows(
    df: DataFrame,
    columns: Sequence[str],
    make_rows: Callable[..., Iterator[tuple]],
    fields: str,
) -> DataFrame:
    """Any number of rows ``fields`` for each row: ``make_rows(*values of columns)``."""
    schema = StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        made = [pa.array(values, f.type) for values, f in zip(zip(*rows), arrow)]
        return pa.RecordBatch.from_arrays(made, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows: list[tuple] = []
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(columns)))):
                for row in make_rows(*values):
                    rows.append(row)
                    if len(rows) == MADE_ROWS:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    _bound_batches(df)
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
