"""User-supplied stages: embed texts, generate texts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolumen.functions.numbers import USD_PER_MILLION_TOKENS, estimated_tokens, token_cost
from repolumen.operators.packing import CALL_CHARS, CALL_ROWS, pack_bounds

EMBED_DIM = 4096
EMBED_RETRIES = 10

# texts -> (one vector per text, tokens used by the call)
EmbedCall = Callable[[Sequence[str]], tuple[Sequence[Sequence[float]], int]]


class ServiceError(Exception):
    """An embedding service answered with an HTTP status other than 200."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"service error {status}: {text}")
        self.status = status


class BudgetExhausted(ServiceError):
    """Status 402: stop cleanly; what is committed stays and a later run goes on."""

    def __init__(self, text: str = ""):
        super().__init__(402, text)


def is_budget_stop(error: BaseException) -> bool:
    """True if a failed job was stopped by :class:`BudgetExhausted` inside a task."""
    return BudgetExhausted.__name__ in str(error)


@dataclass(frozen=True)
class Embedder:
    """An embedding service: how to call it, what it costs, how much fits a call.

    ``connect`` is called once per task with one access key after the other;
    calls then take turns between the keys.
    """

    connect: Callable[[str], EmbedCall]
    dimension: int = EMBED_DIM
    usd_per_million: float = USD_PER_MILLION_TOKENS["realtime"]
    keys: tuple[str, ...] = ("",)
    max_rows: int = CALL_ROWS
    max_chars: int = CALL_CHARS
    retries: int = EMBED_RETRIES
    sleep: Callable[[float], None] = field(default=time.sleep)

    def call(self, service: EmbedCall, texts: Sequence[str]) -> tuple[np.ndarray, int]:
        """One call with retries on overload and server errors."""
        for left in range(self.retries, -1, -1):
            try:
                vectors, tokens = service(texts)
                break
            except ServiceError as error:
                if left == 0 or not (error.status >= 500 or error.status == 429):
                    raise
                self.sleep((11 - left) * 2)
        matrix = np.asarray(vectors, dtype=np.float32)
        if matrix.shape != (len(texts), self.dimension):
            raise ValueError(f"expected {len(texts)} x {self.dimension}, got {matrix.shape}")
        return matrix, int(tokens or 0)


def embed_column(
    df: DataFrame, embedder: Embedder, text_col: str = "content", pending_on_stop: bool = False
) -> DataFrame:
    """Replace a text column by ``vector`` and the ``tokens`` and ``cost`` of its call.

    Calls are packed from neighbouring rows of a task, so no row is shuffled.
    Tokens and cost stand on the first row of a call and are 0 on the others:
    sums over any rows written are exact. :class:`BudgetExhausted` fails the job; with
    ``pending_on_stop`` the task makes no more calls, what it has bought stays, and
    rows not embedded come back with a null vector.
    """
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType(
        [
            *kept,
            T.StructField("vector", T.ArrayType(T.FloatType())),
            T.StructField("tokens", T.LongType()),
            T.StructField("cost", T.DoubleType()),
        ]
    )
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        turn = context.partitionId() if context else 0
        services = [embedder.connect(key) for key in embedder.keys]
        stopped = False
        for batch in batches:
            texts = batch[text_col].tolist()
            sizes = [len(t) for t in texts]
            for start, stop in pack_bounds(sizes, embedder.max_rows, embedder.max_chars):
                if start == stop:
                    continue
                service = services[turn % len(services)]
                turn += 1
                vectors, tokens = [None] * (stop - start), 0
                if not stopped:
                    try:
                        matrix, tokens = embedder.call(service, texts[start:stop])
                        vectors = list(matrix)
                    except BudgetExhausted:
                        if not pending_on_stop:
                            raise
                        stopped = True
                out = batch.iloc[start:stop][names].copy()
                out["vector"] = vectors
                out["tokens"] = [tokens] + [0] * (stop - start - 1)
                out["cost"] = out["tokens"] / 1_000_000 * embedder.usd_per_million
                yield out

    return df.select(*names, text_col).mapInPandas(run, schema)


def generate_column(
    df: DataFrame, make_generate: Callable[[], Callable[[str], str]], text_col: str, out_col: str
) -> DataFrame:
    """Add the text a generator writes for each row; the client is made once per task."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generate()
        for batch in batches:
            yield batch.assign(**{out_col: [generate(text) for text in batch[text_col]]})

    return df.mapInPandas(run, schema)


def cost_estimate(items: DataFrame, usd_per_million: float | Column) -> DataFrame:
    """Items, estimated tokens and dollars before anything is embedded."""
    chars = F.coalesce(F.sum(F.char_length("content")), F.lit(0))
    price = usd_per_million if isinstance(usd_per_million, Column) else F.lit(usd_per_million)
    totals = items.agg(F.count("*").alias("items"), estimated_tokens(chars).alias("tokens"))
    return totals.withColumn("cost", token_cost(F.col("tokens"), price))


def usage_totals(embedded: DataFrame) -> DataFrame:
    """Items, tokens and dollars of embedded rows; missing usage counts as 0."""
    return embedded.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum(F.coalesce("tokens", F.lit(0))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.coalesce("cost", F.lit(0.0))), F.lit(0.0)).alias("cost"),
    )
