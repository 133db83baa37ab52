"""Text quality by a hashed word n-gram logistic regression, trained with FTRL.

Features are words, word shapes (letter runs reduced to ``x`` or ``X``, digit runs to
``9``), pairs of both, and marks for pairs that repeat, hashed into a fixed number of
slots. A document is the unit vector of its damped counts; its score is a sparse dot
product. Training follows the regularised leader over a bounded, hash-ordered sample
of the labelled rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.llm.texts import with_text_columns
from repolumen.session import cut_lineage

SLOTS = 1 << 18
#: Labelled rows used for training: those with the smallest hash of their id.
TRAIN_ROWS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.0005
REMEMBERED = 100_000
LONG_WORD = 40
#: Words turned into features at once: bounds the memory of a very long text.
_PART = 200_000

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-ZX]+"), re.compile(r"\d+")


def shape_of(word: str) -> str:
    """``Then`` -> ``Xx``, ``THE!!`` -> ``X!!``, ``ab12`` -> ``x9``."""
    return _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word)))[:12]


class Codes(dict):
    """Word to the hashes of itself (upper half) and of its shape; unknown words are worked out."""

    def __missing__(self, word: bytes) -> int:
        digest = xxhash.xxh32_intdigest
        code = digest(word) << 32 | digest(shape_of(word.decode()).encode(), 7)
        if len(word) <= LONG_WORD:
            self[word] = code
        return code


@functools.cache
def _codes() -> Codes:
    return Codes()


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(salt)
        mixed ^= mixed >> np.uint64(29)
        return mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values, a unit vector; no words: no slots."""
    words = text.encode().split() if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    known = _codes()
    if len(known) >= REMEMBERED:
        known.clear()
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    codes = np.stack([codes >> np.uint64(32), codes & np.uint64((1 << 32) - 1)], axis=1)
    slots, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    seen_pairs = 0
    for at in range(0, len(codes), _PART):
        word, shape = codes[at : at + _PART + 1].T
        pairs = _pair(word[:-1], word[1:], 3)
        distinct = len(np.unique(pairs))
        seen_pairs += len(pairs) - distinct
        same = np.full(int((word[:-1] == word[1:]).sum()), 11, np.uint64)
        hashed = np.concatenate(
            [word[:_PART], _pair(shape, shape, 1)[:_PART], pairs, _pair(shape[:-1], shape[1:], 2), same]
        )
        found, times = np.unique((hashed % np.uint64(SLOTS)).astype(np.int64), return_counts=True)
        if len(slots):
            both, back = np.unique(np.concatenate([slots, found]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times])).astype(np.int64)
            slots = both
        else:
            slots, counts = found, times
    # A mark for the share of word pairs that came before, in tenths.
    tenth = 10 * seen_pairs // max(1, len(words) - 1)
    slots = np.append(slots, SLOTS + np.arange(tenth + 1))
    values = np.sqrt(np.append(counts, np.full(tenth + 1, max(1, len(words) // 4)))).astype(np.float32)
    return slots, values / np.linalg.norm(values)


WIDTH = SLOTS + 11


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Leader:
    """Follow-the-regularised-leader state: gradient sums ``z`` and squares ``n`` per slot."""

    def __init__(self) -> None:
        self.z = np.zeros(WIDTH + 1, np.float64)  # the last slot is the intercept
        self.n = np.zeros(WIDTH + 1, np.float64)

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        slots, values = np.append(slots, WIDTH), np.append(values, 1.0)
        weights = self.weights(slots)
        gradient = (_sigmoid(weights @ values) - label) * values
        squares = self.n[slots]
        rate = (np.sqrt(squares + gradient**2) - np.sqrt(squares)) / ALPHA
        self.z[slots] += gradient - rate * weights
        self.n[slots] = squares + gradient**2

    def all_weights(self) -> np.ndarray:
        return self.weights(slice(None)).astype(np.float32)


def sample_of(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids that may be learnt from: ``doc_id``, ``quality``."""
    usable = labels.where(
        F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    )
    first = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return first.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights by slot, learnt from at most ``rows`` labelled documents.

    Rows with a crc32 of the id divisible by 5, without a label of 0 or 1, or without
    a document are not used. Repeated ids count once, by their lowest label and text;
    other columns are not looked at. No rows: all weights are 0, every score one half.
    """
    sample = cut_lineage(sample_of(labels, rows), "label-sample")
    # Bounded by ``rows``: of several texts of one id the first is learnt from.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    chosen = labelled.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def vectors(texts):
        made = [features(t) for t in texts]
        return [[s for s, _ in made], [v for _, v in made]]

    seen = cut_lineage(
        with_text_columns(chosen, "text", vectors, "slots array<int>, vals array<float>", ["doc_id", "quality"]),
        "training-vectors",
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, data = Leader(), []
        for batch in batches:
            slots, values = batch.column(1), batch.column(2)
            for i, label in enumerate(batch.column(0).to_pylist()):
                data.append((slots[i].values.to_numpy(), values[i].values.to_numpy(), label))
        for _ in range(EPOCHS):
            for row in data:
                leader.learn(*row)
        yield pa.RecordBatch.from_arrays([pa.array([leader.all_weights().tobytes()])], ["weights"])

    ordered = (
        seen.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(5)), "doc_id")
        .select("quality", "slots", "vals")
    )
    made = ordered.mapInArrow(learn, "weights binary").collect()  # 1 MB, whatever the corpus
    return np.frombuffer(made[0]["weights"], np.float32) if made else Leader().all_weights()


def with_score(
    docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null, empty and white texts get the score of the intercept. Rows stay as many;
    columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def compute(texts):
        w = shared.value
        scores = []
        for text in texts:
            slots, values = features(text)
            scores.append(_sigmoid(float(w[slots] @ values) + float(w[WIDTH])))
        return [scores]

    scored = with_text_columns(docs, "text", compute, "score double", keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
