"""Rule-based quality: base counts of a text and compression bands.

Text that a general compressor shrinks too well repeats itself; text that it hardly
shrinks is noise. Short texts compress worse, so each length class has its own band.
The whole document and its fixed chunks are measured, since a repetitive stretch of a
long document hardly moves the ratio of the whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.llm.texts import with_text_columns

SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = re.compile("[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 8


@dataclass(frozen=True)
class Band:
    """Ratios (bytes before / after) accepted for texts of less than ``below`` bytes."""

    below: int
    least: float
    most: float


#: Prose of the labelled tables lies inside with a margin of a tenth or more.
BANDS = (
    Band(100, 0.4, 1.6),
    Band(300, 0.75, 2.2),
    Band(1_000, 1.1, 2.3),
    Band(3_000, 1.25, 2.5),
    Band(10_000, 1.4, 2.7),
    Band(1 << 62, 1.5, 2.9),
)
#: Bytes of a chunk, and the part of the chunks that may lie outside their band.
CHUNK, BAD_CHUNKS = 4_096, 0.25

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " whole_ratio double, n_chunks long, n_bad_chunks long"
)


@functools.cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


def ratio(data: bytes) -> float:
    return len(data) / len(_compressor().compress(data)) if data else 0.0


def in_band(n_bytes: int, value: float, bands: Sequence[Band] = BANDS) -> bool:
    band = next(b for b in bands if n_bytes < b.below)
    return band.least <= value <= band.most


def chunk_ratios(data: bytes) -> list[tuple[int, float]]:
    """Size and ratio of the fixed chunks; a shorter rest counts if it is half a chunk."""
    parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    return [(len(p), ratio(p)) for p in parts if len(p) * 2 >= CHUNK]


def repeated_words(words: Sequence[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        mixed = np.zeros(n, np.uint64)
        for k in range(window):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    _, inverse, counts = np.unique(mixed, return_inverse=True, return_counts=True)
    suspects = np.flatnonzero(counts[inverse] > 1)
    if not len(suspects):
        return 0
    # Hashes only nominate: the words themselves decide.
    seen: dict[tuple[str, ...], int] = {}
    first = [seen.setdefault(tuple(words[i : i + window]), i) for i in suspects.tolist()]
    again = {f for i, f in zip(suspects.tolist(), first) if f != i}
    starts = np.array([i for i, f in zip(suspects.tolist(), first) if f in again], np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def measure(text: str | None) -> tuple:
    text = text or ""
    data = text.encode()
    words = [w.decode() for w in data.split()]
    chunks = chunk_ratios(data)
    return (
        len(words),
        sum(map(len, words)),
        len(_IS_SYMBOL.findall(text)),
        repeated_lines(text),
        repeated_words(words),
        ratio(data),
        len(chunks),
        sum(not in_band(size, value) for size, value in chunks),
    )


def with_quality(docs: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with the base counts, the compression figures, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 % repeated words. ``kept`` is
    false then, and else tells whether the whole text's ratio is in the band of its
    length and at most a quarter of its chunks are outside theirs. A null text counts
    like an empty one: no words, base failed. Rows stay as many; columns of the new
    names are replaced.
    """

    def compute(texts):
        return list(zip(*map(measure, texts))) if texts else [[]] * 8

    size = "_bytes"
    while size in docs.columns:
        size += "_"
    named = with_text_columns(docs.withColumn(size, F.coalesce(F.octet_length("text"), F.lit(0))), "text", compute, FIELDS, [*(docs.columns if keep is None else keep), size])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.lit(False)
    for low, band in zip((0, *(b.below for b in BANDS)), BANDS):
        within = within | (
            (F.col(size) >= low) & (F.col(size) < band.below) & F.col("whole_ratio").between(band.least, band.most)
        )
    chunks_ok = F.col("n_bad_chunks") <= F.col("n_chunks") * BAD_CHUNKS
    return named.withColumns({"base_failed": failed, "kept": ~failed & within & chunks_ok}).drop(size)
