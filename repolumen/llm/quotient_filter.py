"""Counting quotient filters: multisets of fingerprints as quotients, remainders and counts.

A fingerprint of ``bits`` bits is cut into a quotient, which names a run, and a
remainder, which stands in a slot of that run. Three bits tell what is where: one per
quotient (it has a run), one per slot (the run ends here), one per slot (the slot
holds a counter digit of the remainder before it, not a remainder). Runs follow each
other without gaps, remainders in a run ascend. No bit of a fingerprint is lost, so
the filter lists its fingerprints in order, and two filters merge by walking both lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fingerprints of a partition that make up one filter; more make more filters.
FILTER_ROWS = 1 << 21
#: Fingerprints that a block of the merged filter holds, about.
BLOCK_ROWS = 1 << 16
#: Bits of a fingerprint beyond those that number as many rows.
REMAINDER_BITS = 32
_HEAD = np.dtype([("bits", "<u4"), ("q", "<u4"), ("slots", "<u8")])


def _width(bits: int) -> str:
    return "<u4" if bits <= 32 else "<u8"


def encode(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of distinct ascending ``prints`` (below ``2 ** bits``, 62 at most) and their ``counts``."""
    q = min(len(prints).bit_length(), bits - 1)
    r = bits - q
    mask = np.uint64((1 << r) - 1)
    quotients, more = prints >> np.uint64(r), counts.astype(np.uint64) - np.uint64(1)
    digits = (more > 0).astype(np.int64) + (more > mask)
    ends = np.cumsum(digits + 1)
    at = ends - digits - 1
    total = int(ends[-1]) if len(ends) else 0
    slots = np.zeros(total, _width(r))
    slots[at] = prints & mask
    slots[at[digits > 0] + 1] = more[digits > 0] & mask
    slots[at[digits > 1] + 2] = more[digits > 1] >> np.uint64(r)
    counter = np.ones(total, np.uint8)
    counter[at] = 0
    last = np.ones(len(prints), bool)
    last[:-1] = quotients[1:] != quotients[:-1]
    run_end = np.zeros(total, np.uint8)
    run_end[ends[last] - 1] = 1
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotients.astype(np.int64)] = 1
    head = np.array([(bits, q, total)], _HEAD)
    return b"".join(x.tobytes() for x in (head, *map(np.packbits, (occupied, run_end, counter)), slots))


def decode(filter: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Ascending fingerprints, their counts, and the bits of a fingerprint."""
    head = np.frombuffer(filter, _HEAD, 1)[0]
    bits, q, total = (int(head[name]) for name in _HEAD.names)
    r, at, parts = bits - q, _HEAD.itemsize, []
    for size in (1 << q, total, total):
        packed = np.frombuffer(filter, np.uint8, (size + 7) // 8, at)
        parts.append(np.unpackbits(packed, count=size))
        at += len(packed)
    occupied, run_end, counter = parts
    slots = np.frombuffer(filter, _width(r), total, at).astype(np.uint64)
    starts = np.flatnonzero(counter == 0)
    run = (np.cumsum(run_end, dtype=np.int64) - run_end)[starts]
    prints = np.flatnonzero(occupied).astype(np.uint64)[run] << np.uint64(r) | slots[starts]
    digits = np.diff(starts, append=total) - 1
    more = np.zeros(len(starts), np.uint64)
    more[digits > 0] = slots[starts[digits > 0] + 1]
    more[digits > 1] |= slots[starts[digits > 1] + 2] << np.uint64(r)
    return prints, more.astype(np.int64) + 1, bits


def counted(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending ``prints`` with the sums of their ``counts``."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])[: len(prints)])
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def merge(filters: Iterable[bytes]) -> bytes:
    """One filter with all that ``filters`` of equal bits hold, counts added."""
    parts = [decode(f) for f in filters]
    prints, counts = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return encode(prints, counts, parts[0][2])


# --- on Spark -------------------------------------------------------------------


def print_bits(rows: int) -> tuple[int, int]:
    """Bits of a fingerprint for so many rows, and how many of them number the block."""
    quotient = max(1, rows.bit_length())
    return min(62, quotient + REMAINDER_BITS), max(0, quotient - BLOCK_ROWS.bit_length() + 1)


def build_filters(prints: DataFrame, bits: int, block_bits: int) -> DataFrame:
    """``(block, filter)``: the filter of each partition of ``prints`` (one long column), cut by leading bits."""
    rest = bits - block_bits

    def filters(found: np.ndarray) -> pa.RecordBatch:
        values, counts = np.unique(found, return_counts=True)
        blocks = (values >> np.uint64(rest)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        tails = values & np.uint64((1 << rest) - 1)
        made = [encode(tails[a:b], counts[a:b], rest) for a, b in zip(cuts, [*cuts[1:], len(values)])]
        return pa.RecordBatch.from_arrays([pa.array(blocks[cuts]), pa.array(made, pa.binary())], ["block", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += batch.num_rows
            if rows >= FILTER_ROWS:
                yield filters(np.concatenate(held))
                held, rows = [], 0
        if rows:
            yield filters(np.concatenate(held))

    return prints.mapInArrow(run, "block long, filter binary")


def merge_filters(filters: DataFrame) -> DataFrame:
    """``(block, filter)``: one filter for each block."""

    def merged(table: pa.Table) -> pa.Table:
        whole = merge(table.column("filter").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "filter": pa.array([whole], pa.binary())})

    return filters.groupBy("block").applyInArrow(merged, "block long, filter binary")


def list_counts(filters: DataFrame, block_bits: int, least: int = 1) -> DataFrame:
    """``(print, count)`` of the fingerprints that merged ``filters`` hold ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, filter in zip(batch.column("block").to_pylist(), batch.column("filter").to_pylist()):
                tails, counts, bits = decode(filter)
                prints = (tails | np.uint64(block << bits)).view(np.int64)
                often = counts >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[often]), pa.array(counts[often])], ["print", "count"]
                )

    return filters.select("block", "filter").mapInArrow(run, "print long, count long")


def fingerprint_column(column: str, bits: int) -> F.Column:
    """The leading ``bits`` of the 64-bit xxHash of a column."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
