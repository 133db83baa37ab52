"""Near duplicates by SimHash, found with pigeonring filtering.

A fingerprint is cut into a ring of segments. If two fingerprints differ in at most
``distance`` bits, then from some segment on every chain of ``l`` consecutive
segments differs in at most ``l * distance / segments`` bits. The first segments of
such a chain have a budget below one bit, so they are equal: they are the join key.
The budgets of longer chains prune what meets there before the full check.

A key that very many fingerprints share is not compared pair by pair. Its chains are
extended by the next segment, with every choice of bits that the budget leaves open
masked out, until few share a key. At full length all fingerprints of a key lie
within the distance, so each one is linked with the smallest only.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolumen.llm.graphs import components
from repolumen.llm.texts import with_text_columns
from repolumen.session import cut_lineage

#: Keys with more fingerprints get longer chains instead of pairs.
CROWD = 100
#: Crowded keys are broadcast up to this number (16 bytes each).
BROADCAST_KEYS = 100_000
#: Hashes turned into bits at once.
_SLICE = 1 << 16


# --- fingerprints ---------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: Sequence[bytes], size: int) -> np.ndarray:
    """XXH64 with seed 42 of every ``size`` consecutive words, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    if size == 1:
        joined = words
    elif len(words) <= size:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = functools.partial(xxhash.xxh64_intdigest, seed=42)
    return np.fromiter(map(digest, joined), np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = np.ascontiguousarray(hashes[at : at + _SLICE], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255  # 255 ones are the most that a byte can count
        total += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[full:].sum(0, dtype=np.int64)
    return total


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; signed 64-bit. No hash: 0."""
    ones = _bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (long): the 64-bit SimHash of the word shingles of ``text``.

    Null and empty texts and texts of white space have fingerprint 0.
    """

    def compute(texts):
        return [[fingerprint(shingle_hashes(words_of(t), shingle)) for t in texts]]

    return with_text_columns(docs, "text", compute, "fp long", keep)


# --- chains ---------------------------------------------------------------------


def ring(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """Segments ``[from, to)``: 2 * distance + 1, so two have a budget below one bit."""
    n = 2 * distance + 1
    edges = [bits * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def budget(length: int, distance: int) -> int:
    return length * distance // (2 * distance + 1)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def chain_masks(distance: int, start: int, length: int) -> list[int]:
    """Masks of the bits that must agree on a chain, one for each way to spend its budget."""
    segments = ring(distance)
    chain = [segments[(start + i) % len(segments)] for i in range(length)]
    bits = [(b, i) for i, (lo, hi) in enumerate(chain) for b in range(lo, hi)]
    free = [x for x in bits if budget(x[1] + 1, distance) > 0]
    whole = sum(1 << b for b, _ in bits)
    masks = []
    for spent in combinations(free, budget(length, distance)):
        within = all(
            sum(i < done for _, i in spent) <= budget(done, distance) for done in range(1, length)
        )
        if within:
            masks.append(_signed(whole & ~sum(1 << b for b, _ in spent)))
    return masks


def _keys(fps: DataFrame, distance: int, length: int, starts: Column) -> DataFrame:
    """``(fp, start, kind, value)``: a row for each start and mask."""
    n = 2 * distance + 1
    masks = F.array(
        *[F.array(*[F.lit(m).cast("long") for m in chain_masks(distance, i, length)]) for i in range(n)]
    )
    begun = fps.select("fp", starts.alias("start"))
    return begun.select(
        "fp", "start", F.posexplode(F.element_at(masks, F.col("start") + 1)).alias("m", "mask")
    ).select(
        "fp",
        "start",
        (F.col("m") * n + F.col("start")).alias("kind"),
        F.col("fp").bitwiseAND(F.col("mask")).alias("value"),
    )


def few(df: DataFrame, limit: int) -> bool:
    return df.limit(limit + 1).count() <= limit


def split_crowds(rows: DataFrame, keys: Sequence[str], crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key few share, and those whose key more than ``crowd`` rows share."""
    crowded = cut_lineage(
        rows.groupBy(*keys).count().where(F.col("count") > crowd).drop("count"), "crowds"
    )
    if crowded.isEmpty():
        return rows, None
    side = F.broadcast(crowded) if few(crowded, BROADCAST_KEYS) else crowded
    return rows.join(side, list(keys), "left_anti"), rows.join(side, list(keys), "left_semi")


def fingerprint_links(fps: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that connect all within ``distance`` bits.

    All pairs within the distance are linked, directly or through others that are
    within the distance of both. ``crowd`` moves work between pairs and longer
    chains; it changes no component.
    """
    n = 2 * distance + 1
    first = max(length for length in range(1, n + 1) if budget(length, distance) == 0)
    rows = _keys(fps, distance, first, F.explode(F.array(*[F.lit(i) for i in range(n)])))
    edges = None
    for length in range(first, n):
        calm, crowded = split_crowds(rows, ("kind", "value"), crowd)
        left, right = calm.alias("l"), calm.alias("r")
        differ = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
        # Ever longer chains prune; the whole fingerprints are compared where all of them held.
        chains = [_chain_within(differ, F.col("l.start"), distance, upto) for upto in range(length + 1, n)]
        in_budget = functools.reduce(Column.__and__, [*chains, F.bit_count(differ) <= distance])
        same = (F.col("l.kind") == F.col("r.kind")) & (F.col("l.value") == F.col("r.value"))
        pairs = left.join(right, same & (F.col("l.fp") < F.col("r.fp")) & in_budget)
        found = pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        if crowded is None:
            return edges
        left_over = cut_lineage(crowded.select("fp", "start").distinct(), "crowded")
        rows = _keys(left_over, distance, length + 1, F.col("start"))
    lowest = rows.groupBy("kind", "value").agg(F.min("fp").alias("low"))
    stars = rows.join(lowest, ["kind", "value"]).where("fp > low")
    return edges.unionByName(stars.select(F.col("low").alias("a"), F.col("fp").alias("b")))


def _chain_within(differ: Column, start: Column, distance: int, length: int) -> Column:
    """The chain of ``length`` segments from ``start`` on keeps its budget."""
    segments = ring(distance)
    n = len(segments)
    masks = [
        _signed(sum(1 << b for i in range(length) for b in range(*segments[(s + i) % n])))
        for s in range(n)
    ]
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), start + 1)
    return F.bit_count(differ.bitwiseAND(mask)) <= budget(length, distance)


# --- groups ---------------------------------------------------------------------


def simhash_components(
    docs: DataFrame, shingle: int = 3, distance: int = 2, crowd: int = CROWD
) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` of every row of ``docs`` (doc_id, text).

    Rows whose fingerprints are linked by steps of at most ``distance`` bits are one
    component, named by its smallest doc_id (null if it has none). Null and empty
    texts have fingerprint 0 and are linked like any other. Repeated rows come back
    repeated; an empty table gives no rows; other columns are not looked at.
    """
    marked = cut_lineage(with_fingerprint(docs, shingle), "fingerprints")
    fps = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fps")
    roots = components(fingerprint_links(fps, distance, crowd))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    classes = cut_lineage(named.select("fp", "component_id"), "classes")
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")
