"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces of binary lengths: whole sequences of the
largest length, then the powers of two of the rest, largest first. Every piece is a
sequence of its own in the bucket of its length, so no sequence crosses documents and
none is padded.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.llm.texts import exploded_text_rows
from repolumen.llm.vocabulary import LONG_WORD, REMEMBERED, Vocabulary
from repolumen.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below

#: Columns of a piece. ``ids`` and their checksum are made on request.
PIECES = {
    "start": "long",
    "length": "long",
    "doc_tokens": "long",
    "ids": "array<int>",
    "ids_crc32": "long",
}


def binary_lengths(n: int, largest: int) -> Iterator[int]:
    """``n`` as a sum of powers of two of at most ``largest``, largest first."""
    for _ in range(n // largest):
        yield largest
    rest = n % largest
    while rest:
        piece = 1 << (rest.bit_length() - 1)
        yield piece
        rest -= piece


class WordIds(dict):
    """Word to ids by a tokenizer file, as little-endian 32-bit bytes; unknown words are worked out.

    Right for tokenizers that drop white space and never join across it. Pieces that
    are not remembered are given to the tokenizer's model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.vocabulary = Vocabulary(path)
        self.of_pieces = self._specials()

    def _specials(self) -> dict[str, bytes]:
        return {s: i.to_bytes(4, "little") for s, i in self.vocabulary.specials.items()}

    def piece(self, piece: str) -> bytes:
        ids = self.of_pieces.get(piece)
        if ids is None:
            found = self.model.tokenize(self.vocabulary.spelled(piece))
            ids = b"".join([token.id.to_bytes(4, "little") for token in found])
            if len(piece) <= LONG_WORD:
                if len(self.of_pieces) >= REMEMBERED:
                    self.of_pieces = self._specials()
                self.of_pieces[piece] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids = b"".join(map(self.piece, self.vocabulary.pieces(word)))
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().split())) if text else b""


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_documents(
    docs: DataFrame,
    tokenizer: str,
    columns: Sequence[str] = ("start", "length", "ids", "doc_tokens"),
    last_id: int = 2,
    largest: int = 4096,
) -> DataFrame:
    """``doc_id`` and ``columns`` (of ``PIECES``) of the binary pieces of ``text``.

    ``last_id`` ends every document, so a null or empty text is one piece of one id.
    ``ids_crc32`` is of the little-endian unsigned 32-bit ids. Repeated rows are packed
    as often as they come; an empty table gives no pieces.
    """
    last = last_id.to_bytes(4, "little")

    def rows(key, text):
        data = word_ids(tokenizer).text(text) + last
        n = len(data) // 4
        at = 0
        for length in binary_lengths(n, largest):
            piece = data[4 * at : 4 * (at + length)]
            made = {"start": at, "length": length, "doc_tokens": n}
            if "ids" in columns:
                made["ids"] = np.frombuffer(piece, "<i4")
            if "ids_crc32" in columns:
                made["ids_crc32"] = zlib.crc32(piece)
            yield key, *[made[c] for c in columns]
            at += length

    fields = [f"`doc_id` {docs.schema['doc_id'].dataType.simpleString()}"]
    fields += [f"{c} {PIECES[c]}" for c in columns]
    return exploded_text_rows(docs, ["doc_id", "text"], rows, ", ".join(fields))


def in_buckets(pieces: DataFrame, *order: str) -> DataFrame:
    """``pieces`` with ``sequence_id`` (dense from 0, equal lengths together) and ``offset`` 0.

    Rows are range-partitioned by length and ``order`` and written once; a counter per
    partition then numbers them, so a crowded length is spread over many tasks.
    """
    keys = ["length", *order]
    # Range bounds are drawn from the written rows: nothing is tokenized twice.
    pieces = cut_lineage(pieces, "pieces")
    placed = cut_lineage(
        pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()),
        "buckets",
    )
    part = F.shiftright("_place", _ROW_BITS)
    counted = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    # One entry per written partition: bounded by the tasks of one job.
    before, shifts = 0, []
    for row in counted:
        shifts += [F.lit(row["part"]), F.lit(before)]
        before += row["count"]
    number = F.element_at(F.create_map(*shifts), part) if shifts else F.lit(0)
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.select(
        *pieces.columns, (number + row).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
