"""Token counts by byte-pair merging with a heap and a linked list.

A count needs no token ids: it is the number of initial symbols less the number of
merges. For each piece of text the symbols form a doubly linked list and their
mergeable neighbours a heap by rank, then place. The lowest pair is popped, if both
ends are still as they were, its left end takes over the right one, and the two new
neighbours are pushed. Every piece costs ``n log n``.

The vocabulary file names the rules: normal form, split pattern, alphabet, merges.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.llm.texts import with_text_columns
from repolumen.llm.vocabulary import LONG_WORD, REMEMBERED, Vocabulary

class MergeCounter(dict):
    """Word to number of tokens for one vocabulary file; unknown words are worked out."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(self.vocabulary.merges)}
        self.of_pieces: dict[str, int] = dict.fromkeys(self.vocabulary.specials, 1)

    def merge(self, symbols: list[str]) -> int:
        """Tokens that ``symbols`` become."""
        n = len(symbols)
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (rank, i, symbols[i], symbols[i + 1])
            for i in range(n - 1)
            if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None
        ]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one end was merged meanwhile
            merges += 1
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (rank, a, symbols[a], symbols[b]))
        return n - merges

    def piece(self, piece: str) -> int:
        count = self.of_pieces.get(piece)
        if count is None:
            count = self.merge(self.vocabulary.symbols(piece))
            if len(piece) <= LONG_WORD:
                if len(self.of_pieces) >= REMEMBERED:
                    self.of_pieces = dict.fromkeys(self.vocabulary.specials, 1)
                self.of_pieces[piece] = count
        return count

    def __missing__(self, word: bytes) -> int:
        count = sum(map(self.piece, self.vocabulary.pieces(word)))
        if len(word) <= LONG_WORD:
            self[word] = count
        return count

    def text(self, text: str | None) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        return sum(map(self.__getitem__, text.encode().split())) if text else 0


@functools.cache
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def with_token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a byte-pair vocabulary file on every executor. Null
    texts count like empty ones: no bytes, no tokens. Rows stay as many; columns of
    these names are replaced.
    """

    def compute(texts):
        return [[counter(vocabulary).text(t) for t in texts]]

    columns = docs.columns if keep is None else keep
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    names = [*(c for c in columns if c not in ("n_bytes", "n_tokens", "over_limit")), "n_bytes"]
    counted = with_text_columns(sized, "text", compute, "n_tokens long", names)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
