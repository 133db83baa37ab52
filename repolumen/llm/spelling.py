"""Spelling variants: near words by permuterm rotations, and the form that each word stands for.

A word and its terminator make a ring, which is cut open at every place. A rotation
that ends with the edited letter begins with all the rest of the ring, so words that
differ by one replaced letter share that beginning, and a word without the letter is
that beginning as a whole. Sorting the rotations by beginning and skipped letter puts
them next to each other; one scan of each group names all neighbours. A group has at
most one row for each letter and one for the shorter word, however large the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.llm.texts import _bound_batches, _parts
from repolumen.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A near word this many times as frequent is the form of a word.
RATIO = 5
TERMINATOR = "$"
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 1 << 17
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def noised(run: str, h: int, every: int) -> str:
    """``run`` without one letter if ``every`` divides the hash ``h``."""
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def id_seed(doc_id: int | None) -> int:
    """CRC-32 of ``<doc_id>:``, from which that of ``<doc_id>:<run>`` goes on."""
    return zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())


def word_counts(docs: DataFrame, every: int = 199) -> DataFrame:
    """``word``, ``n``: letter runs of all texts (doc_id, text), A-Z in lower case, and how often they occur.

    One run in about ``every`` loses a letter, by the hash of document and run. A
    null id hashes as an empty one; null texts have no runs; a repeated row counts
    again. Counts are folded in each task and again before they are shuffled.
    """

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in _parts(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    seed = id_seed(doc_id)
                    for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                        h = zlib.crc32(word.encode(), seed)
                        held[word if h % every else noised(word, h, every)] += n
                if len(held) >= HELD_WORDS:
                    yield flush(held)
                    held = Counter()
        if held:
            yield flush(held)

    _bound_batches(docs)
    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``head``, ``skipped``, ``lead`` of every rotation of ``words`` (word, n).

    ``head`` is the rotation without its last letter, ``skipped`` that letter; for the
    rotation taken whole ``skipped`` is empty. ``lead`` is false where the letter
    repeats the one before it: taking out either gives the same shorter word, so only
    the first of them leads to it.
    """
    at = F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("at")
    ring = words.select("word", "n", at)
    before, after = F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1)")
    letter, earlier = F.expr("substring(word, at, 1)"), F.expr("substring(word, at - 1, 1)")
    open_head = F.concat(after, F.lit(TERMINATOR), before)
    whole_head = F.concat(letter, after, F.lit(TERMINATOR), before)
    kinds = F.inline(
        F.array(
            F.struct(open_head.alias("head"), letter.alias("skipped"), ((F.col("at") == 1) | (letter != earlier)).alias("lead")),
            F.struct(whole_head.alias("head"), F.lit("").alias("skipped"), F.lit(True).alias("lead")),
            # The gap before the terminator: a letter added at the end of the word.
            F.struct(F.when(F.col("at") == 1, F.concat(F.lit(TERMINATOR), "word")).alias("head"), F.lit("").alias("skipped"), F.lit(True).alias("lead")),
        )
    )
    return ring.select("word", "n", kinds).where("head is not null")


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``near_n``, ``near``: how many near words, and the most frequent of them.

    Words (word, n, each once) are near if exactly one letter is added, left out or
    replaced. Of equally frequent ones the first in code-point order is named. Words
    without a near word do not come back.
    """
    grouped = rotations(words).groupBy("head").agg(
        F.collect_list(F.struct((-F.col("n")).alias("less"), "word", "skipped", "lead")).alias("group")
    )
    groups = grouped.where(F.size("group") > 1).select(F.array_sort("group").alias("group"))

    def near(me: F.Column, other: F.Column) -> F.Column:
        replaced = (me["skipped"] != "") & (other["skipped"] != "")
        return (me["word"] != other["word"]) & (replaced | (me["lead"] & other["lead"]))

    def scanned(me: F.Column) -> F.Column:
        others = F.filter("group", lambda o: near(me, o))
        return F.struct(me["word"].alias("word"), F.size(others).alias("met"), F.get(others, F.lit(0)).alias("best"))

    met = groups.select(F.inline(F.transform("group", scanned))).where("met > 0")
    return met.groupBy("word").agg(
        F.sum("met").alias("n_near"),
        F.min(F.struct("best.less", "best.word")).alias("best"),
    ).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.word").alias("near"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the end of the chain of ``forms`` (word, form or null), by pointer doubling.

    A form is ``RATIO`` times as frequent as its word, so chains are short and have no
    circles; each round is a written table.
    """
    now = cut_lineage(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = cut_lineage(stepped, "roots")
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    every: int = 199,
) -> DataFrame:
    """``word``, ``n``, ``form``, ``form_n``, ``n_near``, ``root`` of every frequent word of ``docs`` (doc_id, text).

    Words have ``least_length`` code points and ``least_count`` occurrences at least.
    The form is the most frequent near word if it is ``ratio`` times as frequent; the
    root is the last form of the chain, the word itself if it has none. Empty tables
    and texts without letters give no rows; other columns are not looked at.
    """
    counts = word_counts(docs, every)
    words = cut_lineage(counts.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    has_form = F.col("near_n") >= ratio * F.col("n")
    formed = words.join(neighbours(words), "word", "left").select(
        "word",
        "n",
        F.when(has_form, F.col("near")).alias("form"),
        F.when(has_form, F.col("near_n")).alias("form_n"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )
    formed = cut_lineage(formed, "formed-words")
    return formed.join(roots_of(formed), "word")
