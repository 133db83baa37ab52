"""Benchmark items inside documents, by edit distance over words.

The walk of Chakraborty, Goldenberg and Koucky embeds a string so that few edits
become few differing places: at step ``j`` it writes the current word and moves on if
bit ``j`` of a random function of that word says so. Edit distance so becomes Hamming
distance, and that is searched by sampling: a repetition looks at a few steps of one
walk, and windows that write the same there are candidates.

A walk is embedded from anchors along the whole item, over the window of what follows,
so edits that gather in one part leave the windows of other parts alone. How many
repetitions an item gets follows from the recall wanted, the part of steps in which
windows agree when all edits allowed are spent, and the steps of a sample. Only places of
a document that have enough pairs of neighbouring words of items around them are
embedded: an edit breaks two pairs at most, so that filter loses nothing. Of candidates
the edit distance is worked out exactly.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.llm.texts import with_text_columns
from repolumen.session import cut_lineage

#: Edits allowed, as a part of an item's words.
EDITS = 0.2
#: Part of the items with all edits allowed that the sampled repetitions of one item must meet.
RECALL = 0.9999
#: Part of the steps in which the windows of an item and its edited copy agree at least, in the mean over
#: anchors, when a fifth of the words is replaced, left out or added all over the item.
AGREEMENT = 0.4
#: Steps that a repetition looks at.
SAMPLED = 3
#: Independent walks; repetitions take turns between them.
WALKS = 16
#: Anchors of an item, about, words between them, words of a window at least, and steps of a walk at most.
ANCHORS, ANCHOR_WORDS, LEAST_WINDOW, MOST_STEPS = 6, 8, 8, 64
#: Places of a document embedded at once.
_PLACES = 8192
#: Items of so many characters are broadcast at once; more are worked through in blocks.
BLOCK_CHARS = 4_000_000
_SEED = 0x5EED
#: Words of documents searched at once.
_BATCH = 400_000

_WORD = re.compile(r"\w+")
_ODD = re.compile(r"[^\w\x00-\x7f]")
_MARKS = bytes(
    b if b > 127 or chr(b).isalnum() or chr(b) == "_" else 32 for b in range(256)
)
HITS = "item_id:long,distance:int,item_words:int,start:long,end:long"
_HIT = ("item_id", "distance", "item_words", "start", "end")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and underscores in lower case: marks and case are no edits."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = _ODD.sub(" ", text)
    return text.encode().translate(_MARKS).split()


def allowed_edits(n_words: int) -> int:
    return int(n_words * EDITS)


def kept_pairs(n_words: int) -> int:
    """Pairs of neighbouring words that an item keeps at least: an edit breaks two at most."""
    return n_words - 1 - 2 * allowed_edits(n_words)


def nearest_end(pattern: Sequence, text: Sequence) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and where the first such ends.

    Bit-parallel: a column of the distance table is two integers of as many bits as the
    pattern has words.
    """
    m = len(pattern)
    places: dict = {}
    for i, word in enumerate(pattern):
        places[word] = places.get(word, 0) | 1 << i
    whole, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = whole, 0, m
    best, at = m, 0
    for end, word in enumerate(text, 1):
        eq = places.get(word, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (whole & ~(flat | up)), up & flat
        now += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & whole, minus << 1 & whole
        eq |= down
        up, down = minus | (whole & ~(eq | plus)), plus & eq
        if now < best:
            best, at = now, end
    return best, at


class Marks:
    """A set of hashes that answers for whole arrays; it may say yes too often, never no."""

    def __init__(self, hashes: np.ndarray):
        bits = max(16, min(26, (64 * max(len(hashes), 1)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[hashes >> self.shift] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.marks[hashes >> self.shift]


@dataclass
class Items:
    """One block of items, ready to be looked for."""

    ids: list[int]
    words: list[list[int]]
    vocabulary: dict[bytes, int]
    pairs: Marks
    #: Hashes of the pairs of each item, sorted.
    own_pairs: list[np.ndarray]
    #: A row of chance bits for each walk: bit ``j`` moves the walk on from a word at step ``j``.
    moves: np.ndarray
    #: Steps of a walk, repetitions, marks of the keys, and key to ``(item, anchor)``.
    tables: list[tuple[int, int, Marks, dict[int, list[tuple[int, int]]]]]
    #: Sizes of items from and to, which are looked for together.
    sizes: list[tuple[int, int]]


def _pair_hashes(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = codes[:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed + codes[1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


def _walk(codes: np.ndarray, starts: np.ndarray, moves: np.ndarray, steps: int) -> np.ndarray:
    """The words written at each step, a row for each start. Past the end the code is 0."""
    at = starts.astype(np.int64)
    last = len(codes) - 1
    out = np.empty((steps, len(starts)), np.int64)
    for step in range(steps):
        np.minimum(at, last, out=at)
        out[step] = codes[at]
        at += moves[out[step]] >> np.uint64(step) & np.uint64(1) > 0
    return out


def _samples(steps: int, repetitions: int) -> np.ndarray:
    """The steps that each repetition looks at: a row of ``SAMPLED`` for each, the same on every machine."""
    random = np.random.default_rng([_SEED, steps])
    rows = [np.sort(random.permutation(steps)[:SAMPLED]) for _ in range(repetitions)]
    return np.array(rows, np.int64).reshape(repetitions, -1)


def _walks(codes: np.ndarray, starts: np.ndarray, moves: np.ndarray, steps: int) -> list[np.ndarray]:
    """What each walk writes from each start; a shorter walk is the beginning of a longer one."""
    return [_walk(codes, starts, own, steps).astype(np.uint64) for own in moves]


def _keys(walks: list[np.ndarray], steps: int, repetitions: int) -> Iterator[np.ndarray]:
    """What the sampled ones of so many steps write, as one hash for each repetition."""
    with np.errstate(over="ignore"):
        for number, sample in enumerate(_samples(steps, repetitions)):
            walk = walks[number % len(walks)]
            key = np.full(walk.shape[1], number * 1_000_003 + steps, np.uint64)
            for step in sample.tolist():
                key = (key + walk[step] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            yield key


def anchors(words: int) -> list[int]:
    """Where windows of an item begin, as long as a window of some words is left; closer in short items."""
    apart = min(ANCHOR_WORDS, max(2, words // ANCHORS))
    return [0, *range(apart, words - LEAST_WINDOW + 1, apart)]


def walk_steps(words: int) -> int:
    """Steps of the walk over a window of so many words: a power of two, so that windows share samples.

    A walk moves on at every second step in the mean, and mostly stays inside the window.
    """
    return min(MOST_STEPS, 1 << max(1, words * 3 // 2).bit_length() - 1)


def repetitions(words: int) -> int:
    """Repetitions for each anchor of an item, so that all together reach the recall."""
    if allowed_edits(words) == 0:
        return 1
    chance = AGREEMENT ** min(SAMPLED, walk_steps(words))
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - chance) / len(anchors(words))))


def prepare(items: Sequence[tuple[int, str]]) -> Items:
    """Embeds the items ``(id, text)``; those without a word are left out."""
    split = [(i, w) for i, t in items if (w := words_of(t))]
    vocabulary: dict[bytes, int] = {}
    coded = [[vocabulary.setdefault(x, len(vocabulary) + 1) for x in w] for _, w in split]
    pairs = [_pair_hashes(np.array(w)) for w in coded if len(w) > 1]
    random = np.random.default_rng(_SEED)
    moves = random.integers(0, 1 << 64, (WALKS, len(vocabulary) + 1), np.uint64)
    # Words of no item write 0 and always move on.
    moves[:, 0] = np.uint64((1 << 64) - 1)
    groups: dict[int, list[tuple[int, int]]] = {}
    for number, words in enumerate(coded):
        for anchor in anchors(len(words)):
            groups.setdefault(walk_steps(len(words) - anchor), []).append((number, anchor))
    # Behind an item a walk writes nothing, as behind a document.
    flat = np.array([c for w in coded for c in (*w, *[0] * MOST_STEPS)] or [0], np.int64)
    begin = np.cumsum([0, *(len(w) + MOST_STEPS for w in coded)])
    tables = []
    for steps, members in sorted(groups.items()):
        rounds = np.array([repetitions(len(coded[number])) for number, _ in members])
        starts = np.array([begin[number] + anchor for number, anchor in members])
        table: dict[int, list[tuple[int, int]]] = {}
        for number, keys in enumerate(_keys(_walks(flat, starts, moves, steps), steps, rounds.max())):
            for i in np.flatnonzero(rounds > number).tolist():
                table.setdefault(int(keys[i]), []).append(members[i])
        tables.append((steps, int(rounds.max()), Marks(np.array(list(table), np.uint64)), table))
    sizes: list[tuple[int, int]] = []
    for size in sorted({len(w) for w in coded}):
        if sizes and size <= 1.25 * sizes[-1][0]:
            sizes[-1] = (sizes[-1][0], size)
        else:
            sizes.append((size, size))
    known = Marks(np.concatenate(pairs) if pairs else np.empty(0, np.uint64))
    own_pairs = [np.unique(_pair_hashes(np.array(w))) for w in coded]
    return Items([i for i, _ in split], coded, vocabulary, known, own_pairs, moves, tables, sizes)


def _possible(codes: np.ndarray, items: Items) -> np.ndarray:
    """Places that may lie within an item.

    An edit breaks two pairs of neighbouring words at most, so a stretch with fewer
    known pairs than an item keeps cannot hold it.
    """
    n = len(codes)
    known = items.pairs.has(_pair_hashes(codes)) & (codes[:-1] > 0) & (codes[1:] > 0)
    reach = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])
    possible = np.zeros(n, bool)
    for low, high in items.sizes:
        k = allowed_edits(high)
        least = min(map(kept_pairs, range(low, high + 1)))
        if least <= 0:
            return codes > 0
        width = high + 2 * k
        full = np.pad(reach, (width, width), mode="edge")
        # By the place where the stretch of ``width`` begins, from ``width`` places before the text on.
        enough = full[width:] - full[:-width] >= least
        # Within an item that begins at most ``high`` places before, edits included.
        covered = np.concatenate([[0], np.cumsum(enough, dtype=np.int64)])
        first, last = np.arange(n), np.arange(width + 1, width + 1 + n)
        possible |= covered[last] > covered[first]
    return possible & (codes > 0)


def _candidates(codes: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(item, place, anchor)``: places where the window of the item from ``anchor`` on may begin."""
    places = np.flatnonzero(_possible(codes, items))
    found: list[tuple[int, int, int]] = []
    for first in range(0, len(places), _PLACES):
        starts = places[first : first + _PLACES]
        walks = _walks(codes, starts, items.moves, max(steps for steps, _, _, _ in items.tables))
        for steps, rounds, marks, table in items.tables:
            for keys in _keys(walks, steps, rounds):
                at = np.flatnonzero(marks.has(keys))
                for start, key in zip(starts[at].tolist(), keys[at].tolist()):
                    for number, anchor in table.get(key, ()):
                        found.append((number, start, anchor))
    rows = np.unique(np.array(found, np.int64).reshape(-1, 3), axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def find_items(texts: Sequence[str | None], items: Items) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text the items in it: id, distance, words, and start and end of the nearest stretch."""
    out: list[list] = [[] for _ in texts]
    if not items.ids:
        return out
    numbers, parts, total = [], [], 0
    for number, text in enumerate(texts):
        words = words_of(text)
        if words:
            numbers.append(number)
            parts.append(np.fromiter(map(items.vocabulary.get, words, repeat(0)), np.int64, len(words)))
            total += len(words)
        if parts and (total >= _BATCH or number == len(texts) - 1):
            for place, hits in _find_in(parts, items):
                out[numbers[place]] = _with_places(texts[numbers[place]], hits, items)
            numbers, parts, total = [], [], 0
    if parts:
        for place, hits in _find_in(parts, items):
            out[numbers[place]] = _with_places(texts[numbers[place]], hits, items)
    return out


def _find_in(parts: list[np.ndarray], items: Items) -> Iterator[tuple[int, dict[int, tuple[int, int, int]]]]:
    """Of each text with hits: item to distance, first word and end word."""
    gap = np.zeros(1, np.int64)
    codes = np.concatenate([x for part in parts for x in (part, gap)])
    begin = np.cumsum([0, *(len(part) + 1 for part in parts)])
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    number, start, anchor = _candidates(codes, items)
    sizes = np.array([len(w) for w in items.words])[number]
    margin = 2 * (sizes * EDITS).astype(np.int64) + 1
    # The window lies in the text, also where its item would begin before it.
    text = np.searchsorted(begin, start, "right") - 1
    lo = np.maximum(start - anchor - margin, begin[text])
    hi = np.minimum(start - anchor + sizes + margin, begin[text + 1] - 1)
    order = np.lexsort((lo, number, text))
    order = order[lo[order] < hi[order]]
    text, number, lo, hi = text[order], number[order], lo[order], hi[order]
    # Stretches of one item in one text that meet are one; ends ascend with beginnings.
    apart = (text[1:] != text[:-1]) | (number[1:] != number[:-1]) | (lo[1:] > hi[:-1])
    first = np.flatnonzero(np.append(True, apart)[: len(text)])
    last = np.append(first[1:], len(text)) - 1
    for i, j in zip(first.tolist(), last.tolist()):
        regions.setdefault((int(text[i]), int(number[i])), []).append((int(lo[i]), int(hi[j])))
    found: dict[int, dict[int, tuple[int, int, int]]] = {}
    for (text, number), own in regions.items():
        pattern, pairs = items.words[number], items.own_pairs[number]
        least = kept_pairs(len(pattern))
        for lo, hi in own:
            if least > 0:
                around = _pair_hashes(codes[lo:hi])
                at = np.minimum(np.searchsorted(pairs, around), len(pairs) - 1)
                if np.count_nonzero(pairs[at] == around) < least:
                    continue
            region = codes[lo:hi].tolist()
            distance, end = nearest_end(pattern, region)
            best = found.get(text, {}).get(number)
            if distance <= allowed_edits(len(pattern)) and (best is None or distance < best[0]):
                _, back = nearest_end(pattern[::-1], region[:end][::-1])
                first = lo - int(begin[text])
                found.setdefault(text, {})[number] = (distance, first + end - back, first + end)
    yield from found.items()


def _with_places(text: str, hits: dict[int, tuple[int, int, int]], items: Items) -> list[tuple]:
    places = [m.span() for m in _WORD.finditer(text)]
    made = []
    for number, (distance, lo, hi) in sorted(hits.items()):
        # Lower case can turn a letter into a letter and a mark; then the whole text is named.
        whole = hi > len(places) or hi <= lo
        start, end = (0, len(text)) if whole else (places[lo][0], places[hi - 1][1])
        made.append((items.ids[number], distance, len(items.words[number]), start, end))
    return made


def item_blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of about ``chars`` characters, one at a time."""
    usable = items.where(F.col("item_id").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"))
    usable = cut_lineage(usable.where(F.length("text") > 0), "items")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / chars))
    for block in range(blocks):
        part = usable.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id")
        yield [(row["item_id"], row["text"]) for row in part.collect()]


def find_leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance``, ``item_words``, ``start``, ``end``: items found in documents.

    A row for each row of ``docs`` (doc_id, text) and item (item_id, text) whose words
    lie in the text with at most a fifth of them edited, at the nearest stretch (code
    points). Unedited items are always met, edited ones with the recall ``RECALL`` by
    design. Repeated rows come back repeated; other columns are not looked at. Items of equal text are one, named by the smallest id; items without a
    word, or without an id, and null or empty texts match nothing.
    """
    found = None
    for block in item_blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        name = uuid.uuid4().hex

        def compute(texts, shared=shared, name=name):
            hits = find_items(texts, _prepared(name, shared))
            return [[[dict(zip(_HIT, hit)) for hit in own] for own in hits]]

        part = with_text_columns(docs, "text", compute, f"hits array<struct<{HITS}>>", ["doc_id"])
        part = part.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
        found = part if found is None else found.unionByName(part)
    return found


_ready: dict[str, Items] = {}


def _prepared(name: str, shared) -> Items:
    """Embedded once in each Python worker; the block before is let go."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = prepare(shared.value)
    return _ready[name]
