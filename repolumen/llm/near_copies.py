"""One document of every group of near copies: two ways to candidates, then exact similarity.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of at least 0.8. Most pairs are met by a wide SimHash: 768 bits of the
distinct words, a ring of 32 segments. Pairs meet where one segment is equal; the
chain that starts there must keep its proportional budget.

SimHash loses pairs that differ by a block of new words, so a prefix filter closes the
gap, and it loses none: put the shingles of all texts in one order. If two sets of
``n`` shingles at most reach the similarity, the first ``n // 5 + 1`` of each share a
shingle. Rare ones come first, so few texts meet by chance. Only texts that SimHash
has not put into one component yet are paired there, by length and position.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolumen.llm.graphs import components
from repolumen.llm.simhash import BROADCAST_KEYS, _bit_counts, few, shingle_hashes, split_crowds, words_of
from repolumen.llm.texts import with_text_columns
from repolumen.session import cut_lineage

SEGMENTS, SEGMENT_BITS = 32, 24
#: Bits in which a pair that SimHash meets may differ. Pairs beyond it are met by their prefixes.
DISTANCE = 80
SHINGLE, SIMILARITY = 5, 0.8
#: Segments that more texts share are joined by their lowest text first.
CROWD = 8
#: Texts to compare and removed ids are broadcast up to this number (about 100 bytes each).
BROADCAST_IDS = 200_000
#: Tasks that share the pairs of a crowded key.
SPREAD = 8
#: Rounds in which each text is compared with its best partner, before all pairs that are still apart are.
ROUNDS = 2
#: The order of shingles is by counts in one of so many texts, for shingles counted so often, as many as
#: listed. It decides how many pairs meet by chance, never which similar ones do: any order is complete.
COUNTED, LEAST_COUNT, LISTED = 16, 3, 1_000_000
#: Bits of the mark of a set: each shingle sets one. Marks of similar sets differ in few bits, whatever the hash.
MARK_BITS = 1024
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def segments_of(words: list[bytes]) -> list[int]:
    """The ring of a text: 24-bit segments of the SimHash of its distinct words."""
    hashes = np.unique(shingle_hashes(words, 1))
    ones = []
    with np.errstate(over="ignore"):
        for k in range(SEGMENTS * SEGMENT_BITS // 64):
            mixed = hashes + np.uint64((k + 1) * _MIX[0] & (1 << 64) - 1)
            mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(_MIX[1])
            mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(_MIX[2])
            ones.append(_bit_counts(mixed ^ mixed >> np.uint64(31)) * 2 > len(hashes))
    bits = np.concatenate(ones).reshape(SEGMENTS, SEGMENT_BITS)
    return (bits @ (1 << np.arange(SEGMENT_BITS))).tolist()


def budget(length: int) -> int:
    return length * DISTANCE // SEGMENTS


def _segment(i: Column | int) -> Column:
    return F.element_at("segments", (i % SEGMENTS + 1).cast("int") if isinstance(i, Column) else i % SEGMENTS + 1).cast("long")


def _segment_rows(nodes: DataFrame) -> DataFrame:
    """``node``, ``start``, ``value`` of every segment, ``ahead``: the two that follow."""
    begun = nodes.select("node", "segments", F.explode(F.array(*[F.lit(i) for i in range(SEGMENTS)])).alias("start"))
    at = F.col("start")
    ahead = F.shiftleft(_segment(at + 2), SEGMENT_BITS).bitwiseOR(_segment(at + 1))
    return begun.select("node", "start", _segment(at).alias("value"), ahead.alias("ahead"))


def _in_budget(one: Column, other: Column) -> Column:
    """The chain of an equal segment and the two ahead keeps its budget at both lengths."""
    differ = one.bitwiseXOR(other)
    return (F.bit_count(differ.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))) <= budget(2)) & (
        F.bit_count(differ) <= budget(3)
    )


def _meet() -> Column:
    """Rows ``l`` and ``r`` share a segment and keep the budget ahead."""
    return (
        (F.col("l.start") == F.col("r.start"))
        & (F.col("l.value") == F.col("r.value"))
        & _in_budget(F.col("l.ahead"), F.col("r.ahead"))
    )


def candidate_pairs(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct ``(a, b)`` of ``nodes`` (node, segments) that agree on a segment and keep the budget ahead.

    Where more than ``crowd`` nodes share a segment they are paired with the lowest
    one only. That joins most of a crowd with few pairs, not all of it: the rest is met
    by prefixes.
    """
    calm, crowded = split_crowds(_segment_rows(nodes), ("start", "value"), crowd)
    near = _meet() & (F.col("l.node") < F.col("r.node"))
    pairs = calm.alias("l").join(calm.alias("r"), near).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    if crowded is not None:
        crowded = cut_lineage(crowded.select("node", "start", "value", "ahead"), "crowded-segments")
        lowest = crowded.groupBy("start", "value").agg(
            F.min("node").alias("a"), F.min_by("ahead", "node").alias("ahead_of_a")
        )
        stars = crowded.join(lowest, ["start", "value"]).where((F.col("node") > F.col("a")) & _in_budget(F.col("ahead"), F.col("ahead_of_a")))
        pairs = pairs.unionByName(stars.select("a", F.col("node").alias("b")))
    return cut_lineage(pairs.distinct(), "candidate-pairs")


def shingles_of(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text), SHINGLE)).view(np.int64)


def prefix_of(shingles: np.ndarray, listed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``n // 5 + 1`` of ``n`` distinct shingles: those not ``listed`` (sorted), then by count."""
    if not len(shingles):
        return shingles
    weight = np.zeros(len(shingles), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, shingles), len(listed) - 1)
        weight = np.where(listed[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, weight))][: len(shingles) // 5 + 1]


def mark_of(shingles: np.ndarray) -> np.ndarray:
    """Bits set by the shingles, as longs. Each bit in which two marks differ tells of a shingle that one set lacks."""
    bits = np.zeros(MARK_BITS, np.uint8)
    bits[shingles.view(np.uint64) % np.uint64(MARK_BITS)] = 1
    return np.packbits(bits).view(np.int64)


def _counted_shingles(digest: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of the counted texts hold, sorted, and in how many."""
    some = digest.where(F.pmod(F.xxhash64("copy"), F.lit(COUNTED)) == 0)

    def compute(texts):
        return [[shingles_of(t) for t in texts]]

    rows = with_text_columns(some, "text", compute, "shingles array<long>", ["copy"]).dropDuplicates(["copy"])
    often = rows.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where(F.col("count") >= LEAST_COUNT)
    table = often.orderBy(F.desc("count"), "shingle").limit(LISTED).toArrow()
    shingles, counts = (table.column(c).to_numpy() for c in ("shingle", "count"))
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def prefix_pairs(nodes: DataFrame, digest: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct ``(a, b, score)`` of texts in different components whose prefixes share enough shingles.

    All pairs of the similarity are among them but those within a component. Two texts
    of ``n`` and ``m`` shingles need ``4 / 9`` of ``n + m`` in common. In one order, what
    they share before, at and after a shared shingle is bounded by its two places; what
    they share in all, by what their prefixes share and what stands behind those.
    """
    listed = digest.sparkSession.sparkContext.broadcast(_counted_shingles(digest))

    def compute(texts):
        sets = [shingles_of(t) for t in texts]
        return [[len(s) for s in sets], [prefix_of(s, *listed.value) for s in sets], [mark_of(s) for s in sets]]

    made = with_text_columns(digest, "text", compute, "n int, prefix array<long>, mark array<long>", ["copy"])
    made = made.dropDuplicates(["copy"])
    rooted = nodes.select("node", "copy").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    prefixes = cut_lineage(made.join(rooted, "copy").select("node", "root", "n", "prefix", "mark"), "prefixes")
    rows = prefixes.select("node", "root", "n", F.posexplode("prefix").alias("place", "shingle"))
    span = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("met"))
    open_keys = cut_lineage(span.where("low < high").select("shingle", (F.col("met") > CROWD).alias("crowded")), "open-shingles")
    side = F.broadcast(open_keys) if few(open_keys, BROADCAST_KEYS) else open_keys
    rows = cut_lineage(rows.join(side, "shingle"), "open-prefixes")
    # Where many texts meet, their marks come along and pass over most that are not similar.
    marks = prefixes.select("node", "mark").join(rows.where("crowded").select("node").distinct(), "node")
    crowded = rows.where("crowded").join(marks, "node")
    rows = crowded.unionByName(rows.where("not crowded").withColumn("mark", F.lit(None).cast("array<long>")))
    # One side of a crowded key goes to all parts, the other to one of them.
    everywhere = F.array(*[F.lit(i).cast("long") for i in range(SPREAD)])
    nowhere = F.array(F.lit(0).cast("long"))
    left = rows.withColumn("part", F.explode(F.when(F.col("crowded"), everywhere).otherwise(nowhere)))
    right = rows.withColumn("part", F.when(F.col("crowded"), F.pmod(F.xxhash64("node"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long")))
    n, m, i, j = F.col("l.n"), F.col("r.n"), F.col("l.place"), F.col("r.place")
    sizes = (5 * n >= 4 * m) & (5 * m >= 4 * n)
    around = 9 * (F.least(i, j) + F.least(n - i, m - j)) >= 4 * (n + m)
    met = (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.part") == F.col("r.part"))
    apart = (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root"))
    # Similarity 0.8 leaves a ninth of both sizes to differ.
    differing = F.aggregate(
        F.zip_with("l.mark", "r.mark", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    alike = F.col("l.mark").isNull() | (9 * differing <= n + m)
    found = left.alias("l").join(right.alias("r"), met & apart & sizes & around & alike)
    shared = found.groupBy(F.col("l.node").alias("a"), F.col("r.node").alias("b"), n.alias("n"), m.alias("m")).agg(
        F.count("*").alias("shared"),
        (n - F.min(i)).alias("a_from_first"),
        (m - F.min(j)).alias("b_from_first"),
        (n - F.max(i) - 1).alias("a_after_last"),
        (m - F.max(j) - 1).alias("b_after_last"),
    )
    n, m = F.col("n"), F.col("m")
    behind = F.greatest(n - F.floor(n / 5) - 1, m - F.floor(m / 5) - 1)
    most = F.least(
        F.col("shared") + F.least(behind, "a_after_last", "b_after_last"), F.col("a_from_first"), F.col("b_from_first")
    )
    near = shared.where(9 * most >= 4 * (n + m)).select("a", "b", (F.col("shared") / (n + m)).alias("score"))
    return cut_lineage(near, "prefix-pairs")


def _both(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    first = side.select(F.col("node").alias("a"), F.col(column).alias("of_a"))
    second = side.select(F.col("node").alias("b"), F.col(column).alias("of_b"))
    return pairs.join(first, "a").join(second, "b")


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` within the whole distance; the nearer, the higher their ``score``."""
    differing = F.aggregate(
        F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    near = _both(pairs, nodes, "segments").select("a", "b", (-differing).cast("double").alias("score"))
    return cut_lineage(near.where(F.col("score") >= -DISTANCE), "close-pairs")


def _shingle_table(pairs: DataFrame, nodes: DataFrame, digest: DataFrame) -> DataFrame:
    """``node``, ``shingles`` of the texts that ``pairs`` name, each hashed and written once."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "copy"), "node")
    asked = cut_lineage(asked, "compared-texts")

    def shingles(texts):
        return [[shingles_of(t) for t in texts]]

    texts = digest.join(F.broadcast(asked) if few(asked, BROADCAST_IDS) else asked, "copy")
    hashed = with_text_columns(texts, "text", shingles, "shingles array<long>", ["node"]).dropDuplicates(["node"])
    return cut_lineage(hashed, "shingles")


def _similar(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The ``pairs`` whose texts have the similarity."""
    both = _both(pairs, shingles, "shingles")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    sized = both.select("a", "b", shared.alias("n"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return cut_lineage(sized.where(F.col("n") >= SIMILARITY * (F.col("total") - F.col("n"))).select("a", "b"), "similar-pairs")


def _best_partners(pairs: DataFrame) -> DataFrame:
    """For every text of ``pairs`` the pair with its best partner."""
    turned = pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "score")
    ends = turned.unionByName(pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "score"))
    best = ends.groupBy("node").agg(F.max_by("other", F.struct("score", "other")).alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _joined(pairs: DataFrame, nodes: DataFrame, digest: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` and those of the similar ``pairs`` that the components of all similar ones need.

    In every round each text is compared with its best partner left. Copies so join
    quickly, and pairs that came into one component need no comparison. What is still
    apart after some rounds is compared pair by pair: nothing is left out.
    """
    if pairs.isEmpty():
        return edges
    shingles, left = _shingle_table(pairs, nodes, digest), pairs
    for _ in range(ROUNDS):
        best = cut_lineage(_best_partners(left), "best-partners")
        found = _similar(best, shingles)
        edges = edges.unionByName(found)
        left = left.join(best, ["a", "b"], "left_anti")
        if not found.isEmpty():
            roots = components(edges)
            for end in ("a", "b"):
                left = left.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
            left = left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
        left = cut_lineage(left.select("a", "b", "score"), "pairs-apart")
        if left.isEmpty():
            return edges
    return edges.unionByName(_similar(left.select("a", "b"), shingles))


def near_copy_components(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``copy`` (digest of the text) and ``root`` of every row of ``docs`` (doc_id, text).

    Rows of one root are connected by steps of similarity 0.8 or more. Texts without a
    word, null ones too, are copies of each other. ``crowd`` moves work; it changes no
    component.
    """

    def compute(texts):
        return [[segments_of(words_of(t)) for t in texts]]

    # Without words there is one text, the empty one.
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[\x20\x09-\x0D]+$", "")
    digest = docs.select("doc_id", "text", F.md5(bare).alias("copy"))
    rows = cut_lineage(digest.select("doc_id", "copy"), "copies")
    marked = with_text_columns(digest, "text", compute, "segments array<int>", ["copy"])
    nodes = cut_lineage(
        marked.groupBy("copy").agg(F.first("segments").alias("segments")).withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    pairs = candidate_pairs(nodes.select("node", "segments"), crowd)
    edges = _joined(_close(pairs, nodes), nodes, digest, pairs.select("a", "b").limit(0))
    roots = components(edges)
    roots = components(_joined(prefix_pairs(nodes, digest, roots), nodes, digest, edges))
    named = nodes.select("node", "copy").join(roots, "node", "left")
    classes = cut_lineage(named.select("copy", F.coalesce("root", "node").alias("root")), "copy-classes")
    return rows.join(classes, "copy", "left")


def drop_near_copies(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id.

    Rows without an id come last; equal rows of one id count once. All columns are kept.
    """
    groups = cut_lineage(near_copy_components(docs, crowd), "copy-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    first = groups.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.copy")
    kept = cut_lineage(first, "kept-copies")
    # Narrow rows decide; texts move only if there is more to drop than a broadcast may hold.
    lost = groups.select("doc_id", "copy").distinct().alias("g").join(
        kept.alias("k"), F.col("g.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("g.copy") == F.col("k.copy")), "left_anti"
    )
    lost = cut_lineage(lost, "dropped-copies")
    twice = groups.groupBy("doc_id", "copy").count().where("count > 1").drop("count")
    twice = cut_lineage(twice, "repeated-rows")
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[\x20\x09-\x0D]+$", "")
    mark, taken = "_copy", {c.lower() for c in docs.columns}
    while mark in taken:
        mark += "_"
    named = docs.withColumn(mark, F.md5(bare))

    def of(side: DataFrame) -> tuple[DataFrame, Column]:
        renamed = side.select(F.col("doc_id").alias("kept_id"), F.col("copy").alias("kept_copy")).alias("side")
        small = few(side, BROADCAST_IDS)
        same = F.col("d.doc_id").eqNullSafe(F.col("side.kept_id")) & (F.col(f"d.{mark}") == F.col("side.kept_copy"))
        return F.broadcast(renamed) if small else renamed, same

    side, same = of(lost)
    left = named.alias("d").join(side, same, "left_anti")
    if not twice.isEmpty():
        side, same = of(twice)
        repeated = left.alias("d").join(side, same, "left_semi").dropDuplicates(["doc_id", mark])
        left = left.alias("d").join(side, same, "left_anti").unionByName(repeated)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
