"""Shards of equal row counts that keep linked documents together, by label propagation.

Documents of equal text are linked. They start in balanced shards at random, then move
in rounds: each group picks the shard where most of it already is, and members elsewhere
ask to move there. Those let in are as many as unlinked documents can make room for,
and all that can change places with others that ask, in pairs or around cycles of
shards. Rounds go on until nothing falls any more. At the end unlinked documents fill
what is left, so counts stay as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.session import cut_lineage

SHARDS = 16
#: Rounds without a fall of the cut before it counts as settled; ties are drawn anew in each.
PATIENCE = 2
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def numbered_within(df: DataFrame, key: str, *order: str, name: str = "place") -> DataFrame:
    """``df`` with ``name``: 0, 1, .. within each ``key`` (a small int), by ``order``.

    Rows are range-partitioned by key and order and written once with their places.
    What a partition must add for a key is one small row: a crowded key is many
    partitions, not one task.
    """
    placed = cut_lineage(
        df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    part, row = F.shiftright("_place", _ROW_BITS).alias("_part"), F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counted = placed.groupBy(part, key).agg(F.count("*").alias("n"), F.min(row).alias("low")).collect()
    # At most one entry for each written partition and key.
    done: dict[int, int] = {}
    shifts = []
    for entry in sorted(counted, key=lambda r: (r[key], r["_part"])):
        before = done.get(entry[key], 0)
        shifts.append((entry["_part"], entry[key], before - entry["low"]))
        done[entry[key]] = before + entry["n"]
    side = df.sparkSession.createDataFrame(shifts, f"_part long, {key} int, _shift long")
    joined = placed.withColumn("_part", part).join(F.broadcast(side), ["_part", key])
    return joined.select(*df.columns, (row + F.col("_shift")).alias(name))


def _counts(df: DataFrame, shards: int, key: str = "shard") -> list[int]:
    found = {r[key]: r["count"] for r in df.groupBy(key).count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def _wishes(linked: DataFrame, fits: list[int], turn: int) -> DataFrame:
    """``linked`` rows that want to move, with their ``target``.

    A group wants the fewest of its shards that can hold it, fullest first: a shard
    holds ``fits`` rows of a group, or those that it has. Ties are drawn by the group in
    each turn, so groups do not all want the same one.
    """
    rooms = F.array(*[F.lit(r).cast("long") for r in fits])
    held = linked.groupBy("group", "shard").count()
    ranked = held.groupBy("group").agg(
        F.sum("count").alias("size"),
        F.sort_array(
            F.collect_list(
                F.struct("count", F.xxhash64("group", "shard", F.lit(turn)).alias("draw"), "shard")
            ),
            asc=False,
        ).alias("held"),
    )
    # Up to ``shards`` entries a group. What fits into the shards before one, each with its room.
    fits = F.transform("held", lambda h: F.greatest(h["count"], F.element_at(rooms, h["shard"] + 1)))
    taken = F.transform(
        F.sequence(F.lit(1), F.size("held")),
        lambda i: F.aggregate(F.slice(fits, 1, i - 1), F.lit(0).cast("long"), lambda s, x: s + x),
    )
    wanted = F.filter(
        F.transform(F.arrays_zip(F.col("held").alias("h"), taken.alias("t")), lambda z: F.struct(z["h"]["shard"].alias("shard"), (z["t"] < F.col("size")).alias("use"))),
        lambda z: z["use"],
    )
    targets = ranked.select("group", F.transform(wanted, lambda z: z["shard"]).alias("targets"))
    asking = linked.join(targets, "group").where(~F.array_contains("targets", F.col("shard")))
    pick = F.pmod(F.xxhash64("number"), F.size("targets").cast("long")).cast("int")
    return asking.select("number", "shard", F.element_at("targets", pick + 1).alias("target"))


def _cycle(left: list[list[int]]) -> list[int] | None:
    """Shards around which each has wishes ``left`` to the next; None if there is no such cycle."""
    done: set[int] = set()
    for start in range(len(left)):
        path, todo = [], [(start, 0)]
        while todo:
            at, nxt = todo.pop()
            if nxt == 0:
                if at in done:
                    continue
                path.append(at)
            for to in range(nxt, len(left)):
                if left[at][to] and to not in done:
                    if to in path:
                        return path[path.index(to) :]
                    todo += [(at, to + 1), (to, 0)]
                    break
            else:
                done.add(path.pop())
    return None


def grants(wishes: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the ``wishes`` [from][to] are let in: no shard gains more than its ``room``.

    Swaps first, then cycles, then moves into room, which leave room behind.
    """
    n = range(len(room))
    left, room, given = [list(row) for row in wishes], list(room), [[0] * len(room) for _ in n]

    def give(a: int, b: int, count: int) -> None:
        left[a][b] -= count
        given[a][b] += count

    for a in n:
        for b in range(a):
            both = min(left[a][b], left[b][a])
            give(a, b, both)
            give(b, a, both)
    while cycle := _cycle(left):
        steps = list(zip(cycle, [*cycle[1:], cycle[0]]))
        count = min(left[a][b] for a, b in steps)
        for a, b in steps:
            give(a, b, count)
    # Without cycles each pass over the shards brings room one step further back.
    moved = True
    while moved:
        moved = False
        for b in n:
            for a in n:
                count = min(left[a][b], room[b])
                if count > 0:
                    give(a, b, count)
                    room[b] -= count
                    room[a] += count
                    moved = True
    return given


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row of ``docs`` (doc_id, text).

    Shard counts differ by one at most. ``size`` is the text's bytes and one; a null
    text has none and is linked with nothing. Slots are 0, 1, .. in each shard. A
    group larger than a shard spreads over those with most of it and room. Linked rows
    change places, so unlinked ones are not needed for groups to come together.
    Repeated rows count each; an empty table gives no rows.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.md5("text").alias("group"),
        F.lit(0).alias("all"),
        F.xxhash64("doc_id", F.lit(11)).alias("draw"),
    )
    start = numbered_within(cut_lineage(rows, "sizes"), "all", "draw", "doc_id", "text_crc32", name="number")
    start = start.withColumn("shard", F.pmod("number", F.lit(shards)).cast("int")).drop("all", "draw")
    groups = start.where(F.col("group").isNotNull()).groupBy("group").count().where("count > 1").select("group")
    groups = cut_lineage(groups, "linked-groups")
    linked = cut_lineage(start.join(groups, "group", "left_semi"), "linked")
    free = start.join(groups, "group", "left_anti")
    capacity = _counts(start, shards)
    lowest, turn, idle = None, 0, 0
    while idle < PATIENCE:
        held = _counts(linked, shards)
        room = [c - n for c, n in zip(capacity, held)]
        asked = cut_lineage(_wishes(linked, capacity, turn), "wishes")
        counts = [[0] * shards for _ in range(shards)]
        for r in asked.groupBy("shard", "target").count().collect():
            counts[r["shard"]][r["target"]] = r["count"]
        # Rows away from where their groups want to be.
        cut = sum(map(sum, counts))
        idle = 0 if lowest is None or cut < lowest else idle + 1
        lowest = cut if lowest is None else min(cut, lowest)
        given = [n for row in grants(counts, room) for n in row]
        turn += 1
        if not cut:
            break
        if not any(given):
            continue
        ways = asked.select("number", "target", (F.col("shard") * shards + F.col("target")).alias("way"))
        let_in = F.array(*[F.lit(n).cast("long") for n in given])
        granted = numbered_within(ways, "way", "number").where(F.col("place") < F.element_at(let_in, F.col("way") + 1))
        moved = linked.join(cut_lineage(granted.select("number", "target"), "granted"), "number", "left")
        linked = cut_lineage(
            moved.withColumn("shard", F.coalesce("target", "shard")).select(*start.columns), "moved"
        )
    need = [c - n for c, n in zip(capacity, _counts(linked, shards))]
    free = numbered_within(free, "shard", "number")
    needs = F.array(*[F.lit(n).cast("long") for n in need])
    stay = F.col("place") < F.element_at(needs, F.col("shard") + 1)
    given = free.where(~stay).drop("place").withColumn("all", F.lit(0))
    given = numbered_within(given, "all", "number").drop("all")
    # Shards that still need rows take the given ones in turn.
    have = [min(n, h) for n, h in zip(need, _counts(free, shards))]
    target, taken = F.lit(None).cast("int"), sum(n - h for n, h in zip(need, have))
    for shard in reversed(range(shards)):
        taken -= need[shard] - have[shard]
        target = F.when(F.col("place") < taken + need[shard] - have[shard], shard).otherwise(target)
    given = given.withColumn("shard", target)
    columns = start.columns
    settled = linked.select(*columns).unionByName(free.where(stay).select(*columns)).unionByName(given.select(*columns))
    return numbered_within(settled, "shard", "number", name="slot").select("doc_id", "size", "text_crc32", "shard", "slot")
