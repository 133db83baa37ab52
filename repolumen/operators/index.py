"""Vector index as Parquet segments under a manifest: one row per content id.

Layout: ``<root>/segments/segment=<name>/bucket=<b>/*.parquet`` and
``<root>/manifest/<number>.json``. A segment holds what one write brought, cut into
buckets by a hash of the id. The manifest names the segments and buckets that count;
it is put in place by a rename when everything it names is written, and a number can
be taken once only. Readers go by the highest manifest and never write.

Appended ids are new, so their segments just add up. A replacing segment covers older
rows of its ids: they are left out on read, in its buckets only. Compaction writes the
segments of crowded buckets as one and drops what is covered.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolumen.functions.numbers import FORK_FACTOR, compact_count
from repolumen.operators.corpus import BROADCAST_IDS, without_known
from repolumen.session import cut_lineage, scratch_scope
from repolumen.sources import schemas
from repolumen.sources.files import child_names, delete_tree, modified_ms, publish_text, read_small_text

INDEX_COLUMNS = schemas.VECTOR_INDEX.fieldNames()
STORED = T.StructType([*schemas.VECTOR_INDEX, T.StructField("segment", T.StringType()), T.StructField("bucket", T.IntegerType())])
#: Buckets of a new index, and rows of a bucket beyond which compaction doubles their number.
BUCKETS, BUCKET_ROWS = 16, 1_000_000
#: Segments in a bucket beyond which it is compacted.
MOST_SEGMENTS = 8
APPEND, REPLACE, BASE = "append", "replace", "base"


class IndexConflict(RuntimeError):
    """Another writer changed what this write was based on; run it again."""


@dataclass(frozen=True)
class Segment:
    """Rows of one write. ``order`` ranks it among writes; ``rows`` counts its live buckets."""

    name: str
    kind: str
    order: int
    rows: dict[int, int]

    def without(self, buckets: Iterable[int]) -> Segment:
        gone = set(buckets)
        return replace(self, rows={b: n for b, n in self.rows.items() if b not in gone})


@dataclass(frozen=True)
class Manifest:
    """What counts: ``number`` grows with every commit, ``writes`` with those that bring rows."""

    number: int = 0
    buckets: int = BUCKETS
    writes: int = 0
    segments: tuple[Segment, ...] = field(default=())

    def to_json(self) -> str:
        return json.dumps({**vars(self), "segments": [vars(s) for s in self.segments]})

    @staticmethod
    def from_json(text: str) -> Manifest:
        read = json.loads(text)
        segments = (Segment(**{**s, "rows": {int(b): n for b, n in s["rows"].items()}}) for s in read.pop("segments"))
        return Manifest(**read, segments=tuple(segments))

    def bucket_rows(self) -> dict[int, int]:
        """Stored rows of every bucket, covered ones too."""
        total: dict[int, int] = {}
        for segment in self.segments:
            for bucket, n in segment.rows.items():
                total[bucket] = total.get(bucket, 0) + n
        return total

    def segment_counts(self) -> dict[int, int]:
        counts: dict[int, int] = {}
        for segment in self.segments:
            for bucket in segment.rows:
                counts[bucket] = counts.get(bucket, 0) + 1
        return counts


# --- manifests ------------------------------------------------------------------


def _numbers(spark: SparkSession, root: str) -> list[int]:
    names = child_names(spark, f"{root}/manifest")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> Manifest:
    return Manifest.from_json(read_small_text(spark, f"{root}/manifest/{number}.json"))


def current_manifest(spark: SparkSession, root: str) -> Manifest:
    """The highest manifest; an empty one, which nobody wrote, for a new index."""
    numbers = _numbers(spark, root)
    return _manifest(spark, root, numbers[-1]) if numbers else Manifest()


def _commit(
    spark: SparkSession, root: str, change: Callable[[Manifest], Manifest]
) -> Manifest:
    """Put the changed manifest in place; if another came first, change that one."""
    while True:
        now = current_manifest(spark, root)
        changed = replace(change(now), number=now.number + 1)
        if publish_text(spark, f"{root}/manifest/{changed.number}.json", changed.to_json()):
            return changed


def ensure_index(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Manifest:
    """The manifest of the index, which is created with so many buckets if it is new."""
    if _numbers(spark, root):
        return current_manifest(spark, root)
    return _commit(spark, root, lambda now: now if now.number else replace(now, buckets=buckets))


# --- reading --------------------------------------------------------------------


def bucket_of(buckets: int, column: str = "id") -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _stored_rows(
    spark: SparkSession, root: str, segments: Iterable[Segment], buckets: set[int] | None
) -> DataFrame:
    """Rows of live buckets with ``segment`` and ``bucket``; other folders are pruned."""
    live = [(s, sorted(s.rows if buckets is None else set(s.rows) & buckets)) for s in segments]
    live = [(s, b) for s, b in live if b]
    if not live:
        return spark.createDataFrame([], STORED)
    base = f"{root}/segments"
    stored = spark.read.schema(STORED).option("basePath", base).parquet(*[f"{base}/segment={s.name}" for s, _ in live])
    # Segments with the same live buckets share a term, so the filter stays short.
    alike: dict[tuple[int, ...], list[str]] = {}
    for segment, own in live:
        alike.setdefault(tuple(own), []).append(segment.name)
    wanted = F.lit(False)
    for own, names in alike.items():
        wanted |= F.col("segment").isin(names) & F.col("bucket").isin(list(own))
    return stored.where(wanted)


def _latest(spark: SparkSession, root: str, manifest: Manifest, buckets: set[int] | None) -> DataFrame:
    """Stored rows that no later replacing segment covers, with ``segment`` and ``bucket``.

    Only ids of replacing segments are looked at. Their number is known from the
    manifest: up to a bound they are broadcast, and no vector moves.
    """
    stored = _stored_rows(spark, root, manifest.segments, buckets)
    covering = [s for s in manifest.segments if s.kind == REPLACE and (buckets is None or buckets & set(s.rows))]
    if not covering:
        return stored
    orders = F.create_map(*[F.lit(x) for s in manifest.segments for x in (s.name, s.order)])
    order = F.element_at(orders, F.col("segment"))
    touched = set().union(*(s.rows for s in covering))
    ids = _stored_rows(spark, root, covering, buckets).select("id", order.alias("latest"))
    ids = ids.groupBy("id").agg(F.max("latest").alias("latest"))
    if sum(sum(s.rows.values()) for s in covering) <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    in_touched = F.col("bucket").isin(sorted(touched))
    covered = stored.where(in_touched).withColumn("order", order).join(ids, "id", "left")
    kept = covered.where(F.col("latest").isNull() | (F.col("latest") <= F.col("order")))
    return stored.where(~in_touched).unionByName(kept.select(*stored.columns))


def read_index(spark: SparkSession, root: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """The index, or its rows in some ``buckets``; their folders only are read."""
    chosen = None if buckets is None else set(buckets)
    return _latest(spark, root, current_manifest(spark, root), chosen).select(*INDEX_COLUMNS)


def existing_ids(spark: SparkSession, root: str, manifest: Manifest | None = None) -> DataFrame:
    """Ids of the index; neither vectors nor payload are read.

    Covered rows have the same ids as those that cover them: once is enough.
    """
    manifest = manifest or current_manifest(spark, root)
    ids = _stored_rows(spark, root, manifest.segments, None).select("id")
    return ids.distinct() if any(s.kind == REPLACE for s in manifest.segments) else ids


def hit_buckets(ids: DataFrame, buckets: int) -> dict[int, int]:
    """Buckets in which ``ids`` fall, and how many of them; as many numbers as there are buckets at most."""
    counts = ids.where("id is not null").groupBy(bucket_of(buckets).alias("bucket")).count()
    return {row["bucket"]: row["count"] for row in counts.collect()}


def known_ids(
    spark: SparkSession, root: str, ids: DataFrame, manifest: Manifest | None = None
) -> DataFrame:
    """Those of ``ids`` that the index holds, each once. Only the buckets they hit are read.

    ``ids`` are read twice: give a written table.
    """
    manifest = manifest or current_manifest(spark, root)
    hit = hit_buckets(ids, manifest.buckets)
    asked = ids.select("id")
    if sum(hit.values()) <= BROADCAST_IDS:
        asked = F.broadcast(asked)
    stored = _stored_rows(spark, root, manifest.segments, set(hit)).select("id")
    return stored.join(asked, "id", "left_semi").distinct()


# --- writing --------------------------------------------------------------------


def checked_points(points: DataFrame, dimension: int) -> DataFrame:
    """Points with the declared dimension; any other fails the job instead of being dropped."""
    right_size = F.coalesce(F.size("vector") == dimension, F.lit(False))
    message = F.concat(F.lit("wrong vector dimension at id "), F.col("id").cast("string"))
    vector = F.when(right_size, F.col("vector")).otherwise(F.raise_error(message))
    return points.withColumn("vector", vector)


def unique_points(points: DataFrame) -> DataFrame:
    """One point per id, the lowest repository name; copies fold before the shuffle."""
    rest = F.struct("repo_name", "content_hash", "vector")
    return (
        points.groupBy("id")
        .agg(F.min_by(rest, F.struct("repo_name", "content_hash")).alias("p"))
        .select("id", "p.vector", "p.repo_name", "p.content_hash")
    )


def _write_segment(
    spark: SparkSession, root: str, points: DataFrame, kind: str, buckets: int, number: int
) -> Segment:
    """A new segment; nobody reads it before a manifest names it."""
    name = f"{number}-{uuid.uuid4().hex[:12]}"
    path = f"{root}/segments/segment={name}"
    placed = points.select(*INDEX_COLUMNS, bucket_of(buckets).alias("bucket"))
    # Few, even files: small buckets share a task, a large one is split over several.
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "id").write.option(
        "compression", "zstd"
    ).partitionBy("bucket").parquet(path)
    found = spark.read.schema(placed.schema).parquet(path).groupBy("bucket").count().collect()
    return Segment(name, kind, number, {row["bucket"]: row["count"] for row in found})


def _add_segment(spark: SparkSession, root: str, base: Manifest, segment: Segment) -> Manifest:
    if not segment.rows:
        return base

    def change(now: Manifest) -> Manifest:
        # Compaction in between moves rows but brings none; another write may have brought the same ids.
        if now.writes != base.writes or now.buckets != base.buckets:
            raise IndexConflict(f"the index {root} was written to since manifest {base.number}")
        added = replace(segment, order=now.number + 1)
        return replace(now, writes=now.writes + 1, segments=(*now.segments, added))

    return _commit(spark, root, change)


def append_points(
    spark: SparkSession,
    root: str,
    points: DataFrame,
    dimension: int,
    new_since: Manifest | None = None,
) -> Manifest:
    """Add points whose id is not in the index yet. Running it again adds nothing.

    ``new_since`` saves the comparison for points that were compared with that
    manifest already (:func:`repolumen.operators.corpus.new_items`). Else the points
    are written to the shared folder once, and compared with the buckets they hit.
    """
    base = ensure_index(spark, root) if new_since is None else new_since
    fresh = checked_points(points, dimension)
    with scratch_scope(spark):
        if new_since is None:
            unique = cut_lineage(unique_points(fresh), "points")
            fresh = without_known(unique, known_ids(spark, root, unique, base))
        return _add_segment(
            spark, root, base, _write_segment(spark, root, fresh, APPEND, base.buckets, base.number + 1)
        )


def replace_points(spark: SparkSession, root: str, points: DataFrame, dimension: int) -> Manifest:
    """Upsert: a segment that covers the older rows of its ids.

    The points are all that is written and shuffled; no file of the index is read.
    """
    base = ensure_index(spark, root)
    fresh = unique_points(checked_points(points, dimension))
    segment = _write_segment(spark, root, fresh, REPLACE, base.buckets, base.number + 1)
    return _add_segment(spark, root, base, segment)


# --- upkeep ---------------------------------------------------------------------


def crowded_buckets(manifest: Manifest, most_segments: int = MOST_SEGMENTS) -> set[int]:
    """Buckets of more than ``most_segments`` segments, or where a tenth of the rows may be covered."""
    replacing: dict[int, int] = {}
    for segment in manifest.segments:
        if segment.kind == REPLACE:
            for bucket, n in segment.rows.items():
                replacing[bucket] = replacing.get(bucket, 0) + n
    rows = manifest.bucket_rows()
    many = {b for b, n in manifest.segment_counts().items() if n > most_segments}
    return many | {b for b, n in replacing.items() if 10 * n >= rows[b] and n < rows[b]}


def compact(
    spark: SparkSession,
    root: str,
    buckets: Iterable[int] | None = None,
    most_segments: int = MOST_SEGMENTS,
    bucket_rows: int = BUCKET_ROWS,
) -> Manifest:
    """Write crowded buckets (or the given ones) as one segment without covered rows.

    Where buckets hold more than ``bucket_rows`` in the mean, all are written anew in
    more of them: a bucket stays about as large, however large the index. Rows that
    other writers bring meanwhile stay: only the segments that were read are replaced.
    """
    base = current_manifest(spark, root)
    total = sum(base.bucket_rows().values())
    count = base.buckets
    while total > bucket_rows * count:
        count *= 2
    if count > base.buckets:
        chosen = set(base.bucket_rows())
    else:
        chosen = (crowded_buckets(base, most_segments) if buckets is None else set(buckets)) & set(base.bucket_rows())
    if not chosen:
        return base
    read = {s.name for s in base.segments if chosen & set(s.rows)}
    order = max(s.order for s in base.segments if s.name in read)
    rows = _latest(spark, root, base, chosen).select(*INDEX_COLUMNS)
    written = replace(_write_segment(spark, root, rows, BASE, count, base.number + 1), order=order)

    def change(now: Manifest) -> Manifest:
        live = {(s.name, b) for s in now.segments for b in s.rows}
        gone = {(s.name, b) for s in base.segments for b in chosen & set(s.rows)}
        if now.buckets != base.buckets or not gone <= live or (count != base.buckets and now.writes != base.writes):
            raise IndexConflict(f"the index {root} was compacted or split since manifest {base.number}")
        left = (s.without(chosen) if s.name in read else s for s in now.segments)
        return replace(now, buckets=count, segments=(written, *(s for s in left if s.rows)))

    return _commit(spark, root, change)


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_than_hours: float = 24.0) -> int:
    """Remove segments that none of the last ``keep`` manifests names, and older manifests.

    Younger folders stay: they may belong to a write that is not committed yet. Returns
    how many segments went.
    """
    numbers, now_ms = _numbers(spark, root), 1000 * time.time()
    named = {s.name for n in numbers[-keep:] for s in _manifest(spark, root, n).segments}
    gone = 0
    for folder in child_names(spark, f"{root}/segments"):
        path = f"{root}/segments/{folder}"
        age_ms = now_ms - modified_ms(spark, path)
        if folder.removeprefix("segment=") not in named and age_ms >= older_than_hours * 3_600_000:
            delete_tree(spark, path)
            gone += 1
    for number in numbers[:-keep]:
        delete_tree(spark, f"{root}/manifest/{number}.json")
    return gone


def index_stats(index: DataFrame) -> DataFrame:
    """Rows of the index, and the display estimate that also counts forks and copies."""
    counted = index.agg(F.count("*").alias("repos"))
    with_forks = F.col("repos") * FORK_FACTOR
    return counted.select(
        "repos",
        compact_count(F.col("repos")).alias("repos_text"),
        with_forks.alias("with_forks"),
        compact_count(with_forks).alias("with_forks_text"),
    )
