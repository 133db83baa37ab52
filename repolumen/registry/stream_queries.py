"""Time-ordered operators, as batch and as stream over the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from repolumen.registry import register
from repolumen.registry import inputs as I
from repolumen.session import scratch_path
from repolumen.sources import schemas, writers
from repolumen.streaming import bursts, health, quota
from repolumen.streaming.ingest import read_record_stream, start_ingest

QUOTA_WINDOW = timedelta(hours=6)
PAUSE = timedelta(hours=2)

_CLASSED = f"""{I.REQUESTS}, classed AS (
  SELECT event_id, ts,
    CASE WHEN length(forwarded_for) > 0 THEN trim(split_part(forwarded_for, ',', 1))
         ELSE 'unknown' END AS client,
    CASE WHEN path IN ('/health', '/stats') THEN 'exempt'
         WHEN coalesce(api_key = 'valid-key', false) THEN 'key' ELSE 'limited' END AS kind
  FROM requests),
limited AS (SELECT * FROM classed WHERE kind = 'limited'),
anchors AS (
  SELECT client, min(ts) AS anchor FROM limited GROUP BY client
  UNION ALL
  SELECT client, anchor FROM (
    SELECT a.client, (SELECT min(l.ts) FROM limited l WHERE l.client = a.client
                      AND l.ts > a.anchor + INTERVAL 6 HOUR) AS anchor FROM anchors a)
  WHERE anchor IS NOT NULL),
ranked AS (
  SELECT l.event_id, l.client, a.anchor,
         row_number() OVER (PARTITION BY l.client, a.anchor ORDER BY l.ts, l.event_id) AS n
  FROM limited l JOIN anchors a ON a.client = l.client AND l.ts >= a.anchor
   AND l.ts <= a.anchor + INTERVAL 6 HOUR)"""
_QUOTA = f"""WITH RECURSIVE {_CLASSED}
  SELECT event_id, client, CASE WHEN n <= 10 THEN 'allowed' ELSE 'blocked' END AS verdict,
         greatest(10 - n, 0) AS remaining, anchor + INTERVAL 6 HOUR AS reset_at FROM ranked
  UNION ALL SELECT event_id, client, kind, -1, NULL FROM classed WHERE kind <> 'limited'"""

_BURSTS = """SELECT user_id, ts, event_id, query FROM (
  SELECT user_id, ts, event_id, event_type || ' ' || props AS query,
         lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
  WHERE following IS NULL OR following - ts >= INTERVAL 2 HOUR"""

_HEALTH = """WITH RECURSIVE rows AS (
  SELECT user_id AS source, ts, event_id,
         CASE WHEN event_type = 'error' THEN 15000.0::DOUBLE ELSE value END AS ms,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT source, n, ts, event_id, 1000.0::DOUBLE * 0.8 + ms * 0.2 AS health FROM rows WHERE n = 1
  UNION ALL
  SELECT r.source, r.n, r.ts, r.event_id, w.health * 0.8 + r.ms * 0.2
  FROM walk w JOIN rows r ON r.source = w.source AND r.n = w.n + 1) """


_RANGE_FILES = 4
_BATCHES = 3


def _as_stream(df, name, parts=3):
    """The rows as a file stream, in time order over a few micro-batches.

    One write of several files per time range, oldest first: a file stream takes files
    by age, and each micro-batch as many as a range has.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    steps = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx(at, steps).alias("b")).head()["b"]
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = df if low is None else df.where(at >= low)
        part = part if high is None else part.where(at < high)
        part.repartition(_RANGE_FILES).write.mode("append").parquet(path)
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", _RANGE_FILES)
    return reader.parquet(path)


def _drain(stream, name, mode="append"):
    """Run the stream over all of its files into a table and read that."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out, format="parquet")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@register("m2_quota", _QUOTA)
def request_quota(spark, sf_dir):
    """M2: anchored quota windows over the request log."""
    return quota.apply_quota(I.requests(spark, sf_dir), 10, QUOTA_WINDOW, ("valid-key",))


@register("m2_quota_stream", _QUOTA)
def request_quota_stream(spark, sf_dir):
    """M2 as a stream with state per client."""
    stream = _as_stream(I.requests(spark, sf_dir), "requests")
    verdicts = quota.stream_quota(
        stream, 10, QUOTA_WINDOW, ("valid-key",), late=timedelta(days=1)
    )
    return _drain(verdicts, "verdicts")


@register("m3_bursts", _BURSTS)
def query_bursts(spark, sf_dir):
    """M3: queries followed by a pause."""
    return bursts.collapse_bursts(I.query_log(spark, sf_dir), PAUSE, span_pauses=16)


@register("m3_bursts_stream", _BURSTS)
def query_bursts_stream(spark, sf_dir):
    """M3 as a stream: a session per burst. Its last bursts close with the end marker."""
    log = I.query_log(spark, sf_dir)
    end = F.max(F.col("ts")) + F.make_dt_interval(F.lit(2))
    marker = log.agg(
        F.lit(-1).cast("long").alias("user_id"),
        end.alias("ts"),
        F.lit(-1).cast("long").alias("event_id"),
        F.lit("").alias("query"),
    )
    stream = _as_stream(log.unionByName(marker), "query-log")
    found = _drain(bursts.stream_bursts(stream, PAUSE, late=timedelta(hours=1)), "bursts")
    return found.where("user_id >= 0").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("w8_health_now", _HEALTH + """SELECT source, round(arg_max(health, n), 6) AS health_ms
  FROM walk GROUP BY source""")
def health_now(spark, sf_dir):
    """Present estimate per source."""
    found = health.current_health(I.health_log(spark, sf_dir))
    return found.withColumn("health_ms", F.round("health_ms", 6))


@register("w8_health_history", _HEALTH + """SELECT source, ts, event_id,
  round(health, 6) AS health_ms FROM walk""")
def health_over_time(spark, sf_dir):
    """Estimate after every attempt."""
    found = health.health_history(I.health_log(spark, sf_dir))
    return found.withColumn("health_ms", F.round("health_ms", 6))


@register(
    "m1_stream_ingest",
    I.with_sql(I.READMES, I.keyed_sql("readmes"), I.UNIQUE)
    + """SELECT id, content_hash, array_to_string(list_transform("""
    + I.letters_sql("content")
    + """, lambda x: CAST(x AS BIGINT)), ',') AS letters FROM uniq""",
)
def stream_ingest(spark, sf_dir):
    """M1: JSON lines files arriving in micro-batches, each new text embedded once."""
    from repolumen.functions.hashing import content_sha1
    from repolumen.operators.index import read_index

    source, root = scratch_path(spark, "records"), scratch_path(spark, "index")
    records = I.readmes(spark, sf_dir).withColumn("content_hash", content_sha1(F.col("content")))
    # Three micro-batches, of as many files as the table has splits: no file grows with the table.
    files = -(-records.rdd.getNumPartitions() // _BATCHES)
    writers.write_readme_records(
        records.select(*schemas.README_RECORD.fieldNames()).repartition(_BATCHES * files), source
    )
    query = start_ingest(
        read_record_stream(spark, source, files_per_trigger=files),
        root,
        I.letter_embedder(),
        scratch_path(spark, "ingest-state"),
    )
    query.awaitTermination()
    letters = F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",")
    return read_index(spark, root).select("id", "content_hash", letters.alias("letters"))
