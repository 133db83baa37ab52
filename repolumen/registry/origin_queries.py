"""Crawl lists: sources, host and date filters, last visits, numbering, slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolumen.functions.text import file_key, repo_from_url
from repolumen.functions.times import parse_day
from repolumen.operators import numbering, origins
from repolumen.plans import crawl
from repolumen.registry import register
from repolumen.registry import inputs as I
from repolumen.session import scratch_path
from repolumen.sources import readers, schemas, writers

MIN_DATE = "2024-01-15"
LOOKBACK_DAYS = 10
_VISITS = I.with_sql(I.VISITS)
_HOST_SQL = "origin LIKE 'https://github.com/%'"
_NUMBERED = I.with_sql(
    "numbered AS (SELECT row_number() OVER (ORDER BY url, page_id) AS id, url, page_id FROM pages)"
)


@register(
    "s1_orc_origins",
    "SELECT url FROM pages WHERE url LIKE 'https://m.%'",
)
def orc_origins(spark, sf_dir):
    """Origins written as ORC files, read pruned to ``url``, one host kept."""
    path = scratch_path(spark, "origins-orc")
    pages = I.table(spark, sf_dir, "pages")
    pages.select(F.col("page_id").cast("string").alias("id"), "url").write.orc(path)
    return origins.on_host(readers.read_origins(spark, path), "url", I.PAGE_PREFIX)


@register(
    "s2_orc_visits",
    f"{_VISITS} SELECT origin, max(date) AS date FROM visits WHERE {_HOST_SQL} GROUP BY origin",
)
def orc_visits(spark, sf_dir):
    """ORC visits to a zstd Parquet table of last visits."""
    source, target = scratch_path(spark, "visits-orc"), scratch_path(spark, "visits")
    visits = I.visits(spark, sf_dir).withColumn("date", F.col("date").cast("timestamp"))
    visits.select(
        "origin", F.lit(1).alias("visit"), "date", F.lit("git").alias("type")
    ).write.orc(source)
    crawl.convert_visits(spark, source, target)
    return spark.read.parquet(target).select("origin", F.col("date").cast("timestamp_ntz"))


@register("s3_origin_list", "SELECT url FROM pages ORDER BY url LIMIT 20 OFFSET 5")
def origin_list(spark, sf_dir):
    """The URL list with offset and limit."""
    return readers.read_host_origins(spark, f"{sf_dir}/pages.parquet", limit=20, offset=5)


@register(
    "s4_recent_origins",
    f"{_VISITS} SELECT origin FROM visits WHERE date >= TIMESTAMP '{MIN_DATE}'"
    " ORDER BY origin LIMIT 100 OFFSET 10",
)
def recent_origins(spark, sf_dir):
    """Origins on or after a date, one slice."""
    path = scratch_path(spark, "visits")
    writers.write_zstd_parquet(I.visits(spark, sf_dir), path)
    return readers.read_recent_origins(spark, path, MIN_DATE, limit=100, offset=10)


@register(
    "s5_sql_over_parquet",
    f"SELECT event_type, count(*) AS n, max(ts) AS newest FROM events"
    f" WHERE ts >= TIMESTAMP '{MIN_DATE}' GROUP BY event_type",
)
def sql_over_parquet(spark, sf_dir):
    """SQL straight over a Parquet path."""
    return readers.query_parquet(
        spark,
        f"SELECT event_type, count(*) AS n, max(ts) AS newest FROM {{events}}"
        f" WHERE ts >= TIMESTAMP_NTZ '{MIN_DATE} 00:00:00' GROUP BY event_type",
        events=f"{sf_dir}/events.parquet",
    )


@register("s6_row_count", "SELECT count(*) AS n FROM pages")
def row_count(spark, sf_dir):
    """Row count without reading a column."""
    return I.table(spark, sf_dir, "pages").agg(F.count("*").alias("n"))


@register("k2_sorted_lines", f"{_VISITS} SELECT DISTINCT origin AS value FROM visits")
def sorted_lines(spark, sf_dir):
    """Distinct origins as sorted text lines, read back."""
    path = scratch_path(spark, "active")
    writers.write_sorted_lines(
        I.visits(spark, sf_dir).select("origin").distinct(), "origin", path
    )
    return spark.read.text(path)


@register(
    "p1_host_prefix",
    "SELECT page_id, url FROM pages WHERE url LIKE 'https://m.%'",
)
def host_prefix(spark, sf_dir):
    """P1, X21."""
    pages = I.table(spark, sf_dir, "pages").select("page_id", "url")
    return origins.on_host(pages, "url", I.PAGE_PREFIX)


@register(
    "p2_min_date",
    f"{_VISITS} SELECT origin, date FROM visits WHERE date >= TIMESTAMP '{MIN_DATE}'",
)
def min_date(spark, sf_dir):
    """Inclusive minimum date."""
    return origins.recent(I.visits(spark, sf_dir), MIN_DATE)


@register(
    "p3_look_back",
    f"{_VISITS} SELECT origin, date FROM visits"
    f" WHERE date >= (SELECT max(date) FROM visits) - INTERVAL {LOOKBACK_DAYS} DAY",
)
def look_back(spark, sf_dir):
    """Last days before the newest visit of all hosts."""
    return origins.active_visits(I.visits(spark, sf_dir), LOOKBACK_DAYS)


@register(
    "p3_look_back_given_date",
    f"{_VISITS} SELECT origin, date FROM visits"
    f" WHERE date >= TIMESTAMP '2024-01-20' - INTERVAL {LOOKBACK_DAYS} DAY",
)
def look_back_given(spark, sf_dir):
    """P3 with a reference date."""
    return origins.active_visits(I.visits(spark, sf_dir), LOOKBACK_DAYS, "2024-01-20")


@register(
    "p4_repo_from_url",
    """SELECT page_id, url, CASE WHEN regexp_matches(url, 'example\\.com/([^/]+/[^/]+)')
         THEN regexp_replace(regexp_extract(url, 'example\\.com/([^/]+/[^/]+)', 1), '\\.git$', '')
         END AS repo_name FROM pages""",
)
def repo_names(spark, sf_dir):
    """Repository out of any URL, null without a match."""
    repo = repo_from_url(F.col("url"), "example.com").alias("repo_name")
    return I.table(spark, sf_dir, "pages").select("page_id", "url", repo)


@register(
    "p5_file_key",
    """SELECT page_id, regexp_replace(url, '/', '_') AS file_key,
         CASE WHEN length(url) > 40 THEN 'skipped' ELSE 'fetch' END AS verdict FROM pages""",
)
def file_keys(spark, sf_dir):
    """First slash to underscore; over-long keys are skipped."""
    key = file_key(F.col("url"))
    verdict = F.when(F.char_length(key) > 40, "skipped").otherwise("fetch")
    return I.table(spark, sf_dir, "pages").select(
        "page_id", key.alias("file_key"), verdict.alias("verdict")
    )


@register(
    "a1_last_visit",
    f"{_VISITS} SELECT origin, max(date) AS date FROM visits WHERE {_HOST_SQL} GROUP BY origin",
)
def last_visit(spark, sf_dir):
    """A1."""
    return origins.last_visits(I.visits(spark, sf_dir))


@register(
    "a2_active_origins",
    f"{_VISITS} SELECT DISTINCT origin FROM visits WHERE {_HOST_SQL}"
    f" AND date >= (SELECT max(date) FROM visits) - INTERVAL {LOOKBACK_DAYS} DAY",
)
def active(spark, sf_dir):
    """Distinct active origins of one host."""
    return origins.active_origins(
        I.visits(spark, sf_dir), LOOKBACK_DAYS, prefix="https://github.com/"
    )


@register(
    "a4_recent_count",
    f"{_VISITS} SELECT count(*) AS cnt FROM visits WHERE date >= TIMESTAMP '{MIN_DATE}'",
)
def recent_count(spark, sf_dir):
    """A4."""
    return origins.count_recent(I.visits(spark, sf_dir), MIN_DATE)


@register(
    "a12_visit_range",
    f"{_VISITS} SELECT count(*) AS visits, min(date) AS first_date, max(date) AS last_date"
    " FROM visits",
)
def visit_range(spark, sf_dir):
    """A12."""
    return origins.visit_range(I.visits(spark, sf_dir))


@register(
    "x14_day_parse",
    """SELECT event_id, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') AS day,
         ts - INTERVAL 365 DAY AS year_before FROM events""",
)
def day_parse(spark, sf_dir):
    """Day text to timestamp; minus a number of days."""
    text = F.date_format(F.col("ts"), "yyyy-MM-dd")
    return I.table(spark, sf_dir, "events").select(
        "event_id",
        parse_day(text).alias("day"),
        (F.col("ts") - F.make_dt_interval(F.lit(365))).alias("year_before"),
    )


def _numbered(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages").select("url", "page_id")
    return numbering.dense_ids(pages, "url", "page_id")


@register("w1_dense_ids", f"{_NUMBERED} SELECT * FROM numbered")
def dense_ids(spark, sf_dir):
    """Row numbers in URL order without a single-task window."""
    return _numbered(spark, sf_dir)


@register(
    "w4_chunks",
    f"{_NUMBERED} SELECT id, CAST(floor((id - 1) / 64) AS BIGINT) AS chunk,"
    " CAST(floor((id - 1) / 64) AS BIGINT) % 3 AS lane FROM numbered",
)
def chunks(spark, sf_dir):
    """Chunks of 64, keys in turn."""
    chunked = numbering.with_chunks(_numbered(spark, sf_dir), 64)
    return numbering.with_round_robin(chunked, 3).select("id", "chunk", "lane")


@register("w6_id_slice", f"{_NUMBERED} SELECT id, url FROM numbered WHERE id > 40 AND id <= 140")
def id_slice(spark, sf_dir):
    """The share of one worker."""
    return numbering.id_slice(_numbered(spark, sf_dir), 40, 100).select("id", "url")


@register(
    "t3_keyset_page", f"{_NUMBERED} SELECT id, url FROM numbered WHERE id > 100 ORDER BY id LIMIT 50"
)
def keyset_page(spark, sf_dir):
    """Next page after a saved id."""
    return numbering.keyset_page(_numbered(spark, sf_dir), 100, 50).select("id", "url")


@register(
    "t2_all_pages",
    f"{_NUMBERED} SELECT id, url, CAST(floor((id - 31) / 40) AS BIGINT) AS batch"
    " FROM numbered WHERE id > 30 AND id <= 30 + 150",
)
def all_pages(spark, sf_dir):
    """Every batch of 40 of a paging loop with limit and offset."""
    return numbering.paged(_numbered(spark, sf_dir), 30, 150, 40).select("id", "url", "batch")


@register(
    "k7_progress",
    """SELECT 'user' || user_id AS table_name, CAST(arg_max(event_id, ts) AS BIGINT) AS last_id
       FROM events GROUP BY user_id""",
)
def progress(spark, sf_dir):
    """K7: progress rows appended, the latest per key read back."""
    from repolumen.operators.batches import latest_progress

    saved = I.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("table_name"),
        F.col("event_id").alias("last_id"),
        F.col("ts").alias("saved_at"),
    )
    path = scratch_path(spark, "progress")
    for step in range(3):
        writers.append_progress(saved.where(F.col("last_id") % 3 == step), path)
    kept = spark.read.schema(schemas.PROGRESS).parquet(path)
    return latest_progress(kept, "table_name", "last_id", "saved_at")
