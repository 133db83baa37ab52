"""Fetching: work list, candidates, attempts, outcomes, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolumen.functions.numbers import embed_wait_seconds, fetch_wait_seconds
from repolumen.functions.text import finished_file_key
from repolumen.operators import fetch
from repolumen.registry import register
from repolumen.registry import inputs as I
from repolumen.session import scratch_path
from repolumen.sources import readers, schemas, writers

_OUTCOMES = I.with_sql(I.RESULTS, I.OUTCOMES)
_WORK = """work AS (
  SELECT origin, CASE WHEN regexp_matches(origin, 'github\\.com/([^/]+/[^/]+)')
    THEN regexp_replace(regexp_extract(origin, 'github\\.com/([^/]+/[^/]+)', 1), '\\.git$', '')
    END AS repo_name FROM visits)"""
_RESOLVED = """resolved AS (
  SELECT repo, min(priority) FILTER (status = 200) AS ok_at,
         min(priority) FILTER (status = 451) AS blocked_at,
         arg_max(status, priority) FILTER (status NOT IN (200, 404, 451)) AS other,
         CAST(count(DISTINCT filename) AS INT) AS candidates_tried,
         CAST(sum(ms) AS BIGINT) AS fetch_ms
  FROM attempts GROUP BY repo),
final AS (
  SELECT *, ok_at IS NOT NULL AND (blocked_at IS NULL OR ok_at < blocked_at) AS won FROM resolved)"""


def _outcomes(spark, sf_dir):
    return fetch.classify_outcomes(I.results(spark, sf_dir), I.MIN_CHARS, I.MAX_CHARS)


@register(
    "p4_work_list",
    I.with_sql(I.VISITS, _WORK)
    + """SELECT origin, repo_name, regexp_replace(repo_name, '/', '_') AS file_key,
         CASE WHEN repo_name IS NULL THEN 'no_match'
              WHEN length(repo_name) > 200 THEN 'skipped' ELSE 'fetch' END AS verdict FROM work""",
)
def work_list(spark, sf_dir):
    """Repository, file key and verdict of each visit."""
    return fetch.work_list(I.visits(spark, sf_dir))


@register(
    "j4_to_fetch",
    I.with_sql(I.VISITS, _WORK)
    + """SELECT DISTINCT repo_name, replace(repo_name, '/', '_') AS file_key FROM work
         WHERE repo_name IS NOT NULL AND replace(repo_name, '/', '_') NOT IN (
           SELECT 'user' || user_id || '_repo' || user_id FROM events
             WHERE event_type = 'error' AND user_id % 4 = 1
           UNION SELECT 'user' || user_id || '_repo' || user_id FROM events
             WHERE value > 250 AND user_id % 4 = 2)""",
)
def to_fetch(spark, sf_dir):
    """Repositories without outcome or stored file."""
    events = I.table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    failed = events.where("event_type = 'error' AND user_id % 4 = 1").select(
        F.concat(F.lit("user"), user, F.lit("/repo"), user).alias("repo_name")
    )
    names = events.where("value > 250 AND user_id % 4 = 2").select(
        F.concat(F.lit("user"), user, F.lit("_repo"), user, F.lit("_HEAD_README.md")).alias("name")
    )
    finished = fetch.finished_keys(failed, names)
    return fetch.to_fetch(fetch.work_list(I.visits(spark, sf_dir)), finished).select(
        "repo_name", "file_key"
    )


@register("s7_stored_readmes", I.with_sql(I.STORED) + "SELECT name, content FROM stored")
def stored_readmes(spark, sf_dir):
    """A file for every document, read back whole under its name."""
    path = scratch_path(spark, "stored")
    writers.write_stored_readmes(I.stored(spark, sf_dir).select("name", "content"), path)
    found = readers.read_stored_readmes(spark, path, folders=True)
    # The writer ends every text with a line break.
    text = F.expr("substring(content, 1, char_length(content) - 1)")
    return found.select("name", text.alias("content"))


@register(
    "s10_finished_files",
    I.with_sql(I.STORED)
    + """SELECT name, CASE WHEN len(p) >= 3 THEN array_to_string(p[1:len(p) - 2], '_') END
         AS file_key FROM (SELECT name, string_split(name, '_') AS p FROM stored)""",
)
def finished_files(spark, sf_dir):
    """File keys of stored names."""
    return I.stored(spark, sf_dir).select(
        "name", finished_file_key(F.col("name")).alias("file_key")
    )


_NAMES = ", ".join(f"'{n}'" for n in fetch.README_NAMES)


@register(
    "p14_candidate_urls",
    f"""SELECT source || '/' || doc_id AS repo_name, CAST(i * 2 + j AS INT) AS priority,
          (['main', 'master'])[j + 1] AS branch, ([{_NAMES}])[i + 1] AS filename,
          '{fetch.RAW_PREFIX}' || source || '/' || doc_id || '/' || (['main', 'master'])[j + 1]
            || '/' || ([{_NAMES}])[i + 1] AS url
        FROM documents, range(12) AS a(i), range(2) AS b(j)""",
)
def candidates(spark, sf_dir):
    """12 names x 2 branches per repository, in order."""
    return fetch.candidate_urls(I.readmes(spark, sf_dir).select("repo_name"))


@register(
    "p15_resolve_attempts",
    I.with_sql(I.ATTEMPTS, _RESOLVED)
    + """SELECT f.repo AS repo_name, CASE WHEN won THEN a.body END AS content,
           CASE WHEN won THEN a.branch ELSE '' END AS branch,
           CASE WHEN won THEN a.filename ELSE '' END AS filename,
           CAST(CASE WHEN won THEN 200 WHEN blocked_at IS NOT NULL THEN 451
                     ELSE coalesce(other, 404) END AS INT) AS status, candidates_tried, fetch_ms
         FROM final f LEFT JOIN attempts a ON a.repo = f.repo AND a.priority = f.ok_at""",
)
def resolved(spark, sf_dir):
    """One result per repository out of its attempts."""
    return fetch.resolve_attempts(I.attempts(spark, sf_dir))


@register(
    "s13_archive",
    I.with_sql(I.READMES)
    + """SELECT repo_name, CASE WHEN found THEN content END AS content, CASE WHEN found THEN branch ELSE '' END
           AS branch, CASE WHEN found THEN filename ELSE '' END AS filename,
           CAST(CASE WHEN found THEN 200 ELSE 404 END AS INT) AS status, CAST(12 AS INT) AS candidates_tried
         FROM (SELECT *, branch IN ('main', 'master') AND lang <> 'es' AS found
               FROM readmes JOIN (SELECT source || '/' || doc_id AS repo_name, lang FROM documents) USING (repo_name))""",
)
def archived(spark, sf_dir):
    """Candidate addresses of all repositories looked up in a stored crawl."""
    stored = I.readmes(spark, sf_dir)
    langs = I.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("repo_name"), "lang"
    )
    address = F.concat(F.lit(fetch.RAW_PREFIX), F.concat_ws("/", "repo_name", "branch", "filename"))
    archive = stored.join(langs.where("lang <> 'es'"), "repo_name").select(
        address.alias("url"), F.col("content").alias("body")
    )
    found = fetch.fetch_from_archive(stored, archive)
    return found.drop("fetch_ms")


@register(
    "s13_fetch",
    I.with_sql(I.READMES)
    + """SELECT repo_name, CASE WHEN length(content) % 3 > 0 THEN repo_name || ' text' END AS content,
           CASE WHEN length(content) % 3 > 0 THEN 'master' ELSE '' END AS branch,
           CASE WHEN length(content) % 3 > 0 THEN 'readme.md' ELSE '' END AS filename,
           CAST(CASE length(content) % 3 WHEN 0 THEN 0 ELSE 200 END AS INT) AS status,
           CAST(2 AS INT) AS candidates_tried FROM readmes""",
)
def fetched(spark, sf_dir):
    """Fetch stage with a client that answers by the address alone.

    The repository carries the remainder its answer depends on.
    """
    repos = I.readmes(spark, sf_dir).select(
        F.concat_ws("~", F.col("repo_name"), (F.length("content") % 3).cast("string")).alias(
            "repo_name"
        )
    )

    def make_fetch():
        def answer(url):
            repo, branch, name = url.removeprefix(fetch.RAW_PREFIX).rsplit("/", 2)
            plain, rest = repo.rsplit("~", 1)
            if rest == "0":
                return 503, ""
            return (200, f"{plain} text") if (branch, name) == ("master", "readme.md") else (404, "")

        return answer

    found = fetch.fetch_readmes(
        repos,
        make_fetch,
        names=fetch.README_NAMES[:2],
        branches=fetch.WIDE_BRANCHES,
        policy=fetch.FetchPolicy(tries=3, sleep=lambda seconds: None),
    )
    plain = F.regexp_extract("repo_name", "^(.*)~", 1)
    return found.withColumn("repo_name", plain).drop("fetch_ms")


@register(
    "p6_outcomes",
    f"{_OUTCOMES} SELECT repo_name, status, outcome, length(content) AS n_chars,"
    " sha1(content) AS content_sha1 FROM outcomes",
)
def outcomes(spark, sf_dir):
    """Outcome class and stored content."""
    return _outcomes(spark, sf_dir).select(
        "repo_name",
        "status",
        "outcome",
        F.char_length("content").cast("long").alias("n_chars"),
        F.sha1(F.encode("content", "UTF-8")).alias("content_sha1"),
    )


@register(
    "k4_outcome_table",
    f"{_OUTCOMES} SELECT repo_name, branch, filename, status, candidates_tried, outcome, content"
    " FROM outcomes WHERE outcome <> 'ok'",
)
def outcome_table(spark, sf_dir):
    """K4: outcomes written by class; reading the rest skips the successes."""
    path = scratch_path(spark, "outcomes")
    writers.write_outcomes(_outcomes(spark, sf_dir), path)
    stored = spark.read.schema(schemas.FETCH_OUTCOME).parquet(path)
    return stored.where(F.col("outcome") != "ok").select(*fetch.OUTCOME_COLUMNS)


@register(
    "k4_error_keys",
    f"{_OUTCOMES} SELECT repo_name, CASE WHEN outcome = 'too_small' THEN 'tooSmall'"
    " WHEN status = 404 THEN '404_' || candidates_tried ELSE CAST(status AS VARCHAR) END AS key"
    " FROM outcomes WHERE outcome IN ('error', 'too_small')",
)
def error_keys(spark, sf_dir):
    """K4: keys failures are filed under."""
    failed = _outcomes(spark, sf_dir).where(F.col("outcome").isin("error", "too_small"))
    key = F.when(F.col("outcome") == "too_small", "tooSmall").otherwise(
        fetch.error_key(F.col("status"), F.col("candidates_tried"))
    )
    return failed.select("repo_name", key.alias("key"))


@register(
    "p16_status_labels",
    I.with_sql(I.ATTEMPTS)
    + """SELECT repo, priority, CASE status WHEN 0 THEN 'timeout/connection'
           WHEN 404 THEN 'not found' WHEN 451 THEN 'DMCA' ELSE CAST(status AS VARCHAR) END AS label
         FROM attempts""",
)
def status_labels(spark, sf_dir):
    """P16."""
    return I.attempts(spark, sf_dir).select(
        "repo", "priority", fetch.status_label(F.col("status")).alias("label")
    )


@register(
    "a6_fetch_report",
    f"""{_OUTCOMES} SELECT count(*) FILTER (outcome IN ('ok', 'truncated')) AS success,
          count(*) FILTER (outcome = 'too_small') AS too_small,
          count(*) FILTER (outcome = 'truncated') AS truncated,
          count(*) FILTER (outcome = 'skipped') AS skipped, count(*) AS fetched,
          count(*) AS processed, count(*) FILTER (outcome = 'error') AS errors FROM outcomes""",
)
def report(spark, sf_dir):
    """A6."""
    return fetch.fetch_report(_outcomes(spark, sf_dir))


@register(
    "a7_errors_by_status",
    f"""{_OUTCOMES} SELECT status, CASE status WHEN 0 THEN 'timeout/connection'
          WHEN 404 THEN 'not found' WHEN 451 THEN 'DMCA' ELSE CAST(status AS VARCHAR) END AS label,
          count(*) AS n FROM outcomes WHERE outcome = 'error' GROUP BY status ORDER BY status""",
)
def by_status(spark, sf_dir):
    """A7."""
    return fetch.errors_by_status(_outcomes(spark, sf_dir))


@register(
    "a8_format_counts",
    I.with_sql(I.READMES)
    + """SELECT 'all' AS scope, NULL AS branch, NULL AS filename, count(*) AS n FROM readmes
         UNION ALL
         SELECT 'branch', branch, NULL, count(*) FROM readmes
         WHERE branch IN ('main', 'master', 'default') GROUP BY branch
         UNION ALL
         SELECT 'branch_file', branch, filename, count(*) FROM readmes
         WHERE branch IN ('main', 'master', 'default') GROUP BY branch, filename""",
)
def formats(spark, sf_dir):
    """README formats with totals, most frequent first."""
    return fetch.format_counts(I.readmes(spark, sf_dir))


@register(
    "a14_fetch_speed",
    I.with_sql(I.ATTEMPTS)
    + """SELECT count(*) AS attempts, round(avg(ms), 6) AS avg_ms,
           round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000, 6) AS per_second
         FROM attempts""",
)
def speed(spark, sf_dir):
    """A14."""
    return fetch.fetch_speed(I.attempts(spark, sf_dir)).select(
        "attempts",
        F.round("avg_ms", 6).alias("avg_ms"),
        F.round("per_second", 6).alias("per_second"),
    )


@register(
    "x19_waits",
    """SELECT event_id, power(2.0, event_id % 5) AS fetch_wait,
         (11 - (event_id % 11)) * 2 AS embed_wait FROM events""",
)
def waits(spark, sf_dir):
    """Waits of fetch and embed retries over an attempt log."""
    return I.table(spark, sf_dir, "events").select(
        "event_id",
        fetch_wait_seconds(F.col("event_id") % 5).alias("fetch_wait"),
        embed_wait_seconds(F.col("event_id") % 11).alias("embed_wait"),
    )
