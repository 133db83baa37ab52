"""The test tables seen as this package's inputs, in Spark and in SQL.

Every input covers its whole table. The SQL twin of each is a ``WITH`` member.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolumen.functions.hashing import content_sha1, git_blob_sha1, hash_to_uuid
from repolumen.operators.embedding import EmbedCall, Embedder
from repolumen.streaming.health import response_ms

LETTERS = "abcdefghijklmnopqrstuvwxyz"
VECTOR_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {column} {whens} ELSE '{otherwise}' END"


def with_sql(*members: str) -> str:
    return "WITH " + ", ".join(members) + " "


# --- crawl -------------------------------------------------------------------

_HOST = _case(
    "event_type",
    {"signup": "https://gitlab.com/", "error": "https://github.com.evil/"},
    "https://github.com/",
)
_ORIGIN = (
    f"{_HOST} || 'user' || CAST(user_id AS STRING) || '/repo' || CAST(user_id AS STRING)"
    " || CASE WHEN event_type = 'purchase' THEN '.git' ELSE '' END"
)
VISITS = f"visits AS (SELECT {_ORIGIN} AS origin, ts AS date FROM events)"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(f"{_ORIGIN} AS origin", "ts AS date")


PAGE_PREFIX = "https://m."

# --- fetch -------------------------------------------------------------------

_REPO = "'user' || CAST(user_id AS STRING) || '/day' || CAST(day(ts) AS STRING)"
_STATUS = (
    "CAST(CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 404 WHEN 'purchase' THEN 0"
    " WHEN 'signup' THEN 403 ELSE 451 END AS INT)"
)
_ATTEMPT = [
    f"{_REPO} AS repo",
    "CAST(event_id AS INT) AS priority",
    "CASE WHEN value < 50 THEN 'main' ELSE 'master' END AS branch",
    "CASE WHEN value < 100 THEN 'README.md' ELSE 'README.rst' END AS filename",
    f"{_STATUS} AS status",
    "CASE WHEN event_type = 'view' THEN props END AS body",
    "CAST(floor(value * 10) AS BIGINT) AS ms",
    "ts",
]
ATTEMPTS = f"attempts AS (SELECT {', '.join(_ATTEMPT)} FROM events)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_ATTEMPT)


_RESULT = [
    "source || '/' || CAST(doc_id AS STRING) AS repo_name",
    "CASE WHEN lang = 'es' THEN NULL ELSE text END AS content",
    "CASE WHEN lang = 'es' THEN '' ELSE 'HEAD' END AS branch",
    "CASE WHEN lang = 'es' THEN '' ELSE 'README.md' END AS filename",
    "CAST(CASE WHEN lang <> 'es' THEN 200 WHEN source < 'src13' THEN 404"
    " WHEN source < 'src16' THEN 451 WHEN source < 'src3' THEN 503 ELSE 0 END AS INT) AS status",
    "CAST(CASE WHEN source < 'src11' THEN 1 ELSE 12 END AS INT) AS candidates_tried",
]
RESULTS = f"results AS (SELECT {', '.join(_RESULT)} FROM documents)"
MIN_CHARS, MAX_CHARS = 500, 5000
OUTCOMES = f"""outcomes AS (
  SELECT repo_name, branch, filename, status, candidates_tried,
         CASE WHEN coalesce(length(content), 0) = 0 THEN 'error'
              WHEN length(content) < {MIN_CHARS} THEN 'too_small'
              WHEN length(content) > {MAX_CHARS} THEN 'truncated' ELSE 'ok' END AS outcome,
         CASE WHEN length(content) > {MAX_CHARS}
              THEN substring(content, 1, {MAX_CHARS}) || chr(10) || chr(10) || '[TRUNCATED]'
              WHEN length(content) >= {MIN_CHARS} THEN content END AS content
  FROM results)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*_RESULT)


# --- corpus ------------------------------------------------------------------

_BRANCH = _case("lang", {"en": "HEAD", "fr": "master", "de": "main"}, "default")
_README = [
    "source || '/' || CAST(doc_id AS STRING) AS repo_name",
    "text AS content",
    f"{_BRANCH} AS branch",
    "'README.md' AS filename",
]
READMES = f"readmes AS (SELECT {', '.join(_README)} FROM documents)"


def readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*_README)


_NAME = (
    "CASE source WHEN 'src3' THEN 'o_main_' WHEN 'src4' THEN 'o_my_main_' ELSE 'o_x_' END"
    f" || CAST(doc_id AS STRING) || '_' || {_BRANCH} || '_README.md'"
)
STORED = f"stored AS (SELECT {_NAME} AS name, text AS content, lang FROM documents)"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        f"{_NAME} AS name", "text AS content", "lang"
    )


TRIM_SQL = "concat_ws('', " + ", ".join(
    f"chr({p})"
    for p in [*range(9, 14), 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]
) + ")"
UUID_SQL = (
    "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' ||"
    " substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
)
PARSED = """parsed AS (
  SELECT *, CASE WHEN pos >= 3 THEN parts[1] || '/' || array_to_string(parts[2:pos - 1], '_') END
         AS repo_name
  FROM (SELECT *, list_min(list_filter([list_position(parts, 'main'),
                 list_position(parts, 'master'), list_position(parts, 'default')],
                 lambda x: x > 0)) AS pos
        FROM (SELECT *, string_split(name, '_') AS parts FROM stored)))"""


def keyed_sql(source: str, name: str = "keyed") -> str:
    """Records (``repo_name``, ``content``) with id, hash, trimmed text and class."""
    uuid = UUID_SQL.format("content_hash")
    return f"""{name} AS (
  SELECT *, CASE WHEN kind = 'candidate' THEN {uuid} END AS id
  FROM (SELECT repo_name, content AS raw, sha1(content) AS content_hash,
               substring(trim(content, {TRIM_SQL}), 1, 16000) AS content,
               CASE WHEN repo_name IS NULL THEN 'unparsable'
                    WHEN length(trim(content, {TRIM_SQL})) >= 10 THEN 'candidate'
                    ELSE 'empty' END AS kind
        FROM {source}))"""


UNIQUE = """uniq AS (SELECT id, min(repo_name) AS repo_name, min(content) AS content,
  min(content_hash) AS content_hash FROM keyed WHERE kind = 'candidate' GROUP BY id)"""

# Ids taken as indexed already: all English texts.
EXISTING = f"""existing AS (
  SELECT DISTINCT {UUID_SQL.format("h")} AS id
  FROM (SELECT sha1(text) AS h FROM documents WHERE lang = 'en'))"""

# Ids taken as in flight: all French texts.
IN_FLIGHT = EXISTING.replace("existing", "in_flight").replace("'en'", "'fr'")


def ids_of_language(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("lang") == lang)
    return docs.select(hash_to_uuid(content_sha1(F.col("text"))).alias("id")).distinct()




def fixed_sql(value: str, digits: int) -> str:
    """Fixed digits of a value, ties away from zero."""
    size = f"abs(CAST({value} AS DOUBLE))"
    moved = f"CASE WHEN ({size} * {2 ** (digits + 1)}) % 2 = 1 THEN {size} + {0.5 * 10.0**-digits} ELSE {size} END"
    return f"(CASE WHEN {value} < 0 THEN '-' ELSE '' END || printf('%.{digits}f', {moved}))"


def compact_sql(n: str) -> str:
    kilo = f"regexp_replace({fixed_sql(f'({n} / 1000)', 1)}, '\\.0$', '') || 'k'"
    return f"CASE WHEN {n} >= 1000 THEN {kilo} ELSE CAST({n} AS VARCHAR) END"


def compact_count_sql(n: str) -> str:
    mega = f"regexp_replace({fixed_sql(f'({n} / 1000000)', 1)}, '\\.0$', '') || 'M'"
    kilo = f"{fixed_sql(f'({n} / 1000)', 0)} || 'k'"
    return (
        f"CASE WHEN {n} >= 1000000 THEN {mega} WHEN {n} >= 1000 THEN {kilo}"
        f" ELSE CAST({n} AS VARCHAR) END"
    )


# --- warehouse ---------------------------------------------------------------

_PATH = _case("lang", {"fr": "readme.MD", "de": "docs/README.md"}, "README.md")
_BINARY = "CASE WHEN text LIKE '%@%' THEN NULL ELSE length(text) < 50 END"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        git_blob_sha1(F.col("text")).alias("id"),
        F.col("source").alias("repo_name"),
        F.expr(_PATH).alias("path"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        git_blob_sha1(F.col("text")).alias("id"),
        F.col("text").alias("content"),
        F.expr(_BINARY).alias("binary"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a commit of two repositories; errors belong to none."""
    shared = F.when(
        F.col("event_type") != "error",
        F.array(
            F.concat(F.lit("src"), F.col("user_id").cast("string")),
            F.concat(F.lit("src"), (F.col("user_id") + 7).cast("string")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        shared.alias("repo_name"),
        F.struct(F.struct(seconds.alias("seconds")).alias("date")).alias("committer"),
    )


BLOB_SQL = "sha1(encode('blob ' || strlen({0})) || '\\x00'::BLOB || encode({0}))"
WAREHOUSE = f"""files AS (
  SELECT {BLOB_SQL.format("text")} AS id, source AS repo_name, {_PATH} AS path FROM documents),
contents AS (
  SELECT {BLOB_SQL.format("text")} AS id, text AS content, {_BINARY} AS binary FROM documents),
commits AS (
  SELECT CASE WHEN event_type = 'error' THEN CAST([] AS VARCHAR[])
              ELSE ['src' || user_id, 'src' || (user_id + 7)] END AS repo_name,
         CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events)"""

# --- vectors -----------------------------------------------------------------

POINTS = """points AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vector, source || '/' || doc_id AS repo_name
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the repository of their document."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("repo_name"),
    )
    return vectors(spark, sf_dir).drop("label").join(docs, "id", "left")


def vector_queries(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Every vector asks for its nearest ones."""
    return vectors(spark, sf_dir).select(
        F.col("id").alias("qid"), F.lit(k).cast("long").alias("k"), "vector"
    )


def letter_service(key: str) -> EmbedCall:
    """Offline stand-in for an embedding service: how often each letter occurs."""

    def call(texts: Sequence[str]) -> tuple[list[list[float]], int]:
        return [[float(t.count(c)) for c in LETTERS] for t in texts], sum(map(len, texts))

    return call


def letter_embedder(**options) -> Embedder:
    return Embedder(letter_service, dimension=len(LETTERS), usd_per_million=0.01, **options)


def letters_sql(text: str) -> str:
    return (
        f"list_transform(range(97, 123), lambda c: CAST(length({text})"
        f" - length(replace({text}, chr(c::INT), '')) AS DOUBLE))"
    )


# --- logs --------------------------------------------------------------------

_REQUEST = [
    "event_id",
    "ts",
    "CASE WHEN event_type = 'purchase' THEN NULL WHEN user_id < 3 THEN ''"
    " ELSE ' 10.0.0.' || CAST(user_id AS STRING) || ' , 10.9.9.9' END AS forwarded_for",
    "CASE WHEN value > 200 THEN 'valid-key' WHEN value > 150 THEN 'other-key' END AS api_key",
    "CASE event_type WHEN 'signup' THEN '/stats' WHEN 'click' THEN '/search/full'"
    " ELSE '/search' END AS path",
]
REQUESTS = f"requests AS (SELECT {', '.join(_REQUEST)} FROM events)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_REQUEST)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id", "ts", "event_id", "event_type || ' ' || props AS query"
    )


def health_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"),
        "ts",
        "event_id",
        response_ms(F.col("value"), F.col("event_type") == "error").alias("ms"),
    )

