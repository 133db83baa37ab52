"""Packing, embedding, index writes, asynchronous batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from repolumen.functions.numbers import USD_PER_MILLION_TOKENS
from repolumen.operators import batches, corpus, embedding, index, numbering, packing
from repolumen.plans.ingest import ingest, plan_batches
from repolumen.registry import register
from repolumen.registry import inputs as I
from repolumen.session import scratch_path
from repolumen.sources import readers, schemas, writers

_UNIQUE = I.with_sql(I.READMES, I.keyed_sql("readmes"), I.UNIQUE)
_BUDGET = 40_000
MODEL = "text-embedding"

_PACKS = (
    "WITH RECURSIVE numbered AS (SELECT row_number() OVER (ORDER BY doc_id) AS id,"
    " length(text) AS n FROM documents), items AS (SELECT id, n,"
    " CAST(floor((id - 1) / 64) AS BIGINT) AS chunk FROM numbered), packs AS ("
    " SELECT chunk, id, n AS n_chars, n AS used, 0 AS pack FROM items WHERE id % 64 = 1"
    " UNION ALL SELECT i.chunk, i.id, i.n,"
    f" CASE WHEN p.used + i.n > {_BUDGET} THEN i.n ELSE p.used + i.n END,"
    f" p.pack + CASE WHEN p.used + i.n > {_BUDGET} THEN 1 ELSE 0 END"
    " FROM packs p JOIN items i ON i.id = p.id + 1 AND i.chunk = p.chunk) "
)

# Result lines by label: 3 fails with an error object, 4 has no response, 5 comes
# twice (the later, negated vector counts), 6 has no usage.
_LINES = """lines AS (
  SELECT vec_id, 0 AS turn, label, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL
  SELECT vec_id, 1, label, list_transform(embedding::DOUBLE[], lambda x: -x)
  FROM embeddings WHERE label = 5),
good AS (SELECT * FROM lines WHERE label NOT IN (3, 4)),
ledger AS (SELECT 'batch-' || label AS batch_id, 'v' || vec_id AS id,
                  'src' || (vec_id % 20) || '/' || vec_id AS repo_name, 'h' || vec_id AS content_hash
           FROM embeddings WHERE label <> 8)"""


def _pages_numbered(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(
        "doc_id", F.char_length("text").alias("n_chars")
    )
    return numbering.with_chunks(numbering.dense_ids(docs, "doc_id"), packing.CALL_ROWS)


def _result_lines(spark, sf_dir):
    """Result file lines made from the vectors, written and read back."""
    path = scratch_path(spark, "result-lines")
    vectors = I.vectors(spark, sf_dir)
    again = vectors.where("label = 5").withColumn("vector", F.transform("vector", lambda x: -x))
    turns = vectors.withColumn("turn", F.lit(0)).unionByName(again.withColumn("turn", F.lit(1)))
    data = F.array(F.struct(F.col("vector").alias("embedding")))
    usage = F.when(F.col("label") != 6, F.struct((F.col("id") + 1).alias("prompt_tokens")))
    failure = F.struct(
        F.concat(F.lit("failed "), F.repeat(F.lit("x"), 300)).alias("message"),
        F.lit(500).alias("code"),
    )
    head = (F.format_string("line-%d", "id").alias("id"), F.concat(F.lit("v"), "id").alias("custom_id"))
    line = (
        F.when(F.col("label") == 3, F.to_json(F.struct(*head, F.struct(failure.alias("error")).alias("response"))))
        .when(F.col("label") == 4, F.to_json(F.struct(*head)))
        .otherwise(F.to_json(F.struct(*head, F.struct(data.alias("data"), usage.alias("usage")).alias("response"))))
    )
    blank = F.when(F.col("label") == 0, F.lit("\n  ")).otherwise(F.lit(""))
    # Many files for every batch; names, then places in a file, are the order in which "last wins".
    batch = F.concat(F.lit("batch-"), F.col("label").cast("string"))
    rows = turns.select("turn", "id", batch.alias("batch_id"), F.concat(line, blank).alias("value"))
    ordered = rows.repartitionByRange(8, "turn", "id").sortWithinPartitions("batch_id", "turn", "id")
    ordered.select("value", "batch_id").write.partitionBy("batch_id").text(path)
    return readers.read_result_lines(spark, path)


def _results(spark, sf_dir):
    return batches.parse_results(_result_lines(spark, sf_dir))


def _ledger(spark, sf_dir):
    vec = F.col("vec_id").cast("string")
    return (
        I.table(spark, sf_dir, "embeddings")
        .where("label <> 8")
        .select(
            F.concat(F.lit("batch-"), F.col("label").cast("string")).alias("batch_id"),
            F.concat(F.lit("v"), vec).alias("id"),
            F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string"), F.lit("/"), vec).alias(
                "repo_name"
            ),
            F.concat(F.lit("h"), vec).alias("content_hash"),
        )
    )


def _statuses(spark, sf_dir):
    names = F.array(*map(F.lit, [
        "completed", "in_progress", "validating", "failed", "expired", "cancelled", "completed",
    ]))
    labels = I.table(spark, sf_dir, "embeddings").select("label").distinct()
    return labels.select(
        F.concat(F.lit("batch-"), F.col("label").cast("string")).alias("id"),
        F.get(names, F.col("label") % 7).alias("status"),
        F.when(F.col("label") % 7 == 0, "file").alias("output_file_id"),
    )


_STATUS_SQL = """statuses AS (SELECT DISTINCT 'batch-' || label AS batch_id,
  (['completed', 'in_progress', 'validating', 'failed', 'expired', 'cancelled', 'completed'])
    [label % 7 + 1] AS status, CASE WHEN label % 7 = 0 THEN 'file' END AS output_file_id
  FROM embeddings),
disposed AS (SELECT l.batch_id, l.items, s.status,
    CASE WHEN s.status = 'completed' AND output_file_id IS NOT NULL THEN 'download'
         WHEN s.status IN ('in_progress', 'validating') THEN 'poll' ELSE 'remove' END AS action
  FROM (SELECT batch_id, count(*) AS items FROM ledger GROUP BY batch_id) l
  LEFT JOIN statuses s USING (batch_id))"""


@register("w5_packs", _PACKS + "SELECT chunk, id, n_chars, pack FROM packs")
def packs(spark, sf_dir):
    """Greedy packs by characters inside chunks of 64."""
    return packing.assign_packs(_pages_numbered(spark, sf_dir), _BUDGET)


@register(
    "w4_batch_jobs",
    I.with_sql(I.READMES, I.keyed_sql("readmes"), I.UNIQUE, I.EXISTING, I.IN_FLIGHT)
    + """SELECT id, repo_name, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 50) AS BIGINT)
           AS chunk FROM uniq WHERE id NOT IN
           (SELECT id FROM existing UNION ALL SELECT id FROM in_flight)""",
)
def batch_jobs(spark, sf_dir):
    """New items cut into batch jobs."""
    planned = plan_batches(
        I.readmes(spark, sf_dir),
        I.ids_of_language(spark, sf_dir, "en"),
        I.ids_of_language(spark, sf_dir, "fr"),
        rows=50,
    )
    return planned.select("id", "repo_name", "chunk")


@register(
    "a9_cost_estimate",
    f"{_UNIQUE} SELECT count(*) AS items, CAST(round(sum(length(content)) / 4) AS BIGINT) AS tokens,"
    " round(round(sum(length(content)) / 4) / 1000000 * 0.01, 9) AS cost FROM uniq",
)
def estimate(spark, sf_dir):
    """A9, X22."""
    items = corpus.first_per_id(corpus.keyed_items(I.readmes(spark, sf_dir)))
    found = embedding.cost_estimate(items, USD_PER_MILLION_TOKENS["realtime"])
    return found.select("items", "tokens", F.round("cost", 9).alias("cost"))


@register(
    "f1_embed",
    f"{_UNIQUE} SELECT id, repo_name, array_to_string(list_transform({I.letters_sql('content')},"
    " lambda x: CAST(x AS BIGINT)), ',') AS letters FROM uniq",
)
def embed(spark, sf_dir):
    """Every unique text embedded in packed calls, two keys in turn."""
    items = corpus.first_per_id(corpus.keyed_items(I.readmes(spark, sf_dir)))
    embedder = I.letter_embedder(keys=("a", "b"))
    embedded = embedding.embed_column(items.select("id", "repo_name", "content"), embedder)
    letters = F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",")
    return embedded.select("id", "repo_name", letters.alias("letters"))


@register(
    "a10_usage",
    f"{_UNIQUE} SELECT count(*) AS items, CAST(sum(length(content)) AS BIGINT) AS tokens,"
    " round(sum(length(content)) / 1000000 * 0.01, 6) AS cost FROM uniq",
)
def usage(spark, sf_dir):
    """A10: tokens and cost of an embed run."""
    items = corpus.first_per_id(corpus.keyed_items(I.readmes(spark, sf_dir)))
    totals = embedding.usage_totals(
        embedding.embed_column(items.select("id", "content"), I.letter_embedder())
    )
    return totals.withColumn("cost", F.round("cost", 6))


@register(
    "m1_ingest_twice",
    f"{_UNIQUE} SELECT id, repo_name, content_hash FROM uniq",
)
def ingest_twice(spark, sf_dir):
    """M1, K5, K8: one language first, then everything, then everything again."""
    root = scratch_path(spark, "index")
    records, embedder = I.readmes(spark, sf_dir), I.letter_embedder()
    ingest(records, root, embedder)
    ingest(records, root, embedder)
    return index.read_index(spark, root).select("id", "repo_name", "content_hash")


@register(
    "k5_replace_points",
    """SELECT 'v' || vec_id AS id, CASE WHEN label < 5 THEN 'new' ELSE 'old' END AS repo_name,
         'h' || vec_id AS content_hash, round(CASE WHEN label < 5 THEN -1 ELSE 1 END *
         CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings""",
)
def replace(spark, sf_dir):
    """An index, then the same ids again with other vectors."""
    root = scratch_path(spark, "index")
    points = _points(spark, sf_dir, "old")
    index.append_points(spark, root, points, I.VECTOR_DIM)
    index.replace_points(spark, root, _turned(points.where("label < 5"), "new"), I.VECTOR_DIM)
    first = F.round(F.col("vector")[0].cast("double"), 6).alias("first")
    return index.read_index(spark, root).select("id", "repo_name", "content_hash", first)


def _points(spark, sf_dir, name):
    vec = F.col("id").cast("string")
    return I.vectors(spark, sf_dir).select(
        F.concat(F.lit("v"), vec).alias("id"),
        "vector",
        F.lit(name).alias("repo_name"),
        F.concat(F.lit("h"), vec).alias("content_hash"),
        "label",
    )


def _turned(points, name):
    opposite = F.transform("vector", lambda x: -x).alias("vector")
    return points.select("id", opposite, F.lit(name).alias("repo_name"), "content_hash")


@register(
    "k5_segments",
    """SELECT 'v' || vec_id AS id, CASE WHEN label = 9 THEN 'late' WHEN label < 2 THEN 'newest'
         WHEN label < 5 THEN 'new' ELSE 'old' END AS repo_name, 'h' || vec_id AS content_hash,
         round(CASE WHEN label < 5 OR label = 9 THEN -1 ELSE 1 END * CAST(embedding[1] AS DOUBLE), 6) AS first
       FROM embeddings""",
)
def segments(spark, sf_dir):
    """K5, K8: upserts over upserts, compacted and split into more buckets on the way."""
    root, dim = scratch_path(spark, "index"), I.VECTOR_DIM
    points = _points(spark, sf_dir, "old")
    index.ensure_index(spark, root, buckets=4)
    index.append_points(spark, root, points.where("label <> 7"), dim)
    index.replace_points(spark, root, _turned(points.where("label < 5"), "new"), dim)
    index.compact(spark, root, most_segments=1)
    index.replace_points(spark, root, _turned(points.where("label < 2"), "newest"), dim)
    index.append_points(spark, root, points, dim)
    rows = points.count()
    index.compact(spark, root, bucket_rows=max(1, rows // 7))
    index.replace_points(spark, root, _turned(points.where("label = 9"), "late"), dim)
    first = F.round(F.col("vector")[0].cast("double"), 6).alias("first")
    return index.read_index(spark, root).select("id", "repo_name", "content_hash", first)


@register(
    "m1_known_ids",
    "SELECT 'v' || vec_id AS id FROM embeddings WHERE vec_id % 2 = 0 AND label IN (3, 6)",
)
def known(spark, sf_dir):
    """M1: which ids of a batch the index holds, by the buckets they hit."""
    root = scratch_path(spark, "index")
    points = _points(spark, sf_dir, "r")
    even = F.substring("id", 2, 20).cast("long") % 2 == 0
    index.append_points(spark, root, points.where(even), I.VECTOR_DIM)
    return index.known_ids(spark, root, points.where("label in (3, 6)").select("id"))


@register(
    "a13_index_stats",
    f"""SELECT n AS repos, {I.compact_count_sql("n")} AS repos_text, n * 5 AS with_forks,
          {I.compact_count_sql("(n * 5)")} AS with_forks_text
        FROM (SELECT count(*) AS n FROM embeddings)""",
)
def stats(spark, sf_dir):
    """A13."""
    return index.index_stats(I.points(spark, sf_dir))


@register(
    "k6_request_lines",
    f"""{_UNIQUE} SELECT id AS custom_id, 'POST' AS method, '/v1/embeddings' AS url,
          '{MODEL}' AS model, content AS input, 26 AS dimensions FROM uniq""",
)
def requests(spark, sf_dir):
    """K6: request lines written, read back and decoded."""
    path = scratch_path(spark, "requests")
    items = corpus.first_per_id(corpus.keyed_items(I.readmes(spark, sf_dir)))
    writers.write_request_lines(batches.request_lines(items, MODEL, 26), path)
    schema = (
        "custom_id string, method string, url string,"
        " body struct<model:string,input:string,dimensions:int>"
    )
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    return rows.select("custom_id", "method", "url", "body.*")


@register(
    "s11_result_lines",
    f"""WITH {_LINES} SELECT 'v' || vec_id AS id, turn,
          CASE WHEN label IN (3, 4) OR label = 6 THEN 0 ELSE vec_id + 1 END AS tokens,
          CASE WHEN label NOT IN (3, 4) THEN round(v[1], 6) END AS first,
          CASE label WHEN 3 THEN substring('{{"error":{{"message":"failed ' || repeat('x', 300), 1, 200)
            WHEN 4 THEN '{{"id":"line-' || vec_id || '","custom_id":"v' || vec_id || '"}}' END AS error
        FROM lines""",
)
def parsed_lines(spark, sf_dir):
    """Result lines to vectors or error texts."""
    results = _results(spark, sf_dir)
    turn = F.when(F.row_number().over(_by_line()) > 1, 1).otherwise(0)
    return results.select(
        "id",
        turn.alias("turn"),
        "tokens",
        F.round(F.col("vector")[0].cast("double"), 6).alias("first"),
        "error",
    )


def _by_line():
    return Window.partitionBy("id").orderBy("line_no")


@register(
    "j6_points",
    f"""WITH {_LINES}, last AS (SELECT vec_id, arg_max(v, turn) AS v FROM good GROUP BY vec_id)
        SELECT l.id, l.repo_name, l.content_hash, round(v[1], 6) AS first
        FROM last JOIN ledger l ON l.id = 'v' || vec_id""",
)
def batch_points(spark, sf_dir):
    """Results of known items, the last line of an id wins."""
    points = batches.points_of(_results(spark, sf_dir), _ledger(spark, sf_dir))
    first = F.round(F.col("vector")[0].cast("double"), 6).alias("first")
    return points.select("id", "repo_name", "content_hash", first)


@register(
    "j11_failures",
    f"""WITH {_LINES} SELECT 'v' || vec_id AS id, coalesce(l.repo_name, 'v' || vec_id) AS repo
        FROM lines LEFT JOIN ledger l ON l.id = 'v' || vec_id WHERE label IN (3, 4)""",
)
def failed(spark, sf_dir):
    """J11."""
    return batches.failures(_results(spark, sf_dir), _ledger(spark, sf_dir)).select("id", "repo")


@register(
    "a10_batch_totals",
    f"""WITH {_LINES} SELECT count(*) AS lines, count(*) FILTER (label IN (3, 4)) AS failed,
          CAST(sum(CASE WHEN label IN (3, 4, 6) THEN 0 ELSE vec_id + 1 END) AS BIGINT) AS tokens,
          round(sum(CASE WHEN label IN (3, 4, 6) THEN 0 ELSE vec_id + 1 END) / 1000000 * 0.005, 9)
            AS cost FROM lines""",
)
def batch_totals(spark, sf_dir):
    """Tokens and cost of a batch."""
    totals = batches.result_totals(_results(spark, sf_dir))
    return totals.withColumn("cost", F.round("cost", 9))


@register(
    "a11_completeness",
    f"""WITH {_LINES} SELECT batch_id, items, upserted, round(upserted / items, 6) AS rate,
          upserted / items >= 0.99 OR items < 50 AS finished
        FROM (SELECT batch_id, count(*) AS items, count(g.id) AS upserted FROM ledger l
              LEFT JOIN (SELECT DISTINCT 'v' || vec_id AS id, 'batch-' || CASE WHEN label = 7
                AND vec_id % 2 = 0 THEN 9 ELSE label END AS answered FROM good) g
              ON l.id = g.id AND l.batch_id = g.answered GROUP BY batch_id)""",
)
def complete(spark, sf_dir):
    """Half of the items of one batch are answered in another one, which does not count."""
    even = F.substring("id", 2, 20).cast("long") % 2 == 0
    stray = (F.col("batch_id") == "batch-7") & even
    results = _results(spark, sf_dir)
    results = results.withColumn("batch_id", F.when(stray, "batch-9").otherwise(F.col("batch_id")))
    found = batches.completeness(_ledger(spark, sf_dir), results)
    return found.withColumn("rate", F.round("rate", 6))


@register("p17_dispositions", f"WITH {_LINES}, {_STATUS_SQL} SELECT * FROM disposed")
def disposition(spark, sf_dir):
    """What happens to each batch; the ledger is written and read back."""
    path = scratch_path(spark, "ledger")
    saved = _ledger(spark, sf_dir).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    writers.append_ledger(saved.select(*schemas.BATCH_ITEM.fieldNames()), path)
    return batches.dispositions(readers.read_batch_ledger(spark, path), _statuses(spark, sf_dir))


@register(
    "k9_open_ledger",
    f"""WITH {_LINES}, {_STATUS_SQL} SELECT batch_id, id, repo_name, content_hash FROM ledger
        WHERE batch_id IN (SELECT batch_id FROM disposed WHERE action <> 'remove')""",
)
def open_ledger(spark, sf_dir):
    """The ledger without removed batches."""
    ledger = _ledger(spark, sf_dir)
    removed = batches.dispositions(ledger, _statuses(spark, sf_dir)).where("action = 'remove'")
    return batches.open_ledger(ledger, removed)


@register(
    "a15_progress",
    """SELECT count(*) AS batches, CAST(sum(completed) AS BIGINT) AS completed
       FROM (SELECT user_id, arg_max(event_id, ts) AS completed FROM events GROUP BY user_id)""",
)
def progress_total(spark, sf_dir):
    """Polls of all batches, the latest of each counts."""
    polls = I.table(spark, sf_dir, "events").selectExpr(
        "user_id AS batch_id", "event_id AS completed", "ts"
    )
    return batches.progress_total(polls)


@register(
    "t8_response_order",
    """SELECT CAST(floor(vec_id / 64) AS BIGINT) AS call, true AS ordered, count(*) AS n,
         max(vec_id) AS first_id, min(vec_id) AS last_id FROM embeddings GROUP BY call""",
)
def response_order(spark, sf_dir):
    """Vectors of calls of 64 back in request order (here: falling vector id)."""
    one = F.struct(
        F.array(F.col("id").cast("float")).alias("embedding"), (-F.col("id")).alias("index")
    )
    calls = I.vectors(spark, sf_dir).select(F.floor(F.col("id") / 64).alias("call"), one.alias("d"))
    responses = calls.groupBy("call").agg(F.collect_list("d").alias("data"))
    ordered = batches.response_vectors(responses)
    ids = F.transform("vectors", lambda v: v[0].cast("long"))
    return ordered.select(
        "call",
        (ids == F.reverse(F.array_sort(ids))).alias("ordered"),
        F.size("vectors").cast("long").alias("n"),
        F.get(ids, F.lit(0)).alias("first_id"),
        F.element_at(ids, -1).alias("last_id"),
    )
