"""Searches: exact, approximate, by text, with content and repository details."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import functions as F

from repolumen.functions import vectors as V
from repolumen.functions.numbers import MAX_LIMIT
from repolumen.operators import cells, hits
from repolumen.operators.corpus import first_per_id, keyed_items
from repolumen.operators.embedding import embed_column
from repolumen.operators.scoring import exact_top_k, top_k_for_one
from repolumen.plans.search import answerable, search, search_hypothetical
from repolumen.registry import register
from repolumen.registry import inputs as I

_COS = (
    "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0}))"
    " * sqrt(list_dot_product({1}, {1})))"
)
_HITS = f"""scored AS (
  SELECT q.id AS qid, p.id, p.repo_name, {_COS.format("q.vector", "p.vector")} AS score
  FROM points q, points p),
hits AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10)"""
_SEARCH = I.with_sql(I.POINTS, _HITS)

# Text search: the benchmark passages ask, the unique documents answer.
_TEXT = f"""{I.READMES}, {I.keyed_sql("readmes")}, {I.UNIQUE},
idx AS MATERIALIZED (SELECT id, repo_name, {I.letters_sql("content")} AS vector FROM uniq),
asked AS MATERIALIZED (SELECT item_id AS qid, {{letters}} AS vector, {{text}} AS doc
  FROM benchmark WHERE length(trim(text)) > 0),
scored AS (
  SELECT qid, i.id, i.repo_name,
         CASE WHEN list_dot_product(i.vector, i.vector) = 0 THEN 0
              ELSE {_COS.format("q.vector", "i.vector")} END AS score
  FROM asked q, idx i),
hits AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10)"""
_TEXT_SEARCH = "WITH " + _TEXT.format(letters=I.letters_sql("text"), text="text")
# The first user turn of a conversation asks, the assistant's first answer is the document written for it.
_TALKS = f"""talks AS (SELECT conv_id AS qid, arg_min(text, turn) FILTER (role = 'user') AS query,
    arg_min(text, turn) FILTER (role = 'assistant') AS doc FROM conversations GROUP BY conv_id),
asked AS MATERIALIZED (SELECT qid, doc, {I.letters_sql("doc")} AS vector FROM talks
  WHERE length(trim(query)) > 0 AND doc IS NOT NULL)"""
_HYDE_SEARCH = "WITH " + re.sub(r"asked AS MATERIALIZED \(.*?> 0\)", lambda _: _TALKS, _TEXT, flags=re.S)
_CONTENT = """best AS (SELECT repo_name, content FROM readmes
  WHERE branch IN ('HEAD', 'master', 'main') AND filename = 'README.md')"""
_INFO = """info AS (SELECT source || '/' || doc_id AS repo_name, lang AS language,
    n_chars * 3 AS stars, n_chars AS forks, source AS description,
    TIMESTAMP '2024-01-31' - to_hours(CAST(doc_id % 48 AS INT)) AS fetched_at FROM documents)"""


def _scored(found):
    return found.withColumn("score", F.round("score", 6))


def _nearest(spark, sf_dir, k=10):
    return exact_top_k(
        I.vector_queries(spark, sf_dir, k), I.points(spark, sf_dir), I.VECTOR_DIM, ("repo_name",)
    )


def _text_index(spark, sf_dir):
    items = first_per_id(keyed_items(I.readmes(spark, sf_dir)))
    return embed_column(items.select("id", "repo_name", "content"), I.letter_embedder()).select(
        "id", "repo_name", "vector"
    )


def _text_queries(spark, sf_dir):
    return I.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query")
    )


def nearest_with_content(spark, sf_dir):
    """The flagship: all vectors ask for their ten nearest, content attached."""
    found = _nearest(spark, sf_dir)
    docs = I.readmes(spark, sf_dir)
    bound = I.vectors(spark, sf_dir).count() * MAX_LIMIT
    with_text = hits.attach_content(found, docs, bound)
    return with_text.select("qid", "rank", "id", "repo_name", F.round("score", 6).alias("score"), "content")


@register(
    "q1_exact_search",
    f"{_SEARCH} SELECT qid, rank, id, repo_name, round(score, 6) AS score FROM hits",
)
def exact(spark, sf_dir):
    """Exact cosine top-10 for every vector of the index."""
    return _scored(_nearest(spark, sf_dir))


@register(
    "q1_limit_per_query",
    f"""WITH {I.POINTS}, {_HITS.replace("rank <= 10", "rank <= CASE qid % 3 WHEN 0 THEN 5 WHEN 1 THEN 60 ELSE 120 END")}
        SELECT qid, rank, id, round(score, 6) AS score FROM hits""",
)
def limit_per_query(spark, sf_dir):
    """Every query has its own number of results; tasks of the grid take the index in small parts."""
    wanted = F.element_at(F.array(*map(F.lit, (5, 60, 120))), (F.col("qid") % 3 + 1).cast("int"))
    queries = I.vector_queries(spark, sf_dir, 1).withColumn("k", wanted.cast("long"))
    found = exact_top_k(queries, I.points(spark, sf_dir), I.VECTOR_DIM, part_bytes=8 * I.VECTOR_DIM * 100)
    return _scored(found).select("qid", "rank", "id", "score")


@register(
    "q2_search_with_content",
    f"WITH {I.POINTS}, {_HITS}, {I.READMES}, {_CONTENT} SELECT qid, rank, id, h.repo_name,"
    " round(score, 6) AS score, content FROM hits h LEFT JOIN best USING (repo_name)",
)
def with_content(spark, sf_dir):
    """Exact search with the content of each hit."""
    return nearest_with_content(spark, sf_dir)


@register(
    "j7_content_by_branch",
    f"WITH {I.READMES}, {_CONTENT} SELECT r.repo_name, b.content FROM readmes r"
    " LEFT JOIN best b USING (repo_name)",
)
def content_by_branch(spark, sf_dir):
    """Content of every repository, from the branches search knows."""
    docs = I.readmes(spark, sf_dir)
    return hits.attach_content(docs.select("repo_name"), docs)


@register(
    "j7_content_by_hash",
    f"WITH {I.READMES}, {I.keyed_sql('readmes')} SELECT k.repo_name, k.content_hash, r.content"
    " FROM keyed k JOIN readmes r ON r.repo_name = k.repo_name",
)
def content_by_hash(spark, sf_dir):
    """J7 in hash mode: the very text that was embedded."""
    docs = I.readmes(spark, sf_dir)
    keyed = keyed_items(docs).select("repo_name", "content_hash")
    corpus = docs.select(F.sha1(F.encode("content", "UTF-8")).alias("content_hash"), "content")
    return hits.attach_content_by_hash(keyed, corpus)


@register(
    "t5_single_query",
    f"WITH {I.POINTS} SELECT p.id, p.repo_name,"
    f" round({_COS.format('q.vector', 'p.vector')}, 6) AS score"
    " FROM points p, (SELECT vector FROM points WHERE id = 0) q"
    f" ORDER BY {_COS.format('q.vector', 'p.vector')} DESC, p.id LIMIT 10",
)
def single(spark, sf_dir):
    """One query as a sorted limit over expressions."""
    points = I.points(spark, sf_dir)
    vector = points.where("id = 0").select("vector").head()["vector"]
    return _scored(top_k_for_one(points, vector, 10, ("repo_name",)))


@register(
    "x15_cosine",
    """SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
         AS cosine, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6)
         AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosines(spark, sf_dir):
    """Each vector and the next one."""
    a = I.vectors(spark, sf_dir).select("id", "vector")
    b = a.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return a.join(b, "id").select(
        "id",
        F.round(V.cosine(F.col("vector"), F.col("other")), 6).alias("cosine"),
        F.round(V.l2_norm(F.col("vector")), 6).alias("norm"),
    )


@register(
    "j10_provider_agreement",
    """WITH b AS (SELECT vec_id, label, embedding::DOUBLE[] AS a,
         list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN label = 0 THEN x * 2
           ELSE x + label * i / 64.0 / 200 END) AS v FROM embeddings)
       SELECT vec_id AS id, round(list_cosine_similarity(a, v), 6) AS cosine,
         round(sqrt(list_dot_product(a, a)), 6) AS left_norm,
         round(sqrt(list_dot_product(v, v)), 6) AS right_norm,
         list_cosine_similarity(a, v) > 0.9999 AS agrees FROM b""",
)
def agreement(spark, sf_dir):
    """Two vector sets of the same texts; scaled ones agree, shifted ones less."""
    left = I.vectors(spark, sf_dir)
    shifted = F.transform(
        F.col("vector").cast("array<double>"),
        lambda x, i: F.when(F.col("label") == 0, x * 2).otherwise(
            x + F.col("label") * (i + 1) / 64.0 / 200
        ),
    )
    right = left.select("id", shifted.alias("vector"))
    found = hits.compare_vectors(left.select("id", "vector"), right)
    return found.select(
        "id",
        *[F.round(c, 6).alias(c) for c in ("cosine", "left_norm", "right_norm")],
        "agrees",
    )


@register(
    "f2_text_search",
    f"{_TEXT_SEARCH} SELECT qid, rank, id, repo_name, round(score, 6) AS score FROM hits",
)
def text_search(spark, sf_dir):
    """Passages embedded and searched among all documents."""
    found = search(_text_queries(spark, sf_dir), _text_index(spark, sf_dir), I.letter_embedder())
    return _scored(found)


@register(
    "q3_hypothetical_search",
    f"""{_HYDE_SEARCH}, {_CONTENT} SELECT h.qid, rank, id, h.repo_name, round(score, 6) AS score,
          doc AS hypothetical_doc, content FROM hits h JOIN asked USING (qid)
          LEFT JOIN best USING (repo_name)""",
)
def hypothetical(spark, sf_dir):
    """Search by the answers of conversations, content attached."""
    turns = I.table(spark, sf_dir, "conversations")
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    talks = turns.groupBy(F.col("conv_id").alias("qid")).agg(
        first("user").alias("query"), first("assistant").alias("hypothetical_doc")
    )
    found = search_hypothetical(
        talks.select("qid", "query"),
        _text_index(spark, sf_dir),
        talks.select("qid", "hypothetical_doc"),
        I.letter_embedder(),
        I.readmes(spark, sf_dir),
    )
    return _scored(found).drop("query")


@register(
    "q4_all_cells",
    f"{_SEARCH} SELECT qid, rank, id, repo_name, round(score, 6) AS score FROM hits",
)
def all_cells(spark, sf_dir):
    """Q4 probing every cell: equal to exact search."""
    index = I.points(spark, sf_dir)
    centers = cells.fit_centers(index, 8)
    found = cells.cell_top_k(
        I.vector_queries(spark, sf_dir), cells.with_cells(index, centers), centers, 8, ("repo_name",)
    )
    return _scored(found)


_PROBES = 8
_LABEL_CELLS = f"""units AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[],
    lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
sums AS (SELECT label, pos, sum(x) AS x FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM units)
  GROUP BY label, pos),
centers AS MATERIALIZED (SELECT label, list(x ORDER BY pos) AS c FROM sums GROUP BY label),
ranked AS MATERIALIZED (SELECT id, centers.label AS cell, row_number() OVER (PARTITION BY id
    ORDER BY list_dot_product(u, c) / sqrt(list_dot_product(c, c)) DESC, centers.label) AS place FROM units, centers),
best AS MATERIALIZED (SELECT q.id AS qid, p.id, row_number() OVER (PARTITION BY q.id
    ORDER BY list_dot_product(q.u, p.u) DESC, p.id) AS rank FROM units q, units p),
found AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM best
  JOIN (SELECT id AS pid, cell AS own FROM ranked WHERE place = 1) o ON o.pid = best.id
  WHERE EXISTS (SELECT 1 FROM ranked r WHERE r.id = best.qid AND r.cell = own AND r.place <= {_PROBES}))"""


@register(
    "q4_recall",
    f"""WITH {_LABEL_CELLS}
        SELECT count(*) AS exact_hits, count(f.id) AS found_hits, count(f.id) / count(*) AS recall
        FROM (SELECT qid, id FROM best WHERE rank <= 10) e
        LEFT JOIN (SELECT qid, id FROM found WHERE place <= 10) f ON e.qid = f.qid AND e.id = f.id""",
)
def ann_recall(spark, sf_dir):
    """Q4: recall of the nearest cells around the means of the given labels against exact search."""
    index = I.points(spark, sf_dir)
    labels = I.vectors(spark, sf_dir).select("id", F.col("label").alias("cell"))
    centers = cells.centers_of(index.join(labels, "id"))
    found = cells.cell_top_k(
        I.vector_queries(spark, sf_dir), cells.with_cells(index, centers), centers, _PROBES
    )
    return cells.recall(found, _nearest(spark, sf_dir))


@register(
    "q5_ranked_table",
    f"WITH {I.POINTS}, {_HITS}, {I.READMES}, {_CONTENT} SELECT qid, rank, h.repo_name AS repo,"
    f" {I.fixed_sql('score', 2)} AS score, content FROM hits h LEFT JOIN best USING (repo_name)",
)
def ranked(spark, sf_dir):
    """Q5: the result table users see."""
    found = _nearest(spark, sf_dir)
    bound = I.vectors(spark, sf_dir).count() * MAX_LIMIT
    return hits.ranked_table(hits.attach_content(found, I.readmes(spark, sf_dir), bound))


@register(
    "p18_shaped_hits",
    f"""{_SEARCH} SELECT qid, rank, round(score, 6) AS score, repo_name AS repo,
          'https://github.com/' || repo_name AS url, {I.fixed_sql('(score * 100)', 0)} || '%' AS percent
        FROM hits""",
)
def shaped(spark, sf_dir):
    """Repository page and percentage of each hit."""
    found = _nearest(spark, sf_dir)
    return _scored(hits.shape_hits(found))


@register(
    "j8_repo_info",
    f"""WITH {I.POINTS}, {_HITS}, {_INFO},
        fresh AS (SELECT * FROM info WHERE fetched_at > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR)
        SELECT qid, rank, h.repo_name, description, stars, language, forks,
          {I.compact_sql("stars")} AS stars_text, {I.compact_sql("forks")} AS forks_text
        FROM hits h LEFT JOIN fresh USING (repo_name)""",
)
def repo_details(spark, sf_dir):
    """Repository details younger than a day."""
    found = _nearest(spark, sf_dir).select("qid", "rank", "repo_name")
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    return hits.attach_info(found, _repo_info(spark, sf_dir), as_of)


def _repo_info(spark, sf_dir):
    hours = F.make_dt_interval(F.lit(0), (F.col("doc_id") % 48).cast("int"))
    return I.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("repo_name"),
        F.col("source").alias("description"),
        (F.col("n_chars") * 3).alias("stars"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("forks"),
        (F.lit("2024-01-31").cast("timestamp_ntz") - hours).alias("fetched_at"),
    )


@register(
    "m4_fresh_info",
    f"""WITH {_INFO} SELECT repo_name, fetched_at FROM info
        WHERE fetched_at > TIMESTAMP '2024-01-31' - INTERVAL 1 HOUR""",
)
def fresh(spark, sf_dir):
    """M4 with the one-hour lifetime of counts."""
    info = hits.fresh_info(
        _repo_info(spark, sf_dir), F.lit("2024-01-31").cast("timestamp_ntz"), timedelta(hours=1)
    )
    return info.select("repo_name", "fetched_at")


@register(
    "t6_result_page",
    f"{_SEARCH} SELECT qid, rank, id FROM hits WHERE rank > 5 AND rank <= 10",
)
def page(spark, sf_dir):
    """The second page of five."""
    return hits.result_page(_nearest(spark, sf_dir), page=1, size=5).select("qid", "rank", "id")


@register(
    "t6_has_more",
    f"{_SEARCH} SELECT qid, count(*) AS found, count(*) = 10 AS has_more FROM hits GROUP BY qid",
)
def more(spark, sf_dir):
    """Another page may exist when the limit was reached."""
    return hits.has_more(_nearest(spark, sf_dir), 10)


@register(
    "p19_answerable",
    f"""SELECT doc_id AS qid, text AS query, 10 AS k FROM documents
        WHERE length(trim(text, {I.TRIM_SQL})) > 0""",
)
def not_blank(spark, sf_dir):
    """Blank queries have no results."""
    docs = I.table(spark, sf_dir, "documents")
    return answerable(docs.select(F.col("doc_id").alias("qid"), F.col("text").alias("query")))
