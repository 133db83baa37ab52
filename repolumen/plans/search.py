"""Searches over the index, for a table of queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.functions.numbers import DEFAULT_LIMIT, requested_limit
from repolumen.functions.text import unicode_trim
from repolumen.operators.embedding import Embedder, embed_column, generate_column
from repolumen.operators.hits import attach_content
from repolumen.operators.scoring import exact_top_k
from repolumen.session import cut_lineage


def answerable(queries: DataFrame, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Queries (``qid, query`` and optionally ``limit``) that are not missing or blank,
    with their number of results ``k``."""
    text = F.col("limit").cast("string") if "limit" in queries.columns else F.lit(None).cast("string")
    return queries.where(F.length(unicode_trim(F.col("query"))) > 0).select(
        F.col("qid").cast("long").alias("qid"),
        "query",
        requested_limit(text, default_limit).cast("long").alias("k"),
    )


def embed_queries(queries: DataFrame, embedder: Embedder, text_col: str = "query") -> DataFrame:
    """One vector per query (``qid, k, vector``)."""
    embedded = embed_column(queries.select("qid", "k", text_col), embedder, text_col)
    return embedded.select("qid", "k", "vector")


def search(
    queries: DataFrame,
    index: DataFrame,
    embedder: Embedder,
    readmes: DataFrame | None = None,
    default_limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Top repositories per query; with ``readmes`` their content is attached."""
    asked = answerable(queries, default_limit)
    return _search(asked, embed_queries(asked, embedder), index, embedder.dimension, readmes)


def search_hypothetical(
    queries: DataFrame,
    index: DataFrame,
    generated: DataFrame | Callable[[], Callable[[str], str]],
    embedder: Embedder,
    readmes: DataFrame | None = None,
    default_limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Search with the vector of a document written for the query; returns it too.

    ``generated`` is a table of documents (``qid, hypothetical_doc``) written before, or
    makes a generator, which is called for every query. Queries without a document
    have no results.
    """
    asked = answerable(queries, default_limit)
    if isinstance(generated, DataFrame):
        documents = generated.where("hypothetical_doc is not null").select("qid", "hypothetical_doc")
        written = asked.join(documents, "qid")
    else:
        written = generate_column(asked, generated, "query", "hypothetical_doc")
    written = cut_lineage(written, "hypothetical")
    vectors = embed_queries(written, embedder, "hypothetical_doc")
    hits = _search(written, vectors, index, embedder.dimension, readmes)
    return hits.join(written.select("qid", "query", "hypothetical_doc"), "qid")


def _search(
    asked: DataFrame,
    vectors: DataFrame,
    index: DataFrame,
    dimension: int,
    readmes: DataFrame | None,
) -> DataFrame:
    """Exact hits; the limits asked for bound them together."""
    wanted = F.greatest("k", F.lit(0))
    size = asked.agg(F.count("*").alias("n"), F.sum(wanted).alias("hits"), F.max(wanted).alias("k")).first()
    hits = exact_top_k(vectors, index, dimension, ("repo_name",), n_queries=size["n"], max_k=size["k"] or 0)
    if readmes is None:
        return hits
    return attach_content(hits, readmes, max_hits=size["hits"] or 0)
