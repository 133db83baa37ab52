"""Corpus search on Spark: crawl lists, README corpus, embeddings, vector search."""

__version__ = "0.1.0"
