"""Training corpus from raw documents: filter, deduplicate, decontaminate, mask, pack.

Each stage takes (spark, docs, sf_dir) and works on what the stage before kept. All but
the last return the columns of ``documents``; stages that change a text bring
``n_chars`` up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolumen.llm.decontaminate import find_leaks
from repolumen.llm.near_copies import BROADCAST_IDS, drop_near_copies
from repolumen.llm.power_packing import cut_documents, in_buckets
from repolumen.llm.quality_classifier import train, with_score
from repolumen.llm.queries import tokenizer_path
from repolumen.llm.secret_scan import mask_secrets
from repolumen.llm.simhash import few
from repolumen.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all usable labels, accepts; others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = train(docs, labels)
    return _documents(with_score(docs, weights).where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, that of the smallest id."""
    return drop_near_copies(_documents(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. The text decides, whatever id a row has or shares."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.select(F.sha2("text", 256).alias("doc_id"), "text")
    leaking = find_leaks(texts, items).select(F.col("doc_id").alias("leaking_text")).distinct()
    leaking = cut_lineage(leaking, "leaking")
    side = F.broadcast(leaking) if few(leaking, BROADCAST_IDS) else leaking
    return _documents(docs.join(side, F.sha2(docs["text"], 256) == side["leaking_text"], "left_anti"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return _documents(mask_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in pieces of binary length, equal lengths together."""
    return in_buckets(cut_documents(docs, tokenizer_path()), "doc_id", "start")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", hide_secrets),
    ("packing", pack),
]

#: Classifier, SimHash and embedding cannot be said in SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
