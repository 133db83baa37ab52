"""The registered queries of the operators over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolumen.llm.decontaminate import find_leaks
from repolumen.llm.exact_dedup import exact_duplicates
from repolumen.llm.power_packing import cut_documents, in_buckets
from repolumen.llm.quality_classifier import train, with_score
from repolumen.llm.quality_rules import with_quality
from repolumen.llm.secret_scan import BASE, KINDS, span_list, with_secrets
from repolumen.llm.sharding import balanced_shards
from repolumen.llm.simhash import simhash_components
from repolumen.llm.spelling import spelling_variants
from repolumen.llm.templates import extract_main_text
from repolumen.llm.token_counts import with_token_counts
from repolumen.llm.url_rules import judge_urls, rule_table
from repolumen.llm.whitening import whiten

TOKENIZER = "word_bpe_49k.json"

#: Host and path prefix, and what to do.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The vocabulary file where the public tokenizers are installed, alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components: 3-word shingles, links of at most 2 bits."""
    found = simhash_components(_table(spark, sf_dir, "documents"), shingle=3, distance=2)
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, with its edit distance and place."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, compression figures and the verdict of every document."""
    return with_quality(_table(spark, sf_dir, "documents"), ["doc_id"])


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's template."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages),
rules(rule, action) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'),
  ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
cut AS (SELECT *, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
found AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM (SELECT DISTINCT host, path FROM split)
  JOIN cut ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, split.host, split.path, rule, coalesce(action, 'allow') AS verdict
FROM split LEFT JOIN found ON split.host = found.host AND split.path = found.path
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, and all spans."""
    found = with_secrets(_table(spark, sf_dir, "documents"), ["doc_id"])

    def count(kind: int):
        # A function of one argument: a second one would get the place in the list.
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{name}": count(kind) for kind, name in enumerate(KINDS[:BASE])}
    return found.select(
        "doc_id",
        *[column.alias(name) for name, column in counts.items()],
        F.sha2(span_list("secrets", base_only=True), 256).alias("base_sha256"),
        span_list("secrets").alias("spans"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary pieces of all documents in buckets of equal length."""
    columns = ("start", "length", "ids_crc32", "doc_tokens")
    pieces = cut_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), columns)
    return in_buckets(pieces, "doc_id", "start", "ids_crc32")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = with_score(docs, weights, threshold=0.3, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = _table(spark, sf_dir, "documents")
    return with_token_counts(docs, tokenizer_path(), limit=2048, keep=["doc_id"])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents; counts differ by one at most, equal texts together."""
    placed = balanced_shards(_table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, by equal normalised texts."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of all documents."""
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector along the 16 leading components."""
    return whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    q.__name__: q
    for q in (
        op1_simhash,
        op2_decontaminate,
        op3_quality_rules,
        op4_html_extract,
        op5_url_filter,
        op6_secrets,
        op7_packing,
        op8_quality_classifier,
        op9_token_counts,
        op10_sharding,
        op11_exact_dedup,
        op12_spelling_variants,
        op13_whitening,
        pipeline,
    )
}
ORACLES = {"op5_url_filter": OP5_SQL, "op11_exact_dedup": OP11_SQL}
