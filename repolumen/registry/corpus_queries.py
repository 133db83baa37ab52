"""Corpus: names, hashes, text rules, deduplication, warehouse export."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolumen.functions import hashing, numbers, text
from repolumen.operators import corpus, export, fetch
from repolumen.registry import register
from repolumen.registry import inputs as I
from repolumen.session import scratch_path
from repolumen.sources import readers, writers

_KEYED = I.with_sql(I.READMES, I.keyed_sql("readmes"))
_UNIQUE = I.with_sql(I.READMES, I.keyed_sql("readmes"), I.UNIQUE)
_PARSED = I.with_sql(I.STORED, I.PARSED)
_PARSED_ITEMS = I.with_sql(I.STORED, I.PARSED, I.keyed_sql("parsed"), I.EXISTING)
_EXPORT = I.with_sql(I.WAREHOUSE)
_EXPORT_BODY = """SELECT c.id AS content_hash, min(f.repo_name) AS repo_name,
         min(c.content) AS content, max(cm.seconds) AS last_commit
       FROM files f JOIN contents c ON f.id = c.id
       LEFT JOIN (SELECT unnest(repo_name) AS repo_name, max(seconds) AS seconds
                  FROM commits GROUP BY 1) cm ON f.repo_name = cm.repo_name
       WHERE lower(f.path) = 'readme.md' AND c.content IS NOT NULL AND c.binary = false
       GROUP BY c.id"""


@register("x1_content_sha1", "SELECT doc_id, sha1(text) AS content_hash FROM documents")
def content_sha1(spark, sf_dir):
    """X1."""
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", hashing.content_sha1(F.col("text")).alias("content_hash")
    )


@register(
    "x2_git_blob_sha1", f"SELECT doc_id, {I.BLOB_SQL.format('text')} AS blob_id FROM documents"
)
def git_blob(spark, sf_dir):
    """X2."""
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", hashing.git_blob_sha1(F.col("text")).alias("blob_id")
    )


@register(
    "x3_hash_to_uuid",
    f"SELECT doc_id, {I.UUID_SQL.format('h')} AS id FROM (SELECT doc_id, sha1(text) AS h FROM documents)",
)
def uuid(spark, sf_dir):
    """X3."""
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", hashing.hash_to_uuid(hashing.content_sha1(F.col("text"))).alias("id")
    )


@register(
    "x11_unicode_trim",
    f"""SELECT doc_id, trim(t, {I.TRIM_SQL}) AS trimmed, length(t) AS n FROM (
          SELECT doc_id, chr(65279) || chr(160) || chr(10) || text || chr(8195) || chr(13) || ' '
          AS t FROM documents)""",
)
def trim(spark, sf_dir):
    """Outer Unicode space around every text goes, inner space stays."""
    padded = F.concat(F.lit("﻿ \n"), F.col("text"), F.lit(" \r "))
    return I.table(spark, sf_dir, "documents").select(
        "doc_id",
        text.unicode_trim(padded).alias("trimmed"),
        F.char_length(padded).cast("long").alias("n"),
    )


@register(
    "p8_embed_text",
    f"{_KEYED} SELECT repo_name, content FROM keyed WHERE kind = 'candidate'",
)
def embed_text(spark, sf_dir):
    """Embeddable texts, trimmed and cut."""
    items = corpus.keyed_items(I.readmes(spark, sf_dir))
    return items.where(F.col("kind") == "candidate").select("repo_name", "content")


@register("p10_strict_names", f"{_PARSED} SELECT name, repo_name FROM parsed")
def strict_names(spark, sf_dir):
    """Strict rule; rejects have no repository."""
    parsed = corpus.parse_stored_names(I.stored(spark, sf_dir))
    return parsed.select("name", "repo_name")


@register(
    "p10_extended_names",
    _PARSED.replace("list_position(parts, 'default')", "list_position(parts, 'default'), list_position(parts, 'HEAD')")
    + """SELECT name, repo_name, parts[pos] AS branch,
           array_to_string(parts[pos + 1:], '_') AS filename FROM parsed""",
)
def extended_names(spark, sf_dir):
    """P10 with HEAD as a branch name."""
    parsed = corpus.parse_stored_names(I.stored(spark, sf_dir), text.EXTENDED_BRANCHES)
    return parsed.select("name", "repo_name", "branch", "filename")


@register(
    "p11_lenient_records",
    f"""{_PARSED} SELECT sha1(content) AS content_hash, parts[1] || '/' ||
          array_to_string(parts[2:coalesce(pos, len(parts) - 1) - 1], '_') AS repo_name, content
        FROM parsed""",
)
def lenient_records(spark, sf_dir):
    """Records of stored files, never rejecting a name."""
    return corpus.readme_records(I.stored(spark, sf_dir))


@register(
    "k3_jsonl_records",
    I.with_sql(I.READMES) + "SELECT sha1(content) AS content_hash, repo_name, content FROM readmes",
)
def jsonl_records(spark, sf_dir):
    """Raw, whole records as JSON lines and back."""
    path = scratch_path(spark, "records")
    records = I.readmes(spark, sf_dir).select(
        hashing.content_sha1(F.col("content")).alias("content_hash"), "repo_name", "content"
    )
    writers.write_readme_records(records, path)
    return readers.read_readme_records(spark, path)


@register(
    "w2_first_per_id", f"{_UNIQUE} SELECT id, repo_name, content, content_hash FROM uniq"
)
def first_per_id(spark, sf_dir):
    """One row per content, lowest repository name."""
    return corpus.first_per_id(corpus.keyed_items(I.readmes(spark, sf_dir)))


@register(
    "j3_new_items",
    I.with_sql(I.READMES, I.keyed_sql("readmes"), I.UNIQUE, I.EXISTING)
    + "SELECT id, repo_name, content, content_hash FROM uniq"
    " WHERE id NOT IN (SELECT id FROM existing)",
)
def new_items(spark, sf_dir):
    """Unique items that are not indexed."""
    return corpus.new_items(I.readmes(spark, sf_dir), I.ids_of_language(spark, sf_dir, "en"))


@register(
    "j5_remaining_items",
    I.with_sql(I.READMES, I.keyed_sql("readmes"), I.UNIQUE, I.EXISTING, I.IN_FLIGHT)
    + "SELECT id, repo_name FROM uniq WHERE id NOT IN"
    " (SELECT id FROM existing UNION ALL SELECT id FROM in_flight)",
)
def remaining(spark, sf_dir):
    """Neither indexed nor in flight."""
    return corpus.new_items(
        I.readmes(spark, sf_dir),
        I.ids_of_language(spark, sf_dir, "en"),
        I.ids_of_language(spark, sf_dir, "fr"),
    ).select("id", "repo_name")


@register(
    "a5_load_report",
    _PARSED_ITEMS
    + """SELECT count(DISTINCT k.id) FILTER (e.id IS NULL) AS new,
           count(*) FILTER (e.id IS NOT NULL) AS existing,
           count(k.id) FILTER (e.id IS NULL) - count(DISTINCT k.id) FILTER (e.id IS NULL)
             AS duplicates,
           count(*) FILTER (kind = 'empty') AS empty,
           count(*) FILTER (kind = 'unparsable') AS unparsable
         FROM keyed k LEFT JOIN existing e ON k.id = e.id""",
)
def load_report(spark, sf_dir):
    """A5: load counters, with rejected names counted too."""
    parsed = corpus.parse_stored_names(I.stored(spark, sf_dir))
    return corpus.load_report(parsed, I.ids_of_language(spark, sf_dir, "en"))


@register(
    "p12_warehouse_filter",
    f"""{_EXPORT} SELECT f.id, f.repo_name, f.path FROM files f
        WHERE lower(path) = 'readme.md' AND id IN
          (SELECT c.id FROM contents c WHERE c.content IS NOT NULL AND c.binary = false)""",
)
def warehouse_filter(spark, sf_dir):
    """Root READMEs with text content."""
    texts = export.text_contents(I.contents(spark, sf_dir)).select("id")
    return export.root_readmes(I.files(spark, sf_dir)).join(texts, "id", "left_semi")


@register(
    "j2_last_commits",
    f"""{_EXPORT} SELECT r AS repo_name, max(seconds) AS last_commit
        FROM (SELECT unnest(repo_name) AS r, seconds FROM commits) GROUP BY r""",
)
def last_commits(spark, sf_dir):
    """Newest commit of every repository a commit lists."""
    return export.last_commits(I.commits(spark, sf_dir))


@register("a3_export", f"{_EXPORT}{_EXPORT_BODY} ORDER BY last_commit DESC NULLS LAST, content_hash")
def export_readmes(spark, sf_dir):
    """The export as a whole."""
    return export.export_readmes(
        I.files(spark, sf_dir), I.contents(spark, sf_dir), I.commits(spark, sf_dir)
    )


@register("k3_dated_jsonl", f"{_EXPORT}{_EXPORT_BODY}")
def dated_jsonl(spark, sf_dir):
    """K3: export written as JSON lines with null dates kept, read back."""
    path = scratch_path(spark, "export")
    writers.write_readme_records(export_readmes(spark, sf_dir), path)
    return readers.read_readme_records(spark, path, dated=True)


@register(
    "x12_display_numbers",
    f"""SELECT event_id, {I.fixed_sql("value", 2)} AS two,
          {I.fixed_sql("(value / 100 * 100)", 0)} || '%' AS percent,
          {I.compact_sql("event_id")} AS compact FROM events""",
)
def display(spark, sf_dir):
    """Fixed digits, percent and compact numbers."""
    value = F.col("value")
    return I.table(spark, sf_dir, "events").select(
        "event_id",
        numbers.fixed_text(value, 2).alias("two"),
        numbers.percent_text(value / 100).alias("percent"),
        numbers.compact_number(F.col("event_id")).alias("compact"),
    )


@register(
    "x13_compact_count",
    f"""SELECT o_orderkey, {I.compact_count_sql("n")} AS compact
        FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 7) AS BIGINT) AS n FROM orders)""",
)
def compact_counts(spark, sf_dir):
    """Counts in thousands and millions."""
    n = F.floor(F.col("o_totalprice") * 7).cast("long")
    return I.table(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.compact_count(n).alias("compact")
    )


@register(
    "t7_result_limit",
    """SELECT event_id, least(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 10), 50)
         AS k FROM events""",
)
def limits(spark, sf_dir):
    """Requested limit with default and cap."""
    return I.table(spark, sf_dir, "events").select(
        "event_id", numbers.result_limit(F.get_json_object("props", "$.k")).alias("k")
    )


@register(
    "a8_stored_formats",
    f"""{_PARSED} SELECT parts[pos] AS branch, array_to_string(parts[pos + 1:], '_') AS filename,
          count(*) AS n FROM parsed WHERE pos IS NOT NULL GROUP BY ALL""",
)
def stored_formats(spark, sf_dir):
    """A8 over stored names."""
    parsed = corpus.parse_stored_names(I.stored(spark, sf_dir))
    counts = fetch.format_counts(parsed)
    return counts.where(F.col("scope") == "branch_file").drop("scope")
