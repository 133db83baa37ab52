"""Allow and block rules for URLs by host suffix and path prefix, as a hash-prefix join.

Every URL is expanded into the host-suffix and path-prefix expressions whose lengths
occur in the rules. An expression's digest is joined with the rules' digests by its
first eight hex digits, then confirmed in full. The longest rule that is left decides.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_FIELDS = "rule string, action string"
#: Rules are broadcast up to this number (about 200 bytes each), else joined by a shuffle.
BROADCAST_RULES = 100_000
#: Hex digits of a digest that are joined on.
PREFIX = 8

_AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER_SCHEME, 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(found, upper, lower)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER_SCHEME, 2)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_FIELDS)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule is a host, a slash and a path prefix. It fits its host and all subdomains
    if the URL's path starts with the rule's. The longest fitting rule wins; of one
    rule given with several actions, ``block`` does. No rule: ``rule`` is null and
    the verdict ``otherwise``. A null URL, or one without ``://``, has empty host and
    path. Rules that are null or have no slash or no host fit nothing. Columns of
    these names in ``pages`` are replaced; repeated rows stay.
    """
    slash = F.locate("/", "rule")
    known = (
        rules.where(slash > 1)
        .groupBy("rule")
        .agg(F.max(F.when(F.col("action") == "block", 1).otherwise(0)).alias("blocks"))
        .select(
            F.lower(F.substring_index("rule", "/", 1)).alias("rule_host"),
            F.expr("substr(rule, locate('/', rule))").alias("rule_path"),
            "rule",
            F.when(F.col("blocks") == 1, "block").otherwise("allow").alias("action"),
        )
        .withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("rule_digest", 1, PREFIX))
    )
    # One entry for each pair of lengths: bounded by the longest host and path, not by the rules.
    lengths = known.select(F.length("rule_host").alias("h"), F.length("rule_path").alias("p")).distinct()
    shapes = [(row["h"], row["p"]) for row in lengths.collect()]
    spare = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*[F.col(f"`{c}`") for c in spare], url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})

    fitting = F.filter(
        F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in shapes]),
        lambda s: (s["p"] <= F.length("path"))
        & (
            (s["h"] == F.length("host"))
            | ((s["h"] < F.length("host")) & (F.substring("host", F.length("host") - s["h"], F.lit(1)) == "."))
        ),
    )
    expressions = (
        judged.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(fitting).alias("s"))
        .select(
            F.col("host").alias("of_host"),
            F.col("path").alias("of_path"),
            _digest(
                F.substring("host", F.length("host") - F.col("s.h") + 1, F.col("s.h")),
                F.substring("path", F.lit(1), F.col("s.p")),
            ).alias("digest"),
        )
        .withColumn("short", F.substring("digest", 1, PREFIX))
    )
    small = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    hits = expressions.join(F.broadcast(known) if small else known, "short").where(
        F.col("digest") == F.col("rule_digest")
    )
    best = hits.groupBy("of_host", "of_path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best")
    )
    same = (F.col("page.host") == F.col("found.of_host")) & (F.col("page.path") == F.col("found.of_path"))
    return judged.alias("page").join(best.alias("found"), same, "left").select(
        *[F.col(f"page.`{c}`") for c in spare],
        "page.host",
        "page.path",
        F.col("found.best.rule").alias("rule"),
        F.coalesce("found.best.action", F.lit(otherwise)).alias("verdict"),
    )
