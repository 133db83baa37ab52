"""Main text of pages by equivalence classes of their host's template.

Tokens of a page are its container paths and its text blocks. Over the pages of a
host every token has an occurrence vector; tokens that share one form a class. A class
of several tokens that occurs on most pages is part of the template: classes whose
paths lie inside another's are nested in it, and their text blocks are constant
wording. What the template leaves open are slots. Slots in the article are
extracted; where pages have no article element, those slots are that hold the host's
running text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolumen.llm.page_blocks import page_blocks
from repolumen.llm.texts import exploded_text_rows, with_text_columns
from repolumen.session import cut_lineage

#: Part of a host's pages on which a class of the template occurs, and on which wording is constant.
FREQUENT, CONSTANT = 0.5, 0.8
#: Tokens of a valid class, and distinct pages that constant wording takes.
LARGE, LEAST_PAGES = 2, 10
#: Part of a slot's text that may be links, and of the fullest slot's text that a further slot holds.
LINKS, SHARE = 0.5, 0.2
#: Templates are broadcast up to this number of hosts (about 1 kB each).
BROADCAST_HOSTS = 20_000

TOKENS = "host string, page long, token long, occurs long, path long, in_main boolean, chars long, link_chars long"
TEMPLATE = "host string, slots array<long>, constants array<long>"
_MASK = (1 << 31) - 1


def host_of(url: str | None) -> str:
    after = (url or "").partition("://")[2]
    for mark in "/?#":
        after = after.partition(mark)[0]
    return after.lower()


def text_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}|{text}".encode()) >> 1


def page_tokens(url: str | None, page: str | None) -> Iterator[tuple]:
    """A row for each distinct token: how often it occurs, and the text it holds."""
    blocks, opened = page_blocks(page)
    key = xxhash.xxh64_intdigest((page or "").encode()) >> 1
    host = host_of(url)
    paths: dict[int, list] = {}
    for place in opened:
        paths.setdefault(place.path, [0, place.main, 0, 0])[0] += 1
    wording: dict[int, list] = {}
    for block in blocks:
        entry = paths[block.place.path]
        entry[2] += len(block.text)
        entry[3] += block.link_chars
        token = text_token(block.place.path, block.text)
        wording.setdefault(token, [0, block.place.path, block.place.main])[0] += 1
    for path, (n, main, chars, links) in paths.items():
        yield host, key, path, n, path, main, chars, links
    for token, (n, path, main) in wording.items():
        yield host, key, token, n, path, main, 0, 0


def _template(tokens: pd.DataFrame) -> pd.DataFrame:
    """Slots and constant wording of one host, from its frequent tokens."""
    host, pages = tokens["host"].iloc[0], int(tokens["support"].max())
    is_path = tokens["token"] == tokens["path"]
    size = tokens.groupby(["low", "high", "support"])["token"].transform("size")
    template = tokens[(size >= LARGE) | (tokens["token"] == 0)]
    nested = template["path"].isin(template.loc[template["token"] == template["path"], "token"])
    wording = template[(template["token"] != template["path"]) & nested]
    constant = wording[(wording["support"] >= CONSTANT * pages) & (pages >= LEAST_PAGES)]
    slots = tokens[is_path & (tokens["chars"] > 0) & (tokens["link_chars"] <= LINKS * tokens["chars"])]
    if slots["in_main"].any():
        slots = slots[slots["in_main"]]
    else:
        slots = slots[slots["chars"] >= SHARE * slots["chars"].max()]
    return pd.DataFrame(
        {"host": [host], "slots": [sorted(slots["token"])], "constants": [sorted(constant["token"])]}
    )


def host_templates(pages: DataFrame) -> DataFrame:
    """``host``, ``slots`` (container paths to extract) and ``constants`` (wording to leave out)."""
    rows = exploded_text_rows(pages, ["url", "html"], page_tokens, TOKENS)
    # Equal pages are one page: copies of an article must not pass for a template.
    rows = rows.dropDuplicates(["host", "page", "token"])
    occurrence = F.xxhash64("page", "occurs")
    vectors = rows.groupBy("host", "token").agg(
        F.count("*").alias("support"),
        F.sum(occurrence.bitwiseAND(F.lit(_MASK))).alias("low"),
        F.sum(F.shiftright(occurrence, 31).bitwiseAND(F.lit(_MASK))).alias("high"),
        F.max("path").alias("path"),
        F.max("in_main").alias("in_main"),
        F.sum("chars").alias("chars"),
        F.sum("link_chars").alias("link_chars"),
    )
    vectors = cut_lineage(vectors.where("support > 1 OR token = 0"), "token-vectors")
    # The root is on every page, so its support is the number of distinct pages.
    totals = vectors.where("token = 0").select("host", F.col("support").alias("pages"))
    frequent = vectors.join(totals, "host").where(F.col("support") >= FREQUENT * F.col("pages"))
    # A host's frequent tokens are at most 1 / FREQUENT times those of an average page.
    return frequent.drop("pages").groupBy("host").applyInPandas(_template, TEMPLATE)


def main_text(page: str | None, slots: Sequence[int] | None, constants: Sequence[int] | None) -> str:
    blocks, _ = page_blocks(page)
    usable = [b for b in blocks if b.place.main]
    if not usable:
        held = set(slots or ())
        usable = [b for b in blocks if b.place.path in held] or blocks
    drop = set(constants or ())
    return "\n\n".join(
        b.text for b in usable if not drop or text_token(b.place.path, b.text) not in drop
    )


def extract_main_text(
    pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), templates: DataFrame | None = None
) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) for every row of ``pages`` (url, html).

    ``templates`` are made from ``pages`` if not given. Blocks come in page order,
    joined by an empty line. Null and empty pages have an empty text. Pages of a host
    with fewer than ten distinct pages lose no wording; pages without a host share
    the empty host. Repeated rows stay.
    """
    known = cut_lineage(host_templates(pages) if templates is None else templates, "templates")
    small = known.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    after = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    columns = [c for c in keep if c not in ("text", "n_chars")]
    joined = pages.select(*[F.col(f"`{c}`") for c in columns], F.col("html").alias("_html"), F.lower(after).alias("_host")).join(
        (F.broadcast(known) if small else known).withColumnRenamed("host", "_host"), "_host", "left"
    )
    packed = joined.select(*[F.col(f"`{c}`") for c in columns], F.struct("_html", "slots", "constants").alias("_page"))

    def compute(rows):
        return [[main_text(r["_html"], r["slots"], r["constants"]) for r in rows]]

    made = with_text_columns(packed, "_page", compute, "text string", columns)
    return made.withColumn("n_chars", F.char_length("text").cast("long"))
