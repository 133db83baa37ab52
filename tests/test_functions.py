"""Golden rows of the column expressions."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from repolumen.functions import hashing, numbers, text, times, vectors

README = "# dbc_pair_mate_v2\nThis a verion 2 of the dbc pair mate ported to Rails.\n"


def values(spark, items, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r["r"] for r in rows.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def test_hashes_of_the_documented_record(spark):
    (plain,) = values(spark, [README], hashing.content_sha1)
    (blob,) = values(spark, [README], hashing.git_blob_sha1)
    (uuid,) = values(spark, [plain], hashing.hash_to_uuid)
    assert plain == "be54caf15efe265ade01a9edc99db492892b5bc1"
    assert blob == "9d6a7cca12ed5fc9831fec6d97fed2e88b1bb884"
    assert uuid == "be54caf1-5efe-265a-de01-a9edc99db492"


def test_git_blob_counts_bytes(spark):
    import hashlib

    (found,) = values(spark, ["é😀\n"], hashing.git_blob_sha1)
    body = "é😀\n".encode()
    assert found == hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()


def test_trim_takes_unicode_space_only_at_the_ends(spark):
    inner = "a  b c"
    padded = "﻿ \t\n " + inner + "　\r\n "
    assert values(spark, [padded, "​", None], text.unicode_trim) == [inner, "​", None]


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("123456789", False),
        ("1234567890", True),
        ("  1234567890\n", True),
        (" ﻿" * 20, False),
        ("", False),
    ],
)
def test_embeddable_from_ten_trimmed_characters(spark, content, expected):
    assert values(spark, [content], text.is_embeddable) == [expected]


def test_embed_text_is_trimmed_then_cut(spark):
    (cut,) = values(spark, [" " + "x" * 16_001 + " "], text.embed_text)
    assert cut == "x" * 16_000


def test_truncation_mark_comes_on_top(spark):
    whole, cut = values(spark, ["a" * 50_000, "a" * 50_001], text.truncate_marked)
    assert whole == "a" * 50_000
    assert cut == "a" * 50_000 + "\n\n[TRUNCATED]" and len(cut) == 50_013


def test_repo_from_url(spark):
    urls = [
        "https://github.com/a/b",
        "https://github.com/a/b.git",
        "http://github.com/a/b.git/tree/x",
        "https://github.com/a/b.git?x",
        "https://github.com/a",
        "https://gitlab.com/a/b",
        "https://githubxcom/a/b",
        "https://github.com.evil/a/b",
    ]
    expected = ["a/b", "a/b", "a/b", "a/b.git?x", None, None, None, None]
    assert values(spark, urls, text.repo_from_url) == expected


def test_file_key_replaces_the_first_slash_only(spark):
    assert values(spark, ["a/b", "a_b/c/d"], text.file_key) == ["a_b", "a_b_c/d"]


NAMES = [
    "a_b_main_README.md",
    "a_my_repo_master_README.md",
    "a_my_main_tool_main_README.md",
    "a_main_main_README.md",
    "a_b_HEAD_README.md",
    "a_b_default_readme.rst",
    "a_b_trunk_README.md",
    "x",
    "main",
]


def test_strict_names(spark):
    found = values(spark, NAMES, text.stored_name_repo)
    assert found == ["a/b", "a/my_repo", "a/my", None, None, "a/b", None, None, None]


def test_extended_names_know_head(spark):
    found = values(
        spark, NAMES[4:5], lambda c: text.stored_name_repo(c, text.EXTENDED_BRANCHES)
    )
    assert found == ["a/b"]


def test_lenient_names_never_reject(spark):
    found = values(spark, NAMES, text.stored_name_repo_lenient)
    assert found == ["a/b", "a/my_repo", "a/my", "a/", "a/b", "a/b", "a/b", "x/", "main/"]


def test_stored_branch_and_file(spark):
    assert values(spark, NAMES[:3], text.stored_name_branch) == ["main", "master", "main"]
    found = values(spark, ["a_b_main_my_readme.md"], text.stored_name_file)
    assert found == ["my_readme.md"]


def test_finished_keys_drop_branch_and_file(spark):
    found = values(spark, ["a_b_HEAD_README.md", "a_b", "a_b_c"], text.finished_file_key)
    assert found == ["a_b", None, "a"]


def test_compact_numbers(spark):
    n = [0, 999, 1000, 1250, 1350, 1450, 12_345, 999_999, 1_000_000]
    assert values(spark, n, numbers.compact_number, "long") == [
        "0", "999", "1k", "1.3k", "1.4k", "1.4k", "12.3k", "1000k", "1000k",
    ]
    n = [999, 1000, 2500, 12_345, 999_999, 1_000_000, 3_450_000]
    assert values(spark, n, numbers.compact_count, "long") == [
        "999", "1k", "3k", "12k", "1000k", "1M", "3.5M",
    ]


def test_fixed_digits_round_the_binary_value(spark):
    n = [1.005, 0.125, 2.5, -0.125, 0.0, 1234.5]
    found = values(spark, n, lambda c: numbers.fixed_text(c, 2), "double")
    assert found == ["1.00", "0.13", "2.50", "-0.13", "0.00", "1234.50"]


def test_result_limit(spark):
    asked = [None, "abc", "", "0", "7", "12abc", "51", "1000"]
    assert values(spark, asked, numbers.result_limit) == [10, 10, 10, 0, 7, 12, 50, 50]


def test_waits(spark):
    assert values(spark, [0, 1, 4], numbers.fetch_wait_seconds, "int") == [1, 2, 16]
    assert values(spark, [10, 9, 1], numbers.embed_wait_seconds, "int") == [2, 4, 20]


def test_estimated_tokens_round_half_up(spark):
    assert values(spark, [0, 2, 6, 9], numbers.estimated_tokens, "long") == [0, 1, 2, 2]


def test_freshness_ends_at_the_lifetime(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    at = [datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1), None]
    found = values(
        spark, at, lambda c: times.is_fresh(c, as_of, times.REPO_INFO_TTL), "timestamp_ntz"
    )
    assert found == [False, True, None]


def test_span_of_is_exact_at_borders(spark):
    width = 60_000_000
    edge = 29_000_000 * width
    found = values(spark, [edge - 1, edge, -1], lambda c: times.span_of(c, width), "long")
    assert found == [28_999_999, 29_000_000, -1]


def test_cosine(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 2.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])],
        "a array<float>, b array<float>",
    )
    found = [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert found[0] == 0 and found[1] == pytest.approx(1) and found[2:] == [None, None]
