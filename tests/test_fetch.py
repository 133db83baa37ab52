"""Fetch stage, attempts, outcomes, reports."""

from __future__ import annotations

import pytest

from repolumen.operators import fetch
from repolumen.plans import crawl
from repolumen.sources import schemas
from tests.conftest import plan_of

ATTEMPTS = {
    "all/404": [404, 404],
    "late/hit": [404, 200, 200],
    "blocked/first": [451, 200],
    "hit/first": [200, 451],
    "forbidden/then": [403, 404],
    "down/then": [403, 0, 404],
    "empty/body": [200],
}


def attempts(spark):
    rows = [
        (repo, i, "main", f"N{i}", status, "" if repo == "empty/body" else f"body{i}", 10, None)
        for repo, statuses in ATTEMPTS.items()
        for i, status in enumerate(statuses)
    ]
    return spark.createDataFrame(rows, schemas.FETCH_ATTEMPT)


def test_resolved_attempts(spark):
    found = {r["repo_name"]: r for r in fetch.resolve_attempts(attempts(spark)).collect()}
    got = {repo: (r["status"], r["content"], r["filename"]) for repo, r in found.items()}
    assert got == {
        "all/404": (404, None, ""),
        "late/hit": (200, "body1", "N1"),
        "blocked/first": (451, None, ""),
        "hit/first": (200, "body0", "N0"),
        "forbidden/then": (403, None, ""),
        "down/then": (0, None, ""),
        "empty/body": (200, "", "N0"),
    }
    assert found["late/hit"]["candidates_tried"] == 3 and found["all/404"]["fetch_ms"] == 20
    assert plan_of(fetch.resolve_attempts(attempts(spark))).count("Exchange") == 1


def test_size_classes(spark):
    sizes = [None, 0, 499, 500, 50_000, 50_001]
    rows = [(f"r/{i}", None if n is None else "x" * n, "", "", 200, 1, 5) for i, n in enumerate(sizes)]
    found = fetch.classify_outcomes(spark.createDataFrame(rows, schemas.FETCH_RESULT)).orderBy("repo_name").collect()
    assert [r["outcome"] for r in found] == ["error", "error", "too_small", "ok", "ok", "truncated"]
    assert [len(r["content"]) if r["content"] else 0 for r in found] == [0, 0, 0, 500, 50_000, 50_013]


def client(log=None):
    def make():
        def answer(url):
            if "boom" in url:
                raise OSError("no connection")
            if "busy" in url:
                return 503, ""
            if "dmca" in url:
                return 451, ""
            if "found" in url and url.endswith("/master/readme.md"):
                return 200, "text of " + url
            if "forbidden" in url and url.endswith("/main/README.md"):
                return 403, ""
            return 404, ""

        return answer

    return make


def test_fetch_stage(spark):
    names = ["a/found", "a/boom", "a/busy", "a/dmca", "a/forbidden", "a/none"]
    repos = spark.createDataFrame([(n,) for n in names], "repo_name string")
    found = fetch.fetch_readmes(
        repos,
        client(),
        names=fetch.README_NAMES[:2],
        branches=fetch.WIDE_BRANCHES,
        policy=fetch.FetchPolicy(tries=2, sleep=lambda s: None),
        threads=3,
    )
    got = {r["repo_name"]: (r["status"], r["branch"], r["filename"]) for r in found.collect()}
    assert got == {
        "a/found": (200, "master", "readme.md"),
        "a/boom": (0, "", ""),
        "a/busy": (0, "", ""),
        "a/dmca": (451, "", ""),
        "a/forbidden": (403, "", ""),
        "a/none": (404, "", ""),
    }


def test_waits_double_and_errors_wait_only_if_asked():
    waits = []
    policy = fetch.FetchPolicy(tries=3, sleep=waits.append)
    assert fetch._get_with_retry(lambda url: (429, ""), "u", policy) is None
    assert waits == [1, 2, 4]

    def broken(url):
        raise TimeoutError

    waits.clear()
    assert fetch._get_with_retry(broken, "u", policy) is None and waits == []
    patient = fetch.FetchPolicy(tries=2, wait_after_error=True, sleep=waits.append)
    assert fetch._get_with_retry(broken, "u", patient) is None and waits == [1, 2]
    answers = iter([(500, ""), (200, "x")])
    assert fetch._get_with_retry(lambda url: next(answers), "u", policy) == (200, "x")


def test_candidates_are_ordered_name_by_name(spark):
    repos = spark.createDataFrame([("a/b",)], "repo_name string")
    rows = fetch.candidate_urls(repos).orderBy("priority").collect()
    assert [r["priority"] for r in rows] == list(range(24))
    assert rows[2]["url"] == "https://raw.githubusercontent.com/a/b/main/readme.md"


def test_run_again_continues_where_output_ends(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    visits = spark.sql(
        "SELECT origin, TIMESTAMP '2024-02-01' AS date FROM VALUES ('https://github.com/a/found'),"
        " ('https://github.com/a/found.git'), ('https://github.com/a/none'), ('https://x.org/a/b') AS t(origin)"
    )
    options = {"names": fetch.README_NAMES[:2], "branches": fetch.WIDE_BRANCHES}
    first = crawl.run_fetch(visits, path, client(), "2024-01-01", partitions=2, **options)
    assert {r["repo_name"]: r["outcome"] for r in first.collect()} == {"a/found": "too_small", "a/none": "error"}

    def no_call():
        raise AssertionError("nothing is left to fetch")

    again = crawl.run_fetch(visits, path, lambda: no_call, "2024-01-01", **options)
    assert again.count() == 2
    assert crawl.plan_fetch(visits, again, "2024-01-01").count() == 0


def test_work_list_verdicts(spark):
    urls = ["https://github.com/a/" + "x" * 199, "https://github.com/a/" + "x" * 198, "https://github.com/a"]
    df = fetch.work_list(spark.createDataFrame([(u,) for u in urls], "origin string"))
    assert sorted(r["verdict"] for r in df.collect()) == ["fetch", "no_match", "skipped"]


def test_reports(spark):
    rows = [(o, s) for o, s in [
        ("ok", 200), ("truncated", 200), ("too_small", 200), ("error", 404), ("error", 404),
        ("error", 0), ("error", 451), ("error", 500), ("skipped", None), ("no_match", None)]]
    df = spark.createDataFrame(rows, "outcome string, status int")
    assert fetch.fetch_report(df).head().asDict() == {
        "success": 2, "too_small": 1, "truncated": 1, "skipped": 1, "fetched": 8, "processed": 9, "errors": 6,
    }
    by_status = [tuple(r) for r in fetch.errors_by_status(df).collect()]
    assert by_status == [
        (0, "timeout/connection", 2), (404, "not found", 2), (451, "DMCA", 1), (500, "500", 1),
    ]


@pytest.mark.parametrize(("status", "tried", "key"), [(404, 1, "404_1"), (404, 12, "404_12"), (0, 1, "0"), (200, 1, "200")])
def test_error_keys(spark, status, tried, key):
    from pyspark.sql import functions as F

    row = spark.range(1).select(fetch.error_key(F.lit(status), F.lit(tried)).alias("k")).head()
    assert row["k"] == key


def test_format_counts(spark):
    rows = [("default", "README.md"), ("default", "README.md"), ("main", "a.rst"), ("HEAD", "README.md")]
    found = [tuple(r) for r in fetch.format_counts(spark.createDataFrame(rows, "branch string, filename string")).collect()]
    assert found == [
        ("all", None, None, 4),
        ("branch", "default", None, 2),
        ("branch", "main", None, 1),
        ("branch_file", "default", "README.md", 2),
        ("branch_file", "main", "a.rst", 1),
    ]


def test_fetch_from_a_stored_crawl(spark):
    repos = spark.createDataFrame([("o/a",), ("o/b",), ("o/c",), ("o/a",)], "repo_name string")
    raw = fetch.RAW_PREFIX
    rows = [(f"{raw}o/a/master/README.md", "second"), (f"{raw}o/a/main/README.md", "first"), (f"{raw}o/b/main/readme.md", None),
            (f"{raw}o/z/main/README.md", "nobody")]
    archive = spark.createDataFrame(rows, "url string, body string")
    found = {r["repo_name"]: tuple(r)[1:] for r in fetch.fetch_from_archive(repos, archive, fetch.README_NAMES[:2]).collect()}
    assert found["o/a"] == ("first", "main", "README.md", 200, 2, 0)
    assert found["o/b"][3] in (200, 404) and found["o/c"] == (None, "", "", 404, 2, 0)
    kinds = {r["repo_name"]: r["outcome"] for r in fetch.classify_outcomes(fetch.fetch_from_archive(repos, archive), 1).collect()}
    assert kinds["o/c"] == "error"
