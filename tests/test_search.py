"""Exact and cell-wise search against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolumen.operators import cells, hits
from repolumen.operators.embedding import Embedder
from repolumen.operators.scoring import exact_top_k, rank_hits, top_k_for_one
from repolumen.plans.search import search, search_hypothetical
from tests.conftest import plan_of

DIM = 6


def make_index(spark, n=300, seed=3, copies=0, partitions=3):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, DIM)).astype(np.float32)
    if copies:
        vectors[:copies] = vectors[0]
    vectors[n - 1] = 0
    rows = [(f"id{i:04d}", [float(x) for x in v], f"r/{i % 40}") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, repo_name string")
    return df.repartition(partitions), rows


def make_queries(spark, rows, limits):
    asked = [(i, k, rows[i * 7][1]) for i, k in enumerate(limits)]
    return spark.createDataFrame(asked, "qid long, k long, vector array<float>"), asked


def brute(asked, rows):
    matrix = np.array([r[1] for r in rows], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    out = {}
    for qid, k, vector in asked:
        q = np.array(vector)
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = np.nan_to_num(matrix @ q / (norms * np.linalg.norm(q)))
        # Equal vectors tie exactly; their computed scores may differ in the last bit.
        best = sorted((-round(s, 12), r[0]) for s, r in zip(scores, rows))[:k]
        out[qid] = [i for _, i in best]
    return out


def found_ids(df):
    out = {}
    for row in df.orderBy("qid", "rank").collect():
        out.setdefault(row["qid"], []).append(row["id"])
    return out


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_exact_equals_brute_force(spark, partitions):
    index, rows = make_index(spark, partitions=partitions)
    queries, asked = make_queries(spark, rows, [10, 3, 1, 25, 300, 400])
    assert found_ids(exact_top_k(queries, index, DIM)) == brute(asked, rows)


def test_blocks_give_the_same_rows_as_one(spark):
    index, rows = make_index(spark)
    queries, asked = make_queries(spark, rows, [5] * 9)
    in_blocks = exact_top_k(queries, index, DIM, block_bytes=2 * 8 * DIM)
    assert found_ids(in_blocks) == brute(asked, rows)


def test_copies_making_up_most_of_the_index_tie_by_id(spark):
    index, rows = make_index(spark, copies=200)
    queries, asked = make_queries(spark, rows, [10, 10])
    found = found_ids(exact_top_k(queries, index, DIM))
    assert found[0] == [f"id{i:04d}" for i in range(10)]


def test_compaction_keeps_the_result(spark, monkeypatch):
    from repolumen.operators import scoring

    index, rows = make_index(spark, n=100)
    block = scoring.QueryBlock(
        np.arange(3), np.array([4, 2, 4]), scoring.unit_rows(np.array([rows[i][1] for i in range(3)]))
    )
    monkeypatch.setattr(scoring, "COMPACT_ROWS", 5)
    import pyarrow as pa

    best = scoring.BestRows(block, ["id"])
    for start in range(0, 100, 10):
        part = rows[start : start + 10]
        scores = block.units @ scoring.unit_rows(np.array([r[1] for r in part])).T
        best.add(scores, pa.table({"id": [r[0] for r in part]}), np.arange(3))
    got = best.compact().groupby("_q")["id"].apply(list).to_dict()
    want = brute([(i, 4, rows[i][1]) for i in range(3)], rows)
    assert got == want


def test_limits_of_zero_and_empty_queries(spark):
    index, rows = make_index(spark, n=30)
    queries, _ = make_queries(spark, rows, [0, 2])
    assert set(found_ids(exact_top_k(queries, index, DIM))) == {1}
    assert exact_top_k(queries.limit(0), index, DIM).count() == 0


def test_single_query_form_agrees(spark):
    index, rows = make_index(spark)
    queries, asked = make_queries(spark, rows, [10])
    one = top_k_for_one(index, rows[0][1], 10)
    assert [r["id"] for r in one.collect()] == found_ids(exact_top_k(queries, index, DIM))[0]
    assert "TakeOrderedAndProject" in plan_of(one)


def test_wrong_dimension_fails(spark):
    index = spark.createDataFrame([("a", [1.0, 2.0], "r/1")], "id string, vector array<float>, repo_name string")
    queries = spark.createDataFrame([(1, 1, [1.0] * DIM)], "qid long, k long, vector array<float>")
    with pytest.raises(Exception, match="components"):
        exact_top_k(queries, index, DIM).collect()


def test_rank_is_cut_before_the_shuffle(spark):
    index, rows = make_index(spark)
    queries, _ = make_queries(spark, rows, [10])
    plan = plan_of(exact_top_k(queries, index, DIM))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(qid")
    assert plan.count("WindowGroupLimit") == 2
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_cells_equal_exact_and_fewer_cells_are_subsets(spark):
    index, rows = make_index(spark)
    queries, asked = make_queries(spark, rows, [8] * 5)
    centers = cells.fit_centers(index, 5)
    celled = cells.with_cells(index, centers)
    assert celled.select("cell").distinct().count() <= 5
    assert found_ids(cells.cell_top_k(queries, celled, centers, 5)) == brute(asked, rows)
    some = cells.cell_top_k(queries, celled, centers, 2)
    share = cells.recall(some, exact_top_k(queries, index, DIM)).head()
    assert 0.2 < share["recall"] <= 1 and share["exact_hits"] == 40
    # The nearest row of a stored vector is itself, in its own cell.
    assert all(found_ids(some)[q][0] == rows[q * 7][0] for q in range(5))


def test_stored_cells_are_pruned(spark, tmp_path):
    index, rows = make_index(spark)
    queries, asked = make_queries(spark, rows, [4])
    centers = cells.fit_centers(index, 5)
    path = str(tmp_path / "cells")
    cells.write_cells(cells.with_cells(index, centers), path)
    assert spark.read.parquet(path).count() == len(rows)
    found = cells.cell_top_k(queries, spark.read.parquet(path), centers, 1)
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", plan_of(found))
    assert found_ids(found)[0][0] == rows[0][0]


def test_crowded_cell_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        rows = spark.range(0, 40_000, 1, 6).select(
            F.col("id").cast("string").alias("id"),
            F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("vector"),
            F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 5).cast("int").alias("cell"),
        )
        cells.write_cells(rows, str(tmp_path / "c"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "c" / "cell=0").glob("part-*"))) > 1
    assert spark.read.parquet(str(tmp_path / "c")).count() == 40_000


def letters(key):
    return lambda texts: ([[float(t.count(c)) for c in "abcdef"] for t in texts], len(texts))


def test_search_skips_blank_queries_and_attaches_content(spark):
    embedder = Embedder(letters, dimension=6)
    index = spark.createDataFrame(
        [
            ("1", [3.0, 0.0, 0.0, 0.0, 0.0, 0.0], "o/a"),
            ("2", [0.0, 2.0, 0.0, 0.0, 0.0, 0.0], "o/b"),
            ("3", [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], "o/c"),
        ],
        "id string, vector array<float>, repo_name string",
    )
    readmes = spark.createDataFrame(
        [
            ("o/a", "main", "README.md", "main text"),
            ("o/a", "HEAD", "README.md", "head text"),
            ("o/b", "default", "README.md", "unseen"),
            ("o/c", "master", "readme.rst", "unseen"),
        ],
        "repo_name string, branch string, filename string, content string",
    )
    queries = spark.createDataFrame(
        [(1, "aaa", "2"), (2, "  ", None), (3, None, None), (4, "b", "99")],
        "qid long, query string, `limit` string",
    )
    rows = search(queries, index, embedder, readmes).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["repo_name"], r["content"]) for r in rows] == [
        (1, "o/a", "head text"), (1, "o/c", None),
        (4, "o/b", None), (4, "o/c", None), (4, "o/a", "head text"),
    ]
    table = hits.ranked_table(search(queries, index, embedder, readmes)).orderBy("qid", "rank")
    assert [r["score"] for r in table.collect()][:2] == ["1.00", "0.71"]
    written = search_hypothetical(
        queries, index, lambda: lambda q: q.replace("a", "b"), embedder, readmes
    ).orderBy("qid", "rank")
    first = written.head()
    assert (first["repo_name"], first["hypothetical_doc"], first["query"]) == ("o/b", "bbb", "aaa")


def test_content_filters_the_corpus_where_it_is_read(spark):
    found = spark.createDataFrame([(1, "o/a")], "qid long, repo_name string")
    readmes = spark.createDataFrame([("o/a", "HEAD", "README.md", "x")], "repo_name string, branch string, filename string, content string")
    plan = plan_of(hits.attach_content(found, readmes, max_hits=1))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_pages_and_more(spark):
    ranked = rank_hits(
        spark.createDataFrame([(1, 50, 0.5, str(i)) for i in range(45)], "qid long, k long, score double, id string"), 50
    )
    assert hits.result_page(ranked, 2).count() == 5
    assert hits.has_more(ranked, 45).head()["has_more"]
    assert not hits.has_more(ranked, 50).head()["has_more"]


def test_info_is_left_out_at_24_hours(spark):
    found = spark.createDataFrame([(1, "o/a"), (1, "o/b"), (1, "o/c")], "qid long, repo_name string")
    info = spark.sql(
        "SELECT * FROM VALUES ('o/a', 'd', 999L, 'Go', 12345L, TIMESTAMP_NTZ '2024-01-01 00:00:00'),"
        " ('o/b', NULL, 1000L, NULL, 1000000L, TIMESTAMP_NTZ '2024-01-01 00:00:01')"
        " AS t(repo_name, description, stars, language, forks, fetched_at)"
    )
    as_of = F.lit("2024-01-02").cast("timestamp_ntz")
    rows = hits.attach_info(found, info, as_of).orderBy("repo_name").collect()
    assert [(r["stars_text"], r["forks_text"]) for r in rows] == [(None, None), ("1k", "1000k"), (None, None)]


def test_provider_agreement(spark):
    left = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0])], "id string, vector array<float>")
    right = spark.createDataFrame([("a", [2.0, 4.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.02])], "id string, vector array<float>")
    rows = hits.compare_vectors(left, right).orderBy("id").collect()
    assert [r["agrees"] for r in rows] == [True, False, False]


def test_a_grid_is_bounded_by_its_scores_not_by_small_parts():
    from repolumen.operators import scoring

    for n in (10_000, 100_000, 600_000):
        pairs = min(scoring.MOST_PAIRS, -(-n * n // 24))
        for k, payload in ((10, 1), (120, 0)):
            groups, slabs = scoring.grid_of(n, n, 64, k, payload, pairs)
            assert n * n / (groups * slabs) <= pairs  # scores of a task
            assert n / groups * (8 * 64 + 2 * k * (48 + 80 * payload)) <= scoring.HELD_BYTES
            assert groups * slabs <= 200 and slabs <= 20
