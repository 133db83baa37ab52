"""Corpus, export, numbering, packing, index."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolumen.operators import corpus, export, index, numbering, origins, packing
from repolumen.operators.embedding import Embedder, ServiceError, embed_column, is_budget_stop
from repolumen.operators.embedding import BudgetExhausted, usage_totals
from repolumen.plans.ingest import ingest
from repolumen.session import shared_dir
from tests.conftest import plan_of


def records(spark, rows):
    return spark.createDataFrame(rows, "repo_name string, content string")


def uuid_of(content):
    h = hashlib.sha1(content.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


BOILERPLATE = "the same boilerplate"
ROWS = [
    ("o/b", "some long text"),
    ("o/a", "some long text"),
    ("o/c", "some long text\n"),
    ("o/d", "short"),
    (None, "no name but long enough"),
    ("o/e", "  already there  "),
    *[(f"z/{i:03d}", BOILERPLATE) for i in range(200)],
]


def test_new_items_fold_copies_and_leave_out_known(spark):
    known = spark.createDataFrame([(uuid_of("  already there  "),)], "id string")
    df = corpus.new_items(records(spark, ROWS), known)
    plan = plan_of(df)
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {uuid_of(t) for t in ("some long text", "some long text\n", BOILERPLATE)}
    assert rows[uuid_of("some long text")]["repo_name"] == "o/a"
    assert rows[uuid_of("some long text\n")]["content"] == "some long text"
    assert rows[uuid_of(BOILERPLATE)]["repo_name"] == "z/000"
    assert plan.count("Exchange hashpartitioning(id") == 1 and "Join" not in plan


def test_small_batches_do_not_shuffle_the_index(spark, monkeypatch):
    known = spark.createDataFrame([(uuid_of("  already there  "),), ("other",)], "id string")
    df = corpus.known_among(records(spark, ROWS), known)
    assert "BroadcastHashJoin" in plan_of(df) and df.count() == 1
    monkeypatch.setattr(corpus, "BROADCAST_IDS", 2)
    assert corpus.known_among(records(spark, ROWS), known).count() == 2


def test_load_report_counts_every_class(spark):
    known = spark.createDataFrame([(uuid_of("  already there  "),)] * 2, "id string")
    report = corpus.load_report(records(spark, ROWS), known).head().asDict()
    assert report == {"new": 3, "existing": 1, "duplicates": 200, "empty": 1, "unparsable": 1}


def test_dense_ids_without_a_single_task(spark):
    values = [f"u{i:05d}" for i in range(2000)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "origin string").repartition(5)
    numbered = numbering.dense_ids(df, "origin", partitions=6)
    assert "SinglePartition" not in plan_of(numbered)
    rows = sorted((r["id"], r["origin"]) for r in numbered.collect())
    assert rows == list(enumerate(sorted(values), start=1))
    assert numbering.id_slice(numbered, 10, 5).count() == 5
    assert [r["id"] for r in numbering.keyset_page(numbered, 1998, 50).collect()] == [1999, 2000]
    assert numbering.dense_ids(df.limit(0), "origin").count() == 0
    shares = [numbering.hash_share(df, "origin", 3, i).count() for i in range(3)]
    assert sum(shares) == 2000


PACKS = [([4, 4, 4], [[4, 4], [4]]), ([5, 5, 1], [[5, 5], [1]]), ([12], [[12]]), ([3, 12, 3], [[3], [12], [3]]), ([], [])]


@pytest.mark.parametrize(("sizes", "expected"), PACKS)
def test_pack_golden(sizes, expected):
    assert [sizes[a:b] for a, b in packing.pack_bounds(sizes, 64, 10)] == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=200), st.integers(1, 40), st.integers(1, 9))
def test_packs_keep_order_and_budget(sizes, budget, rows):
    bounds = list(packing.pack_bounds(sizes, rows, budget))
    assert [i for a, b in bounds for i in range(a, b)] == list(range(len(sizes)))
    for a, b in bounds:
        assert 0 < b - a <= rows
        assert b - a == 1 or sum(sizes[a:b]) <= budget
    for (a, b), (c, d) in zip(bounds, bounds[1:]):
        assert c % rows == 0 or sum(sizes[a:b]) + sizes[c] > budget


def test_assigned_packs_equal_the_call_packs(spark):
    rng = random.Random(4)
    sizes = [rng.randint(0, 40) for _ in range(500)]
    rows = [(i + 1, n) for i, n in enumerate(sizes)]
    df = numbering.with_chunks(spark.createDataFrame(rows, "id long, n_chars long"), 64)
    found = {r["id"]: (r["chunk"], r["pack"]) for r in packing.assign_packs(df, 100).collect()}
    want, numbers = {}, {}
    for a, b in packing.pack_bounds(sizes, 64, 100):
        chunk = a // 64
        pack = numbers.setdefault(chunk, -1) + 1
        numbers[chunk] = pack
        want.update({i + 1: (chunk, pack) for i in range(a, b)})
    assert found == want


def test_export_equals_the_naive_join(spark):
    files = spark.createDataFrame(
        [("b1", "r1", "README.md"), ("b1", "r2", "readme.MD"), ("b2", "r2", "docs/README.md"),
         ("b3", "r3", "README.md"), ("b4", "r1", "README.md"), ("b5", "r4", "README.md"), ("b6", "r5", "ReadMe.md")],
        "id string, repo_name string, path string",
    )
    contents = spark.createDataFrame(
        [("b1", "one", False), ("b2", "two", False), ("b3", None, False), ("b4", "four", True),
         ("b5", "five", None), ("b6", "six", False), ("b7", "no file", False)],
        "id string, content string, binary boolean",
    )
    commits = spark.sql(
        "SELECT * FROM VALUES (array('r1', 'r2'), named_struct('date', named_struct('seconds', 10L))),"
        " (array('r2'), named_struct('date', named_struct('seconds', 30L))),"
        " (array(), named_struct('date', named_struct('seconds', 99L))) AS t(repo_name, committer)"
    )
    df = export.export_readmes(files, contents, commits)
    assert [tuple(r) for r in df.collect()] == [("b1", "r1", "one", 30), ("b6", "r5", "six", None)]
    assert "NestedLoop" not in plan_of(df)


def test_export_neither_sorts_nor_folds_texts(spark, tmp_path):
    rows = [(f"b{i % 50}", f"text {i % 50}", False) for i in range(200)]
    spark.createDataFrame(rows, "id string, content string, binary boolean").repartition(3).write.parquet(str(tmp_path / "c"))
    contents = spark.read.parquet(str(tmp_path / "c"))
    assert "place" in export.with_place(contents).columns
    files = spark.createDataFrame([(f"b{i}", f"r{i}", "README.md") for i in range(0, 60, 2)], "id string, repo_name string, path string")
    commits = spark.createDataFrame([], "repo_name array<string>, committer struct<date:struct<seconds:long>>")
    df = export.export_readmes(files, contents, commits)
    assert sorted((r["content_hash"], r["content"]) for r in df.collect()) == sorted((f"b{i}", f"text {i}") for i in range(0, 50, 2))
    # Below the last sort, which is asked for, nothing but the join touches texts.
    below = plan_of(df).split("rangepartitioning", 1)[1]
    assert not [line for line in below.splitlines() if "Aggregate" in line and "content" in line]
    assert "SortMergeJoin [id" not in below or "content" not in below.split("SortMergeJoin [id", 1)[0]


def test_equal_keys_are_numbered_by_many_tasks(spark):
    rows = spark.range(0, 20_000, 1, 4).select(F.lit("same").alias("key"), F.col("id").alias("n"))
    numbered = numbering.dense_ids(rows, "key", partitions=8)
    assert sorted(r["id"] for r in numbered.collect()) == list(range(1, 20_001))
    sizes = numbered.groupBy(F.input_file_name()).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 6000


def test_look_back_cutoff_comes_from_all_hosts(spark):
    visits = spark.sql(
        "SELECT origin, CAST(date AS TIMESTAMP_NTZ) AS date FROM VALUES"
        " ('https://github.com/a', '2024-01-01 00:00:00'), ('https://github.com/b', '2024-01-05 12:00:00'),"
        " ('https://github.com/b', '2024-01-06 00:00:00'), ('https://gitlab.com/c', '2024-01-15 12:00:00')"
        " AS t(origin, date)"
    )
    found = origins.active_origins(visits, 10, prefix="https://github.com/")
    assert [r["origin"] for r in found.collect()] == ["https://github.com/b"]
    given = origins.active_origins(visits, 5, "2024-01-06", prefix="https://github.com/")
    assert given.count() == 2


def test_host_and_date_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "visits")
    spark.sql("SELECT 'https://github.com/a' AS origin, TIMESTAMP_NTZ '2024-01-01' AS date").write.parquet(path)
    plan = plan_of(origins.recent(origins.on_host(spark.read.parquet(path), "origin"), "2024-01-01"))
    assert "StringStartsWith(origin,https://github.com/)" in plan and "GreaterThanOrEqual(date" in plan


def test_slices(spark):
    df = spark.createDataFrame([(c,) for c in "edcba"], "url string")
    take = lambda limit, offset: [r["url"] for r in origins.slice_rows(df, "url", limit, offset).collect()]
    assert take(2, 1) == ["b", "c"] and take(0, 0) == [] and take(None, 3) == ["d", "e"]
    assert take(9, 4) == ["e"] and take(3, 9) == [] and sorted(take(None, 0)) == list("abcde")


def letter_calls(key):
    return lambda texts: ([[float(len(t)), 1.0] for t in texts], sum(map(len, texts)))


def test_ingest_twice_is_ingest_once(spark, tmp_path):
    root, embedder = str(tmp_path / "index"), Embedder(letter_calls, dimension=2)
    first = ingest(records(spark, ROWS), root, embedder).head()
    assert (first["items"], first["tokens"]) == (4, 14 + 14 + 20 + 13)
    before = sorted(map(str, index.read_index(spark, root).collect()))
    scratch = Path(shared_dir(spark)) / "repolumen"
    assert not list(scratch.glob("embedded-*"))
    assert ingest(records(spark, ROWS), root, embedder).head()["items"] == 0
    more = ingest(records(spark, [*ROWS, ("n/n", "something new")]), root, embedder).head()
    assert more["items"] == 1
    after = sorted(map(str, index.read_index(spark, root).collect()))
    assert len(after) == 5 and set(before) < set(after)


def test_a_used_up_budget_keeps_what_was_bought(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def connect(key):
        def call(texts):
            if not (tmp_path / "funds").exists() and len(list(calls.iterdir())) >= 2:
                raise BudgetExhausted("add funds")
            for t in texts:
                (calls / t.split()[0]).write_text("")
            return [[float(len(t))] for t in texts], len(texts)
        return call

    root, rows = str(tmp_path / "index"), [(f"o/{i}", f"text{i} of some length") for i in range(12)]
    embedder = Embedder(connect, dimension=1, max_rows=1)
    first = ingest(records(spark, rows).coalesce(1), root, embedder, commit_rows=3).head()
    kept = index.read_index(spark, root).count()
    assert first["items"] == kept == len(list(calls.iterdir())) and 0 < kept < 12
    assert first["pending"] == 12 - kept
    (tmp_path / "funds").write_text("")
    for file in calls.iterdir():
        file.unlink()
    second = ingest(records(spark, rows), root, embedder, commit_rows=3).head()
    assert (second["items"], second["pending"]) == (12 - kept, 0)
    assert len(list(calls.iterdir())) == 12 - kept and index.read_index(spark, root).count() == 12
    assert index.current_manifest(spark, root).writes > 2


def point(spark, rows):
    return spark.createDataFrame(
        [(i, [float(x) for x in v], r, "h" + i) for i, v, r in rows],
        "id string, vector array<float>, repo_name string, content_hash string",
    )


def test_upsert_replaces_and_append_does_not(spark, tmp_path):
    root = str(tmp_path / "index")
    index.append_points(spark, root, point(spark, [("a", [1.0, 0], "x"), ("b", [0, 1.0], "y"), ("b", [0, 1.0], "x")]), 2)
    index.append_points(spark, root, point(spark, [("a", [9.0, 9], "new")]), 2)
    rows = {r["id"]: (r["repo_name"], r["vector"]) for r in index.read_index(spark, root).collect()}
    assert rows == {"a": ("x", [1.0, 0.0]), "b": ("x", [0.0, 1.0])}
    index.replace_points(spark, root, point(spark, [("a", [9.0, 9], "new"), ("c", [1.0, 1], "z")]), 2)
    rows = {r["id"]: r["repo_name"] for r in index.read_index(spark, root).collect()}
    assert rows == {"a": "new", "b": "x", "c": "z"}
    assert index.index_stats(index.read_index(spark, root)).head()["with_forks"] == 15
    with pytest.raises(Exception, match="wrong vector dimension at id d"):
        index.append_points(spark, root, point(spark, [("d", [1.0], "z")]), 2)
    assert index.read_index(spark, root).count() == 3


def files_of(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*") if p.is_file()}


def many_points(spark, low, high, name="old"):
    return point(spark, [(f"id-{i}", [float(i), 1.0], name) for i in range(low, high)])


def names_by_id(spark, root):
    rows = index.read_index(spark, root).collect()
    found = {r["id"]: r["repo_name"] for r in rows}
    assert len(found) == len(rows)
    return found


def test_readers_write_nothing_and_need_no_markers(spark, tmp_path):
    root = str(tmp_path / "index")
    assert index.read_index(spark, root).count() == 0 == index.existing_ids(spark, root).count()
    assert not Path(root).exists()
    marker = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(marker, "false")
    try:
        index.append_points(spark, root, many_points(spark, 0, 40), 2)
        index.append_points(spark, root, many_points(spark, 20, 60), 2)
    finally:
        conf.unset(marker)
    assert not [p for p in files_of(root) if p.endswith("_SUCCESS")]
    before = files_of(root)
    assert len(names_by_id(spark, root)) == 60
    assert files_of(root) == before


def test_uncommitted_segment_is_not_read(spark, tmp_path):
    root = str(tmp_path / "index")
    base = index.append_points(spark, root, many_points(spark, 0, 10), 2)
    index._write_segment(spark, root, many_points(spark, 5, 30, "lost"), index.REPLACE, base.buckets, 9)
    assert names_by_id(spark, root) == {f"id-{i}": "old" for i in range(10)}
    assert index.vacuum(spark, root) == 0 and index.vacuum(spark, root, older_than_hours=0) == 1
    assert len(names_by_id(spark, root)) == 10


def test_upsert_writes_its_own_rows_only(spark, tmp_path):
    root = str(tmp_path / "index")
    index.ensure_index(spark, root, buckets=8)
    index.append_points(spark, root, many_points(spark, 0, 2000), 2)
    before = files_of(root)
    index.replace_points(spark, root, many_points(spark, 100, 120, "new"), 2)
    index.replace_points(spark, root, many_points(spark, 110, 130, "newer"), 2)
    after = files_of(root)
    assert before.items() <= after.items()
    added = sum(Path(p).stat().st_size for p in after.keys() - before.keys() if p.endswith(".parquet"))
    assert spark.read.parquet(f"{root}/segments").count() == 2040 and added < 100_000
    wanted = {f"id-{i}": "newer" if 110 <= i < 130 else "new" if 100 <= i < 110 else "old" for i in range(2000)}
    assert names_by_id(spark, root) == wanted
    some = index.read_index(spark, root, buckets=[1, 5])
    assert {r["id"] for r in some.collect()} == {
        r["id"] for r in index.read_index(spark, root).where(index.bucket_of(8).isin(1, 5)).collect()
    }
    assert index.existing_ids(spark, root).count() == 2000


def test_compaction_drops_covered_rows_of_crowded_buckets_only(spark, tmp_path):
    root = str(tmp_path / "index")
    index.ensure_index(spark, root, buckets=4)
    index.append_points(spark, root, many_points(spark, 0, 400), 2)
    own = {b: [r["id"] for r in index.read_index(spark, root, buckets=[b]).collect()] for b in range(4)}
    newer = [(i, [0.0, 0.0], "new") for i in own[2][:30]]
    index.replace_points(spark, root, point(spark, newer), 2)
    before = names_by_id(spark, root)
    made = index.compact(spark, root)
    assert {s.kind: set(s.rows) for s in made.segments} == {index.BASE: {2}, index.APPEND: {0, 1, 3}}
    assert sum(made.bucket_rows().values()) == 400 and names_by_id(spark, root) == before
    assert index.compact(spark, root) == made
    split = index.compact(spark, root, bucket_rows=30)
    assert split.buckets == 16 and len(split.segments) == 1 and names_by_id(spark, root) == before
    index.replace_points(spark, root, point(spark, [(own[1][0], [5.0, 5.0], "last")]), 2)
    assert names_by_id(spark, root) == {**before, own[1][0]: "last"}


def test_writers_that_meet(spark, tmp_path):
    root = str(tmp_path / "index")
    index.ensure_index(spark, root, buckets=2)
    base = index.append_points(spark, root, many_points(spark, 0, 20), 2)
    index.append_points(spark, root, many_points(spark, 20, 40), 2)
    with pytest.raises(index.IndexConflict):
        index.append_points(spark, root, many_points(spark, 20, 50), 2, new_since=base)
    # A compaction in between changes no row: the write goes on from it.
    base = index.current_manifest(spark, root)
    index.compact(spark, root, most_segments=1)
    index.append_points(spark, root, many_points(spark, 40, 50), 2, new_since=base)
    # An upsert that comes while a compaction runs stays on top of what was compacted.
    write = index._write_segment
    def slow(*args):
        segment = write(*args)
        if args[3] == index.BASE:
            index._write_segment = write
            index.replace_points(spark, root, many_points(spark, 3, 5, "new"), 2)
        return segment
    index._write_segment = slow
    try:
        index.compact(spark, root, most_segments=1)
    finally:
        index._write_segment = write
    wanted = {f"id-{i}": "new" if i in (3, 4) else "old" for i in range(50)}
    assert names_by_id(spark, root) == wanted


def test_a_batch_reads_as_much_of_a_large_index_as_of_a_small_one(spark, tmp_path):
    read = []
    for rows in (1000, 8000):
        root = str(tmp_path / f"index-{rows}")
        index.append_points(spark, root, many_points(spark, 0, rows), 2)
        manifest = index.compact(spark, root, bucket_rows=50)
        ids = spark.createDataFrame([("id-7",), ("id-8",), ("nobody",)], "id string")
        assert {r["id"] for r in index.known_ids(spark, root, ids).collect()} == {"id-7", "id-8"}
        stored = index._stored_rows(spark, root, manifest.segments, set(index.hit_buckets(ids, manifest.buckets)))
        files = {r["f"] for r in stored.select(F.input_file_name().alias("f")).distinct().collect()}
        read.append(sum(Path(f.removeprefix("file://")).stat().st_size for f in files))
        assert manifest.buckets >= rows // 50
    assert read[1] < 1.5 * read[0]


def test_embed_calls_are_bounded_and_keys_take_turns(spark):
    def connect(key):
        def call(texts):
            assert len(texts) <= 3 and (len(texts) == 1 or sum(map(len, texts)) <= 50)
            return [[float(key), float(len(texts))] for _ in texts], 7
        return call

    df = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(60)], "id int, content string").coalesce(1)
    embedder = Embedder(connect, dimension=2, keys=("0", "1"), max_rows=3, max_chars=50, usd_per_million=1e6)
    found = embed_column(df, embedder)
    rows = found.orderBy("id").collect()
    calls = [r for r in rows if r["tokens"]]
    assert {r["tokens"] for r in rows} == {0, 7} and len(rows) == 60
    assert [r["vector"][0] for r in calls] == [float(i % 2) for i in range(len(calls))]
    totals = usage_totals(found).head()
    assert totals["tokens"] == 7 * len(calls) and totals["cost"] == pytest.approx(7.0 * len(calls))


def test_embed_retries_overload_and_stops_on_other_errors():
    waits, answers = [], [500, 429, 200]

    def service(texts):
        status = answers.pop(0)
        if status != 200:
            raise ServiceError(status)
        return [[1.0]] * len(texts), None

    embedder = Embedder(lambda key: service, dimension=1, sleep=waits.append)
    matrix, tokens = embedder.call(service, ["a", "b"])
    assert matrix.shape == (2, 1) and tokens == 0 and waits == [2, 4]
    answers[:] = [400]
    with pytest.raises(ServiceError, match="400"):
        embedder.call(service, ["a"])
    answers[:] = [503] * 11
    waits.clear()
    with pytest.raises(ServiceError):
        embedder.call(service, ["a"])
    assert len(waits) == 10 and waits[-1] == 20


def test_budget_stop_is_recognised_on_the_driver(spark):
    def connect(key):
        def call(texts):
            raise BudgetExhausted("add funds")
        return call

    df = spark.createDataFrame([("a",)], "content string")
    with pytest.raises(Exception) as stop:
        embed_column(df, Embedder(connect, dimension=1)).collect()
    assert is_budget_stop(stop.value)


def test_wrong_vectors_from_a_service_fail(spark):
    df = spark.createDataFrame([("a",)], "content string")
    with pytest.raises(Exception, match="expected 1 x 3"):
        embed_column(df, Embedder(letter_calls, dimension=3)).collect()


def test_parsed_names_feed_the_report(spark):
    files = spark.createDataFrame([("a_b_HEAD_README.md", "long enough text"), ("a_b_main_README.md", "long enough text")], "name string, content string")
    empty = spark.createDataFrame([], "id string")
    report = corpus.load_report(corpus.parse_stored_names(files), empty).head()
    assert (report["new"], report["unparsable"]) == (1, 1)
    names = corpus.parse_stored_names(files).where(F.col("repo_name").isNotNull())
    assert names.head()["filename"] == "README.md"
