"""Readers, writers, batch tables, streams end to end."""

from __future__ import annotations

import json
from datetime import timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repolumen.operators import batches, corpus
from repolumen.operators.embedding import Embedder
from repolumen.operators.index import read_index
from repolumen.plans import crawl
from repolumen.plans.ingest import collect_batches, plan_batches
from repolumen.sources import readers, schemas, stored, writers
from repolumen.streaming.ingest import read_record_stream, start_ingest
from tests.conftest import plan_of


def test_orc_conversion(spark, tmp_path):
    origins, visits = str(tmp_path / "o"), str(tmp_path / "v")
    urls = ["https://github.com/a/b", "https://github.com/a/b", "http://github.com/a/b", "https://github.com.evil/x"]
    spark.createDataFrame([(str(i), u) for i, u in enumerate(urls)], schemas.ORIGIN).write.orc(origins)
    spark.sql(
        "SELECT origin, 1 AS visit, CAST(date AS TIMESTAMP) AS date, 'git' AS type FROM VALUES"
        " ('https://github.com/a/b', '2024-01-01'), ('https://github.com/a/b', '2024-01-03'),"
        " ('https://gitlab.com/a/b', '2024-02-01') AS t(origin, date)"
    ).write.orc(visits)
    crawl.convert_origins(spark, origins, str(tmp_path / "op"))
    crawl.convert_visits(spark, visits, str(tmp_path / "vp"))
    assert spark.read.parquet(str(tmp_path / "op")).count() == 2
    rows = spark.read.parquet(str(tmp_path / "vp")).collect()
    assert [(r["origin"], r["date"].day) for r in rows] == [("https://github.com/a/b", 3)]
    assert any(".zstd.parquet" in f.name for f in (tmp_path / "op").iterdir())
    plan = plan_of(readers.read_origins(spark, origins))
    assert "ReadSchema: struct<url:string>" in plan
    assert readers.read_visits(spark, visits, all_columns=True).columns == ["origin", "visit", "date", "type"]
    assert readers.count_rows(spark, str(tmp_path / "op")) == 2
    assert [r["url"] for r in readers.read_host_origins(spark, str(tmp_path / "op"), 1, 1).collect()] == urls[:1]
    crawl.list_active(spark, visits, str(tmp_path / "active"), days=10)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "active")).collect()] == ["https://gitlab.com/a/b"]


def test_sorted_lines_are_ordered_across_files(spark, tmp_path):
    path = tmp_path / "lines"
    df = spark.range(5000).select(F.format_string("u%05d", F.col("id") * 7919 % 5000).alias("origin"))
    writers.write_sorted_lines(df.repartition(7), "origin", str(path))
    lines = [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == sorted(lines) and len(lines) == 5000


def test_stored_files_are_read_whole(spark, tmp_path):
    folder = tmp_path / "readmes"
    folder.mkdir()
    (folder / "a_b_main_README.md").write_text("line one\nline two\n\n")
    (folder / "a_c_d_master_README.md").write_text("é😀 text\r\nmore")
    (folder / ".hidden_x_main_README.md").write_text("no")
    rows = readers.read_stored_readmes(spark, str(folder)).orderBy("name").collect()
    assert [tuple(r) for r in rows] == [
        ("a_b_main_README.md", "line one\nline two\n\n"),
        ("a_c_d_master_README.md", "é😀 text\r\nmore"),
    ]
    records = corpus.readme_records(readers.read_stored_readmes(spark, str(folder)))
    assert sorted(r["repo_name"] for r in records.collect()) == ["a/b", "a/c_d"]


STORED_ROWS = [
    ("a/b c+d%2F_main_README.md", "line one\nline two\n"),
    ("é_main_README.md", "😀\r\n"),
    ("twice", "same"),
    ("twice", "same"),
    ("empty", ""),
    ("missing", None),
    (None, "no name"),
    ("_hidden", "x" * 5_000_000),
]
STORED_FILES = [
    ("__HIVE_DEFAULT_PARTITION__", "no name\n"),
    ("_hidden", "x" * 5_000_000 + "\n"),
    ("a/b c+d%2F_main_README.md", "line one\nline two\n\n"),
    ("empty", "\n"),
    ("missing", "\n"),
    ("twice", "same\nsame\n"),
    ("é_main_README.md", "😀\r\n\n"),
]


@pytest.mark.parametrize("bounds", [{}, {"REPEATED_NAMES": 0}, {"TASK_FILES": 100}])
def test_stored_readmes_come_back_by_tasks(spark, tmp_path, monkeypatch, bounds):
    """A file per name; neither folders nor what the driver lists grow with the documents."""
    for bound, value in bounds.items():
        monkeypatch.setattr(writers, bound, value)
    rows = [*STORED_ROWS, *((f"d{i}", f"text {i}") for i in range(3000))]
    path = tmp_path / "stored"
    writers.write_stored_readmes(spark.createDataFrame(rows, "name string, content string").repartition(3), str(path))
    folders = list(path.iterdir())
    assert 0 < len(folders) <= 3 + 4 and all(f.name.startswith("part-") for f in folders)
    assert sum(f.is_file() for folder in folders for f in folder.iterdir()) == 3000 + len(STORED_FILES)
    found = readers.read_stored_readmes(spark, str(path), folders=True)
    assert found.rdd.getNumPartitions() == len(folders)
    expected = [*STORED_FILES, *((f"d{i}", f"text {i}\n") for i in range(3000))]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    with pytest.raises(FileExistsError):
        writers.write_stored_readmes(spark.createDataFrame(rows, "name string, content string"), str(path))


def test_stored_texts_of_single_names_are_not_shuffled(spark, tmp_path):
    path = tmp_path / "stored"
    rows = spark.range(1000).select(F.concat(F.lit("d"), "id").alias("name"), F.lit("text").alias("content"))
    writers.write_stored_readmes(rows.coalesce(2), str(path))
    assert sorted(f.name for f in path.iterdir()) == ["part-single-00000", "part-single-00001"]
    assert readers.read_stored_readmes(spark, str(path), folders=True).distinct().count() == 1000


def test_stored_readmes_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "stored")
    writers.write_stored_readmes(spark.createDataFrame([], "name string, content string"), path)
    assert readers.read_stored_readmes(spark, path, folders=True).collect() == []


def test_a_part_is_put_in_place_once(tmp_path):
    def batches(text, broken=False):
        yield pa.RecordBatch.from_pydict({"name": pa.array([b"n"], pa.binary()), "text": pa.array([text], pa.binary())})
        if broken:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stored.write_part(str(tmp_path), "a-3", batches(b"first", broken=True))
    assert not list(tmp_path.iterdir())
    stored.write_part(str(tmp_path), "a-3", batches(b"second"))
    stored.write_part(str(tmp_path), "a-3", batches(b"third"))
    assert [f.name for f in tmp_path.iterdir()] == ["part-a-3"]
    assert [r for b in stored.read_part(str(tmp_path / "part-a-3")) for r in b.to_pylist()] == [
        {"name": b"n", "content": b"second\n"}
    ]


def test_stored_readmes_in_a_store_of_hadoop(spark, tmp_path):
    """Where files cannot be opened by path, Spark writes and lists them; its folders are read anywhere."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.stored.link./in", f"file://{tmp_path}")
    rows = [("a_b_main_README.md", "one\ntwo"), ("a_c_main_README.md", None), ("twice", "same"), ("twice", "same")]
    path = "viewfs://stored/in/readmes"
    writers.write_stored_readmes(spark.createDataFrame(rows, "name string, content string"), path)
    expected = [("a_b_main_README.md", "one\ntwo\n"), ("a_c_main_README.md", "\n"), ("twice", "same\nsame\n")]
    for place in (path, str(tmp_path / "readmes")):
        assert sorted(map(tuple, readers.read_stored_readmes(spark, place, folders=True).collect())) == expected


def test_records_keep_null_dates(spark, tmp_path):
    path = str(tmp_path / "jsonl")
    rows = [("h1", "a/b", 'quote " and\nnew line é', 5), ("h2", "a/c", "x", None)]
    writers.write_readme_records(spark.createDataFrame(rows, schemas.DATED_README_RECORD), path)
    text = "".join(f.read_text() for f in (tmp_path / "jsonl").glob("part-*"))
    assert '"last_commit":null' in text
    back = readers.read_readme_records(spark, path, dated=True).orderBy("content_hash").collect()
    assert [tuple(r) for r in back] == rows


def test_ledger_may_be_missing(spark, tmp_path):
    assert readers.read_batch_ledger(spark, str(tmp_path / "none")).count() == 0
    rows = [("b1", None, "i1", "r", "h"), ("b2", None, None, None, None)]
    writers.append_ledger(spark.createDataFrame(rows, schemas.BATCH_ITEM), str(tmp_path / "l"))
    assert [r["batch_id"] for r in readers.read_batch_ledger(spark, str(tmp_path / "l")).collect()] == ["b1"]


def test_query_parquet(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    assert readers.query_parquet(spark, "SELECT sum(id) AS s FROM {t}", t=str(tmp_path / "t")).head()["s"] == 45


def result_line(i, vector, **usage):
    response = {"data": [{"embedding": vector}]}
    if usage:
        response["usage"] = usage
    return json.dumps({"id": f"l{i}", "custom_id": i, "response": response})


LINES = [
    result_line("a", [1.0, 0.0], prompt_tokens=5),
    "",
    result_line("b", [0.0, 1.0]),
    "   ",
    json.dumps({"id": "x", "custom_id": "c", "response": {"error": {"message": "m" * 300}}}),
    json.dumps({"id": "x", "custom_id": "d", "error": "gone"}),
    json.dumps({"id": "x", "custom_id": "e", "response": {"data": []}}),
    result_line("a", [0.5, 0.5], prompt_tokens=7),
    result_line("stranger", [1.0, 1.0], prompt_tokens=1),
]


def write_lines(tmp_path, lines):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "result.jsonl").write_text("\n".join(lines))
    return str(tmp_path / "out")


def test_batch_results(spark, tmp_path):
    results = batches.parse_results(readers.read_result_lines(spark, write_lines(tmp_path, LINES)))
    totals = batches.result_totals(results).head()
    assert (totals["lines"], totals["failed"], totals["tokens"]) == (7, 3, 13)
    assert totals["cost"] == pytest.approx(13 / 1e6 * 0.005)
    ledger = spark.createDataFrame(
        [("b1", None, i, f"r/{i}", "h" + i) for i in "abcd"], schemas.BATCH_ITEM
    )
    root = str(tmp_path / "index")
    complete, failed = collect_batches(
        readers.read_result_lines(spark, str(tmp_path / "out")), ledger, root, 2
    )
    index = {r["id"]: (r["repo_name"], r["vector"]) for r in read_index(spark, root).collect()}
    assert index == {"a": ("r/a", [0.5, 0.5]), "b": ("r/b", [0.0, 1.0])}
    errors = {r["repo"]: r["error"] for r in failed.collect()}
    assert set(errors) == {"r/c", "r/d", "e"}
    assert errors["r/c"].startswith('{"error":{"message":"mmm') and len(errors["r/c"]) == 200
    assert errors["r/d"] == '{"id":"x","custom_id":"d","error":"gone"}'
    row = complete.head()
    assert (row["items"], row["upserted"], row["finished"]) == (4, 2, True)


def test_malformed_line_fails_the_job(spark, tmp_path):
    lines = readers.read_result_lines(spark, write_lines(tmp_path, [*LINES, "{broken"]))
    with pytest.raises(Exception, match="(?i)malformed"):
        batches.parse_results(lines).collect()


@pytest.mark.parametrize(
    ("items", "done", "finished"), [(49, 20, True), (50, 49, False), (100, 99, True), (100, 98, False)]
)
def test_completeness_rule(spark, items, done, finished):
    ledger = spark.createDataFrame([("b", None, str(i), "r", "h") for i in range(items)], schemas.BATCH_ITEM)
    results = spark.createDataFrame([(str(i), [1.0]) for i in range(done)], "id string, vector array<float>")
    assert batches.completeness(ledger, results).head()["finished"] is finished


def test_dispositions_and_in_flight(spark):
    states = ["completed", "completed", "in_progress", "validating", "failed", "expired", "cancelled"]
    ledger = spark.createDataFrame([(f"b{i}", None, f"i{i}", "r", "h") for i in range(7)], schemas.BATCH_ITEM)
    statuses = spark.createDataFrame(
        [(f"b{i}", s, "f" if i == 0 else None, None, None) for i, s in enumerate(states)], schemas.BATCH_STATUS
    )
    unknown = batches.dispositions(ledger, statuses.where("false")).collect()
    assert {r["action"] for r in unknown} == {"poll"}
    found = {r["batch_id"]: r["action"] for r in batches.dispositions(ledger, statuses).collect()}
    assert [found[f"b{i}"] for i in range(7)] == ["download", "remove", "poll", "poll", *["remove"] * 3]
    assert {r["id"] for r in batches.in_flight_ids(ledger, statuses).collect()} == {"i0", "i2", "i3"}
    removed = batches.dispositions(ledger, statuses).where("action = 'remove'")
    assert batches.open_ledger(ledger, removed).count() == 3


def test_request_lines_and_jobs(spark):
    text = 'quote " line\nend é😀'
    items = spark.createDataFrame([("i1", text)], "id string, content string")
    (row,) = batches.request_lines(items, "m", 8).collect()
    assert json.loads(row["value"]) == {
        "custom_id": "i1", "method": "POST", "url": "/v1/embeddings",
        "body": {"model": "m", "input": text, "dimensions": 8},
    }
    records = spark.createDataFrame([(f"r/{i}", f"text number {i}") for i in range(25)], "repo_name string, content string")
    none = spark.createDataFrame([], "id string")
    jobs = plan_batches(records, none, none, rows=10)
    assert sorted(r["count"] for r in jobs.groupBy("chunk").count().collect()) == [5, 10, 10]
    made = jobs.select("chunk").distinct().select("chunk", F.lit("b").alias("batch_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    assert batches.ledger_rows(jobs, made).count() == 25


def test_progress_takes_the_latest(spark, tmp_path):
    path = str(tmp_path / "progress")
    for last_id, day in [(50, 1), (20, 3), (90, 2)]:
        row = spark.sql(f"SELECT 't' AS table_name, {last_id}L AS last_id, TIMESTAMP_NTZ '2024-01-0{day}' AS saved_at")
        writers.append_progress(row, path)
    latest = batches.latest_progress(spark.read.parquet(path), "table_name", "last_id", "saved_at")
    assert latest.head()["last_id"] == 20


def test_response_order(spark):
    data = [([2.0], 1), ([3.0], 2), ([1.0], 0)]
    df = spark.createDataFrame([(data,)], "data array<struct<embedding:array<float>,index:int>>")
    assert batches.response_vectors(df).head()["vectors"] == [[1.0], [2.0], [3.0]]


def test_stream_ingest_resumes(spark, tmp_path):
    source, root, state = (str(tmp_path / n) for n in ("in", "index", "state"))
    embedder = Embedder(lambda key: lambda texts: ([[float(len(t))] for t in texts], 1), dimension=1)

    def arrive(*texts):
        rows = [("h", f"r/{t[:3]}", t) for t in texts]
        spark.createDataFrame(rows, schemas.README_RECORD).coalesce(1).write.mode("append").json(source)
        start_ingest(read_record_stream(spark, source, 1), root, embedder, state).awaitTermination()
        return read_index(spark, root).count()

    assert arrive("first long text", "second long text") == 2
    assert arrive("first long text", "third long text") == 3
    assert arrive("short") == 3


def test_late_client_is_forgotten_only_when_asked(spark):
    from repolumen.streaming import quota

    stream = spark.readStream.format("rate").load().select(
        F.col("value").alias("event_id"), F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        F.lit("c").alias("forwarded_for"), F.lit(None).cast("string").alias("api_key"), F.lit("/").alias("path"),
    )
    assert quota.stream_quota(stream).isStreaming
    assert quota.stream_quota(stream, late=timedelta(hours=1)).isStreaming


def test_scratch_tables_go_with_their_scope_but_stay_after_an_error(spark):
    from pathlib import Path

    from repolumen.session import cut_lineage, scratch_scope

    with scratch_scope(spark):
        df = cut_lineage(spark.range(3), "probe")
        (file, *_) = df.inputFiles()
        assert df.count() == 3
    folder = Path(file.removeprefix("file://")).parent
    assert not folder.exists()
    with pytest.raises(RuntimeError), scratch_scope(spark):
        kept = cut_lineage(spark.range(3), "probe")
        raise RuntimeError
    assert kept.count() == 3


def test_compaction_stream_follows_the_ingest_stream(spark, tmp_path):
    from repolumen.operators import index
    from repolumen.streaming.ingest import start_compaction

    root, state = str(tmp_path / "index"), str(tmp_path / "state")
    schema = "id string, vector array<float>, repo_name string, content_hash string"
    for i in range(4):
        points = spark.createDataFrame([(f"{i}-{j}", [1.0], "r", "h") for j in range(50)], schema)
        index.append_points(spark, root, points, 1)
    start_compaction(spark, root, state, most_segments=2).awaitTermination()
    made = index.current_manifest(spark, root)
    assert [s.kind for s in made.segments] == [index.BASE] and index.read_index(spark, root).count() == 200
    start_compaction(spark, root, state, most_segments=2).awaitTermination()
    assert index.current_manifest(spark, root) == made


def test_stream_ingest_input_is_written_in_as_many_files_as_the_table_has_splits(spark, tmp_path, monkeypatch):
    from repolumen.registry import stream_queries

    rows = [(i, f"text number {i} of many words {i * 7919}", "en", "s", 30) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    used, write = [], stream_queries.writers.write_readme_records
    monkeypatch.setattr(
        stream_queries.writers, "write_readme_records", lambda df, path: (used.append(df.rdd.getNumPartitions()), write(df, path))
    )
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a split for each file
    try:
        assert stream_queries.stream_ingest(spark, str(tmp_path)).count() == 400
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert used == [9]
