"""Quota windows, bursts and health against plain loops."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repolumen.streaming import bursts, health, quota

START = datetime(2024, 1, 1)


def loop_quota(rows, limit, window):
    """(event_id -> (verdict, remaining, reset_at)) one request after the other."""
    state, out = {}, {}
    for event_id, ts, client in sorted(rows, key=lambda r: (r[1], r[0])):
        count, reset = state.get(client, (0, None))
        if reset is None or ts > reset:
            count, reset = 0, ts + window
        count += 1
        state[client] = (count, reset)
        out[event_id] = ("allowed" if count <= limit else "blocked", max(limit - count, 0), reset)
    return out


def requests_of(spark, rows):
    data = [(i, t, c if c != "unknown" else None, None, "/search") for i, t, c in rows]
    return spark.createDataFrame(
        data, "event_id long, ts timestamp_ntz, forwarded_for string, api_key string, path string"
    )


@pytest.mark.parametrize(
    ("split_rows", "span_windows", "fan"), [(10**6, 64, 64), (500, 1, 64), (500, 2, 3), (500, 64, 64), (20, 1, 2), (20, 2, 4)]
)
def test_batch_equals_loop(spark, monkeypatch, split_rows, span_windows, fan):
    monkeypatch.setattr(quota, "FAN", fan)
    rng = np.random.default_rng(split_rows + span_windows)
    rows = []
    for i in range(3000):
        # A third of all rows belong to one client; times repeat.
        client = "unknown" if rng.random() < 0.34 else f"10.0.0.{rng.integers(25)}"
        rows.append((i, START + timedelta(seconds=int(rng.integers(6000))), client))
    window = timedelta(seconds=60)
    found = quota.apply_quota(
        requests_of(spark, rows), 10, window, split_rows=split_rows, span_windows=span_windows
    )
    got = {r["event_id"]: (r["verdict"], r["remaining"], r["reset_at"]) for r in found.collect()}
    assert got == loop_quota(rows, 10, window)


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
@pytest.mark.parametrize("batch", [3, 50])
def test_runs_are_never_cut(monkeypatch, chunk, batch):
    monkeypatch.setattr(quota, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(chunk)
    rows = sorted((f"c{rng.integers(9)}", 0, int(rng.integers(900)) * 10**6, i) for i in range(400))
    frame = pd.DataFrame(rows, columns=["client", "span", "ts_us", "event_id"]).assign(weight=1, real=True)
    parts = [frame[i : i + batch] for i in range(0, len(frame), batch)]
    out = pd.concat(quota._resolve(parts, 60 * 10**6))
    want = loop_quota([(i, START + timedelta(microseconds=t), c) for c, _, t, i in rows], 10, timedelta(seconds=60))
    got = {e: (r, START + timedelta(microseconds=u)) for e, r, u in zip(out["event_id"], out["rank"], out["end_us"])}
    assert {e: (max(10 - r, 0), end) for e, (r, end) in got.items()} == {e: w[1:] for e, w in want.items()}


def test_window_ends_after_its_last_moment(spark):
    at = [0, *range(1, 11), 60, 61]
    rows = [(i, START + timedelta(seconds=s), "c") for i, s in enumerate(at)]
    found = quota.apply_quota(requests_of(spark, rows)).orderBy("event_id").collect()
    assert [r["verdict"] for r in found] == ["allowed"] * 10 + ["blocked", "blocked", "allowed"]
    assert found[-1]["remaining"] == 9


def test_clients_keys_and_open_paths(spark):
    rows = [
        (1, START, " 1.2.3.4 , 9.9.9.9", None, "/search"),
        (2, START, None, None, "/search"),
        (3, START, "", None, "/search"),
        (4, START, "5.5.5.5", "good", "/search/full"),
        (5, START, "5.5.5.5", "bad", "/search/full"),
        (6, START, "5.5.5.5", None, "/health"),
        (7, START, "5.5.5.5", None, "/stats"),
    ]
    df = spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, forwarded_for string, api_key string, path string"
    )
    found = quota.apply_quota(df, valid_keys=("good", "")).orderBy("event_id").collect()
    assert [r["client"] for r in found][:3] == ["1.2.3.4", "unknown", "unknown"]
    assert [r["verdict"] for r in found] == ["allowed"] * 3 + ["key", "allowed", "exempt", "exempt"]
    assert [r["remaining"] for r in found] == [9, 9, 8, -1, 9, -1, -1]


def test_bursts_keep_the_query_before_a_pause(spark):
    at = [0, 299, 599, 899, 1200, 100_000]
    rows = [(1, START + timedelta(milliseconds=m), i, f"q{i}") for i, m in enumerate(at)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, query string")
    for span_pauses in (1, 2, 4096):
        found = bursts.collapse_bursts(df, span_pauses=span_pauses).orderBy("event_id").collect()
        assert [r["query"] for r in found] == ["q1", "q2", "q3", "q4", "q5"]


def test_bursts_equal_loop_for_a_busy_user(spark):
    rng = np.random.default_rng(5)
    at = np.sort(rng.integers(0, 400_000, 1500))
    users = np.where(rng.random(1500) < 0.5, 1, rng.integers(2, 9, 1500))
    rows = [(int(u), START + timedelta(milliseconds=int(m)), i, f"q{i}") for i, (u, m) in enumerate(zip(users, at))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, query string")
    found = {r["event_id"] for r in bursts.collapse_bursts(df, span_pauses=3).collect()}
    want = set()
    for user in set(users.tolist()):
        mine = [r for r in rows if r[0] == user]
        for row, after in zip(mine, [*mine[1:], None]):
            if after is None or after[1] - row[1] >= timedelta(milliseconds=300):
                want.add(row[2])
    assert found == want


def test_health_equals_loop(spark):
    rng = np.random.default_rng(9)
    rows = [
        (f"s{0 if i % 3 else i % 7}", START + timedelta(minutes=i), i, float(rng.integers(10, 15_001)))
        for i in range(2500)
    ]
    df = spark.createDataFrame(rows, "source string, ts timestamp_ntz, event_id long, ms double")
    state, want = {}, {}
    for source, _, event_id, ms in rows:
        state[source] = state.get(source, 1000.0) * 0.8 + ms * 0.2
        want[event_id] = state[source]
    history = {r["event_id"]: r["health_ms"] for r in health.health_history(df).collect()}
    assert history == pytest.approx(want, abs=1e-8)
    now = {r["source"]: r["health_ms"] for r in health.current_health(df).collect()}
    assert now == pytest.approx(state, abs=1e-8)


def test_summaries_of_a_busy_client_compose(spark, monkeypatch):
    """Gaps, covered spans and bursts of a single client, over several levels of summaries."""
    monkeypatch.setattr(quota, "FAN", 2)
    rng = np.random.default_rng(11)
    at = np.concatenate([rng.integers(0, 3000, 700), rng.integers(9000, 9100, 200), 60 * np.arange(100, 140), rng.integers(20_000, 40_000, 300)])
    rows = [(i, START + timedelta(seconds=int(s)), "hot") for i, s in enumerate(at)]
    found = quota.apply_quota(requests_of(spark, rows), 3, timedelta(seconds=60), split_rows=10, span_windows=1)
    got = {r["event_id"]: (r["verdict"], r["remaining"], r["reset_at"]) for r in found.collect()}
    assert got == loop_quota(rows, 3, timedelta(seconds=60))


def test_health_of_one_busy_source_is_spread_over_tasks(spark):
    rows = spark.range(100_000).select(
        F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise("only").alias("source"),
        F.timestamp_seconds(F.col("id") % 70_000).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("event_id"),
        (F.xxhash64("id") % 5000 + 5000).cast("double").alias("ms"),
    )
    folds = health._local_folds(rows).groupBy("source", "part").count().collect()
    assert len([r for r in folds if r["source"] == "only"]) >= 3
    state, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r["ts"], r["event_id"])):
        state[r["source"]] = state.get(r["source"], 1000.0) * 0.8 + r["ms"] * (1 - 0.8)
        want[r["event_id"]] = state[r["source"]]
    found = {r["event_id"]: r["health_ms"] for r in health.health_history(rows).collect()}
    assert len(found) == 100_000 and max(abs(found[i] - x) for i, x in want.items()) < 1e-8
    now = {r["source"]: r["health_ms"] for r in health.current_health(rows).collect()}
    assert now == pytest.approx(state, abs=1e-8)


def test_stream_shares_state_by_bucket(spark, tmp_path):
    day = 86_400_000_000
    schema = "event_id long, ts timestamp_ntz, forwarded_for string, api_key string, path string"
    rows = [
        (n, c, (n * 7 + c * 3) * 3_600_000_000 // 4 + (0 if n < 40 else 5 * day)) for c in range(30) for n in range(60) if (n + c) % 3
    ]
    made = [
        (1000 * c + n, datetime(2024, 1, 1) + timedelta(microseconds=at), f"10.0.0.{c}", None, "/search") for n, c, at in rows
    ]
    made.sort(key=lambda r: r[1])
    for i in range(3):  # a micro-batch each; some clients pause for days and are forgotten
        part = made[i * len(made) // 3 : (i + 1) * len(made) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = quota.stream_quota(stream, 2, timedelta(hours=6), late=timedelta(days=1), buckets=2)
    writer = found.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    query = writer.start(f"{tmp_path}/out", format="parquet")
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 2
    want = quota.apply_quota(spark.createDataFrame(made, schema), 2, timedelta(hours=6))
    read = spark.read.schema(found.schema).parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, want.collect()))
