"""Request quota per client over a request log.

A client's window opens at its first request and lasts a fixed time; a request
at exactly the end is still inside. The first ``limit`` requests of a window are
allowed, blocked ones do not move it. The windows are anchored, not aligned, so
each depends on the one before.

Most clients are walked whole, many at a time. A client with very many requests
is split: time is cut into spans, each span is summarised on its own as "window
coming in -> window going out". Such summaries compose: those of neighbouring spans
become one, level by level, until few are left. From the top down every level then
learns with which window its spans begin, and at last all spans are walked in
parallel. No task chains more than a bounded number of spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repolumen.functions.text import unicode_trim
from repolumen.functions.times import micros_of, span_of
from repolumen.session import cut_lineage

# Quota of anonymous clients and addresses outside it.
ANON_LIMIT = 10
WINDOW = timedelta(minutes=1)
OPEN_PATHS = ("/health", "/stats")
UNKNOWN_CLIENT = "unknown"

SPLIT_ROWS = 250_000  # requests of one client that are walked by one task at most
SPAN_WINDOWS = 64  # windows per span
FAN = 64  # spans whose summaries become one on the next level
BROADCAST_CLIENTS = 500_000
CHUNK_ROWS = 50_000
STATE_BUCKETS = 1024  # groups of clients whose stream state is one row
_NEVER = np.iinfo(np.int64).min


def _micros(delta: timedelta) -> int:
    return delta // timedelta(microseconds=1)


def client_of(forwarded_for: Column) -> Column:
    """First forwarded address, trimmed, else ``unknown``."""
    first = unicode_trim(F.split(forwarded_for, ",")[0])
    return F.when(F.length(forwarded_for) > 0, first).otherwise(UNKNOWN_CLIENT)


def classify_requests(requests: DataFrame, valid_keys: Iterable[str] = ()) -> DataFrame:
    """Client and kind of each request: ``exempt`` path, valid ``key``, or ``limited``."""
    keys = [k for k in valid_keys if k]
    has_key = F.col("api_key").isin(*keys) if keys else F.lit(False)
    kind = (
        F.when(F.col("path").isin(*OPEN_PATHS), "exempt")
        .when(F.coalesce(has_key, F.lit(False)), "key")
        .otherwise("limited")
    )
    return requests.select(
        "event_id",
        micros_of(F.col("ts")).alias("ts_us"),
        client_of(F.col("forwarded_for")).alias("client"),
        kind.alias("kind"),
    )


def _chunks(batches: Iterable[pd.DataFrame], key: str = "span") -> Iterator[pd.DataFrame]:
    """Sorted rows in pieces of many whole runs of one (client, ``key``)."""
    held, size, enough = [], 0, CHUNK_ROWS
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < enough:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = (rows["client"] == rows["client"].iat[-1]) & (rows[key] == rows[key].iat[-1])
        cut = int(last.to_numpy().argmax())
        if cut:
            yield rows[:cut]
        held, size = [rows[cut:]], len(rows) - cut
        enough = max(CHUNK_ROWS, 2 * size)  # a long run is looked at again when it has doubled
    if size:
        yield pd.concat(held, ignore_index=True)


class _Runs:
    """Rows of many runs, and for each the first row past the window it would open."""

    def __init__(self, rows: pd.DataFrame, window: int):
        clients, spans = rows["client"].to_numpy(), rows["span"].to_numpy()
        self.times = rows["ts_us"].to_numpy()
        changes = (clients[1:] != clients[:-1]) | (spans[1:] != spans[:-1])
        self.starts = np.append(0, np.flatnonzero(changes) + 1)
        self.stops = np.append(self.starts[1:], len(rows))
        self.run = np.repeat(np.arange(len(self.starts)), self.stops - self.starts)
        # Runs laid out one after the other on a single axis, further apart than a window.
        since = self.times - self.times.min()
        pitch = int(since.max()) + window + 1
        per_search = max(1, (1 << 62) // pitch)
        self.following = np.empty(len(rows), dtype=np.int64)
        for first in range(0, len(self.starts), per_search):
            low = self.starts[first]
            high = self.stops[min(first + per_search, len(self.starts)) - 1]
            axis = (self.run[low:high] - first) * pitch + since[low:high]
            self.following[low:high] = low + np.searchsorted(axis, axis + window, "right")

    def anchors(self) -> np.ndarray:
        """For every row the row that opened its window, if each run's first row opens one."""
        opens = np.zeros(len(self.times), dtype=np.int64)
        at, stops = self.starts, self.stops
        while len(at):
            opens[at] = at
            at = self.following[at]
            inside = at < stops
            at, stops = at[inside], stops[inside]
        return np.maximum.accumulate(opens)

    def last_anchor(self, at: np.ndarray) -> np.ndarray:
        """The row that opened the last window of its run, if ``at`` opens one."""
        stops = self.stops[self.run[at]]
        while True:
            after = self.following[at]
            moved = np.where(after < stops, after, at)
            if (moved == at).all():
                return at
            at = moved


def _resolve(batches: Iterable[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Window end and rank inside it for every request.

    A row that is not ``real`` stands for the window a span starts with: it lies
    where that opened, and weighs as many requests as it had.
    """
    for rows in _chunks(batches):
        anchor = _Runs(rows, window).anchors()
        weight = rows["weight"].to_numpy()
        total = np.cumsum(weight)
        out = pd.DataFrame(
            {
                "event_id": rows["event_id"].to_numpy(),
                "client": rows["client"].to_numpy(),
                "end_us": rows["ts_us"].to_numpy()[anchor] + window,
                "rank": total - total[anchor] + weight[anchor],
            }
        )
        yield out[rows["real"].to_numpy()]


def _summaries(batches: Iterable[pd.DataFrame], window: int, span: int) -> Iterator[pd.DataFrame]:
    """Per span: which window is open at its end, for every way it may be entered."""
    for rows in _chunks(batches):
        runs = _Runs(rows, window)
        times, spans, index = runs.times, rows["span"].to_numpy(), np.arange(len(rows))
        # A window coming in ends within one window length of the span's start, so
        # the next one opens at a row up to there or at the first row after it.
        early = times <= spans * span + window
        is_start = np.zeros(len(rows), dtype=bool)
        is_start[runs.starts] = True
        after_early = ~early & (is_start | np.append(False, early[:-1]))
        first_of_time = is_start | np.append(True, times[1:] != times[:-1])
        entry = index[(early | after_early) & first_of_time]
        last = runs.last_anchor(entry)
        run = runs.run[entry]
        # Of neighbours that end in the same window the last one stands for all.
        differs = np.append((last[1:] != last[:-1]) | (run[1:] != run[:-1]), True)
        entry, last, run = entry[differs], last[differs], run[differs]
        yield pd.DataFrame(
            {
                "client": rows["client"].to_numpy()[entry],
                "span": spans[entry],
                "entry": times[entry],
                "end_out": times[last] + window,
                "count_out": runs.stops[run] - last,
                "rows": runs.stops[run] - runs.starts[run],
            }
        )


def _tables(rows: pd.DataFrame) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """``span`` and the columns of its summary, for sorted rows of one client."""
    columns = [rows[c].to_numpy() for c in ("entry", "end_out", "count_out", "rows")]
    spans = rows["span"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(spans)) + 1).tolist(), len(spans)]
    for start, end in zip(cuts, cuts[1:]):
        yield int(spans[start]), tuple(c[start:end] for c in columns)


def _pass(table: tuple[np.ndarray, ...], end: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows open after a span, for windows ``end`` with ``count`` requests open before it."""
    entry, end_out, count_out, rows = table
    at = np.searchsorted(entry, end, "right")
    opens, at = at < len(entry), np.minimum(at, len(entry) - 1)
    return np.where(opens, end_out[at], end), np.where(opens, count_out[at], count + rows[0])


def _composed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One summary for all spans of each (client, ``up``), of the same form."""
    for rows in _chunks(batches, "up"):
        out = []
        for (client, up), own in rows.groupby(["client", "up"], sort=False):
            (_, (entry, end, count, n)), *later = _tables(own)
            total = int(n[0]) + sum(int(t[3][0]) for _, t in later)
            if later:
                # A window that covers the first span ends before the second: its first row opens the next.
                entry = np.append(entry, later[0][1][0][0])
                end, count = np.append(end, _NEVER), np.append(count, 0)
            for _, table in later:
                end, count = _pass(table, end, count)
            differs = np.append((end[1:] != end[:-1]) | (count[1:] != count[:-1]), True)
            out.append(
                pd.DataFrame({"client": client, "span": up, "entry": entry[differs], "end_out": end[differs],
                              "count_out": count[differs], "rows": total})
            )
        yield pd.concat(out)


def _started(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The window each span of a (client, ``up``) starts with, from that with which ``up`` does."""
    for rows in _chunks(batches, "up"):
        out = []
        for (client, _), own in rows.groupby(["client", "up"], sort=False):
            first = own["end_in"].iat[0]
            known = not pd.isna(first)
            end = np.array([int(first) if known else _NEVER])
            count = np.array([int(own["count_in"].iat[0]) if known else 0])
            for span, table in _tables(own):
                if end[0] != _NEVER:
                    out.append((client, span, int(end[0]), int(count[0])))
                end, count = _pass(table, end, count)
        yield pd.DataFrame(out, columns=["client", "span", "end_in", "count_in"])


_RANKED = "event_id long, client string, end_us long, rank long"
_ROW = ("client", "span", "ts_us", "event_id", "weight", "real")


def _walk(rows: DataFrame, window: int) -> DataFrame:
    """Rank all rows; those of one (client, span) are in one task, in time order."""
    return (
        rows.select(*_ROW)
        .repartition("client", "span")
        .sortWithinPartitions("client", "span", "ts_us", "event_id")
        .mapInPandas(lambda batches: _resolve(batches, window), _RANKED)
    )


_SUMMARY = "client string, span long, entry long, end_out long, count_out long, rows long"
_START = "client string, span long, end_in long, count_in long"


def _levels(summaries: DataFrame) -> list[DataFrame]:
    """The summaries, then those of ever more spans, until no client has many."""
    levels = [cut_lineage(summaries, "span-summaries")]
    while True:
        reach = levels[-1].groupBy("client").agg((F.max("span") - F.min("span")).alias("n"))
        if (reach.agg(F.max("n")).first()[0] or 0) <= FAN:
            return levels
        upper = (
            levels[-1]
            .withColumn("up", span_of(F.col("span"), FAN))
            .repartition("client", "up")
            .sortWithinPartitions("client", "up", "span", "entry")
            .mapInPandas(_composed, _SUMMARY)
        )
        levels.append(cut_lineage(upper, "span-summaries"))


def _span_starts(rows: DataFrame, window: int, span: int) -> DataFrame:
    """The window each span of a split client starts with, as one more row of it."""
    summaries = (
        rows.select("client", "span", "ts_us")
        .repartition("client", "span")
        .sortWithinPartitions("client", "span", "ts_us")
        .mapInPandas(lambda batches: _summaries(batches, window, span), _SUMMARY)
    )
    *lower, top = _levels(summaries)
    nothing = F.lit(None).cast("long")
    begun = top.withColumns({"up": F.lit(0).cast("long"), "end_in": nothing, "count_in": nothing})
    while True:
        ordered = begun.repartition("client", "up").sortWithinPartitions("client", "up", "span", "entry")
        starts = ordered.mapInPandas(_started, _START)
        if not lower:
            break
        above = cut_lineage(starts, "span-starts").withColumnRenamed("span", "up")
        begun = lower.pop().withColumn("up", span_of(F.col("span"), FAN)).join(above, ["client", "up"], "left")
    return starts.select(
        "client",
        "span",
        (F.col("end_in") - window).alias("ts_us"),
        F.lit(0).cast("long").alias("event_id"),
        F.col("count_in").alias("weight"),
        F.lit(False).alias("real"),
    )


def _verdicts(ranked: DataFrame, others: DataFrame, limit: int) -> DataFrame:
    allowed = F.col("rank") <= limit
    limited = ranked.select(
        "event_id",
        "client",
        F.when(allowed, "allowed").otherwise("blocked").alias("verdict"),
        F.greatest(F.lit(limit) - F.col("rank"), F.lit(0)).cast("long").alias("remaining"),
        F.timestamp_micros("end_us").cast("timestamp_ntz").alias("reset_at"),
    )
    free = others.select(
        "event_id",
        "client",
        F.col("kind").alias("verdict"),
        F.lit(-1).cast("long").alias("remaining"),
        F.lit(None).cast("timestamp_ntz").alias("reset_at"),
    )
    return limited.unionByName(free)


def apply_quota(
    requests: DataFrame,
    limit: int = ANON_LIMIT,
    window: timedelta = WINDOW,
    valid_keys: Iterable[str] = (),
    split_rows: int = SPLIT_ROWS,
    span_windows: int = SPAN_WINDOWS,
) -> DataFrame:
    """Verdict per request: ``event_id, client, verdict, remaining, reset_at``.

    Counts the requests per client when called, to know which ones to split.
    """
    width = _micros(window)
    span = width * span_windows
    classed = classify_requests(requests, valid_keys)
    limited = classed.where(F.col("kind") == "limited").select(
        "client",
        "ts_us",
        "event_id",
        F.lit(1).cast("long").alias("weight"),
        F.lit(True).alias("real"),
    )
    others = classed.where(F.col("kind") != "limited")
    counts = limited.groupBy("client").agg(F.count("*").alias("n"))
    busy = cut_lineage(counts.where(F.col("n") > split_rows).select("client"), "busy-clients")
    n_busy = busy.count()
    whole = limited.withColumn("span", F.lit(0).cast("long"))
    if not n_busy:
        return _verdicts(_walk(whole, width), others, limit)
    if n_busy <= BROADCAST_CLIENTS:
        busy = F.broadcast(busy)
    spans = limited.join(busy, "client", "left_semi").withColumn(
        "span", span_of(F.col("ts_us"), span)
    )
    starts = _span_starts(spans, width, span)
    quiet = whole.join(busy, "client", "left_anti")
    rows = [df.select(*_ROW) for df in (quiet, spans, starts)]
    return _verdicts(_walk(reduce(DataFrame.unionByName, rows), width), others, limit)


def stream_quota(
    requests: DataFrame,
    limit: int = ANON_LIMIT,
    window: timedelta = WINDOW,
    valid_keys: Iterable[str] = (),
    late: timedelta | None = None,
    buckets: int = STATE_BUCKETS,
) -> DataFrame:
    """The same verdicts on a stream: two numbers of state per client.

    Clients share the state of their bucket, and all requests of a bucket are decided in
    one call: calls do not grow with the clients. The number of ``buckets`` stays as it is
    while a checkpoint lives. Requests of one trigger are taken in time order; bound a
    trigger's size at the source. With ``late``, a client is forgotten once its window is
    that far in the past, and requests arriving later than that are dropped by the
    watermark; without it all clients are kept and nothing is dropped.
    """
    width = _micros(window)

    def decide(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the last window of the bucket is past
            state.remove()
            return
        rows = pd.concat(batches)[["client", "ts_us", "event_id"]].assign(weight=1, real=True)
        clients, ends, counts = state.get if state.exists else ([], [], [])
        kept = pd.DataFrame(
            {"client": pd.Series(clients, dtype=object), "end_us": np.array(ends, dtype=np.int64), "rank": np.array(counts, dtype=np.int64)}
        )
        asking = kept["client"].isin(rows["client"].unique())
        open_windows = kept[asking].rename(columns={"rank": "weight"})
        open_windows = open_windows.assign(ts_us=open_windows.pop("end_us") - width, event_id=0, real=False)
        if len(open_windows):
            rows = pd.concat([open_windows[rows.columns], rows], ignore_index=True)
        rows = rows.sort_values(["client", "real", "ts_us", "event_id"], ignore_index=True).assign(span=0)
        out = pd.concat(_resolve([rows], width))
        kept = kept[~asking]
        if late is not None:
            kept = kept[kept["end_us"] // 1000 >= state.getCurrentWatermarkMs()]
        last = out.drop_duplicates("client", keep="last")[kept.columns]
        kept = pd.concat([kept, last]) if len(kept) else last
        state.update(tuple(kept[c].tolist() for c in kept.columns))
        if late is not None:
            past_end = int(kept["end_us"].max()) // 1000 + 1
            state.setTimeoutTimestamp(max(past_end, state.getCurrentWatermarkMs() + 1))
        yield out

    classed = classify_requests(requests, valid_keys)
    limited = classed.where(F.col("kind") == "limited")
    if late is not None:
        limited = limited.withColumn("at", F.timestamp_micros("ts_us")).withWatermark(
            "at", f"{_micros(late)} microseconds"
        )
    ranked = (
        limited.withColumn("bucket", F.pmod(F.xxhash64("client"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(
            decide,
            _RANKED,
            "client array<string>, end_us array<long>, rank array<long>",
            "append",
            GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout,
        )
    )
    return _verdicts(ranked, classed.where(F.col("kind") != "limited"), limit)
