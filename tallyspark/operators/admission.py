"""Sliding-window admission: at most ``budget`` accepted requests per key in any window.

Whether a request is accepted depends on earlier acceptances, but seldom on many of them. A request that has at most
``budget`` requests of its key in its window, itself included, is accepted whatever came before: window functions find
all of those. Only the others, with what lies within one window of them, have to be walked in time order. They form
islands, which know nothing of each other, and a task streams through an island keeping nothing but ``budget`` times. Every
request is looked at once. The window functions run over stretches of time that overlap, so a hot key is many groups.
An island as long as its key, of a key over its budget all the time, is one stream through one task: there each
acceptance does depend on the one before.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark import fixed
from tallyspark.session import stored

SECOND = 1_000_000
HITS = "key string, ts_us bigint, seq bigint, budget int"
CARRY = "key string, live array<bigint>"
_DECISIONS = "key string, seq bigint, ts_us bigint, at_us bigint, admitted boolean, retry_after bigint"
# length of a stretch of time, in windows; it copies what lies within three windows of its edges
STRETCH = 64
_BEHIND, _AHEAD = 3, 1


def hits(events: DataFrame, key: Column, ts: Column, seq: Column, budget: Column) -> DataFrame:
    """Requests in the shape the operators here take; ``ts`` may be any timestamp type."""
    return events.select(
        key.cast("string").alias("key"),
        F.unix_micros(ts.cast("timestamp")).alias("ts_us"),
        seq.cast("bigint").alias("seq"),
        budget.cast("int").alias("budget"),
    )


def bucket_key(is_upload: Column, client: Column) -> Column:
    """Uploads and other requests of a client count separately."""
    return F.concat(F.when(is_upload, "u:").otherwise("g:"), client.cast("string"))


def bucket_budget(is_upload: Column) -> Column:
    return F.when(is_upload, fixed.RATE_BUDGET_UPLOAD).otherwise(fixed.RATE_BUDGET_GENERAL)


def _pass_over(ts: np.ndarray, budget: np.ndarray, live: deque, window_us: int):
    """Accept or reject one run of requests in time order; changes ``live``.

    Returns which were accepted and, for the others, the oldest accepted time that blocks them.
    """
    admitted = np.zeros(len(ts), dtype=bool)
    blocker = np.zeros(len(ts), dtype=np.int64)
    i = 0
    while i < len(ts):
        now = ts[i]
        while live and live[0] < now - window_us:
            live.popleft()
        if len(live) < budget[i]:
            admitted[i] = True
            live.append(int(now))
            i += 1
            continue
        # nothing is accepted before the oldest time leaves the window or a request with a larger budget comes
        stop = int(np.searchsorted(ts, live[0] + window_us, side="right"))
        larger = budget[i:stop] > len(live)
        if larger.any():
            stop = i + int(larger.argmax())
        blocker[i:stop] = live[0]
        i = stop
    return admitted, blocker


def _walker(window_us: int):
    """Arrow function over rows sorted by key, island and time; carried times come before requests."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, live = None, deque()
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            keys, islands, given, at, budget = [column(c) for c in ("key", "island", "given", "at_us", "budget")]
            admitted, blocker = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (islands[1:] != islands[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)]):
                if start == stop:
                    continue
                if (keys[start], islands[start]) != current:
                    current, live = (keys[start], islands[start]), deque()
                first = start + int(given[start:stop].sum())
                live.extend(int(t) for t in at[start:first])
                if first < stop:
                    run = slice(first, stop)
                    admitted[run], blocker[run] = _pass_over(at[run], budget[run], live, window_us)
            # whole seconds, cut towards zero
            wait = np.maximum(1, (window_us - (at - blocker)) // SECOND)
            names = ["key", "seq", "ts_us", "at_us"]
            decided = pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(admitted), pa.array(wait, pa.int64(), mask=admitted)],
                names=[*names, "admitted", "retry_after"],
            )
            yield decided.filter(pa.array(~given))

    return walk


def _with_carried(requests: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Requests and carried times as rows with the time they count at, ``at_us``.

    A request older than a time carried for its key comes late and counts at that time.
    """
    rows = requests.withColumns({"at_us": F.col("ts_us"), "given": F.lit(False)})
    if carry is None:
        return rows
    newest = carry.select(F.col("key").alias("_key"), F.array_max("live").alias("_newest"))
    rows = rows.join(newest, F.col("key").eqNullSafe(F.col("_key")), "left")
    rows = rows.withColumn("at_us", F.greatest("ts_us", "_newest")).drop("_key", "_newest")
    times = carry.select("key", F.explode("live").alias("ts_us"))
    null = F.lit(None)
    carried = times.select(
        "key", "ts_us", null.cast("bigint").alias("seq"), null.cast("int").alias("budget"),
        F.col("ts_us").alias("at_us"), F.lit(True).alias("given"),
    )
    return rows.unionByName(carried)


def _islands(rows: DataFrame, window_us: int, stretch: int) -> DataFrame:
    """``rows`` with ``island``: where the island begins that a row is walked in, null for a row that is surely accepted."""
    width = max(stretch, _BEHIND) * window_us
    at, own = F.col("at_us"), F.expr(f"(at_us - pmod(at_us, {width}L)) div {width}L")
    into = at - own * width
    copies = F.array_compact(
        F.array(
            own,
            F.when(into >= width - _BEHIND * window_us, own + 1),
            F.when(into <= _AHEAD * window_us, own - 1),
        )
    )
    spread = rows.withColumn("own", own).withColumn("stretch", F.explode(copies))
    in_time = Window.partitionBy("key", "stretch").orderBy("at_us")
    by_row = Window.partitionBy("key", "stretch").orderBy("at_us", F.desc("given"), "seq")
    # a frame that starts with the group grows by its new rows; one that slides would be added up anew at every row
    upto = lambda value, after: F.coalesce(F.sum(value).over(in_time.rangeBetween(Window.unboundedPreceding, after)), F.lit(0))
    one = F.lit(1)
    crowded = upto(one, Window.currentRow) - upto(one, -window_us - 1) > F.col("budget")
    crowds = F.col("crowded").cast("int")
    near = upto(crowds, window_us) - upto(crowds, -window_us - 1) > 0
    apart = F.lag("walked").over(by_row).isNull() | ~F.lag("walked").over(by_row) | (at - F.lag("at_us").over(by_row) > window_us)
    marked = (
        spread.withColumn("crowded", F.coalesce(crowded, F.lit(False)))
        .withColumn("walked", near)
        .withColumn("start", F.when(F.col("walked") & apart, at))
        .where(F.col("own") == F.col("stretch"))
        .withColumn("begin", F.max("start").over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .drop("own", "crowded")
    )
    marked = stored(marked, "requests")
    # an island that began in an earlier stretch
    last = marked.groupBy("key", "stretch").agg(F.max("start").alias("last"))
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    opened = last.select(F.col("key").alias("_key"), F.col("stretch").alias("_stretch"), F.max("last").over(before).alias("opened"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("stretch") == F.col("_stretch"))
    island = F.when(F.col("walked"), F.coalesce("begin", "opened"))
    return marked.join(opened, same, "left").withColumn("island", island).drop("_key", "_stretch", "opened", "begin", "start")


def _decided(requests: DataFrame, carry: DataFrame | None, window_us: int, stretch: int) -> DataFrame:
    rows = _islands(_with_carried(requests, carry), window_us, stretch)
    sure = rows.where("island IS NULL AND NOT given").select(
        "key", "seq", "ts_us", "at_us", F.lit(True).alias("admitted"), F.lit(None).cast("bigint").alias("retry_after")
    )
    walked = rows.where("island IS NOT NULL").select("key", "island", "at_us", "given", "seq", "ts_us", "budget")
    walked = walked.withColumns({"seq": F.coalesce("seq", F.lit(-1)), "budget": F.coalesce("budget", F.lit(0))})
    ordered = walked.repartition("key", "island").sortWithinPartitions("key", "island", "at_us", F.desc("given"), "seq")
    return sure.unionByName(ordered.mapInArrow(_walker(window_us), _DECISIONS))


def _left_behind(decided: DataFrame, carry: DataFrame | None, window_us: int) -> DataFrame:
    """Accepted times per key in the window before its newest one; keys idle for a whole window are dropped."""
    latest = decided.agg(F.max("at_us")).first()[0]
    times = decided.where("admitted").select("key", F.col("at_us").alias("t"))
    if carry is not None:
        times = times.unionByName(carry.select("key", F.explode("live").alias("t")))
    if latest is not None:
        times = times.where(F.col("t") >= latest - 2 * window_us)
    # two windows hold at most two budgets of accepted times
    kept = times.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("live"))
    kept = kept.withColumn("live", F.filter("live", lambda t: t >= F.array_max("live") - window_us))
    return kept if latest is None else kept.where(F.array_max("live") >= latest - window_us)


def admit_with_state(
    requests: DataFrame, window_seconds: float, stretch: int = STRETCH, carry: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Decisions for ``requests`` (see ``HITS``) and the times each key carries into later requests.

    ``carry(key, live)`` is what an earlier call returned; ``stretch`` is the length in windows of the stretches of time
    that the window functions run over, and changes no decision.
    """
    window_us = int(window_seconds * SECOND)
    decided = stored(_decided(requests, carry, window_us, stretch), "decisions")
    return decided.drop("at_us"), _left_behind(decided, carry, window_us)


def admit(
    requests: DataFrame, window_seconds: float = fixed.RATE_WINDOW_SECONDS, stretch: int = STRETCH
) -> DataFrame:
    """``key, seq, ts_us, admitted, retry_after`` for every request."""
    return _decided(requests, None, int(window_seconds * SECOND), stretch).drop("at_us")
