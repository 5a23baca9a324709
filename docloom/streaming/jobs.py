"""Structured Streaming jobs.

Each takes a streaming DataFrame and returns one; callers choose sink and trigger. State is bounded:
by watermarks, by retention, or by the number of open sessions, jobs and clients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from docloom import rules
from docloom.functions import urls as U
from docloom.operators import corpus
from docloom.session import scratch_dir
from docloom.streaming import stateful
from docloom.streaming.batch import ClientWindow, decide, paired_calls


def _part(column: str) -> Column:
    """The group that a key is handled in."""
    return F.pmod(F.xxhash64(column), F.lit(stateful.PARTS)).cast("int")


def stream_session_fold(events: DataFrame, delay: str = "10 minutes", retention: str = "7 days", ts: str = "ts") -> DataFrame:
    """Running reply, failure and tool calls per session; folding stops at the first turn boundary.

    Emits the session's row whenever a batch changed it (update mode). Events may arrive in any order within ``delay``: one
    that does not follow on the last is folded when the watermark has passed it. ``skipped`` counts events that came behind
    what was folded by then, repeats among them; Spark counts those behind the watermark. What waits and the calls go at the end of a turn, the rest
    when a session was silent for ``retention``. Times of a session must not fall with seq. Needs the RocksDB state store.
    """
    flat = events.withWatermark(ts, delay).select(
        _part("session_id").alias("part"),
        "session_id",
        "seq",
        ts,
        F.unix_micros(ts).alias("us"),
        "type",
        F.col("data.message").alias("message"),
        F.col("data.messageSoFar").alias("so_far"),
        F.col("data.callId").alias("call_id"),
    )
    keep_ms = int(pd.Timedelta(retention).total_seconds() * 1000)
    return flat.groupBy("part").transformWithStateInPandas(
        stateful.SessionFold(keep_ms), stateful.FOLD, "update", "EventTime"
    )


def stream_rolling_usage(
    attempts: DataFrame,
    cooldown_us: int = rules.GENERATION_LIMITS["cooldown_us"],
    delay: str = "10 minutes",
    ts: str = "created_at",
) -> DataFrame:
    """attempt_id, scope, attempts, oldest_us: the trailing usage of every attempt by client hour, client day and repository cooldown.

    The same numbers as ``rolling_usage``, both ends of a window included, once the watermark has passed an attempt. One union of the scopes feeds one state:
    an attempt is a row under its client and one under its repository. Names are dealt into groups that are counted together. Usage of all together is not a key to hold in one
    task; ``stream_usage`` without keys counts it in slides. Needs the RocksDB state store.
    """
    windows = {"client": [("client_hour", rules.HOUR_US), ("client_day", rules.DAY_US)]}
    keys = [F.struct(F.lit("client").alias("kind"), F.col("client_key").alias("name"))]
    if cooldown_us > 0:
        windows["repo"] = [("repo_cooldown", cooldown_us)]
        keys.append(F.struct(F.lit("repo").alias("kind"), F.col("repo_full_name").alias("name")))
    rows = attempts.withWatermark(ts, delay).select("attempt_id", ts, F.unix_micros(ts).alias("us"), F.inline(F.array(*keys)))
    return rows.withColumn("part", _part("name")).groupBy("kind", "part").transformWithStateInPandas(
        stateful.TrailingUsage(windows), stateful.USAGE, "append", "EventTime"
    )


def stream_usage(
    attempts: DataFrame,
    keys: tuple[str, ...] = ("client_key",),
    window: str = "1 hour",
    slide: str = "15 minutes",
    delay: str = "10 minutes",
    ts: str = "created_at",
) -> DataFrame:
    """Attempts per key in sliding windows; the watermark bounds state to the window and the delay."""
    marked = attempts.withWatermark(ts, delay)
    return (
        marked.groupBy(F.window(ts, window, slide).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("attempts"), F.min(ts).alias("oldest"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "attempts", "oldest")
    )


_ADMITTED = "client_key string, attempt_id bigint, ts_us bigint, allowed boolean, scope string"


def stream_admission(
    attempts: DataFrame,
    per_hour: int = rules.GENERATION_LIMITS["client_hour"],
    per_day: int = rules.GENERATION_LIMITS["client_day"],
    delay: str = "10 minutes",
    ts: str = "created_at",
) -> DataFrame:
    """Sequential admission per client, in time order across micro-batches.

    An attempt waits in its client's state until the watermark has passed it, when nothing older can arrive, and is
    decided then, so ``delay`` is also the delay of a decision and bounds what waits. Attempts that arrive
    behind the watermark are dropped and counted by Spark. An idle client's times go a day after the watermark
    passed its last admitted attempt. Clients are dealt into groups, one state and one call a group.
    """
    rows = attempts.withWatermark(ts, delay).select(
        _part("client_key").alias("part"), "client_key", "attempt_id", F.col(ts), F.unix_micros(ts).alias("ts_us")
    )
    columns = ["client_key", "attempt_id", "ts_us"]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, passed = state.get if state.exists else (None, None), state.getCurrentWatermarkMs()
        before, waiting = (stateful.unpacked([h] if h else [], columns) for h in held)
        parts = [] if state.hasTimedOut else [part[columns] for part in batches]
        parts = [f for f in (waiting, *parts) if len(f)]
        waiting = pd.concat(parts, ignore_index=True) if parts else waiting
        ripe = waiting["ts_us"] <= passed * 1000
        left, part = waiting[~ripe], waiting[ripe]
        at, clients = stateful.runs(part["client_key"], part["ts_us"], part["attempt_id"])
        part = part.iloc[at]
        admitted = {name: times.tolist() for name, times in before.groupby("client_key", dropna=False)["ts_us"]}
        names, times = part["client_key"].tolist(), part["ts_us"].to_numpy(np.int64)
        denied = np.empty(len(part), dtype=object)
        for a, b in clients:
            window = ClientWindow(per_hour, per_day, admitted.get(names[a]))
            denied[a:b] = decide(window, times[a:b])
            admitted[names[a]] = window.admitted
        # admitted times over a day behind the watermark deny nothing any more
        admitted = {c: t for c, t in admitted.items() if t and (t[-1] + rules.DAY_US) // 1000 + 1 > passed}
        wakes = [(t[-1] + rules.DAY_US) // 1000 + 1 for t in admitted.values()]
        wakes += [int(left["ts_us"].min()) // 1000 + 1] if len(left) else []
        if wakes:
            kept = pd.DataFrame([(c, t) for c, ts_us in admitted.items() for t in ts_us], columns=["client_key", "ts_us"])
            state.update(tuple(stateful.packed(f) if len(f) else None for f in (kept, left)))
            state.setTimeoutTimestamp(max(min(wakes), passed + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(
            {
                "client_key": names,
                "attempt_id": part["attempt_id"].tolist(),
                "ts_us": times,
                "allowed": denied == "",
                "scope": [d or None for d in denied],
            }
        )

    return rows.groupBy("part").applyInPandasWithState(
        run, _ADMITTED, "admitted binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_pair_calls(
    requests: DataFrame, results: DataFrame, wait_minutes: int = 60, delay: str = "10 minutes"
) -> DataFrame:
    """Requests joined with their result within a bounded wait; unanswered ones come out once the
    watermark has passed the wait."""
    return paired_calls(
        requests.withWatermark("requested_at", delay),
        results.withWatermark("answered_at", delay),
        wait_minutes,
    )


def stream_stale_jobs(
    heartbeats: DataFrame,
    minutes: int = rules.STALE_ACTIVE_MINUTES,
    delay: str = "1 minute",
) -> DataFrame:
    """Jobs that missed their heartbeat for longer than allowed, once per silence.

    A silence ends a session window of Spark's with that gap, so a job is one row of state in the JVM: it comes out when the watermark has passed
    the last heartbeat plus the limit. Heartbeats may arrive in any order within ``delay``; one behind the watermark counts as long as its own limit is not passed.
    """
    width = minutes * 60_000_000
    # a window goes when the watermark reaches its end, a silence counts when it has passed that: one microsecond later
    shifted = heartbeats.select("job_id", F.timestamp_micros(F.unix_micros("ts") + 1).alias("ts")).withWatermark("ts", delay)
    silent = shifted.groupBy("job_id", F.session_window("ts", f"{width} microseconds").alias("w")).agg((F.max(F.unix_micros("ts")) - 1).alias("last_us"))
    return silent.select("job_id", "last_us", (F.col("last_us") + width).alias("failed_us"))


_UNSTARTED = "job_id string, started_us bigint, failed_us bigint"


def stream_unstarted_jobs(
    events: DataFrame,
    minutes: int = rules.STALE_BEFORE_SESSION_MINUTES,
    delay: str = "1 minute",
    retention_minutes: int = 7 * 24 * 60,
) -> DataFrame:
    """Jobs that had no session within ``minutes`` of their first event, once each.

    ``events``: job_id, ts, has_session. An event-time timer fires when the watermark passes the limit, so order within
    ``delay`` does not matter. A settled job is remembered until it has been silent for ``retention_minutes``. Jobs are dealt
    into groups, one state and one call a group.
    """
    width, keep = minutes * 60_000_000, retention_minutes * 60_000_000
    rows = events.withWatermark("ts", delay).select(_part("job_id").alias("part"), "job_id", "ts", F.unix_micros("ts").alias("us"), "has_session")
    never = 2**62

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = [stateful.unpacked([state.get[0]], [])] if state.exists else []
        for part in [] if state.hasTimedOut else batches:
            us = part["us"]
            session = us.where(part["has_session"].astype(bool), never)
            jobs.append(pd.DataFrame({"job_id": part["job_id"], "started": us, "session": session, "last": us, "settled": False}))
        by = pd.concat(jobs, ignore_index=True).groupby("job_id", dropna=False, sort=False)
        jobs = by.agg({"started": "min", "session": "min", "last": "max", "settled": "max"}).reset_index()
        now = state.getCurrentWatermarkMs()
        jobs = jobs[~(jobs["settled"] & ((jobs["last"] + keep) // 1000 + 1 <= now))]
        due = ~jobs["settled"] & (now * 1000 >= jobs["started"] + width)
        failed = jobs[due & (jobs["session"] > jobs["started"] + width)]
        jobs = jobs.assign(settled=jobs["settled"] | due)
        if len(jobs):
            wake = jobs["started"] + width
            wake = wake.where(~jobs["settled"], jobs["last"] + keep)
            state.update((stateful.packed(jobs),))
            state.setTimeoutTimestamp(max(int(wake.min()) // 1000 + 1, now + 1))
        else:
            state.remove()
        if len(failed):
            yield pd.DataFrame({"job_id": failed["job_id"], "started_us": failed["started"], "failed_us": failed["started"] + width})

    return rows.groupBy("part").applyInPandasWithState(run, _UNSTARTED, "jobs binary", "append", GroupStateTimeout.EventTimeTimeout)


def first_copies(pages: DataFrame, delay: str, ts: str) -> DataFrame:
    """The first page of each ``url_key``, by ``ts`` and page_id; later copies drop until the watermark is ``delay`` past it.

    ``dropDuplicatesWithinWatermark`` keeps whichever copy of a micro-batch comes out of the shuffle first. Of a copy only
    the best so far is held.
    """
    known = F.coalesce(ts, F.timestamp_seconds(F.lit(0)))
    order = [F.unix_micros(known).alias("_us"), F.col("page_id").isNull().alias("_late")]
    micros = {c: F.unix_micros(c) for c, kind in pages.dtypes if kind == "timestamp"}  # pandas would move them to local time
    rows = pages.select(
        *[micros[c].alias(c) if c in micros else c for c in pages.columns],
        F.col(ts).alias("_ts"),
        *order,
        F.unix_millis(known + F.expr(f"INTERVAL {delay}")).alias("_until"),
    )

    def rank(row: pd.DataFrame) -> tuple:
        return tuple(row[c].iloc[0] for c in ("_us", "_late", "page_id"))

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else now
        best = None
        for part in batches:
            if until <= now:
                first = part.sort_values(["_us", "_late", "page_id"]).iloc[:1]
                best = first if best is None or rank(first) < rank(best) else best
        if best is not None:
            until = int(best["_until"].iloc[0])
            yield best[columns]
        state.update((until,))
        state.setTimeoutTimestamp(max(until, now + 1))

    columns = pages.columns
    kinds = StructType([StructField(f.name, LongType() if f.name in micros else f.dataType) for f in pages.schema.fields])
    first = rows.groupBy("url_key").applyInPandasWithState(run, kinds, "until bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return first.select(*[F.timestamp_micros(c).alias(c) if c in micros else c for c in columns])


def stream_pages(
    pages: DataFrame, out: str, checkpoint: str, delay: str = "1 day", ts: str = "landed_at"
):
    """Extract links, headings and text of newly landed pages, the first copy of each address only.

    Of copies in one micro-batch the one with the least ``ts``, then page_id, is the first, in whatever order tasks hand them over.
    Returns the started query (``availableNow``: it ends with the input). Every micro-batch writes its
    own directory with overwrite, so a batch that runs again replaces what it wrote.
    """
    unique = first_copies(pages.withWatermark(ts, delay).withColumn("url_key", U.dedupe_key(F.col("url"))), delay, ts)

    def write(batch: DataFrame, epoch: int) -> None:
        landed = batch.persist()
        try:
            parts = {
                "links": corpus.extract_links(landed),
                "headings": corpus.html_headings(landed),
                "texts": corpus.readable_text(landed).select("page_id", "url", "text"),
            }
            for name, df in parts.items():
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={epoch}")
        finally:
            landed.unpersist()

    return (
        unique.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# -- running a stream over landed files -------------------------------------------------------


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(spark, writer):
    """Start a query on the RocksDB state store; a query keeps the settings it was started with, so the session gets its own back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def run_available(
    stream: DataFrame, name: str, mode: str = "append", late: list[int] | None = None, progress: list | None = None
) -> DataFrame:
    """Run a stream to the end of its landed input and return what it wrote.

    The number of rows that each stateful batch dropped as late is added to ``late``, the reports of all batches to ``progress``.

    Output goes to Parquet in the scratch folder, one directory per micro-batch. In update mode the last
    batch that mentions a row wins, so readers get ``batch`` as a column.
    """
    spark = stream.sparkSession
    root = scratch_dir(spark, name)
    out = f"{root}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
    )
    query = started(spark, writer)
    query.awaitTermination()
    if late is not None:
        late += [s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]]
    if progress is not None:
        progress += query.recentProgress
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(out)
