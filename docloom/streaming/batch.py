"""Batch twins of the streaming jobs: what each stream must have produced once its input ended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.ids import micros
from docloom.operators.joins import pair_tool_calls

_WAITING = "session.waiting"


def tool_events(events: DataFrame) -> DataFrame:
    """Session events as the request and result rows ``pair_tool_calls`` reads."""
    kind = F.when(F.col("type") == "actions.requested", F.lit("request")).when(
        F.col("type") == "action.result", F.lit("result")
    )
    d = F.col("data")
    return events.select(
        "session_id",
        "seq",
        kind.alias("kind"),
        d["callId"].alias("call_id"),
        d["toolName"].alias("tool_name"),
        d["input"].alias("input"),
        d["output"].alias("output"),
        d["status"].alias("status"),
    ).filter(F.col("kind").isNotNull() & F.col("call_id").isNotNull())


def current_turn(events: DataFrame) -> DataFrame:
    """Events of each session up to and including its first turn boundary.

    A session that resumes (its log starts past index 0) may lead with a stale waiting event, which is
    no boundary.
    """
    firsts = events.groupBy("session_id").agg(
        F.min("seq").alias("_first"), F.min_by("type", "seq").alias("_first_type")
    )
    joined = events.join(firsts, "session_id")
    stale = (
        (F.col("seq") == F.col("_first")) & (F.col("_first") > 0) & (F.col("type") == _WAITING)
    )
    boundary = F.col("type").isin(rules.TURN_BOUNDARIES) & ~stale
    marked = joined.withColumn("_boundary", boundary)
    ends = marked.filter("_boundary").groupBy("session_id").agg(F.min("seq").alias("_end"))
    return (
        marked.join(ends, "session_id", "left")
        .filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
        .withColumn("ended", F.col("_end").isNotNull())
        .drop("_first", "_first_type", "_boundary", "_end")
    )


def session_fold(events: DataFrame) -> DataFrame:
    """Latest reply, failure, next index and number of tool calls of each session's current turn."""
    turn = current_turn(events)
    d = F.col("data")
    said = F.when(F.col("type") == "message.completed", d["message"]).when(
        F.col("type") == "message.appended", d["messageSoFar"]
    )
    failed = F.col("type") == "session.failed"
    calls = F.col("type").isin("actions.requested", "action.result")
    return turn.groupBy("session_id").agg(
        F.max_by(said, F.when(said.isNotNull(), F.col("seq"))).alias("reply"),
        F.max(F.when(failed, F.coalesce(d["message"], F.lit("session failed")))).alias("failure"),
        (F.max("seq") + 1).alias("next_index"),
        F.count_distinct(F.when(calls, d["callId"])).alias("tool_calls"),
        F.bool_or("ended").alias("ended"),
    )


def session_tool_calls(events: DataFrame) -> DataFrame:
    return pair_tool_calls(tool_events(current_turn(events)))


# -- admission --------------------------------------------------------------------------------


class ClientWindow:
    """Admitted times of one client inside the longest window, and the sequential decision."""

    def __init__(self, per_hour: int, per_day: int, admitted: list[int] | None = None):
        self.per_hour, self.per_day = per_hour, per_day
        self.admitted = list(admitted or [])

    def opens_at(self) -> int:
        """Earliest time at which a further attempt would be admitted (window starts inclusive)."""
        at = -(2**62)
        for limit, width in ((self.per_hour, rules.HOUR_US), (self.per_day, rules.DAY_US)):
            if 0 < limit <= len(self.admitted):
                at = max(at, self.admitted[-limit] + width + 1)
        return at

    def admit(self, ts: int) -> None:
        self.admitted.append(ts)
        keep = max(self.per_hour, self.per_day, 1)
        del self.admitted[:-keep]


def decide(window: ClientWindow, times: np.ndarray) -> np.ndarray:
    """Scope that denies each of the sorted times, or an empty string where admitted.

    Only admitted attempts change the state, so runs of denied ones are skipped with one search.
    """
    out = np.empty(len(times), dtype=object)
    i = 0
    while i < len(times):
        opens = window.opens_at()
        j = int(np.searchsorted(times, opens, side="left", sorter=None)) if times[i] < opens else i
        if j > i:
            hour_opens = -(2**62)
            if 0 < window.per_hour <= len(window.admitted):
                hour_opens = window.admitted[-window.per_hour] + rules.HOUR_US + 1
            by_hour = times[i:j] < hour_opens
            out[i:j] = np.where(by_hour, "client_hour", "client_day")
            i = j
            continue
        out[i] = ""
        window.admit(int(times[i]))
        i += 1
    return out


_ADMISSION = "client_key string, attempt_id bigint, ts_us bigint, denied_by string"


def admission(
    attempts: DataFrame,
    per_hour: int = rules.GENERATION_LIMITS["client_hour"],
    per_day: int = rules.GENERATION_LIMITS["client_day"],
    ts: str = "created_at",
) -> DataFrame:
    """Exact sequential admission per client: denied attempts do not count towards later ones.

    Decisions of one client depend on each other in order, so a client is one sequence by nature. Rows
    are hash-partitioned by client and sorted by Spark (which spills); Python sees them as a stream of
    Arrow batches, keeps at most a day's admitted times and jumps over runs of denied attempts. The
    scopes that couple clients (global, repository) are offered as load counts in ``rolling_usage``.
    """
    rows = attempts.select("client_key", "attempt_id", micros(F.col(ts)).alias("ts_us"))
    ordered = rows.repartition("client_key").sortWithinPartitions("client_key", "ts_us", "attempt_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, None
        for batch in batches:
            parts = []
            for client, part in batch.groupby("client_key", sort=False):
                if client != key:
                    key, window = client, ClientWindow(per_hour, per_day)
                parts.append(part.assign(denied_by=decide(window, part["ts_us"].to_numpy())))
            if parts:
                yield pd.concat(parts)

    decided = ordered.mapInPandas(run, _ADMISSION)
    return decided.select(
        "client_key",
        "attempt_id",
        "ts_us",
        (F.col("denied_by") == "").alias("allowed"),
        F.when(F.col("denied_by") != "", F.col("denied_by")).alias("scope"),
    )


# -- jobs, calls ------------------------------------------------------------------------------


def stale_jobs(
    jobs: DataFrame,
    now: Column,
    before_session_minutes: int = rules.STALE_BEFORE_SESSION_MINUTES,
    active_minutes: int = rules.STALE_ACTIVE_MINUTES,
) -> DataFrame:
    """Unfinished jobs to fail: never started a session in time, or stopped reporting.

    ``jobs``: job_id, status, session_id, started_at, updated_at.
    """
    open_jobs = jobs.filter(F.col("status").isin(rules.UNFINISHED_STATUSES))
    at = F.unix_micros(now)
    waited = at - micros(F.col("started_at"))
    silent = at - micros(F.col("updated_at"))
    minute = 60_000_000
    reason = F.when(
        F.col("session_id").isNull() & (waited > before_session_minutes * minute), F.lit("not_started")
    ).when(silent > active_minutes * minute, F.lit("no_heartbeat"))
    return open_jobs.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def silent_jobs(heartbeats: DataFrame, end_us: Column | int, minutes: int = rules.STALE_ACTIVE_MINUTES) -> DataFrame:
    """Jobs whose heartbeats stopped for longer than allowed, with every such gap.

    ``heartbeats``: job_id, ts. A gap ends with the next heartbeat or with the end of the log.
    """
    w = Window.partitionBy("job_id").orderBy("_us")
    at = heartbeats.select("job_id", micros(F.col("ts")).alias("_us"))
    gaps = at.withColumn("_next", F.lead("_us").over(w))
    width = minutes * 60_000_000
    end = F.lit(end_us) if isinstance(end_us, int) else end_us
    late = F.coalesce("_next", end) - F.col("_us") > width
    return gaps.filter(late).select(
        "job_id", F.col("_us").alias("last_us"), (F.col("_us") + width).alias("failed_us")
    )


def paired_calls(requests: DataFrame, results: DataFrame, wait_minutes: int = 60) -> DataFrame:
    """Requests with their result if one came within the wait.

    ``requests``: call_id, requested_at. ``results``: result_call_id, answered_at, status.
    """
    bound = F.expr(f"interval {wait_minutes} minutes")
    on = (
        (F.col("call_id") == F.col("result_call_id"))
        & (F.col("answered_at") >= F.col("requested_at"))
        & (F.col("answered_at") <= F.col("requested_at") + bound)
    )
    return requests.join(results, on, "left").drop("result_call_id")
