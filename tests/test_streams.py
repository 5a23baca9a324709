"""Streams over several files, in and out of order, against their batch twins."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import ordering
from docloom.schemas import EVENTS
from docloom.streaming import batch, jobs

START = 1_704_000_000


def landed(spark, folder, parts, schema, **options):
    """A file stream of one file a batch, in the order of ``parts`` (DataFrames)."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/{i}")
        for f in os.listdir(f"{folder}/{i}"):
            os.utime(f"{folder}/{i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.options(**options).parquet(str(folder))


def dealt(rows, time, n, rng, delay=540):
    """Rows as they arrive, up to ``delay`` seconds out of order, in ``n`` files."""
    arrived = sorted(rows, key=lambda r: time(r) + rng.randint(0, delay))
    size = -(-len(arrived) // n)
    return [arrived[i : i + size] for i in range(0, len(arrived), size)]


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


# -- T1 -----------------------------------------------------------------------------------------


def session_rows(rng):
    kinds = ["message.appended", "message.completed", "actions.requested", "action.result", "step.started"]
    rows = []
    for k in range(14):
        first, n = rng.choice([0, 0, 3, 40]), rng.randint(4, 30)
        seq, at = first, START + rng.randint(0, 4000)
        for i in range(n):
            kind = rng.choice(kinds)
            if i == 0 and first and rng.random() < 0.7:
                kind = "session.waiting"
            elif i == n - 4 and k % 3:
                kind = rng.choice(["session.waiting", "session.failed", "turn.failed"])
            message = rng.choice([None, f"m{k}.{seq}"])
            data = (message, f"so far {seq}" if rng.random() < 0.8 else None, f"c{rng.randint(0, 3)}" if rng.random() < 0.8 else None)
            rows.append((f"s{k}", seq, at, kind, *data))
            seq += 1 if rng.random() < 0.85 else rng.randint(2, 5)  # a gap that never closes
            at += rng.randint(0, 200)
    return rows


def as_events(spark, rows):
    flat = spark.createDataFrame(rows, "session_id string, seq bigint, s bigint, type string, message string, so_far string, call_id string")
    given = {"message": "message", "messageSoFar": "so_far", "callId": "call_id"}
    fields = EVENTS["data"].dataType.fields
    data = F.struct(*[(F.col(given[f.name]) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    return flat.select("session_id", "seq", F.timestamp_seconds("s").alias("ts"), "type", data.alias("data"))


def test_session_fold_equals_its_twin_whatever_the_order(spark, tmp_path):
    rng = random.Random(11)
    rows = session_rows(rng)
    parts = dealt(rows, lambda r: r[2], 7, rng)
    parts[3] = parts[3] + parts[1][:6]  # repeats
    end = START + 1_000_000
    parts += [[("closing", 0, end, "step.started", None, None, None)]]
    parts += [[("s0", 10_000, START, "message.completed", "far too late", None, None), ("closing", 1, end + 5, "step.started", None, None, None)]]
    frames = [as_events(spark, p) for p in parts]
    stream = landed(spark, tmp_path / "in", frames, frames[0].schema)
    late, progress = [], []
    folded = jobs.run_available(jobs.stream_session_fold(stream, retention="1 day"), "fold", "update", late, progress)
    assert folded.select("batch").distinct().count() >= 5
    last = ordering.first_wins(folded.where("session_id <> 'closing'"), ["session_id"], [F.col("batch").desc()])
    columns = ["session_id", "reply", "failure", "next_index", "tool_calls", "ended"]
    want = batch.session_fold(as_events(spark, rows)).select(columns)
    assert sorted(map(tuple, last.select(columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.ended for r in want.collect()} == {True, False}
    assert sum(late) >= 1  # counted, not folded
    # what sessions held is gone: of the closing one only its numbers and its timer are left
    assert max(state_rows(progress)) > 30 and state_rows(progress)[-1] <= 4


def test_events_behind_what_was_folded_are_counted(spark, tmp_path):
    ev = lambda seq, s, kind="message.completed": ("s", seq, START + s, kind, f"m{seq}", None, None)
    parts = [[ev(0, 0), ev(1, 1), ev(3, 3)], [ev(2, 2), ev(1, 1)], [ev(5, 5)], [ev(9, 5000, "step.started")], [ev(12, 9000, "session.waiting")], [ev(13, 9001)]]
    frames = [as_events(spark, p) for p in parts]
    folded = jobs.run_available(jobs.stream_session_fold(landed(spark, tmp_path / "in", frames, frames[0].schema)), "skips", "update")
    rows = {r.batch: r for r in folded.collect()}
    assert (rows[0].reply, rows[0].next_index) == ("m1", 2)  # 3 waits for 2
    assert (rows[1].reply, rows[1].next_index, rows[1].skipped) == ("m3", 4, 1)
    last = rows[max(rows)]
    assert (last.reply, last.next_index, last.skipped, last.ended) == ("m5", 10, 1, False)  # the watermark has not passed 12, which follows a gap


# -- T2 -----------------------------------------------------------------------------------------


def test_live_usage_equals_rolling_usage(spark, tmp_path):
    rng = random.Random(6)
    schema = "attempt_id bigint, client_key string, repo_full_name string, s bigint"
    rows = [(i, rng.choice("aaab"), rng.choice(["x/1", "y/2"]), START + 50_000 if i % 9 == 0 else rng.randint(0, 200_000)) for i in range(240)]
    make = lambda part: spark.createDataFrame(part, schema).select(
        "attempt_id", "client_key", "repo_full_name", F.timestamp_seconds("s").alias("created_at")
    )
    end = START + 900_000
    parts = dealt(rows, lambda r: r[3], 9, rng) + [[(-1, "end", "end", end)], [(-2, "a", "x/1", START), (-3, "end", "end", end + 200_000)], [(-4, "end", "end", end + 400_000)]]
    frames = [make(p) for p in parts]
    late, progress = [], []
    used = jobs.run_available(jobs.stream_rolling_usage(landed(spark, tmp_path / "in", frames, frames[0].schema)), "usage", "append", late, progress)
    got = {(r.attempt_id, r.scope): (r.attempts, r.oldest_us) for r in used.where("attempt_id >= 0").collect()}
    want = {}
    for r in ordering.rolling_usage(make(rows)).collect():
        for scope in ("client_hour", "client_day", "repo_cooldown"):
            want[r.attempt_id, scope] = (r[f"{scope}_count"], r[f"{scope}_oldest"])
    assert got == want and len(got) == 720
    assert used.select("batch").distinct().count() >= 5 and sum(late) == 2  # one row under its client and its repository
    assert state_rows(progress)[-1] <= 12  # clients and repositories that fell silent hold nothing


# -- T4, T5 -------------------------------------------------------------------------------------


def test_pairs_over_several_files(spark, tmp_path):
    rng = random.Random(9)
    asked = [(f"c{i}", START + rng.randint(0, 30_000)) for i in range(80)]
    answered = [(c, s + rng.randint(1, 5000)) for c, s in asked if rng.random() < 0.7]
    make = lambda rows, a, b: spark.createDataFrame(rows, f"{a} string, s bigint").select(a, F.timestamp_seconds("s").alias(b))
    end = START + 200_000
    ask_parts = [make(p, "call_id", "requested_at") for p in [*dealt(asked, lambda r: r[1], 5, rng), [("end", end)], [("end2", end + 1)]]]
    answer_parts = [make(p, "result_call_id", "answered_at") for p in [*dealt(answered, lambda r: r[1], 5, rng), [("none", end)], [("none2", end + 1)]]]
    requests = landed(spark, tmp_path / "asked", ask_parts, ask_parts[0].schema)
    results = landed(spark, tmp_path / "answered", answer_parts, answer_parts[0].schema)
    got = jobs.run_available(jobs.stream_pair_calls(requests, results, 60), "pairs").where("call_id LIKE 'c%'")
    want = batch.paired_calls(make(asked, "call_id", "requested_at"), make(answered, "result_call_id", "answered_at"), 60)
    columns = ["call_id", "requested_at", "answered_at"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert want.where("answered_at IS NULL").count() > 10


@pytest.mark.parametrize("unstarted", [False, True])
def test_job_timers_over_several_files(spark, tmp_path, unstarted):
    rng = random.Random(3)
    rows = [(f"j{i % 9}", START + i * 90 + rng.randint(0, 20) + (2000 if i % 23 > 18 else 0), rng.random() < 0.15) for i in range(300)]
    make = lambda part: spark.createDataFrame(part, "job_id string, s bigint, has_session boolean").select(
        "job_id", F.timestamp_seconds("s").alias("ts"), "has_session"
    )
    end = START + 900_000
    parts = dealt(rows, lambda r: r[1], 6, rng, delay=3000) + [[("end", end, True)], [("end", end + 1, True)]]
    frames = [make(p) for p in parts]
    stream = landed(spark, tmp_path / "in", frames, frames[0].schema)
    if unstarted:
        found = jobs.run_available(jobs.stream_unstarted_jobs(stream, 20, delay="90 minutes"), "unstarted")
        got = sorted((r.job_id, r.started_us) for r in found.collect())
        want = []
        for job in {r[0] for r in rows}:
            first = min(s for j, s, _ in rows if j == job)
            session = [s for j, s, x in rows if j == job and x and s <= first + 1200]
            want += [] if session else [(job, first * 1_000_000)]
        assert got == sorted(want) and want
    else:
        beats = stream.select("job_id", "ts")
        found = jobs.run_available(jobs.stream_stale_jobs(beats, 15, delay="90 minutes"), "stale").where("job_id <> 'end'")
        want = batch.silent_jobs(make(rows), end * 1_000_000, 15)
        assert sorted(map(tuple, found.drop("batch").collect())) == sorted(map(tuple, want.collect()))
