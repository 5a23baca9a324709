"""State of streams with many keys: groups of keys, not a call and a state for each."""

import pytest
from pyspark.sql import functions as F
from test_streams import START, landed, state_rows

from docloom.streaming import jobs, stateful


def _rows(spark, n, at):
    made = spark.range(n).select((F.col("id") % 60).cast("string").alias("k"), "id", F.timestamp_seconds(F.lit(START + at) + F.col("id")).alias("t"))
    return made.select(F.col("id").alias("attempt_id"), F.col("k").alias("client_key"), F.concat(F.lit("r"), "k").alias("repo_full_name"), F.col("t").alias("created_at"))


@pytest.mark.parametrize("kind", ["usage", "admission", "unstarted"])
def test_many_keys_share_a_state(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(stateful, "PARTS", 2, raising=False)
    frames = [_rows(spark, 180, 0), _rows(spark, 1, 500_000)]
    stream, progress = landed(spark, tmp_path / "in", frames, frames[0].schema), []
    if kind == "usage":
        out = jobs.stream_rolling_usage(stream)
    elif kind == "admission":
        out = jobs.stream_admission(stream, 2, 2)
    else:
        out = jobs.stream_unstarted_jobs(stream.select(F.col("client_key").alias("job_id"), F.col("created_at").alias("ts"), F.lit(False).alias("has_session")), 5)
    rows = jobs.run_available(out, kind, "append", None, progress).collect()
    assert max(state_rows(progress)) <= 24  # 60 clients, 60 repositories, 60 jobs
    if kind == "usage":
        found = {(r.attempt_id, r.scope): r.attempts for r in rows if r.oldest_us < (START + 1000) * 1_000_000}
        assert found == {(i, s): i // 60 + 1 for i in range(180) for s in ("client_hour", "client_day", "repo_cooldown")}
    elif kind == "admission":
        assert {r.attempt_id: r.allowed for r in rows if r.ts_us < (START + 1000) * 1_000_000} == {i: i < 120 for i in range(180)}
    else:
        assert sorted(int(r.job_id) for r in rows) == list(range(60))


def test_silence_is_strictly_longer_than_the_limit_without_python(spark, tmp_path):
    minute, end = 60_000_000, START * 1_000_000 + 500_000_000_000
    first = START * 1_000_000
    beats = [("same", first), ("same", first + 15 * minute), ("apart", first), ("apart", first + 15 * minute + 1), ("end", end), ("edge", end - 16 * minute)]
    make = lambda part: spark.createDataFrame(part, "job_id string, us long").select("job_id", F.timestamp_micros("us").alias("ts"))
    frames = [make(beats), make([("end", end)])]
    silent = jobs.stream_stale_jobs(landed(spark, tmp_path / "in", frames, frames[0].schema), 15, "1 minute")
    assert "TransformWithState" not in silent._jdf.queryExecution().analyzed().toString()
    found = {(r.job_id, r.last_us) for r in jobs.run_available(silent, "silent").collect()}
    # the watermark stands at the limit of "edge" and has not passed it
    assert found == {("same", first + 15 * minute), ("apart", first), ("apart", first + 15 * minute + 1)}


def test_sessions_are_folded_in_groups(spark, tmp_path):
    events = spark.range(1).selectExpr("CAST(id AS STRING) AS session_id", "id AS seq", "timestamp_seconds(id) AS ts", "'x' AS type", "named_struct('message', '', 'messageSoFar', '', 'callId', '') AS data")
    folded = jobs.stream_session_fold(landed(spark, tmp_path / "in", [events], events.schema))
    assert "pmod(xxhash64(session_id" in folded._jdf.queryExecution().analyzed().toString()
