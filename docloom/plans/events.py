"""Queries of the usage, session and job operators over the event log, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.ids import micros
from docloom.operators import joins, ordering, rollups
from docloom.plans.catalog import register
from docloom.plans.corpus import HEADINGS_SQL, LINKS_SQL, READABLE_SQL
from docloom.plans.inputs import SQL, computed, cte, derive, table
from docloom.session import scratch_dir
from docloom.streaming import batch, jobs

_HOUR = 3_600_000_000
_NOW_US = 1705752000000000  # 2024-01-20 12:00 UTC
_A = cte("attempts")


# -- usage ------------------------------------------------------------------------------------


def _over(keys: str, width: int) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"OVER ({part}ORDER BY us RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)"


_SCOPES = {
    "client_hour": ("client_key", _HOUR),
    "client_day": ("client_key", 24 * _HOUR),
    "global_hour": ("", _HOUR),
    "repo_cooldown": ("repo_full_name", 600_000_000),
}


@register(
    "rolling_usage",
    f"""{_A}, u AS (SELECT *, epoch_us(created_at) AS us FROM attempts)
    SELECT attempt_id, """
    + ", ".join(
        f"count(*) {_over(k, w)} AS {n}_count, min(us) {_over(k, w)} AS {n}_oldest"
        for n, (k, w) in _SCOPES.items()
    )
    + " FROM u",
)
def rolling_usage(spark, sf):
    used = ordering.rolling_usage(derive(spark, sf, "attempts"))
    return used.select("attempt_id", *[f"{n}_{m}" for n in _SCOPES for m in ("count", "oldest")])


def _snapshot_sql() -> str:
    def agg(scope: str, width: int) -> str:
        inside = f"us >= {_NOW_US} - {width}"
        return f"count(*) FILTER ({inside}) AS {scope}_count, min(us) FILTER ({inside}) AS {scope}_oldest"

    return f"""{_A}, u AS (SELECT *, epoch_us(created_at) AS us FROM attempts WHERE epoch_us(created_at) <= {_NOW_US}
        AND epoch_us(created_at) >= {_NOW_US} - {24 * _HOUR}),
    q AS (SELECT DISTINCT client_key, repo_full_name FROM attempts),
    c AS (SELECT client_key, {agg('client_hour', _HOUR)}, {agg('client_day', 24 * _HOUR)} FROM u GROUP BY 1),
    r AS (SELECT repo_full_name, {agg('repo_cooldown', 600_000_000)} FROM u GROUP BY 1),
    g AS (SELECT {agg('global_hour', _HOUR)} FROM u),
    s AS (SELECT q.client_key || '|' || q.repo_full_name AS request_id,
      coalesce(client_hour_count, 0) AS client_hour_count, client_hour_oldest,
      coalesce(client_day_count, 0) AS client_day_count, client_day_oldest,
      coalesce(repo_cooldown_count, 0) AS repo_cooldown_count, repo_cooldown_oldest,
      global_hour_count, global_hour_oldest
      FROM q LEFT JOIN c USING (client_key) LEFT JOIN r USING (repo_full_name) CROSS JOIN g)"""


def _snapshot(spark, sf):
    attempts = derive(spark, sf, "attempts")
    requests = attempts.select("client_key", "repo_full_name").distinct()
    requests = requests.withColumn("request_id", F.concat_ws("|", "client_key", "repo_full_name"))
    return rollups.usage_snapshot(attempts, requests, _NOW_US)


@register("usage_snapshot", _snapshot_sql() + " SELECT * FROM s")
def usage_snapshot(spark, sf):
    return _snapshot(spark, sf).drop("client_key", "repo_full_name")


_LIMITS = {"client_hour": 1, "client_day": 3, "global_hour": 14, "cooldown_us": 600_000_000}


@register(
    "quota_decision",
    _snapshot_sql()
    + f""", d AS (SELECT *, CASE WHEN repo_cooldown_count >= 1 THEN 'repo_cooldown' WHEN client_hour_count >= 1 THEN 'client_hour'
        WHEN client_day_count >= 3 THEN 'client_day' WHEN global_hour_count >= 14 THEN 'global_hour' END AS scope FROM s),
    e AS (SELECT *, CASE scope WHEN 'repo_cooldown' THEN repo_cooldown_oldest + 600000000 WHEN 'client_hour' THEN client_hour_oldest + {_HOUR}
        WHEN 'client_day' THEN client_day_oldest + {24 * _HOUR} WHEN 'global_hour' THEN global_hour_oldest + {_HOUR} END AS reset FROM d)
    SELECT request_id, scope IS NULL AS allowed, scope,
      CAST(CASE scope WHEN 'repo_cooldown' THEN 1 WHEN 'client_hour' THEN 1 WHEN 'client_day' THEN 3 WHEN 'global_hour' THEN 14 END AS INT) AS "limit",
      reset AS reset_us, CAST(CASE WHEN scope IS NOT NULL THEN greatest(1, ceil((reset - {_NOW_US}) / 1000000)) END AS BIGINT) AS retry_after_seconds
    FROM e""",
)
def quota_decision(spark, sf):
    decided = rollups.quota_decision(_snapshot(spark, sf), _NOW_US, _LIMITS)
    return decided.select(
        "request_id",
        "allowed",
        "scope",
        "limit",
        micros(F.col("reset_at")).alias("reset_us"),
        "retry_after_seconds",
    )


# -- admission --------------------------------------------------------------------------------

_PER_HOUR, _PER_DAY = 1, 2
_ADMISSION_SQL = f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS STRING) AS client_key, event_id AS attempt_id, epoch_us(ts) AS ts_us,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT DISTINCT client_key, CAST(0 AS BIGINT) AS attempt_id, CAST(0 AS BIGINT) AS ts_us, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS adm, CAST(NULL AS VARCHAR) AS scope FROM e
      UNION ALL
      SELECT e.client_key, e.attempt_id, e.ts_us, e.n, CASE WHEN d.scope IS NULL THEN list_append(f.adm, e.ts_us) ELSE f.adm END, d.scope
      FROM f JOIN e ON e.client_key = f.client_key AND e.n = f.n + 1,
      LATERAL (SELECT CASE WHEN len(list_filter(f.adm, lambda a: a >= e.ts_us - {_HOUR})) >= {_PER_HOUR} THEN 'client_hour'
        WHEN len(list_filter(f.adm, lambda a: a >= e.ts_us - {24 * _HOUR})) >= {_PER_DAY} THEN 'client_day' END AS scope) d)
    SELECT client_key, attempt_id, ts_us, scope IS NULL AS allowed, scope FROM f WHERE n > 0"""


@register("admission", _ADMISSION_SQL)
def admission(spark, sf):
    return batch.admission(derive(spark, sf, "attempts"), _PER_HOUR, _PER_DAY)


# -- sessions ---------------------------------------------------------------------------------

_SESSION_EVENTS = """CAST(user_id AS STRING) AS session_id, event_id AS seq, ts,
  CASE event_type WHEN 'click' THEN 'actions.requested' WHEN 'view' THEN 'message.appended'
    WHEN 'purchase' THEN 'message.completed' WHEN 'signup' THEN 'action.result'
    ELSE CASE WHEN value < 2 THEN 'session.failed' WHEN value < 50 THEN 'session.waiting' ELSE 'step.started' END END AS type,
  CASE WHEN event_type = 'purchase' THEN 'done ' || CAST(event_id AS STRING) WHEN event_type = 'error' THEN 'broken' END AS message,
  CASE WHEN event_type = 'view' THEN 'so far ' || CAST(event_id AS STRING) END AS so_far,
  CASE WHEN event_type IN ('click', 'signup') THEN 'c' || CAST(event_id % 9 AS STRING) END AS call_id,
  CASE WHEN event_type = 'click' OR value > 50 THEN 'tool' || CAST(event_id % 4 AS STRING) END AS tool_name"""


def _session_events(df):
    flat = computed(df, _SESSION_EVENTS)
    data = F.struct(
        "message",
        F.col("so_far").alias("messageSoFar"),
        F.col("call_id").alias("callId"),
        F.col("tool_name").alias("toolName"),
        F.when(F.col("type") == "actions.requested", F.concat(F.lit("in "), F.col("seq"))).alias("input"),
        F.when(F.col("type") == "action.result", F.concat(F.lit("out "), F.col("seq"))).alias("output"),
        F.when(F.col("type") == "action.result", F.lit("ok")).alias("status"),
    )
    return flat.select("session_id", "seq", "ts", "type", data.alias("data"))


_BOUNDARY = "('authorization.required', 'session.completed', 'session.failed', 'session.waiting', 'turn.failed')"
_TURN_SQL = f"""WITH s AS (SELECT {_SESSION_EVENTS} FROM events),
    b AS (SELECT *, type IN {_BOUNDARY} AND NOT (type = 'session.waiting' AND seq > 0
        AND seq = min(seq) OVER (PARTITION BY session_id)) AS boundary FROM s),
    t AS (SELECT * FROM b QUALIFY seq <= coalesce(min(CASE WHEN boundary THEN seq END) OVER (PARTITION BY session_id), 9e18))"""
_FOLD_SQL = (
    _TURN_SQL
    + """ SELECT session_id,
      arg_max(coalesce(CASE WHEN type = 'message.completed' THEN message END, so_far), seq) FILTER (type IN ('message.completed', 'message.appended')) AS reply,
      max(message) FILTER (type = 'session.failed') AS failure, max(seq) + 1 AS next_index,
      count(DISTINCT call_id) FILTER (type IN ('actions.requested', 'action.result')) AS tool_calls, bool_or(boundary) AS ended
    FROM t GROUP BY 1"""
)


@register("session_fold", _FOLD_SQL)
def session_fold(spark, sf):
    return batch.session_fold(_session_events(table(spark, sf, "events")))


@register(
    "pair_tool_calls",
    f"""WITH s AS (SELECT {_SESSION_EVENTS} FROM events),
    r AS (SELECT session_id, call_id, min(seq) AS first_seq, max(seq) FILTER (type = 'actions.requested') AS asked,
        max(seq) FILTER (type = 'action.result') AS answered, arg_max(tool_name, seq) FILTER (tool_name IS NOT NULL) AS name
      FROM s WHERE type IN ('actions.requested', 'action.result') GROUP BY 1, 2)
    SELECT session_id, call_id, first_seq, coalesce(name, 'tool') AS tool_name, 'in ' || CAST(asked AS STRING) AS input,
      CASE WHEN answered > coalesce(asked, -1) THEN 'out ' || CAST(answered AS STRING) END AS output,
      CASE WHEN answered > coalesce(asked, -1) THEN 'ok' END AS status,
      CASE WHEN answered > coalesce(asked, -1) THEN CASE WHEN asked IS NULL THEN 'result_only' ELSE 'done' END ELSE 'pending' END AS state
    FROM r""",
)
def pair_tool_calls(spark, sf):
    return joins.pair_tool_calls(batch.tool_events(_session_events(table(spark, sf, "events"))))


# -- jobs -------------------------------------------------------------------------------------


@register(
    "latest_phase",
    """WITH e AS (SELECT user_id AS job_id, event_id, epoch_us(ts) AS us,
        CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'outlining' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' END AS phase FROM events)
    SELECT job_id, (SELECT phase FROM e x WHERE x.job_id = e.job_id AND phase IS NOT NULL ORDER BY us DESC, event_id DESC LIMIT 1) AS phase,
      max(us) AS updated_us, max(us) FILTER (phase IN ('completed', 'failed')) AS finished_us FROM e GROUP BY 1""",
)
def latest_phase(spark, sf):
    e = F.col("event_type")
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"),
        "event_id",
        "ts",
        F.when(e == "signup", "created")
        .when(e == "click", "outlining")
        .when(e == "error", "failed")
        .when(e == "purchase", "completed")
        .alias("phase"),
    )
    latest = ordering.latest_phase(log)
    return latest.select(
        "job_id",
        "phase",
        micros(F.col("updated_at")).alias("updated_us"),
        micros(F.col("finished_at")).alias("finished_us"),
    )


@register(
    "stale_jobs",
    f"""WITH j AS (SELECT user_id AS job_id, min(epoch_us(ts)) AS started, max(epoch_us(ts)) AS updated,
        max(CASE WHEN event_type = 'click' THEN event_id END) AS session_id, arg_max(event_type, event_id) AS last FROM events
        WHERE epoch_us(ts) <= {_NOW_US} GROUP BY 1),
    r AS (SELECT job_id, CASE WHEN session_id IS NULL AND {_NOW_US} - started > 1200000000 THEN 'not_started'
        WHEN {_NOW_US} - updated > 900000000 THEN 'no_heartbeat' END AS reason FROM j WHERE last NOT IN ('purchase', 'error'))
    SELECT job_id, reason FROM r WHERE reason IS NOT NULL""",
)
def stale_jobs(spark, sf):
    log = table(spark, sf, "events").filter(micros(F.col("ts")) <= _NOW_US)
    open_last = F.max_by("event_type", "event_id")
    rows = log.groupBy(F.col("user_id").alias("job_id")).agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("session_id"),
        open_last.alias("_last"),
    )
    known = rows.withColumn(
        "status", F.when(F.col("_last").isin("purchase", "error"), "completed").otherwise("running")
    )
    return batch.stale_jobs(known, F.timestamp_micros(F.lit(_NOW_US))).select("job_id", "reason")


_GAP_MINUTES = 24 * 60
_WATERMARK_SQL = "(SELECT max(epoch_us(ts)) - 60000000 FROM events)"
_SILENT_SQL = f"""WITH e AS (SELECT CAST(user_id AS STRING) AS job_id, epoch_us(ts) AS us,
      lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events)
    SELECT job_id, us AS last_us, us + {_GAP_MINUTES * 60_000_000} AS failed_us FROM e
    WHERE coalesce(nxt, {_WATERMARK_SQL}) - us > {_GAP_MINUTES * 60_000_000}"""


@register("silent_jobs", _SILENT_SQL)
def silent_jobs(spark, sf):
    log = table(spark, sf, "events")
    beats = log.select(F.col("user_id").cast("string").alias("job_id"), "ts")
    end = log.agg((F.max(micros(F.col("ts"))) - 60_000_000).alias("e")).scalar()
    return batch.silent_jobs(beats, end, _GAP_MINUTES)


# -- streams ----------------------------------------------------------------------------------


def _stream(spark, sf):
    """The event table as a file stream, with an instant as event time."""
    return _file_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _file_stream(spark, sf, name):
    """File streams read folders or patterns; the pattern matches the one table file or folder."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _stream_attempts(spark, sf):
    return computed(_stream(spark, sf), SQL["attempts"][1])


def _closed(spark, stream, ts, landed, **values):
    """``stream`` and one row two days after the last of ``landed``: a table ends, a stream does not, and only a later row
    lets the watermark pass all others."""
    folder = scratch_dir(spark, "closing")
    last = landed.agg((F.max(ts).cast("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("_last"))
    given = {**{k: F.lit(v) for k, v in values.items()}, ts: F.col("_last")}
    row = last.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    row.write.mode("overwrite").parquet(f"{folder}/rows")
    return stream.union(spark.readStream.schema(stream.schema).parquet(f"{folder}/rows"))


@register("stream_session_fold", _FOLD_SQL.replace(" AS ended", " AS ended, 0::BIGINT AS skipped"))
def stream_session_fold(spark, sf):
    events = _closed(spark, _session_events(_stream(spark, sf)), "ts", table(spark, sf, "events"), session_id="closing", seq=0)
    folded = jobs.run_available(jobs.stream_session_fold(events, retention="1000 days"), "sessions", "update")
    last = ordering.first_wins(folded.where("session_id <> 'closing'"), ["session_id"], [F.col("batch").desc()])
    return last.drop("batch")


@register(
    "session_tool_calls",
    _TURN_SQL
    + """, r AS (SELECT session_id, call_id, min(seq) AS first_seq, max(seq) FILTER (type = 'actions.requested') AS asked,
        max(seq) FILTER (type = 'action.result') AS answered, arg_max(tool_name, seq) FILTER (tool_name IS NOT NULL) AS name
      FROM t WHERE type IN ('actions.requested', 'action.result') GROUP BY 1, 2)
    SELECT session_id, call_id, first_seq, coalesce(name, 'tool') AS tool_name, 'in ' || CAST(asked AS STRING) AS input,
      CASE WHEN answered > coalesce(asked, -1) THEN 'out ' || CAST(answered AS STRING) END AS output,
      CASE WHEN answered > coalesce(asked, -1) THEN 'ok' END AS status,
      CASE WHEN answered > coalesce(asked, -1) THEN CASE WHEN asked IS NULL THEN 'result_only' ELSE 'done' END ELSE 'pending' END AS state
    FROM r""",
)
def session_tool_calls(spark, sf):
    """Tool calls of each session's current turn."""
    return batch.session_tool_calls(_session_events(table(spark, sf, "events")))


@register("stream_admission", _ADMISSION_SQL)
def stream_admission(spark, sf):
    attempts = _stream_attempts(spark, sf).select("attempt_id", "client_key", "created_at")
    attempts = _closed(spark, attempts, "created_at", derive(spark, sf, "attempts"), attempt_id=-1, client_key="closing")
    decided = jobs.stream_admission(attempts, _PER_HOUR, _PER_DAY).where("attempt_id >= 0")
    return jobs.run_available(decided, "admission").drop("batch")


_LIVE_SCOPES = ("client_hour", "client_day", "repo_cooldown")


@register(
    "stream_rolling_usage",
    f"""{_A}, u AS (SELECT *, epoch_us(created_at) AS us FROM attempts)
    SELECT attempt_id, """
    + ", ".join(f"count(*) {_over(*_SCOPES[n])} AS {n}_count, min(us) {_over(*_SCOPES[n])} AS {n}_oldest" for n in _LIVE_SCOPES)
    + " FROM u",
)
def stream_rolling_usage(spark, sf):
    """Live usage of every attempt, the scopes side by side."""
    attempts = _closed(spark, _stream_attempts(spark, sf), "created_at", derive(spark, sf, "attempts"), attempt_id=-1, client_key="closing", repo_full_name="closing")
    used = jobs.run_available(jobs.stream_rolling_usage(attempts).where("attempt_id >= 0"), "live-usage")
    wide = [
        F.max(F.when(F.col("scope") == n, F.col(c))).alias(f"{n}_{out}")
        for n in _LIVE_SCOPES
        for c, out in (("attempts", "count"), ("oldest_us", "oldest"))
    ]
    return used.groupBy("attempt_id").agg(*wide)


@register(
    "stream_usage",
    """WITH w AS (SELECT CAST(user_id AS STRING) AS client_key, epoch_us(ts) AS us,
        unnest([0, 1, 2, 3]) AS k FROM events),
    s AS (SELECT client_key, us, (CAST(floor(us / 900000000) AS BIGINT) - k) * 900000000 AS window_start FROM w)
    SELECT client_key, window_start, window_start + 3600000000 AS window_end, count(*) AS attempts, min(us) AS oldest
    FROM s GROUP BY 1, 2 HAVING window_start + 3600000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)""",
)
def stream_usage(spark, sf):
    used = jobs.run_available(jobs.stream_usage(_stream_attempts(spark, sf)), "usage")
    return used.select(
        "client_key",
        micros(F.col("window_start")).alias("window_start"),
        micros(F.col("window_end")).alias("window_end"),
        "attempts",
        micros(F.col("oldest")).alias("oldest"),
    )


_CALL = "CAST(user_id AS STRING) || '-' || CAST(CAST(floor(value / 40) AS INT) AS STRING)"
_PAIRS_SQL = f"""WITH q AS (SELECT {_CALL} AS call_id, event_id, ts AS requested_at FROM events WHERE event_type = 'click'),
    a AS (SELECT {_CALL} AS call_id, ts AS answered_at, event_id AS result_id FROM events WHERE event_type = 'view')
    SELECT q.call_id, event_id, epoch_us(requested_at) AS requested_us, epoch_us(answered_at) AS answered_us, result_id
    FROM q LEFT JOIN a ON a.call_id = q.call_id AND answered_at BETWEEN requested_at AND requested_at + INTERVAL 600 MINUTES"""


def _calls(df):
    keyed = df.selectExpr(f"{_CALL} AS call_id", "event_id", "event_type", "ts")
    requests = keyed.filter("event_type = 'click'").select(
        "call_id", "event_id", F.col("ts").alias("requested_at")
    )
    results = keyed.filter("event_type = 'view'").select(
        F.col("call_id").alias("result_call_id"),
        F.col("event_id").alias("result_id"),
        F.col("ts").alias("answered_at"),
    )
    return requests, results


def _pair_columns(df):
    return df.select(
        "call_id",
        "event_id",
        micros(F.col("requested_at")).alias("requested_us"),
        micros(F.col("answered_at")).alias("answered_us"),
        "result_id",
    )


@register("paired_calls", _PAIRS_SQL)
def paired_calls(spark, sf):
    requests, results = _calls(table(spark, sf, "events"))
    return _pair_columns(batch.paired_calls(requests, results, 600))


@register(
    "stream_pair_calls",
    _PAIRS_SQL
    + """ WHERE answered_at IS NOT NULL OR requested_at + INTERVAL 600 MINUTES <
      (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'view')) - INTERVAL 10 MINUTES FROM events)""",
)
def stream_pair_calls(spark, sf):
    requests, results = _calls(_stream(spark, sf))
    paired = jobs.run_available(jobs.stream_pair_calls(requests, results, 600), "pairs")
    return _pair_columns(paired)


@register("stream_stale_jobs", _SILENT_SQL)
def stream_stale_jobs(spark, sf):
    beats = _stream(spark, sf).select(F.col("user_id").cast("string").alias("job_id"), "ts")
    return jobs.run_available(jobs.stream_stale_jobs(beats, _GAP_MINUTES), "stale").drop("batch")


@register(
    "stream_unstarted_jobs",
    f"""WITH j AS (SELECT CAST(user_id AS STRING) AS job_id, min(epoch_us(ts)) AS started_us,
        min(epoch_us(ts)) FILTER (event_type = 'click') AS session_us FROM events GROUP BY 1)
    SELECT job_id, started_us, started_us + {_GAP_MINUTES * 60_000_000} AS failed_us FROM j
    WHERE started_us + {_GAP_MINUTES * 60_000_000} <= {_WATERMARK_SQL}
      AND (session_us IS NULL OR session_us > started_us + {_GAP_MINUTES * 60_000_000})""",
)
def stream_unstarted_jobs(spark, sf):
    log = _stream(spark, sf).select(
        F.col("user_id").cast("string").alias("job_id"), "ts", (F.col("event_type") == "click").alias("has_session")
    )
    found = jobs.stream_unstarted_jobs(log, _GAP_MINUTES, retention_minutes=100 * 24 * 60)
    return jobs.run_available(found, "unstarted").drop("batch")


def _page_counts(links: str, headings: str, texts: str, pages: str) -> str:
    """Of every first copy: links and headings with a digest of each, and a digest of the text."""
    return f"""SELECT p.page_id, p.url, coalesce(l.n, 0) AS links, l.digest AS links_md5, coalesce(h.n, 0) AS headings,
      h.digest AS headings_md5, md5(t.text) AS text_md5
    FROM ({pages}) p JOIN ({texts}) t ON t.page_id = p.page_id
    LEFT JOIN (SELECT page_id, count(*) AS n, md5(string_agg(pos || ' ' || href || ' ' || url, '|' ORDER BY pos)) AS digest FROM ({links}) GROUP BY 1) l ON l.page_id = p.page_id
    LEFT JOIN (SELECT page_id, count(*) AS n, md5(string_agg(pos || ' ' || level || ' ' || title || ' ' || url, '|' ORDER BY pos)) AS digest FROM ({headings}) GROUP BY 1) h ON h.page_id = p.page_id"""


@register(
    "stream_pages",
    _page_counts(
        LINKS_SQL,
        HEADINGS_SQL,
        READABLE_SQL,
        """SELECT page_id, url FROM pages
        QUALIFY row_number() OVER (PARTITION BY regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') ORDER BY page_id) = 1""",
    ),
)
def stream_pages(spark, sf):
    """All three outputs of a stream over pages that land in four files, one a batch, as counts and digests."""
    root = scratch_dir(spark, "pages")
    pages = table(spark, sf, "pages")
    for i, part in enumerate(_quarters(pages)):
        part.withColumn("landed_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))).write.parquet(f"{root}/in/{i}")
    schema = spark.read.parquet(f"{root}/in/0").schema
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    jobs.stream_pages(landed, f"{root}/out", f"{root}/checkpoint", delay="1000 days").awaitTermination()
    links, headings, texts = (spark.read.parquet(f"{root}/out/{kind}") for kind in ("links", "headings", "texts"))

    def digest(rows, *columns):
        line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("pos", *columns)])
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("x")))), lambda r: r["x"]), "|")
        return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.md5(lines).alias("md5"))

    out = texts.select("page_id", "url", F.md5("text").alias("text_md5"))
    for kind, rows in (("links", digest(links, "href", "url")), ("headings", digest(headings, "level", "title", "url"))):
        rows = rows.select("page_id", F.col("n").alias(kind), F.col("md5").alias(f"{kind}_md5"))
        out = out.join(rows, "page_id", "left").withColumn(kind, F.coalesce(kind, F.lit(0).cast("long")))
    return out


def _quarters(pages):
    """Four ranges of page_id, so that of two copies of an address the one with the smaller id lands first."""
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    width = (high - low) // 4 + 1
    return [pages.where(F.floor((F.col("page_id") - low) / width) == i).repartitionByRange(1, "page_id") for i in range(4)]
