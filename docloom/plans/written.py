"""Queries of the sources and sinks: each writes to the shared folder and reads back what a reader sees."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.plans.catalog import register
from docloom.plans.inputs import cte, derive, table
from docloom.plans.repositories import tree
from docloom.session import scratch_dir
from docloom.sources import corpus, revisions

_TREE = cte("tree")

_LINES = """event_id, CASE WHEN event_id % 10 = 3 THEN '{"session_id": "' || CAST(user_id AS STRING) || '", broken'
  WHEN event_id % 10 = 7 THEN '' ELSE '{"session_id": "' || CAST(user_id AS STRING) || '", "seq": ' || CAST(event_id AS STRING)
    || ', "type": "' || event_type || '", "data": {"message": "m' || CAST(event_id % 4 AS STRING) || '", "other": [1]}}' END AS line"""


@register(
    "read_event_log",
    f"""WITH l AS (SELECT {_LINES}, CAST(user_id AS STRING) AS session_id, event_type FROM events)
    SELECT CASE WHEN event_id % 10 <> 3 THEN session_id END AS session_id, CASE WHEN event_id % 10 <> 3 THEN event_id END AS seq,
      CASE WHEN event_id % 10 <> 3 THEN event_type END AS type, CASE WHEN event_id % 10 <> 3 THEN 'm' || CAST(event_id % 4 AS STRING) END AS message,
      CASE WHEN event_id % 10 = 3 THEN line END AS broken
    FROM l WHERE event_id % 10 <> 7""",
)
def read_event_log(spark, sf):
    """A log of one line an event, some of them blank or broken."""
    path = f"{scratch_dir(spark, 'event-log')}/log"
    table(spark, sf, "events").selectExpr(*_split(_LINES)).select("line").write.text(path)
    log = corpus.read_event_log(spark, path)
    return log.select("session_id", "seq", "type", F.col("data.message").alias("message"), F.col("_corrupt_record").alias("broken"))


def _split(columns: str) -> list[str]:
    first, rest = columns.split(", ", 1)
    return [first, rest]


@register(
    "replace_revision_files",
    f"""{_TREE} SELECT repo_id AS repo_revision_id, pos, CASE WHEN repo_id LIKE 'src1%' THEN 'new/' || path ELSE path END AS path FROM tree
    WHERE repo_id NOT LIKE 'src1%' OR pos < 30""",
)
def replace_revision_files(spark, sf):
    """All revisions written once, then some of them again with fewer files of other names."""
    path = f"{scratch_dir(spark, 'revision-files')}/files"
    rows = tree(spark, sf).select(F.col("repo_id").alias("repo_revision_id"), "pos", "path")
    revisions.replace_revision_files(rows, path)
    again = rows.where("repo_revision_id LIKE 'src1%' AND pos < 30").withColumn("path", F.concat(F.lit("new/"), "path"))
    revisions.replace_revision_files(again, path)
    return spark.read.schema(rows.schema).parquet(path)


@register(
    "publish_revision",
    f"""{_TREE} SELECT repo_id, pos, CASE WHEN repo_id LIKE 'src1%' THEN 'second' ELSE 'first' END AS revision_id,
      CASE WHEN repo_id LIKE 'src1%' THEN upper(path) ELSE path END AS title, CAST(3 AS BIGINT) AS version, CAST(4 AS BIGINT) AS removed FROM tree
    WHERE repo_id NOT LIKE 'src1%' OR pos > 0""",
)
def publish_revision(spark, sf):
    """Two publishes, the second of some repositories; compacted, with what is dead removed."""
    root = scratch_dir(spark, "published")
    first = tree(spark, sf).select("repo_id", F.lit("first").alias("revision_id"), "pos", F.col("path").alias("title"))
    second = first.where("repo_id LIKE 'src1%' AND pos > 0").withColumn("revision_id", F.lit("second")).withColumn("title", F.upper("title"))
    revisions.publish_revision(spark, root, 1, first, first.select("repo_id", "revision_id"))
    revisions.publish_revision(spark, root, 2, second, second.select("repo_id", "revision_id"))
    revisions.compact_versions(spark, root, 3)
    gone = [x for x in revisions.remove_dead(spark, root) if not x.startswith("pointers")]
    shown = revisions.read_published(spark, root).select("repo_id", "pos", "revision_id", "title", F.col("version").cast("long").alias("version"))
    return shown.withColumn("removed", F.lit(len(gone)).cast("long"))
