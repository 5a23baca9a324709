"""What must hold at any size: no broadcast of tables that only their files make look small."""

from pyspark.sql import functions as F

from docloom.operators import matching
from docloom.session import joinable, materialized


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _repeated(spark):
    """300,000 rows, some 30 MB in memory, that repeat one text and lie in a small file."""
    return spark.range(300_000).select(F.lit("acme/router").alias("repo_id"), F.floor(F.col("id") / 100_000).alias("pos"), F.lit("text").alias("gram"))


def test_tables_that_compress_well_are_not_broadcast(spark):
    few = spark.range(3).select(F.col("id").alias("pos"))
    many = materialized(spark.range(400_000).select((F.col("id") % 7).alias("pos"), F.rand(1).alias("x")), "other")
    assert "BroadcastHashJoin" in _plan(many.join(materialized(_repeated(spark), "files").filter("pos = 9"), "pos", "left"))
    large = joinable(_repeated(spark), "rows")
    plan = _plan(many.join(large.filter("pos = 9"), "pos", "left"))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert "BroadcastHashJoin" in _plan(many.join(joinable(few, "few"), "pos"))


def _outline(spark, n):
    return spark.range(n).selectExpr(
        "'r' || floor(id / 50) AS repo_id", "CAST(id % 50 AS INT) AS pos", "'routing-' || id % 50 AS slug", "'Routing' AS title", "'Explain' AS purpose"
    )


def _entries(spark, n):
    return spark.range(n).selectExpr(
        "'r' || floor(id / 50) AS repo_id", "CAST(id % 50 AS INT) AS pos", "'Guides' AS `group`", "'Routing' AS title",
        "'https://docs.acme.dev/docs/guides/routing-' || id % 50 AS url",
    )


def test_matching_plans_do_not_broadcast_what_grows(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        found = matching.match_entries(_outline(spark, 5_000), _entries(spark, 5_000))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "merge" in plan
        assert found.count() == 5_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
