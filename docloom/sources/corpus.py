"""Reading repository trees, crawled pages, event logs and seed lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import rules, schemas
from docloom.operators.ordering import first_wins, rank_by_position
from docloom.operators.predicates import (
    normalize_paths,
    parse_repo_urls,
    useful_paths,
    with_language,
)


def build_inventory(
    tree: DataFrame,
    max_files: int = rules.MAX_FILES_PER_REPO,
    max_bytes: int = rules.MAX_FILE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Split repository listings into an inventory and skipped files with a reason.

    ``tree`` has repo_id, pos (listing order within the repository), path and size. Useful files past
    ``max_files`` in listing order are ``file_limit_exceeded``; of the rest, files over ``max_bytes``
    are ``file_too_large``.
    """
    valid, _ = normalize_paths(tree)
    useful = useful_paths(valid).withColumn("size", F.coalesce("size", F.lit(0)))
    ranked = rank_by_position(useful, ["repo_id"], "pos", out="_rank")
    judged = ranked.withColumn(
        "reason",
        F.when(F.col("_rank") > max_files, F.lit("file_limit_exceeded")).when(
            F.col("size") > max_bytes, F.lit("file_too_large")
        ),
    ).drop("_rank")
    files = with_language(judged.filter(F.col("reason").isNull()).drop("reason"))
    skipped = judged.filter(F.col("reason").isNotNull()).select(
        "repo_id", "pos", "path", "size", "reason"
    )
    return files, skipped


def landed_bodies(
    pages: DataFrame, body: str = "html", max_chars: int = rules.MAX_BODY_CHARS
) -> DataFrame:
    """Drop empty and oversized bodies."""
    return pages.filter(F.length(body).between(1, max_chars))


def scan_pages(spark: SparkSession, path: str, **limits) -> DataFrame:
    return landed_bodies(spark.read.schema(schemas.PAGES).parquet(path), **limits)


def read_event_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Newline-delimited JSON events. Blank lines are skipped; lines that are not JSON keep their
    text in ``_corrupt_record``."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.EVENTS).option("mode", "PERMISSIVE").json(path)


def read_seed_list(spark: SparkSession, source: str | Iterable[dict]) -> DataFrame:
    """Configured repositories (a CSV path with a header, or rows) as a table.

    Rows need ``repo_url``; description and star_label are optional. Addresses that are not
    repositories are dropped, repeats keep the first.
    """
    columns = ["repo_url", "description", "star_label"]
    if isinstance(source, str):
        raw = spark.read.option("header", True).csv(source)
        raw = raw.withColumn("pos", F.monotonically_increasing_id())
        for c in columns:
            if c not in raw.columns:
                raw = raw.withColumn(c, F.lit(None).cast("string"))
    else:
        rows = [(i, *(r.get(c) for c in columns)) for i, r in enumerate(source)]
        raw = spark.createDataFrame(rows, "pos bigint, " + ", ".join(f"{c} string" for c in columns))
    parsed = parse_repo_urls(raw.withColumnRenamed("repo_url", "given_url"), "given_url")
    return first_wins(parsed.filter(F.col("full_name").isNotNull()), ["full_name"], "pos").select(
        "pos", "owner", "name", "full_name", "repo_url", "description", "star_label"
    )
