"""Writing content artifacts and publishing revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions.ids import content_hash

_LAYOUT = {
    "file_inventory": ("application/json", "revisions", "/file-inventory.json"),
    "source_index": ("application/json", "revisions", "/source-index.json"),
    "wiki_markdown": ("text/markdown; charset=utf-8", "wiki", ".md"),
    "citations": ("application/json", "wiki", ".citations.json"),
}


def _by_kind(part: int) -> Column:
    case = None
    for kind, values in _LAYOUT.items():
        case = (F if case is None else case).when(F.col("kind") == kind, F.lit(values[part]))
    return case


def artifact_rows(content: DataFrame) -> DataFrame:
    """Add key, content_type, sha256 and byte_size to content rows.

    ``content`` has kind, repo_id, revision_id, page_id (null for repository artifacts) and text.
    """
    key = F.concat(
        F.lit("repos/"),
        F.col("repo_id"),
        F.lit("/"),
        F.when(_by_kind(1) == "wiki", F.concat(F.lit("wiki/"), F.col("page_id"), F.lit("/"))).otherwise(
            F.lit("")
        ),
        F.lit("revisions/"),
        F.col("revision_id"),
        _by_kind(2),
    )
    return content.select(
        "*",
        key.alias("key"),
        _by_kind(0).alias("content_type"),
        content_hash(F.col("text")).alias("sha256"),
        F.octet_length("text").cast("int").alias("byte_size"),
    )


def write_artifacts(content: DataFrame, path: str, batch: int) -> None:
    """Write the artifacts of one batch, partitioned by batch and kind.

    A batch that is written again replaces itself, so a retry leaves nothing twice; the latest batch of a key
    is the one that ``read_artifacts`` shows. The rebalance hint splits a kind that holds most rows over many tasks
    and keeps small kinds from writing many small files.
    """
    (
        artifact_rows(content)
        .hint("rebalance", "kind")
        .write.mode("overwrite")
        .partitionBy("kind")
        .parquet(f"{path}/batch={int(batch)}")
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Every key once, as its latest batch wrote it; the texts stay out of the comparison of batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    latest = rows.groupBy("key").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["key", "batch"], "left_semi")


def replace_revision_files(files: DataFrame, path: str, revision_id: str | None = None) -> None:
    """Replace all source file rows of the revisions in ``files``; other revisions stay.

    With ``revision_id`` that one revision is replaced, also by nothing.
    """
    if revision_id is not None:
        rows = files.filter(F.col("repo_revision_id") == revision_id).drop("repo_revision_id")
        rows.write.mode("overwrite").parquet(f"{path}/repo_revision_id={revision_id}")
        return
    (
        files.hint("rebalance", "repo_revision_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_revision_id")
        .parquet(path)
    )


# -- publishing -------------------------------------------------------------------------------


def _completed_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a snapshot directory whose write job was committed."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(marker):
            done.append(int(name.split("=", 1)[1]))
    return sorted(done)


def read_pointers(spark: SparkSession, root: str) -> DataFrame:
    """Current revision of each repository: the newest committed pointer snapshot."""
    versions = _completed_versions(spark, f"{root}/pointers")
    if not versions:
        return spark.createDataFrame([], schemas.POINTERS)
    return spark.read.schema(schemas.POINTERS).parquet(f"{root}/pointers/version={versions[-1]}")


def publish_revision(
    spark: SparkSession, root: str, version: int, pages: DataFrame, files: DataFrame
) -> None:
    """Make new revisions visible in one step.

    ``pages`` and ``files`` carry repo_id and revision_id. Their rows go to directories of their own
    first; readers only find them through the pointer snapshot, which is written last and counts once
    its job has committed. A failed publish leaves the previous snapshot in charge. Versions must grow, and a
    repository has one revision in a publish.
    """
    versions = _completed_versions(spark, f"{root}/pointers")
    if versions and version <= versions[-1]:
        raise ValueError(f"version {version} is not newer than {versions[-1]}")
    before = read_pointers(spark, root)
    pages.write.mode("overwrite").parquet(f"{root}/pages/version={version}")
    files.write.mode("overwrite").parquet(f"{root}/files/version={version}")
    written = spark.read.parquet(f"{root}/pages/version={version}")
    fresh = written.groupBy("repo_id").agg(F.max("revision_id").alias("revision_id"), F.min("revision_id").alias("_least"))
    several = fresh.where("revision_id <> _least").select("repo_id").limit(5).collect()
    if several:
        raise ValueError(f"more than one revision in a publish: {[r.repo_id for r in several]}")
    fresh = fresh.select("repo_id", "revision_id", F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    kept = before.join(fresh, "repo_id", "left_anti")
    kept.unionByName(fresh).write.mode("overwrite").parquet(f"{root}/pointers/version={version}")


def live_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that some repository's pointer names: at most one for each publish since the last compaction."""
    return sorted(r.version for r in read_pointers(spark, root).select("version").distinct().collect())


def read_published(spark: SparkSession, root: str, table: str = "pages") -> DataFrame:
    """Rows of the current revision of every repository; only directories that a pointer names are listed and read."""
    current = read_pointers(spark, root).select("repo_id", "revision_id", "version")
    live = live_versions(spark, root)
    if not live:
        return current
    folders = [f"{root}/{table}/version={v}" for v in live]
    return spark.read.option("basePath", f"{root}/{table}").parquet(*folders).join(current, ["repo_id", "revision_id", "version"])


def compact_versions(spark: SparkSession, root: str, version: int, tables: tuple[str, ...] = ("pages", "files")) -> None:
    """Gather what is published in directories of one new version, so that readers list few.

    Pointers keep their revision and time. As in a publish the snapshot is written last; what it leaves behind, ``remove_dead`` takes away.
    """
    versions = _completed_versions(spark, f"{root}/pointers")
    if not versions or version <= versions[-1]:
        raise ValueError(f"version {version} is not newer than {versions[-1:]}")
    before = read_pointers(spark, root)
    for table in tables:
        rows = read_published(spark, root, table).drop("version")
        rows.hint("rebalance", "repo_id").write.mode("overwrite").parquet(f"{root}/{table}/version={version}")
    before.withColumn("version", F.lit(version).cast(before.schema["version"].dataType)).write.mode("overwrite").parquet(
        f"{root}/pointers/version={version}"
    )


def remove_dead(spark: SparkSession, root: str, tables: tuple[str, ...] = ("pages", "files"), keep: int = 1) -> list[str]:
    """Delete directories that none of the last ``keep`` snapshots needs, and the snapshots before these; returns them.

    Readers of an older snapshot must have ended. A version above the newest snapshot may still be being published and stays.
    """
    versions = _completed_versions(spark, f"{root}/pointers")
    kept = versions[-keep:]
    if not kept:
        return []
    snapshots = spark.read.parquet(*[f"{root}/pointers/version={v}" for v in kept])
    live = {r.version for r in snapshots.select("version").distinct().collect()}
    jvm = spark.sparkContext._jvm
    gone = []
    for table in (*tables, "pointers"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(path) if fs.exists(path) else ():
            name = status.getPath().getName()
            number = int(name.split("=", 1)[1]) if name.startswith("version=") else None
            wanted = number is None or number > versions[-1] or number in (set(kept) if table == "pointers" else live)
            if not wanted:
                fs.delete(status.getPath(), True)
                gone.append(f"{table}/{name}")
    return sorted(gone)
