"""What the operators of this package share: words, scratch tables, row keys and components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import discard, materialized

SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def plain_words(text: Column) -> Column:
    """Runs of a-z, 0-9 and anything beyond ASCII, after A-Z became a-z; a null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, NOT_WORD), "")


def small(df: DataFrame, rows: int, limit: int = 20_000) -> DataFrame:
    """Hint a broadcast where the measured row count allows it, else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def sized(df: DataFrame, rows: int, row_bytes: int, most: int = 16 << 20) -> DataFrame:
    """Hint a broadcast of fixed-width rows whose measured count makes them at most ``most`` bytes, else leave the join to Spark."""
    return F.broadcast(df) if rows * row_bytes <= most else df


def hash_sample(df: DataFrame, key: Column, wanted: int, n_rows: int) -> DataFrame:
    """About ``wanted`` to twice as many rows, those with the smallest hashes of ``key``; a filter, so only they move."""
    part = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    return df.where(part <= min(1.0, (1.5 * wanted + 50) / max(n_rows, 1)))


def rows_of(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """The rows of ``docs`` whose id and text hash (and columns ``more``: its column = theirs) are among ``keys``.

    Nulls equal nulls. Texts move at most once, by id and hash, so no key gathers more than its own copies; they are not sorted.
    """
    keys = keys.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_key", *more.values())]).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_doc_id")) & F.xxhash64(text_col).eqNullSafe(F.col("_text_key"))
    for mine, theirs in more.items():
        same = same & F.col(mine).eqNullSafe(F.col(f"_{theirs}"))
    return docs.join(keys.hint("shuffle_hash"), same, "left_semi")


EDGES = 65_536


def _own_stars(batches):
    """(a, b) of a task's edges: every node and the least of its component in them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], ["a", "b"])


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node that it can reach.

    Large-star and small-star steps until nothing changes. Each step is an aggregate and a join on the
    node; its result is a table in the shared folder, so lineage stays short and a lost executor costs
    only its tasks. A step keeps a star per node, so a node with many neighbours is met as the key of
    many narrow rows, which partial aggregation and the skew join of AQE split. Before the steps every task makes stars of
    some ``EDGES`` edges of its own, so few edges take no step at all.
    """

    def stars(links: DataFrame) -> bool:
        """Whether every larger end has one smaller one, and no node is both."""
        ends = links.select(F.col("a").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("low"))
        ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
        odd = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("low").alias("low"))
        return odd.where("n > 1 OR (n = 1 AND low = 1)").isEmpty()

    flat = materialized(edges.select("a", "b").where("a <> b"), f"{name}-edges")
    tasks = -(-flat.count() // EDGES)
    now = materialized(flat.coalesce(max(1, tasks)).mapInArrow(_own_stars, "a long, b long"), f"{name}-stars")
    discard(flat)
    if tasks < 2:
        return now.toDF("node", "root")
    made, now = now, now.where("a <> b")
    for _ in range(rounds):
        if stars(now):
            root = now.select("b").distinct()
            return now.toDF("node", "root").union(root.select(F.col("b").alias("node"), F.col("b").alias("root")))
        both = now.union(now.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialized(large.distinct(), f"{name}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        starred = large.join(low, "a")
        step = starred.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = step.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = materialized(new, f"{name}-small")
        discard(made, large)
        made = now = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
