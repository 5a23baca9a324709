"""Shards of near-equal bytes by a k-d tree over document metadata.

Equal texts are one point, weighted by their bytes, so they stay together. A node that is to hold k shards splits
along the metadata dimension that is widest in it (its range as a share of the whole table's) at the weighted
quantile floor(k/2)/k, the weighted median when k is even, until every leaf is one shard. Ties on the dimension
are ordered by the hash of the text, so a metadata value that holds most rows is cut like any other.

Medians are found for all nodes of a level together by histograms: each round is one partial aggregate over the
narrow table of points, and narrows the range around every median to one bucket. Only histogram rows
(``max_cells`` at most a round) and the splits reach the driver. A round's bucket counts shrink as nodes grow.

A string dimension counts by the rank of its value among the distinct ones, which Spark sorts, so values that share a long prefix still split.

Nulls: a null text weighs one byte and equals the empty text; a metadata value that is null or no number lies
below all others (dimensions are strings or numbers).
Repeated rows stay and each gets a slot of its own; ids may repeat or be null. Other columns are not looked at,
and their names do not matter. An empty table gives an empty result. A text whose copies outweigh a
shard makes that shard heavier; it is not torn apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.base import small, table
from docloom.llm.ranks import ranked
from docloom.llm.registry import register
from docloom.session import materialized

TOP = 2**53  # hashes lie below it, exact in a double
POINT = ["key", "crc", "size"]


def _number(c: Column) -> Column:
    """A numeric metadata value; null for what is no number."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _ranks(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the strings of ``name`` replaced by their rank among its distinct values, in the order of their bytes."""
    values = rows.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_every", F.lit("*"))
    placed = materialized(ranked(values, "_every", [name], "shard-values", "_rank").select(name, "_rank"), "shard-ranks")
    joined = rows.join(placed, name, "left").withColumn(name, F.coalesce(F.col("_rank").cast("double"), F.lit(-1.0)))
    return joined.select(*rows.columns)


def text_rows(docs: DataFrame, id_col: str, text_col: str, dims: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    strings = [i for i, d in enumerate(dims) if isinstance(docs.schema[d].dataType, T.StringType)]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("key"),
        F.crc32(text).alias("crc"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        *[(F.col(d) if i in strings else _number(F.col(d))).alias(f"d{i}") for i, d in enumerate(dims)],
    )
    rows = materialized(rows, "shard-texts")  # the texts are read once
    numbers = [f"d{i}" for i in range(len(dims)) if i not in strings]
    if numbers:
        least = rows.agg(*[F.min(c).alias(c) for c in numbers]).first()
        rows = rows.fillna({c: (0.0 if least[c] is None else least[c]) - 1 for c in numbers})
    for i in strings:
        rows = _ranks(rows, f"d{i}")
    return rows


class _Search:
    """The split of one node: narrowed by value first, then, inside one value, by hash."""

    def __init__(self, dim: int, lo: float, hi: float, total: int, goal: float):
        self.dim, self.total, self.goal, self.below = dim, total, goal, 0
        self.value, self.lo, self.hi = None, lo, hi  # value: set once ties are being cut by hash
        self.split: tuple[float, int] | None = None

    def narrow(self, cells: list, tolerance: float) -> None:
        """cells: (bytes, n points, least, greatest) of the buckets inside the range, in order."""
        at = self.below
        for weight, n, least, most in cells:
            if at + weight >= self.goal or (weight, n, least, most) == cells[-1]:
                if weight <= tolerance * self.total or n == 1 or (self.value is not None and least == most):
                    take = abs(at + weight - self.goal) < abs(at - self.goal)
                    if self.value is None:
                        self.split = (most, TOP) if take else (least, 0)
                    else:
                        self.split = (self.value, int(most) + 1 if take else int(least))
                elif self.value is None and least == most:
                    self.value, self.lo, self.hi, self.below = least, 0, TOP, at
                else:
                    self.lo, self.hi, self.below = least, most, at
                return
            at += weight


def _splits(points: DataFrame, nodes: dict[int, int], widths: list[float], n_dims: int, max_cells: int, tolerance: float):
    """node -> (dim, value, hash) for the nodes with more than one shard; ``nodes`` has the shards of each."""
    spread = points.groupBy("node").agg(
        F.sum("bytes").alias("bytes"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    search: dict[int, _Search] = {}
    for r in spread.collect():  # a row per node
        k = nodes[r.node]
        dim = max(range(n_dims), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / widths[i] if widths[i] else 0.0, -i))
        search[r.node] = _Search(dim, r[f"lo{dim}"], r[f"hi{dim}"], r.bytes, r.bytes * (k // 2) / k)
    spark = points.sparkSession
    while todo := {n: s for n, s in search.items() if s.split is None}:
        cells = max(8, max_cells // len(todo))
        state = [(n, s.dim, s.value, float(s.lo), float(s.hi)) for n, s in todo.items()]
        state = spark.createDataFrame(state, "node long, dim int, value double, lo double, hi double")
        x = points.join(small(state, len(todo)), "node")
        v = F.get(F.array(*[F.col(f"d{i}") for i in range(n_dims)]), F.col("dim"))
        x = x.withColumn("x", F.when(F.col("value").isNull(), v).when(v == F.col("value"), F.col("h").cast("double")))
        x = x.where("x BETWEEN lo AND hi")
        width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
        b = F.least(F.coalesce(F.floor((F.col("x") - F.col("lo")) / width * cells), F.lit(0)), F.lit(cells - 1))
        hist = x.groupBy("node", b.alias("b")).agg(F.sum("bytes"), F.count(F.lit(1)), F.min("x"), F.max("x"))
        found: dict[int, list] = {}
        for r in sorted(hist.collect(), key=lambda r: (r[0], r[1])):  # max_cells rows at most
            found.setdefault(r[0], []).append(tuple(r)[2:])
        for n, s in todo.items():
            s.narrow(found[n], tolerance)
    return {n: (s.dim, *s.split) for n, s in search.items()}


def kd_shards(
    docs: DataFrame,
    n_shards: int | None = None,
    target_bytes: int | None = None,
    dims: tuple[str, ...] = ("n_chars", "source", "lang"),
    max_cells: int = 65_536,
    tolerance: float = 1e-4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row. Give ``n_shards``, or the ``target_bytes`` of a leaf."""
    dims = [d for d in dims if d in docs.columns] or [id_col]
    axes = range(len(dims))
    rows = materialized(text_rows(docs, id_col, text_col, dims), "shard-rows")
    points = rows.groupBy(*POINT).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *[F.min(f"d{i}").alias(f"d{i}") for i in axes]
    )
    points = points.withColumn("h", F.shiftrightunsigned("key", 11)).withColumn("node", F.lit(0).cast("long"))
    points = materialized(points, "shard-points")
    whole = points.agg(
        F.sum("bytes"), F.sum("n"), *[(F.max(f"d{i}") - F.min(f"d{i}")) for i in axes]
    ).first()
    total, n_rows, widths = whole[0] or 0, whole[1] or 0, [w or 0.0 for w in whole[2:]]
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    # a node is named by the first shard below it; nodes: its number of shards
    nodes = {0: n_shards}
    while total and any(k > 1 for k in nodes.values()):
        open_nodes = {n: k for n, k in nodes.items() if k > 1}
        inner = points.where(F.col("node").isin(*open_nodes)) if len(open_nodes) < len(nodes) else points
        cuts = _splits(inner, open_nodes, widths, len(dims), max_cells, tolerance)
        table_ = [(n, dim, float(v), h, n + open_nodes[n] // 2) for n, (dim, v, h) in cuts.items()]
        cut = points.sparkSession.createDataFrame(table_, "node long, dim int, v double, sh long, right long")
        v = F.get(F.array(*[F.col(f"d{i}") for i in axes]), F.col("dim"))
        left = (v < F.col("v")) | ((v == F.col("v")) & (F.col("h") < F.col("sh")))
        node = F.when(F.col("dim").isNull() | left, F.col("node")).otherwise(F.col("right"))
        points = points.join(small(cut, len(table_)), "node", "left")
        points = points.select(*POINT, "bytes", "n", *[f"d{i}" for i in axes], "h", node.alias("node"))
        points = materialized(points, "shard-points")
        halves = {n: k // 2 for n, k in open_nodes.items()} | {n + k // 2: k - k // 2 for n, k in open_nodes.items()}
        present = {r.node for r in points.select("node").distinct().collect()}  # a row per node
        nodes = {n: k for n, k in (nodes | halves).items() if n in present}
    named = rows.select("doc_id", *POINT).join(points.select(*POINT, "node"), POINT)
    named = named.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.col("node").cast("int").alias("shard"), "key")
    return with_slots(materialized(named, "shard-named"), n_rows).drop("key", "part")


def with_slots(named: DataFrame, n_rows: int, rows_per_part: int = 500_000) -> DataFrame:
    """Gapless slots from 0 in every shard, counted part by part, so no shard goes through one task."""
    parts = max(16, -(-n_rows // rows_per_part))
    named = named.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)))
    counts = named.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per part
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    own = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "key")) - 1
    return (
        named.withColumn("own", own)
        .join(offsets, ["shard", "part"])
        .withColumn("slot", (F.col("offset") + F.col("own")).cast("long"))
        .drop("offset", "own")
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write every document into the folder of its shard; ids must be unique and not null."""
    placed = docs.join(shards.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)


@register("op10_sharding")
def op10(spark, sf_dir):
    shards = kd_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
