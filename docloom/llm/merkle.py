"""Merkle manifest of a table, its subtrees kept in van Emde Boas order.

Rows are leaves of one tree per group (source), the roots of these are leaves of the tree of groups, and its root stands
for the table. A node is the SHA-256 of up to ``FAN`` consecutive nodes below it, as hex text; the last run of a
level may be short, down to one node. A tree is cut into aligned blocks of ``LEVELS`` levels of edges: block b of a layer holds the
leaves from b * FAN^LEVELS on, and the roots of a layer's blocks, in order, are the leaves of the next. A block is stored as one
buffer of digests: the upper half of its levels first, then each subtree below it, and each of these parts again in that way
(``address``), so that a path from leaf to root stays within few stretches of the buffer whatever the size of a page. The same
arithmetic places the nodes when a block is built and finds the siblings when a path is asked for.

On Spark: leaves are hashed by built-in functions in the scan, ranked within their group (``ranks.ranked``), and a task builds or reads one
block, of at most FAN^LEVELS leaves, whatever the size of a group. A layer has a 4096th of the rows of the one below it. Texts are
never shuffled. Written by ``write_manifest``, the blocks can be read back and asked for paths without the texts.

Nulls hash as ``-``, which no value gives; empty texts as ``0:``. Rows with a null group are a group of their own, which comes first;
null ids come first within a group, repeated ids in the order of their leaves, and repeated rows are leaves each. An empty
table has no rows, no blocks and no root. Columns that are not named as fields are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.base import LOWER, UPPER, table
from docloom.llm.ranks import ranked
from docloom.llm.registry import register
from docloom.session import materialized

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


# -- one block ----------------------------------------------------------------------------------


def nodes_of(levels: int) -> int:
    """Nodes of a full tree of that many levels of nodes."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index):
    """Place of node ``index`` (a number or an array) of ``depth``, the root's being 0, among ``levels`` levels of nodes."""
    place = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = levels - top
        span = FAN ** (depth - top)
        place = place + nodes_of(top) + index // span * nodes_of(below)
        index, depth, levels = index % span, depth - top, below
    return place + 0 * index


def height(n_leaves: int) -> int:
    """Levels of edges until one node remains."""
    h = 0
    while FAN**h < n_leaves:
        h += 1
    return h


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class Block:
    """The digests of an aligned subtree with ``n`` leaves and ``h`` levels of edges, in van Emde Boas order."""

    def __init__(self, n: int, h: int, nodes: np.ndarray):
        self.n, self.h, self.nodes = n, h, nodes

    @classmethod
    def build(cls, leaves: list[bytes], h: int) -> Block:
        counts = [-(-len(leaves) // FAN ** (h - d)) for d in range(h + 1)]
        last = max(int(address(h + 1, d, np.arange(c)).max()) for d, c in enumerate(counts))
        block = cls(len(leaves), h, np.zeros((last + 1, 32), np.uint8))
        block._put(h, [bytes.fromhex(x.decode()) for x in leaves])
        for d in range(h, 0, -1):
            block._put(d - 1, [hashlib.sha256(x).digest() for x in block.runs(d)])
        return block

    def _put(self, depth: int, digests: list[bytes]) -> None:
        at = address(self.h + 1, depth, np.arange(len(digests)))
        self.nodes[at] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)

    def runs(self, depth: int) -> list[bytes]:
        """The hex digests of every run of siblings of a depth below the root, joined."""
        count = -(-self.n // FAN ** (self.h - depth))
        raw = self.nodes[address(self.h + 1, depth, np.arange(count))].tobytes()
        return [raw[i : i + 32 * FAN].hex().encode() for i in range(0, len(raw), 32 * FAN)]

    def root(self) -> bytes:
        return self.nodes[0].tobytes().hex().encode()

    def paths(self, leaves: list[int]) -> list[list[tuple[bytes, bytes]]]:
        """For each leaf, from its own level up: the digests left and right of the path's node in its run."""
        out: list[list[tuple[bytes, bytes]]] = [[] for _ in leaves]
        for d in range(self.h, 0, -1):
            runs = self.runs(d)
            for path, i in zip(out, leaves):
                at, k = divmod(i // FAN ** (self.h - d), FAN)
                path.append((runs[at][: 64 * k], runs[at][64 * k + 64 :]))
        return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = _sha(left + leaf + right)
    return leaf


# -- layers on Spark ----------------------------------------------------------------------------


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    n, at = rows.num_rows, rows.column("block")[0].as_py()
    # the first block of a tree, if not full, is the only one
    block = Block.build([x.encode() for x in rows.column("digest").to_pylist()], LEVELS if at else height(n))
    return pa.table(
        {
            "tree": rows.column("tree")[:1],
            "pos": rows.column("block")[:1],
            "n": pa.array([n], pa.int32()),
            "h": pa.array([block.h], pa.int32()),
            "nodes": pa.array([block.nodes.tobytes()], pa.binary()),
            "digest": pa.array([block.root().decode()]),
        }
    )


BLOCK_KINDS = "tree string, pos long, n int, h int, nodes binary, digest string"


def layers(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of every layer over ``leaves`` (tree, pos, digest), lowest first; the last has one block a tree."""
    out, at = [], leaves
    while True:
        cut = at.select("tree", "pos", "digest", F.floor(F.col("pos") / BLOCK).alias("block"))
        at = materialized(cut.groupBy("tree", "block").applyInArrow(_build, BLOCK_KINDS), f"{name}-{len(out)}")
        last = at.agg(F.max("pos")).first()[0]
        if last is None:
            return []
        out.append(at)
        if last == 0:
            return out


def _block_of(row: dict) -> Block:
    return Block(row["n"], row["h"], np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32))


def _upper(row: dict) -> list[tuple[bytes, bytes]]:
    return [(x["left"].encode(), x["right"].encode()) for x in row["path"]]


def _in_blocks(leaves: DataFrame, blocks: DataFrame, put, kinds: str) -> DataFrame:
    """``put(rows, paths within the block, path of its root)`` for the rows (tree, pos, ...) of every block."""
    cut = leaves.withColumn("block", F.floor(F.col("pos") / BLOCK))
    held = blocks.select("tree", F.col("pos").alias("block"), "n", "h", "nodes", "path")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a block nobody asks about
            return put(left, [], [])
        own = right.to_pylist()[0]
        return put(left, _block_of(own).paths([i % BLOCK for i in left.column("pos").to_pylist()]), _upper(own))

    return cut.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInArrow(run, kinds)


def _with_paths(rows: pa.Table, paths: list, upper: list) -> pa.Table:
    """Rows of one block and their whole paths."""
    full = [[{"left": a.decode(), "right": b.decode()} for a, b in [*p, *upper]] for p in paths]
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return rows.drop_columns(["block"]).append_column("path", pa.array(full, kind))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def descend(blocks: list[DataFrame], roots: DataFrame, name: str) -> DataFrame:
    """The lowest layer's blocks with the path of their roots; ``roots``: (tree, path) of each tree's own root."""
    at = blocks[-1].join(roots, "tree")
    for k in range(len(blocks) - 2, -1, -1):
        at = materialized(_in_blocks(blocks[k], at, _with_paths, f"{_fields(blocks[k])}, path {PATH}"), f"{name}-{k}")
    return at


# -- a table ------------------------------------------------------------------------------------


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


class Manifest:
    """Blocks of the groups' trees (``groups``) and of the tree above them (``top``), lowest layer first."""

    def __init__(self, groups: list[DataFrame], top: list[DataFrame], names: DataFrame | None):
        self.groups, self.top, self.names = groups, top, names

    def root(self) -> str | None:
        return self.top[-1].first().digest if self.top else None

    def subroots(self) -> DataFrame:
        """tree, subroot and path of the subroot to the root, of every group."""
        no_path = F.array().cast(PATH)
        highest = self.top[-1].select("tree").distinct().withColumn("path", no_path)
        lowest = descend(self.top, highest, "merkle-top")
        return _in_blocks(self.names, lowest, _with_paths, f"{_fields(self.names)}, path {PATH}").select(
            F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"
        )

    def paths(self) -> DataFrame:
        """The lowest blocks of the groups with the path of their roots up to the root of all."""
        roots = materialized(self.subroots(), "merkle-subroots")
        return descend(self.groups, roots.select("tree", "path"), "merkle-paths")


def group_name(group: Column) -> Column:
    """Never null; in the order of the groups' bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (tree, id, leaf, ...) with pos, the place within the tree."""
    return ranked(rows, "tree", ["id", "leaf"], name)


def manifest_of(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (tree, pos, leaf)."""
    groups = layers(leaves.select("tree", "pos", F.col("leaf").alias("digest")), "merkle-groups")
    if not groups:
        return Manifest([], [], None)
    subroots = groups[-1].select(F.col("tree").alias("name"), "digest", F.lit("*").alias("tree"))
    names = ranked(subroots, "tree", ["name"], "merkle-names")
    return Manifest(groups, layers(names, "merkle-root"), names)


def write_manifest(found: Manifest, path: str) -> None:
    """One folder for each layer of blocks and one for the order of the groups; an empty manifest leaves an empty order."""
    for kind, blocks in (("groups", found.groups), ("top", found.top)):
        for k, df in enumerate(blocks):
            df.write.parquet(f"{path}/{kind}/layer={k}")
    if found.names is not None:
        found.names.write.parquet(f"{path}/names")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    def read(kind: str) -> list[DataFrame]:
        n = spark.read.parquet(f"{path}/{kind}").agg(F.max("layer")).first()[0] + 1
        return [spark.read.parquet(f"{path}/{kind}/layer={k}") for k in range(n)]

    return Manifest(read("groups"), read("top"), spark.read.parquet(f"{path}/names"))


def proofs(found: Manifest, rows: DataFrame) -> DataFrame:
    """``rows`` (tree, pos, ...) with ``path``: what stands left and right of each node up to the root of all.

    A path is as long as the trees are high, some 15 digests a level.
    """
    return _in_blocks(rows, found.paths(), _with_paths, f"{_fields(rows)}, path {PATH}")


def audited(found: Manifest, rows: DataFrame, claim: str = "claim") -> DataFrame:
    """``rows`` (tree, pos, ...) with ``proof_sha256`` and ``folded_root``, the root that the leaf ``claim`` leads to.

    Paths are followed where the block is, so only their digests leave the task.
    """

    def put(part: pa.Table, paths: list, upper: list) -> pa.Table:
        tail = b"".join(a + b for a, b in upper)
        claims = [x.encode() for x in part.column(claim).to_pylist()]
        proof = [_sha(b"".join(a + b for a, b in p) + tail).decode() for p in paths]
        folded = [fold(fold(c, p), upper).decode() for c, p in zip(claims, paths)]
        part = part.drop_columns(["block"]).append_column("proof_sha256", pa.array(proof, pa.string()))
        return part.append_column("folded_root", pa.array(folded, pa.string()))

    return _in_blocks(rows, found.paths(), put, f"{_fields(rows)}, proof_sha256 string, folded_root string")


# -- the query ----------------------------------------------------------------------------------

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)),
  lambda i: ord(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


SQL = f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS id, doc_id, source, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      ELSE {_sql_leaf("text")} END AS claim
  FROM documents),
leaves AS (
  SELECT *, coalesce('=' || source, '') AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base),
low AS (
  SELECT tree, 0 AS k, pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, k + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16
  FROM low WHERE n > 1 GROUP BY tree, k, pos // 16, n),
subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS k, pos, digest, n FROM subroots
  UNION ALL
  SELECT k + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16
  FROM high WHERE n > 1 GROUP BY k, pos // 16, n),
steps AS (
  SELECT l.id, x.k AS step, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < l.pos // (16 ** x.k)::BIGINT), '') AS lef,
    coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > l.pos // (16 ** x.k)::BIGINT), '') AS rig
  FROM leaves l JOIN low x ON l.tree = x.tree AND x.n > 1 AND x.pos // 16 = l.pos // (16 ** (x.k + 1))::BIGINT
  GROUP BY l.id, x.k
  UNION ALL
  SELECT l.id, 1000 + x.k, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < s.pos // (16 ** x.k)::BIGINT), ''),
    coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > s.pos // (16 ** x.k)::BIGINT), '')
  FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN high x ON x.n > 1 AND x.pos // 16 = s.pos // (16 ** (x.k + 1))::BIGINT
  GROUP BY l.id, x.k),
path AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step) AS i FROM steps),
folded AS (
  SELECT id, 0 AS i, claim AS digest FROM leaves
  UNION ALL
  SELECT f.id, f.i + 1, sha256(p.lef || f.digest || p.rig) FROM folded f JOIN path p ON p.id = f.id AND p.i = f.i + 1),
proof AS (SELECT id, sha256(string_agg(lef || rig, '' ORDER BY i)) AS proof_sha256 FROM path GROUP BY id)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
  arg_max(f.digest, f.i) AS folded_root, arg_max(f.digest, f.i) = r.digest AS verified
FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN high r ON r.n = 1 LEFT JOIN proof p ON p.id = l.id JOIN folded f ON f.id = l.id
GROUP BY l.id, l.doc_id, l.leaf, s.digest, r.digest, p.proof_sha256
"""


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, a fifth of the texts tampered with."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    own, changed = [F.col(c) for c in FIELDS], [F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    rows = docs.select(
        group_name(F.col("source")).alias("tree"),
        F.col("doc_id").alias("id"),
        leaf_hash(own).alias("leaf"),
        F.when(tampered, leaf_hash(changed)).alias("other"),
    )
    rows = placed(rows, "merkle").withColumn("claim", F.coalesce("other", "leaf")).drop("other")
    found = manifest_of(rows)
    root = found.root()
    if root is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )
    subroots = found.groups[-1].select("tree", F.col("digest").alias("subroot"))
    return audited(found, rows).join(subroots, "tree").select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )


@register("op11_merkle", SQL)
def op11(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))
