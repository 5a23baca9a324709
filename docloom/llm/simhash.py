"""Near-duplicate groups by SimHash, found through vantage-point trees.

Every text becomes a 64-bit fingerprint of its word shingles. Distinct fingerprints are partitioned by a
vantage-point tree: a node splits by the Hamming distance to its vantage point, at a radius near the
median. By the triangle inequality two fingerprints within ``bits`` of each other that fall on different
sides of a node have the inner one within ``bits`` of the boundary; those inner ones are handed to the outer side
too, so every pair meets in at least one shard. A shard searches its own rows by the same tree, down
to small blocks compared exactly, and emits a spanning forest of its pairs. Components of these
links are the groups: no pair is lost, and none is listed twice for a large group.

The tree is fitted on a bounded sample of fingerprints (about ``max_sample`` at most, taken by hash) that grows
with the number of shards; every fingerprint is routed through it. A node passes about a fifth of its rows to both
sides at ``bits`` = 2 and three tenths at 3; from 4 on a vantage-point tree prunes nothing in 64 bits.

A null or empty text has no words and fingerprint zero, linked like any other. ``component_id`` is the
smallest id of the group; null ids are passed over, and a group without any id has a null one. Repeated
rows stay, each with its group. Other columns of the input are not looked at.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import components, hash_sample, table
from docloom.llm.registry import register
from docloom.session import materialized

BLOCK = 1024


def shingle_hashes(text: bytes, k: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxhash.xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[k - 1 :])]


#: For each byte its bits, one in each byte of a word; 255 such words add up without a carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes: bits set in over half of them."""
    out = np.zeros(len(counts), dtype=np.uint64)
    n = np.asarray(counts)
    at = np.flatnonzero(n)
    if len(at):
        lanes = LANES[np.asarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)]
        parts = -(-n[at] // 255)
        first = np.concatenate([[0], np.cumsum(parts)[:-1]])
        step = 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
        starts = np.repeat(np.concatenate([[0], np.cumsum(n[at])[:-1]]), parts) + step
        some = np.add.reduceat(lanes, starts, axis=0).view(np.uint8)
        votes = np.add.reduceat(some, first, axis=0, dtype=np.int32)
        out[at] = np.packbits(votes * 2 > n[at][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(k: int, most: int = 400_000):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            hashes, counts, parts = [], [], []
            for t in texts:
                own = shingle_hashes(t.as_py() or b"", k)
                hashes += own
                counts.append(len(own))
                if len(hashes) > most:  # memory for the votes stays bounded
                    parts.append(majority(hashes, counts))
                    hashes, counts = [], []
            parts.append(majority(hashes, counts))
            fp = pa.array(np.concatenate(parts).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fp], ["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_key, fp) of every row; texts go to Python, narrow rows come back."""
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")
    )
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_fingerprint_batches(shingle), f"doc_id {id_type}, text_key long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split_radius(d: np.ndarray, bits: int) -> tuple[int, int]:
    """The radius between the 35th and 65th percentile that passes fewest rows to both sides, and how many."""
    lo, hi = np.percentile(d, [35, 65]).astype(int)
    counts = np.bincount(d, minlength=65)
    cost = {r: int(counts[max(0, r - bits + 1) : r + 1].sum()) for r in range(lo, max(lo, hi) + 1)}
    best = min(cost, key=lambda r: (cost[r], r))
    return best, cost[best]


def build_tree(sample: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full binary tree in heap order."""
    n = 2**depth - 1
    points, radii = np.zeros(n, np.uint64), np.full(n, 32, np.int64)
    todo = [(0, sample)]
    while todo:
        node, rows = todo.pop()
        if node >= n:
            continue
        if len(rows):
            tries = rows[np.linspace(0, len(rows) - 1, min(8, len(rows))).astype(int)]
            found = [(split_radius(distance(rows, p), bits), p) for p in tries]
            (radius, _), point = min(found, key=lambda x: x[0][1])
            points[node], radii[node] = point, radius
        d = distance(rows, points[node])
        todo += [(2 * node + 1, rows[d <= radii[node]]), (2 * node + 2, rows[d > radii[node]])]
    return points, radii


def route(fp: np.ndarray, points: np.ndarray, radii: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf a row belongs to."""
    at, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    while len(node) and node[0] < len(points):
        d, r = distance(fp[at], points[node]).astype(np.int64), radii[node]
        inner, outer = d <= r, d > r - bits
        at = np.concatenate([at[inner], at[outer]])
        node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
    return at, node - len(points)


def spanning_links(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over ``fp`` (distinct) with the components of all pairs within ``bits``: (row, its root)."""
    root = np.arange(len(fp))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                return
            np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up

    todo = [np.arange(len(fp))]
    while todo:
        rows = todo.pop()
        if len(rows) < 2:
            continue
        if len(rows) > BLOCK:
            d = distance(fp[rows], fp[rows[len(rows) // 2]])
            r, both = split_radius(d, bits)
            inner, outer = rows[d <= r], rows[d.astype(np.int64) > r - bits]
            if max(len(inner), len(outer)) < 0.8 * len(rows):
                todo += [inner, outer]
                continue
        for s in range(0, len(rows), BLOCK):  # a dense cluster: block by block, exact
            for t in range(s, len(rows), BLOCK):
                x, y = rows[s : s + BLOCK], rows[t : t + BLOCK]
                i, j = np.nonzero(distance(fp[x][:, None], fp[y][None, :]) <= bits)
                off = x[i] != y[j]
                join(x[i[off]], y[j[off]])
    own = np.flatnonzero(root != np.arange(len(fp)))
    return own, root[own]


def fingerprint_links(reps: DataFrame, bits: int, shard_rows: int, max_sample: int) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect exactly what lies within ``bits``."""
    n = reps.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard_rows))))
    depth = min(depth, int(np.log2(max_sample / 32)))
    wanted = 32 * 2**depth
    sample = [r.fp for r in hash_sample(reps.select("fp"), F.col("fp"), wanted, n).collect()] if depth else []
    points, radii = build_tree(np.array(sorted(sample), dtype=np.int64).view(np.uint64), depth, bits)

    def to_shards(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, leaf = route(fp, points, radii, bits)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp[at].view(np.int64))], ["leaf", "fp"])

    def in_shard(rows: pa.Table) -> pa.Table:
        fp = np.unique(rows.column("fp").to_numpy().view(np.uint64))
        a, b = spanning_links(fp, bits)
        return pa.table({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    shards = reps.select("fp").mapInArrow(to_shards, "leaf long, fp long")
    return shards.groupBy("leaf").applyInArrow(in_shard, "a long, b long")


def simhash_groups(
    docs: DataFrame,
    bits: int = 2,
    shingle: int = 3,
    shard_rows: int = 4096,
    max_sample: int = 262_144,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp and component_id of every row of ``docs``."""
    rows = materialized(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    reps = materialized(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    links = fingerprint_links(reps, bits, shard_rows, max_sample)
    roots = components(links, "simhash").withColumnRenamed("node", "fp")
    # only linked fingerprints have a root; the others are groups of their own
    linked = reps.join(roots, "fp")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", F.col("component_id").alias("joined_id"))
    classes = reps.join(named, "fp", "left").select("fp", F.coalesce("joined_id", "first_id").alias("component_id"))
    classes = materialized(classes, "simhash-classes")  # two plain inputs, so that AQE can split a hot fingerprint
    return rows.join(classes, "fp").select("doc_id", "text_key", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@register("op8_simhash")
def op8(spark, sf_dir):
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
