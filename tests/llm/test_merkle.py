"""The Merkle manifest against a plain recomputation, its block layout, and odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from docloom.llm import merkle
from docloom.llm.ranks import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return out


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append(row)
    first = lambda v: (v is not None, v)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (first(r[0]), leaf_of(r)))
    levels = {s: climb([leaf_of(r) for r in own]) for s, own in trees.items()}
    top = climb([levels[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for i, row in enumerate(trees[s]):
            steps = path(levels[s], i) + path(top, k)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            digest = leaf_of((row[0], lower(row[1]), *row[2:]) if bad else row)
            for a, b in steps:
                digest = sha(a + digest + b)
            out.append((str(row[0]), leaf_of(row), levels[s][-1][0], root, sha("".join(a + b for a, b in steps)), digest, digest == root))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_addresses_fill_the_buffer_and_halve_the_height():
    for levels in range(1, 5):
        at = np.concatenate([merkle.address(levels, d, np.arange(16**d)) for d in range(levels)])
        assert sorted(at) == list(range(merkle.nodes_of(levels)))
    # four levels: the upper two come first, then each subtree of two levels as one stretch
    assert [int(merkle.address(4, 1, i)) for i in (0, 15)] == [1, 16]
    for j in (0, 3, 255):
        children = merkle.address(4, 3, np.arange(16 * j, 16 * j + 16))
        assert list(children - merkle.address(4, 2, j)) == list(range(1, 17))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4095, 4096])
def test_a_block_is_the_plain_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    block, levels = merkle.Block.build([x.encode() for x in leaves], merkle.height(n)), climb(leaves)
    assert block.root().decode() == levels[-1][0]
    for i in {0, n // 2, n - 1}:
        assert [(a.decode(), b.decode()) for a, b in block.paths([i])[0]] == path(levels, i)


def test_manifest_with_two_layers_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, f"Text {i} É", r.choice(["en", None]), "hot", i) for i in range(4500)]
    rows += [(10_000 + i, "x" * i, "de", f"s{i % 37}", None) for i in range(300)]
    rows += [(None, None, None, None, None), (None, "A", None, None, 1), (7, "", "en", "", 0), (8, "Copy", "en", "one", 4), (8, "Copy", "en", "one", 4)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'?' tree", "'?' pos", "1 block", "'?' leaf", "'?' path")
    assert found(merkle.audit(docs.repartition(7))) == brute(rows)

    # a written manifest gives the same paths
    leaves = docs.selectExpr("doc_id", "source", "lang", "n_chars", "text")
    leaves = leaves.select(
        merkle.group_name(leaves.source).alias("tree"), leaves.doc_id.alias("id"), merkle.leaf_hash([leaves[c] for c in merkle.FIELDS]).alias("leaf")
    )
    at = merkle.placed(leaves, "test")
    merkle.write_manifest(merkle.manifest_of(at), f"file://{tmp_path}/manifest")
    again = merkle.read_manifest(spark, f"file://{tmp_path}/manifest")
    some = at.where("id IS NULL OR id % 977 = 0").select("tree", "pos", "id", "leaf")
    for row in merkle.proofs(again, some).collect():
        digest = merkle.fold(row.leaf.encode(), [(x.left.encode(), x.right.encode()) for x in row.path])
        assert digest.decode() == again.root()


def test_odd_tables(spark):
    rows = [(1, "word " * 200_000, "en", "s", 1_000_000)]
    assert found(merkle.audit(spark.createDataFrame(rows, DOCS))) == brute(rows)
    empty = merkle.audit(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns[0] == "doc_id" and len(empty.columns) == 7


def test_ranks_over_ranges(spark):
    rows = [("a" if i % 3 else "b", i % 50 if i % 7 else None, i) for i in range(3000)] + [("c", 1, 0)] * 900
    df = spark.createDataFrame(rows, "k string, x long, y long").repartition(9)
    got = [tuple(r) for r in ranked(df, "k", ["x", "y"], "test").collect()]
    for k in "abc":
        own = sorted((p, (x is not None, x or 0, y)) for kk, x, y, p in got if kk == k)
        assert [p for p, _ in own] == list(range(len(own)))
        assert [v for _, v in own] == sorted(v for _, v in own)
