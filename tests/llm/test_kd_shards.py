"""K-d shards against a plain recursion over all points."""

import random

import pytest
import xxhash

from docloom.llm import sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, n_shards, dims):
    """Shard of every text: split at the weighted quantile of the widest dimension, ties by hash."""
    points = {}
    for row in rows:
        text = row["text"] or ""
        p = points.setdefault(text, {"bytes": 0, "at": None, "h": (xxhash.xxh64_intdigest(text.encode(), 42)) >> 11})
        p["bytes"] += len(text.encode()) + 1
        at = []
        for d in dims:
            values = sorted({r[d] for r in rows if r[d] is not None}, key=lambda v: v.encode() if isinstance(v, str) else v)
            v = row[d]
            at.append((-1 if isinstance(values[0], str) else values[0] - 1) if v is None else values.index(v) if isinstance(v, str) else v)
        p["at"] = at if p["at"] is None else [min(a, b) for a, b in zip(p["at"], at)]
    axes = range(len(dims))
    width = [max(p["at"][i] for p in points.values()) - min(p["at"][i] for p in points.values()) for i in axes]
    shard = {}

    def split(own, first, k):
        if k == 1 or not own:
            shard.update(dict.fromkeys(own, first))
            return
        spread = [(max(points[t]["at"][i] for t in own) - min(points[t]["at"][i] for t in own)) / width[i] if width[i] else 0 for i in axes]
        dim = max(axes, key=lambda i: (spread[i], -i))
        total = sum(points[t]["bytes"] for t in own)
        goal, below, left = total * (k // 2) / k, 0, []
        order = sorted(own, key=lambda t: (points[t]["at"][dim], points[t]["h"]))
        for t in order:
            n = points[t]["bytes"]
            if below + n >= goal:
                if abs(below + n - goal) < abs(below - goal):
                    left.append(t)
                break
            left.append(t)
            below += n
        split(left, first, k // 2)
        split([t for t in order if t not in set(left)], first + k // 2, k - k // 2)

    split(list(points), 0, n_shards)
    return shard


@pytest.mark.parametrize("n_shards", [2, 5, 8])
def test_equal_to_a_plain_recursion(spark, n_shards):
    r = random.Random(n_shards)
    host = "https://a-long-prefix-that-all-values-share.example.org/"
    rows = []
    for i in range(160):
        text = f"text {r.randint(0, 110)} " * r.randint(1, 40)
        rows.append({"doc_id": i, "text": r.choice([text, text, None if i % 50 == 0 else text]), "lang": r.choice(["en", "de", None]),
                     "source": host + r.choice("abcdefgh") * r.randint(1, 3), "n_chars": r.choice([len(text), len(text), None])})
    dims = ("n_chars", "source", "lang")
    df = spark.createDataFrame([tuple(x.values()) for x in rows], DOCS).selectExpr("*", "'?' d0", "'?' _rank", "1 node")
    want = plain(rows, n_shards, dims)
    got = sharding.kd_shards(df, n_shards=n_shards, dims=dims).collect()
    text_of = {x["doc_id"]: x["text"] or "" for x in rows}
    assert {(x.doc_id, x.shard) for x in got} == {(i, want[t]) for i, t in text_of.items()}


def test_values_with_a_common_prefix_are_told_apart(spark):
    rows = [(i, f"text number {i:04d}", "en", f"https://example.org/{'left' if i % 2 else 'right'}", 16) for i in range(400)]
    got = sharding.kd_shards(spark.createDataFrame(rows, DOCS), n_shards=2).collect()
    assert all((x.shard == 0) == (x.doc_id % 2 == 1) for x in got)
