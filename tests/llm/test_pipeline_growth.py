"""Steps of the pipeline whose work must not outgrow the input."""

import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import base, near_copies, personal, simhash


def _roots(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_of_edges_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(base, "EDGES", 7)
    r = random.Random(2)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(100)] + [(500 + i, 501 + i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    assert {x.node: x.root for x in base.components(df, "test").collect()} == _roots(edges)


def test_few_edges_take_no_step(spark, monkeypatch):
    tables, real = [], base.materialized
    monkeypatch.setattr(base, "materialized", lambda df, name: tables.append(name) or real(df, name))
    edges = [(i + 1, i) for i in range(50)]
    found = base.components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert {x.root for x in found.collect()} == {0}
    assert not [t for t in tables if t.endswith(("large", "small"))]


def test_bands_meet_all_within_three_bits_and_their_number_is_fixed(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), i % 4):
            b ^= 1 << bit
        rows.append(tuple(int(x) for x in np.array([a, b], np.uint64).view(np.int64)))
    df = spark.createDataFrame(rows, "x long, y long")
    bands = lambda c: near_copies._bands(F.col(c), 3)
    got = df.select(F.arrays_overlap(bands("x"), bands("y")).alias("met"), F.size(bands("x")).alias("n")).collect()
    assert all(x.met for x in got) and {x.n for x in got} == {10}


def test_classes_are_proposed_once_each(spark):
    fp = [0, 1, 3, 7, (1 << 63) - 1, -1, 5 << 40, 5 << 40]
    classes = spark.createDataFrame([(i, 10, x) for i, x in enumerate(fp)], "set_key long, n int, fp long")
    pairs = [(x.a, x.b) for x in near_copies.simhash_pairs(classes, (4, 5), 3).collect()]
    assert len({a for a, _ in pairs}) == len(pairs) and all(bin((fp[a] ^ fp[b]) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
    root = {}
    for a, b in pairs:
        root[max(a, b)] = min(a, b)
    assert {1, 2, 3, 5, 7} <= set(root)


def test_shingle_sets_are_those_of_words():
    r = random.Random(6)
    for n in (0, 1, 4, 5, 6, 300):
        words = [r.choice(["a", "B", "the", "Ünï", "x" * 300, "ab", "ba"]) for _ in range(n)]
        text = "".join(w + r.choice([" ", "\n", "\t ", "\x0b", "\r\n"]) for w in words).encode()
        low = text.lower().split()
        want = len({tuple(low[i : i + 5]) for i in range(max(1, n - 4))}) if n else 0
        assert len(near_copies.shingle_set(text, 5)) == want
        assert np.array_equal(near_copies.shingle_set(b" " + text.upper(), 5), near_copies.shingle_set(text, 5))
    assert len(near_copies.shingle_set(None, 5)) == 0


def test_votes_of_long_runs_are_counted_whole():
    rng = np.random.default_rng(3)
    counts = [0, 1, 254, 255, 256, 0, 5000, 2]
    hashes = rng.integers(0, 2**64, sum(counts), np.uint64)
    hashes[300:700] |= np.uint64(1)
    got, at = simhash.majority(hashes, counts), 0
    for n, fp in zip(counts, got.tolist()):
        own = hashes[at : at + n].tolist()
        assert fp == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)
        at += n


def test_candidates_of_many_texts_pass_the_trees_once(monkeypatch):
    model = personal.train(["and", "of", "thing", "other"], 1000)
    texts = [None, "", "password: hunter2secret99 and more", "no data", "call 212-555-1234 or token ghp_" + "a1B2" * 9] * 20
    want = [model.spans(t) for t in texts]
    calls, real = [], model.trees.score
    monkeypatch.setattr(model.trees, "score", lambda x: calls.append(len(x)) or real(x))
    assert model.spans_of(texts) == want and any(added for _, added in want)
    assert len(calls) == 1


def test_values_are_found_from_the_sign():
    import re
    import time

    pair = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,40}[\"']?[ ]?[=:][ ]?[\"']?([^\s\"',;=]{4,}+)")
    r = random.Random(5)
    for _ in range(20_000):
        text = "".join(r.choice("aZ9_-= :\"'xyé,\n") for _ in range(r.randint(1, 60)))
        assert personal.values(text) == [m.span(1) for m in pair.finditer(text)], text
    began = time.monotonic()
    for text in (":" * 200_000, "a:" * 100_000, "-" * 100_000 + ":"):
        personal.candidates(text)
    assert time.monotonic() - began < 20


def test_shingles_that_hold_the_same_classes_are_compared_once(spark, monkeypatch):
    # near copies of one text and as many texts that share its middle and are not alike: every shingle of the middle is crowded
    r = random.Random(8)
    base_words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(12):
        words = list(base_words)
        words[r.choice((0, 59))] = f"v{i}"
        texts.append(" ".join(words))
    texts += [" ".join([*(f"u{i}x{j}" for j in range(15)), *base_words[10:50], *(f"z{i}x{j}" for j in range(15))]) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingles, units, real, crowded_links = [], [], near_copies.Texts.of, near_copies._crowded_links

    def of(self, rows):
        if "side" in rows.columns:
            units.append(rows.select("h", "u", "v").distinct().count())
        return real(self, rows)

    def counted(crowded, *more):
        shingles.append(crowded.select("h").distinct().count())
        return crowded_links(crowded, *more)

    monkeypatch.setattr(near_copies.Texts, "of", of)
    monkeypatch.setattr(near_copies, "_crowded_links", counted)
    rows, classes = near_copies.near_copies(docs, pair_most=2, hub_rounds=1, common=0)
    groups = {x.doc_id: x.grp for x in rows.join(classes, "set_key").collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = [(i, j) for i in range(24) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = _roots([*alike, *((i, i) for i in range(24))])
    assert len({(root[i], groups[i]) for i in range(24)}) == len(set(root.values())) == len(set(groups.values()))
    assert shingles and 2 * sum(units) <= sum(shingles)
