"""The line field against enumeration, its features against plain counts, held-out accuracy, and odd texts."""

import itertools
import random
import zlib

import numpy as np
import pytest

from docloom.llm import base, line_quality

SF = "/root/testdata/sf0.01"


def test_marginals_and_gradient_equal_enumeration():
    r = np.random.default_rng(3)
    lengths = np.array([1, 4, 3, 1, 6])
    logit, moves = r.normal(size=lengths.sum()) * 2, r.normal(size=(2, 2))
    got, want, total, pairs = line_quality.marginals(logit, lengths, moves), [], 0.0, np.zeros((2, 2))
    for own in np.split(logit, np.cumsum(lengths)[:-1]):
        weight, good, seen = 0.0, np.zeros(len(own)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(own)):
            w = np.exp(sum(x for x, on in zip(own, y) if on) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            weight += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                seen[a, b] += w
        want.append(good / weight)
        total += np.log(weight)
        pairs += seen / weight
    assert np.allclose(got, np.concatenate(want))
    assert np.isclose(line_quality.log_sum(logit, lengths, moves), total)
    model = line_quality.Model(np.zeros(0, np.uint64))
    model.moves = moves
    assert np.allclose(model._pairs(logit, lengths), pairs, atol=1e-5)


def test_measures_are_plain_counts():
    common = np.array(sorted(line_quality.word_hash(w) for w in ("the", "and")), np.uint64)
    text = "The cat and THE dog.\n\n  a b a b \t a\nthe,  ###|9!\nÉté Straße\nThe cat and THE dog."
    x, length, key = line_quality.measures(text, common)
    at = {k: i for i, k in enumerate(line_quality.CUTS)}
    lines = text.split("\n")
    assert length.tolist() == [len(s) for s in lines]
    assert x[:, at["words"]].tolist() == [len(s.split()) for s in lines]
    assert np.isclose(x[0, at["common_words"]], 3 / 5) and np.isclose(x[3, at["common_words"]], 1 / 2)
    assert np.isclose(x[2, at["repeats"]], 3 / 5) and x[0, at["repeats"]] == 0
    assert np.isclose(x[3, at["symbols"]], 0.3) and np.isclose(x[3, at["bars"]], 0.1) and np.isclose(x[3, at["digits"]], 0.1)
    assert np.isclose(x[4, at["upper"]], 2 / 9) and x[:, at["ends"]].tolist() == [1, 0, 0, 1, 0, 1]
    assert key[0] == key[5] != 0 and key[1] == 0


def test_texts_of_any_length_are_read_whole(monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("ab \n.É|#") for _ in range(n)) for n in (0, 5, 300, 2000, 50, 700)] + ["x" * 500, "\n" * 400]
    common = np.array([line_quality.word_hash("ab")], np.uint64)
    whole = line_quality.bits_of(texts, common)
    assert [int(n) for n in whole[2]] == [t.count("\n") + 1 for t in texts]
    alone = [line_quality.bits_of([t], common) for t in texts]
    assert np.array_equal(whole[0], np.concatenate([a[0] for a in alone]))  # a text does not depend on its neighbours
    monkeypatch.setattr(line_quality, "PIECE", 64)
    cut = line_quality.bits_of(texts, common)
    assert cut[1].sum() == whole[1].sum()  # every code point of every line, in shorter lines
    assert line_quality.pieces("y" * 200) == ["y" * 64, "y" * 64, "y" * 64, "y" * 8]


def test_held_out_documents_are_told_apart(spark):
    docs = base.table(spark, "/root/testdata/sf0.1", "documents")
    labels = base.table(spark, "/root/testdata/sf0.1", "labels")
    model = line_quality.fitted(docs, labels, per_class=300)
    rows = line_quality.line_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = np.sort([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert len(bad) > 50 and np.searchsorted(good, bad).mean() / len(good) < 0.02  # 1 - area under the curve
    assert (good < 0.3).mean() < 0.01 and (bad >= 0.3).mean() < 0.1
    # held-out labels and other columns have no say
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END quality", "toxic")
    again = line_quality.fitted(docs.selectExpr("doc_id", "text", "'z' lang"), other, per_class=300)
    assert np.array_equal(model.weights, again.weights) and model.slope == again.slope


def test_lines_of_a_mixed_text(spark):
    docs, labels = base.table(spark, SF, "documents"), base.table(spark, SF, "labels")
    model = line_quality.fitted(docs, labels)
    prose = [r.text.split("\n")[0] for r in docs.where("lang = 'en' AND n_chars > 2000").limit(6).collect()]
    junk = ["a*** the### of%%% it&&& on$$$ and*** the### of%%%"] * 3
    text = "\n".join([*prose[:3], *junk, *prose[3:]])
    row = line_quality.line_quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, lines=True).first()
    assert [text[x.start : x.end] for x in row.lines] == text.split("\n")
    assert max(x.good for x in row.lines[3:6]) < 0.5 < min(x.good for x in [*row.lines[:2], *row.lines[-2:]])


@pytest.mark.parametrize("learned", [True, False])
def test_odd_rows(spark, learned):
    docs, labels = base.table(spark, SF, "documents"), base.table(spark, SF, "labels")
    model = line_quality.fitted(docs, labels if learned else labels.where("quality = 1"))
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t\n"), (4, "word " * 300_000), (5, "é퟿𝔘\x00"), (6, "same."), (6, "same.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'?' score", "'?' lines", "1 held_out", "'?' label")
    got = line_quality.line_quality(df, model, lines=True).collect()
    scores = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and scores[1] == scores[2]
    if not learned:
        assert all(s > 0.99 for s in scores.values())  # all that is labelled is good
    assert line_quality.line_quality(df.where("false"), model).count() == 0


def test_nothing_labelled(spark):
    docs, labels = base.table(spark, SF, "documents"), base.table(spark, SF, "labels")
    model = line_quality.fitted(docs, labels.where("false"))
    assert {r.score for r in line_quality.line_quality(docs, model).collect()} == {0.5}
    # rows of one document that do not agree, and null labels, teach nothing
    both = labels.selectExpr("doc_id", "0 quality").union(labels.selectExpr("doc_id", "1 quality")).union(labels.selectExpr("doc_id", "CAST(NULL AS INT)"))
    assert not line_quality.fitted(docs, both).weights.any()
