"""The dealt operators against brute force, exact round trips and held-out accuracy, and on odd inputs."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import base, contamination, html_text, langid, licenses, near_copies, packing, personal, quality_rules
from docloom.llm import registry, sharding, simhash, warc
from docloom.session import materialized

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside
CLASHES = ("row", "fp", "key", "h", "node", "text_key", "stratum", "w", "n", "bytes", "x", "i", "d", "grp", "piece", "first", "pos")


@pytest.fixture(scope="module", autouse=True)
def loaded():
    registry.load()


@pytest.fixture(scope="module")
def docs(spark):
    return base.table(spark, SF, "documents")


def clashing(df):
    """Extra columns under names that operators use themselves."""
    return df.select("*", *[F.lit("?").alias(c) for c in CLASHES if c not in df.columns])


def odd(spark):
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [
        (None, None, None, None, None),
        (None, "a b c d", None, None, 7),
        (1, None, "en", None, None),
        (2, "", "en", "s", 0),
        (3, "  \n\t ", None, "s", 4),
        (4, long, "en", "s", len(long)),
        (5, "the same text of a few words", "en", "s", 28),
        (5, "the same text of a few words", "en", "s", 28),
        (6, "the same text of a few words", "fr", "t", 28),
        (7, "+++ @@@ 1.2.3 ... ¿? 𝔘𝔫𝔦", "xx", "t", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


def over_odd(spark):
    """(name, query over documents) of everything that takes documents."""
    labels = base.table(spark, SF, "labels")
    benchmark = base.table(spark, SF, "benchmark")
    model = personal.train(["and", "of"], 800)
    crf = langid.train([("en", ["the", "and", "of"] * 20), ("de", ["der", "und", "von"] * 20)], sequences=100, epochs=1)
    return {
        "quality": lambda d: quality_rules.quality_rules(d, labels),
        "personal": lambda d: personal.personal_data(d, model),
        "redacted": lambda d: personal.redacted(d, model),
        "language": lambda d: langid.languages(d, crf, runs=True),
        "language_unlearned": lambda d: langid.languages(d, None),
        "contamination": lambda d: contamination.contamination(d, benchmark),
        "licences": lambda d: licenses.license_mentions(d)[0],
        "simhash": lambda d: simhash.simhash_groups(d),
        "shards": lambda d: sharding.kd_shards(d, n_shards=4),
    }


def test_odd_rows_and_clashing_names(spark):
    rows = odd(spark)
    for name, run in over_odd(spark).items():
        assert run(clashing(rows)).count() == rows.count(), name
        assert run(rows.where("false")).count() == 0, name


def test_odd_rows_have_defined_results(spark):
    rows, runs = odd(spark), over_odd(spark)
    q = {(r.doc_id, r.n_words): r for r in runs["quality"](rows).collect()}
    assert q[(1, 0)].base_failed and q[(2, 0)].base_failed and not q[(1, 0)].kept
    assert q[(4, 60_000)].n_repeat_words == 60_000
    lang = {r.doc_id: r for r in runs["language"](rows).where("doc_id IS NOT NULL").collect()}
    assert [lang[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and lang[2].score == 0.0
    assert {r.lang_pred for r in runs["language_unlearned"](rows).collect()} == {"und"}
    groups = {r.doc_id: r for r in runs["simhash"](rows).collect() if r.doc_id is not None}
    assert groups[6].component_id == 5 and {groups[i].component_id for i in (1, 2, 3)} == {1} and groups[2].fp == 0
    shards = [r for r in runs["shards"](rows).collect()]
    assert len({r.shard for r in shards if r.doc_id in (5, 6)}) == 1  # equal texts stay together
    for s in {r.shard for r in shards}:
        own = sorted(r.slot for r in shards if r.shard == s)
        assert own == list(range(len(own)))
    kept = {r.doc_id: r.text for r in runs["redacted"](rows).collect()}
    assert kept[1] is None and kept[2] == ""


# -- WARC ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 150
    rows = [(1, "u1", big), (2, "u2", big), (3, "u3", "small"), (4, "u4", "small"), (5, None, None), (None, "u6", big), (2, "u2", big)]
    rows += [(10 + i, f"v{i}", f"payload {i} é " * 50) for i in range(40)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.archive(pages.repartition(3), f"file://{tmp_path}/a")
    for split in (64 << 20, 700):  # whole files, and ranges that cut them at record boundaries
        back = spark.read.format("warc").option("splitBytes", split).load(f"file://{tmp_path}/a")
        got = back.select(F.element_at("headers", "X-Page-Id").alias("id"), "record_type", "refers_to", "payload_bytes", "payload", "payload_digest").collect()
        assert len(got) == len(rows)
        texts = {str(i): h for i, _, h in rows}
        for r in got:
            want = (texts[r.id] if r.id else big) or ""
            assert r.payload_bytes == len(want.encode()) and r.payload_digest == hashlib.sha256(want.encode()).hexdigest()
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == want.encode()
        kinds = Counter((r.id, r.record_type, r.refers_to) for r in got)
        assert kinds[("1", "response", None)] == 1 and kinds[("2", "revisit", "<urn:page:1>")] == 2
        assert kinds[(None, "revisit", "<urn:page:1>")] == 1 and kinds[("4", "response", None)] == 1
    only = back.where("record_type = 'revisit' AND target_uri LIKE 'u2%'")
    assert only.count() == 2
    reader = warc.WarcReader(back.schema, {"path": f"file://{tmp_path}/a"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 5)]))
    assert len(left) == 1 and left[0].attribute == ("payload_bytes",) and len(reader.filters) == 1
    skipped = spark.read.format("warc").option("payload", "false").load(f"file://{tmp_path}/a")
    assert skipped.where("payload IS NOT NULL").count() == 0 and skipped.agg(F.sum("payload_bytes")).first()[0] > 0


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    row = {"record_type": "response", "record_id": "<urn:x>", "payload": b"<p>hello</p>", "payload_digest": None}
    one, two = warc.record(row), warc.record(row | {"record_id": "<urn:y>", "payload": b""})
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.warc").write_bytes(one + two)
    (tmp_path / "p/b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    warc.register_source(spark)
    got = spark.read.format("warc").load(f"file://{tmp_path}/p").collect()
    assert Counter((r.record_id, bytes(r.payload)) for r in got) == {("<urn:x>", b"<p>hello</p>"): 2, ("<urn:y>", b""): 2}
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert spark.read.format("warc").load(f"file://{tmp_path}/e").count() == 0


# -- quality rules --------------------------------------------------------------------------------


def test_binomial_tail_is_exact(spark):
    from fractions import Fraction
    from math import comb

    cases = [(0, 10, 0.1), (3, 200, 0.05), (5, 900, 0.01), (40, 5000, 0.01), (0, 2000, 0.004)]
    for k, n, p in cases:
        exact = float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(exact, rel=1e-9)


def test_false_rejections_stay_within_the_rate(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, marks = [], []
    for i in range(3000):
        good = r.random() < 0.8
        ws = [word() + ("###" if not good and r.random() < 0.9 else "") for _ in range(60)]
        rows.append((i, " ".join(ws), "en", "s", 0))
        marks.append((i, int(good)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.05 * (n.get((1, False), 0) + n[(1, True)]) and n.get((0, True), 0) == 0
    few = quality_rules.quality_rules(docs, labels.limit(20))
    assert few.where("NOT kept AND NOT base_failed").count() == 0  # too few labels certify nothing


# -- personal data --------------------------------------------------------------------------------


def plain_spans(t):
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    out = [("email", m.start(), m.end()) for m in re.finditer(email, t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        out += [("ip", m.start(), m.end())] * all(int(p) <= 255 for p in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        s = sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(d))
        out += [("card", m.start(), m.end())] * (13 <= len(d) <= 19 and s % 10 == 0)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        out += [("phone", m.start(), m.end())] * (9 <= sum(c.isdigit() for c in m[0]) <= 15)
    return out


def test_base_spans_equal_plain_patterns():
    r = random.Random(5)
    for k in range(20_000):
        letters = "ab.@@1234567890 -+().é%" if k % 2 else "0123456789-  ."
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
        assert plain_spans(t) == personal.base_spans(t), t


def test_added_spans_on_held_out_cases():
    model = personal.train(["and", "of", "thing", "other"], 4000)
    r = random.Random(99)
    right = Counter()
    for k in range(600):
        positive = k % 2 == 0
        lead, span = personal.example(r, positive)
        text = f"some words {lead}{span} and more"
        base, added = model.spans(text)
        hit = any(s < len("some words " + lead + span) and e > len("some words " + lead) for _, s, e, *_ in [*base, *added])
        right[positive, hit == positive] += 1
    assert right[True, True] / 300 > 0.9 and right[False, True] / 300 > 0.95
    assert personal.redact("mail a.b@c.org now", model) == "mail [EMAIL] now"


def test_long_secrets_leave_no_tail():
    model = personal.train(["and", "of", "thing", "other"], 4000)
    r = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n in (256, 257, 300, 1000, 5000):
        for lead in ("token=", "api_key: ", "password=", "secret = ", "", "key ", "bearer "):
            for alphabet in (letters, letters + "_-", "0123456789abcdef"):
                blob = "".join(r.choice(alphabet) for _ in range(n))
                got = personal.redact(f"some words {lead}{blob} and more", model)
                # digits among it may be a card number, which stands as such
                assert re.fullmatch(re.escape(f"some words {lead}") + r"(\[(SECRET|TOKEN|CARD)\])+ and more", got), (n, lead, got[:80])
        jwt = ".".join("eyJ" + "".join(r.choice(letters) for _ in range(n // 3)) for _ in range(3))
        left = re.sub(r"\[(SECRET|TOKEN|CARD)\]", "", personal.redact(f"auth token={jwt} and more", model))
        assert left.replace(".", "") == "auth token= and more", n
        assert personal.redact("see " + "some-plain-words/" * (n // 17) + "9 here", model).startswith("see some-plain")


# -- HTML -----------------------------------------------------------------------------------------


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><p>no";</script></head><body>
    <nav><a href=/>Home</a></nav><header><p>Site</p></header><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>Head &amp; line</h1><p>by me</p></header><p>Short.<p>The text of <b>the</b>
    first&nbsp;paragraph &lt;b&gt; is   here<br>and goes on.<ul><li>one</li><li>two</li></ul><aside>more</aside>
    <form><p>Sign up</p></form><section class="comments"><p>Nice post, I like it</p></section></article></main>
    <footer>&copy; site</footer></body></html>"""
    want = "Head & line Short. The text of the first paragraph <b> is here and goes on. one two"
    assert html_text.main_text(page) == want
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<p>")
    assert html_text.main_text(page[: page.index("<aside>")]) == want  # truncated


def test_odd_pages_keep_their_rows(spark):
    long = "<article><p>" + "the words of a long page " * 20_000 + "</p></article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>&nbsp;</p>"), (3, "u", long), (3, "u", long)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("text", F.lit("?"))
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    texts = sorted((r.page_id or 0, r.text) for r in got.collect())
    assert texts == [(0, ""), (1, ""), (2, ""), *[(3, ("the words of a long page " * 20_000).strip())] * 2]
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_two_passes_without_an_article():
    good = "this is the text that we want to have and it is of the kind that has a lot of words in it " * 4
    menu = "".join(f"<li><a href=/{i}>Entry number {i}</a></li>" for i in range(5))
    page = f"<body><ul>{menu}</ul><div><p>{good}</p><p>Short one.</p><p>{good}</p></div><ul>{menu}</ul><p>End</p></body>"
    one = good.strip()
    assert html_text.main_text(page) == f"{one} Short one. {one}"


def test_a_region_does_not_hide_a_plain_body():
    body = "This is the text of the page and it is not in an article but in a plain block of the body. " * 4
    body = body.strip()
    for teaser in (
        '<div class="post-meta">By X</div>',
        "<article><h2>More</h2><p>A teaser.</p></article>",
        '<section class="story">Soon</section>',
        '<div class="entry"><a href="/a">Read the other story of the day</a></div>',
    ):
        for page in (f"{teaser}<div class=text>{body}</div>", f"<div>{body}</div>{teaser}", f"<div>{body}</div>{teaser}<div>{body}</div>"):
            assert html_text.main_text(f"<html><body>{page}</body></html>").count(body) == page.count(body), page
    links = "<p><a href=/a>Read the first of all the other stories</a></p>"
    page = f"<article><p>{body}</p><p>{body}</p>{links}<p>Share this</p>{links}</article>"
    assert html_text.main_text(page) == f"{body} {body}"  # between bad neighbours


def test_random_markup_does_not_break_extraction():
    r = random.Random(2)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<a href='x>", "<!--", "-->", "<script>", "</script>", "&amp;", "&#xZ;", "<", ">", '"', "w ", "<br/>"]
    for _ in range(2000):
        page = "".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        assert html.unescape("") == "" and isinstance(html_text.main_text(page), str)


# -- language -------------------------------------------------------------------------------------


def test_held_out_language_accuracy(spark):
    docs = base.table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.languages(docs, langid.fitted(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = got.select("lang", "lang_pred", "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def test_long_letter_runs_are_read_whole():
    crf = langid.train([("en", ["the", "and", "thought"] * 20), ("de", ["der", "und", "nicht"] * 20)], sequences=200, epochs=2)
    for head, tail, want in (("the", "und", "de"), ("und", "the", "en")):
        words = langid.words_of(head * 13 + tail * 200)
        assert "".join(words) == head * 13 + tail * 200
        mean = crf.posteriors([words])[0].mean(axis=0)
        assert crf.labels[int(mean.argmax())] == want and len(words) > 1


def test_forward_backward_equals_enumeration():
    from itertools import product

    crf = langid.train([("a", ["xa", "ya", "za"] * 5), ("b", ["xb", "yb", "zb"] * 5)], sequences=60, epochs=2)
    texts = [["xa", "yb", "zb", "new"], ["ya"], ["zb", "xa"]]
    for words, got in zip(texts, crf.posteriors(texts)):
        e = np.array([crf.weights[crf.features(w)].sum(axis=0) for w in words])
        p = np.zeros((len(words), 2))
        for path in product(range(2), repeat=len(words)):
            s = np.exp(sum(e[i, y] for i, y in enumerate(path)) + sum(crf.moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                p[i, y] += s
        assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=1e-4)


# -- SimHash --------------------------------------------------------------------------------------


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghij") * 3 for _ in range(r.randint(0, 60))) for _ in range(300)]
    for t in texts[:120]:
        ws = t.split()
        if len(ws) > 30:
            ws[r.randrange(len(ws))] = "CHANGED"
        texts.append(" ".join(ws))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.simhash_groups(spark.createDataFrame(rows, DOCS), shard_rows=64).collect()}
    fps = []
    for t in texts:
        ws = t.lower().split()
        shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = roots(range(len(fps)), pairs)
    assert len(set(want.values())) < len(set(fps))  # something links beyond equal fingerprints
    for i, fp in enumerate(fps):
        assert got[i].fp % 2**64 == fp and got[i].component_id == want[i]


def test_shards_and_leaves_lose_no_pair():
    g = np.random.default_rng(1)
    far = g.integers(0, 2**63, 3000, dtype=np.uint64)
    ball = np.array([far[0] ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(a)], np.uint64)
    near = far[:800] ^ (np.uint64(1) << g.integers(0, 64, 800).astype(np.uint64))
    fp = np.unique(np.concatenate([far, near, ball]))
    pairs = []
    for k in range(0, len(fp), 500):
        i, j = np.nonzero(simhash.distance(fp[k : k + 500, None], fp[None, :]) <= 2)
        pairs += list(zip(fp[k + i].tolist(), fp[j].tolist()))
    want = roots(fp.tolist(), pairs)
    points, radii = simhash.build_tree(fp[::4], 3, 2)
    at, leaf = simhash.route(fp, points, radii, 2)
    links = []
    for s in range(8):
        own = np.unique(fp[at[leaf == s]])
        a, b = simhash.spanning_links(own, 2)
        links += list(zip(own[a].tolist(), own[b].tolist()))
    assert roots(fp.tolist(), links) == want


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in base.components(edges, "test").collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


# -- decontamination ------------------------------------------------------------------------------


def test_contamination_equals_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["the", "of", "a"] * 4 + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 15, 25, 0])]
    items += [(50, items[7][1]), (51, None), (None, "w1 w2")]
    texts = []
    for _ in range(120):
        ws = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5:
            own = r.choice(items[3:8])[1].split()
            k = r.randrange(len(own))
            ws[r.randint(0, len(ws)) : 0] = own[k : k + 12]
        texts.append(" ".join(ws).replace("the", "The"))
    rows = [(i % 100, t, "en", "s", 0) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("window"), F.lit(1).alias("len"))
    got = contamination.contamination(spark.createDataFrame(rows, DOCS), bench)
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect())
    want = Counter()
    for i, t, *_ in rows:
        ws, hit, found = t.lower().split(), set(), set()
        for item, text in items:
            own = (text or "").split() if item is not None else []
            n = min(10, len(own))
            for s in range(len(own) - n + 1) if own else ():
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == own[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        want[(i, len(ws), len(hit), tuple(sorted(found)))] += 1
    assert got == want and sum(k[2] for k in want) > 0


# -- licences -------------------------------------------------------------------------------------


def test_licence_rules(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": ({"apache-2.0"}, 1),
        "Released under CC BY-NC 4.0 and CC BY": ({"cc-by-nc-4.0", "cc-by"}, 2),
        "SPDX-License-Identifier: MIT": ({"mit"}, 0),
        "GNU General Public License, version 3": ({"gpl-3"}, 1),
        "mit der Zeit und apache": (set(), 0),
        "MIT License MIT License": ({"mit"}, 2),
    }
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(cases)]
    texts, mentions = licenses.license_mentions(spark.createDataFrame(rows, DOCS))
    keys = {r.row: r for r in texts.collect()}
    found = {}
    for m in mentions.collect():
        found.setdefault(keys[m.row].doc_id, set()).add(m.label)
    base_n = {r.doc_id: r.n_base for r in keys.values()}
    for i, (labels, n) in enumerate(cases.values()):
        assert found.get(i, set()) == labels and base_n[i] == n, rows[i]
    assert len(licenses.rules()) > 200


# -- packing and shards -----------------------------------------------------------------------------


def plain_best_fit(lengths, sizes, per_bin, span):
    left, bins, out = sum(lengths), [], []
    for n in lengths:
        open_bins = [(room - n, -i) for i, (room, _) in enumerate(bins) if room >= n]
        if open_bins:
            smallest = min(open_bins)[0]
            out.append({i for i, (room, _) in enumerate(bins) if room - n == smallest})
        else:
            c = min((c for c in sizes if c >= n), key=lambda c: ((c + per_bin + c * c / span) / min(c, left), c))
            bins.append((c, 0))
            out.append({len(bins) - 1})
        left -= n
        yield out[-1], bins


def test_best_fit_follows_the_rule():
    r = random.Random(6)
    lengths = sorted((r.randint(1, 100) for _ in range(400)), reverse=True)
    bins, offsets, sizes = packing.best_fit(lengths, (32, 64, 100), 4.0, 800.0)
    state = []
    plain = plain_best_fit(lengths, (32, 64, 100), 4.0, 800.0)
    for n, b, at in zip(lengths, bins, offsets):
        allowed, rooms = next(plain)
        assert b in allowed
        room, used = rooms[b]
        assert at == used
        rooms[b] = (room - n, used + n)
        state = rooms
    assert sizes == [min(c for c in (32, 64, 100) if c >= used) for _, used in state]


def test_packing_keeps_every_token(spark):
    rows = odd(spark)
    out = packing.packed(clashing(rows), F.size(base.space_words(F.col("text"))), group_rows=5).collect()
    assert Counter(r.doc_id for r in out)[4] == -(-60_001 // 4096) and sum(r.length for r in out if r.doc_id == 4) == 60_001
    for b in {r.bin for r in out}:
        own = sorted((r.offset, r.length, r.bin_size, r.bin_used) for r in out if r.bin == b)
        assert all(a[0] + a[1] == z[0] for a, z in zip(own, own[1:]))
        assert own[-1][0] + own[-1][1] == own[0][3] <= own[0][2]
    assert packing.packed(rows.where("false"), F.lit(1)).count() == 0


def test_shards_are_even_and_equal_texts_stay_together(spark, docs, tmp_path):
    for n in (1, 3, 8):
        rows = sharding.kd_shards(docs, n_shards=n).collect()
        loads = Counter()
        for r in rows:
            loads[r.shard] += r["size"]
        assert set(loads) == set(range(n))
        largest = max(r["size"] for r in rows)
        copies = docs.groupBy("text").agg(F.sum(F.octet_length("text") + 1).alias("b")).agg(F.max("b")).first()[0]
        assert max(loads.values()) - min(loads.values()) <= 2 * n.bit_length() * max(largest, copies)
    texts = {r.doc_id: r.text for r in docs.collect()}
    where = {}
    for r in rows:
        t = texts[r.doc_id].encode()
        assert r["size"] == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
        assert where.setdefault(t, r.shard) == r.shard
    sharding.write_shards(docs, sharding.kd_shards(docs, target_bytes=200_000), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == docs.count()


# -- pipeline and queries ----------------------------------------------------------------------------


def near_groups(texts):
    """Group of every text, by comparing all of them."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    order = sorted(range(len(texts)), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            a, b = sets[i], sets[j]
            if 5 * len(a) < 4 * len(b):
                break
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    return dict(zip(texts, root))


def test_near_copies_equal_brute_force_jaccard(spark):
    r = random.Random(7)
    rows, text = [], {}
    for g in range(12):
        base_words = [f"w{r.randint(0, 400)}" for _ in range(r.choice((3, 12, 60, 150)))]
        for _ in range(60 if g == 5 else 8):
            words = list(base_words)
            for _ in range(r.choice((0, 0, 1, 1, 2, 6))):
                words[r.randrange(len(words))] = f"v{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, rows[0][1]), (None, "no such text here at all")]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    near = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                near += a != b
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    assert near > 50
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted(tuple(sorted(str(rows[i][0]) for i in range(len(rows)) if root[i] == g)) for g in set(root))
    for most, block, sample in ((32, 1024, 8192), (2, 7, 0)):
        found, classes = near_copies.near_copies(df, pair_most=most, block_rows=block, sample=sample)
        got = {}
        for x in found.join(classes, "set_key").collect():
            got.setdefault(x.grp, []).append(str(x.doc_id))
        assert sorted(tuple(sorted(v)) for v in got.values()) == want, (most, block)


def test_pipeline_stage_drops_near_copies(spark):
    words = [f"word{i}" for i in range(100)]
    near, far = list(words), list(words)
    near[50] = "other"
    for i in (10, 30, 50, 70):
        far[i] = "other"
    rows = [(2, " ".join(words)), (1, " ".join(near)), (3, " ".join(far)), (4, " ".join(words))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {1, 3}


def test_pipeline_stages_follow_their_operators(spark):
    sf = "/root/testdata/sf0.01"
    docs = base.table(spark, sf, "documents")
    seen = {"documents": {r.doc_id: r.text for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialized(stage(spark, docs, sf), f"test-{name}")
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    q = quality_rules.quality_rules(base.table(spark, sf, "documents"), base.table(spark, sf, "labels"))
    assert set(seen["quality_rules"]) == {r.doc_id for r in q.where("kept").collect()}
    kept = seen["simhash_near_dedup"]
    assert len(set(kept.values())) == len(kept) and set(kept) <= set(seen["quality_rules"])
    # of every group of texts that five-word shingles at 0.8 connect, one stays
    groups = near_groups(sorted(set(seen["quality_rules"].values())))
    assert sorted(groups[t] for t in kept.values()) == sorted(set(groups.values())) and len(set(groups.values())) < len(groups)
    assert 0 < len(seen["decontamination"]) < len(kept)
    model_free = [plain_spans(t) for t in seen["personal_data"].values()]
    assert not any(model_free) and set(seen["personal_data"]) == set(seen["decontamination"])
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(seen["personal_data"])
    assert sum(r.length for r in pieces) == sum(len(t.split()) + 1 for t in seen["personal_data"].values())


def test_pipeline_on_odd_and_empty_documents(spark):
    for docs in (odd(spark), odd(spark).where("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialized(stage(spark, docs, SF), "test-odd")
    assert docs.count() == 0
    same = spark.createDataFrame([(None, "a b c", None, None, 5)] * 2 + [(None, "x y z", None, None, 5)], DOCS)
    assert corpus_pipeline.near_duplicates(spark, same, SF).count() == 2


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_registered(name):
    assert sum(q.startswith(f"{name}_") for q in registry.QUERIES) == 1
