"""Readers, writers and streams over temporary folders."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import corpus as operators
from docloom.sources import corpus, drafts, revisions
from docloom.streaming import batch, jobs


def test_event_log_lines(spark, tmp_path):
    ok = {"session_id": "s", "seq": 0, "type": "x", "data": {"message": "m"}}
    (tmp_path / "a.ndjson").write_text(json.dumps(ok) + "\n\n  \n{broken\n" + json.dumps({**ok, "seq": 1}))
    rows = corpus.read_event_log(spark, str(tmp_path)).cache()
    assert rows.filter("_corrupt_record is null").count() == 2
    assert rows.filter("_corrupt_record = '{broken'").count() == 1


def test_seed_list(spark, tmp_path):
    rows = [
        {"repo_url": "https://github.com/a/b", "description": "one"},
        {"repo_url": "https://github.com/a/b.git"},
        {"repo_url": "https://example.com/x"},
    ]
    got = corpus.read_seed_list(spark, rows).collect()
    assert [(r.full_name, r.description) for r in got] == [("a/b", "one")]


def test_outline_reply(spark):
    doc = {
        "title": "T",
        "summary": "S",
        "pages": [{"slug": "a", "title": "A", "purpose": "p", "priority": "urgent"}],
        "navigation": [{"title": "F", "children": [{"title": "A", "slug": "a"}]}],
    }
    raw = spark.createDataFrame([("r", "```json\n" + json.dumps(doc) + "\n```")], "repo_id string, raw string")
    pages, nav = drafts.parse_outlines(raw)
    assert [(r.slug, r.priority, r.source_paths) for r in pages.collect()] == [("a", "recommended", [])]
    assert [(r.depth, r.parent_id, r.slug) for r in nav.orderBy("depth").collect()] == [
        (1, None, None),
        (2, "0000", "a"),
    ]


def test_replacing_one_revision_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "files")
    files = lambda rev, paths: spark.createDataFrame(
        [(p, rev) for p in paths], "path string, repo_revision_id string"
    )
    revisions.replace_revision_files(files("1", "ab").unionByName(files("2", "c")), path)
    revisions.replace_revision_files(files("1", "d"), path)
    rows = {(str(r.repo_revision_id), r.path) for r in spark.read.parquet(path).collect()}
    assert rows == {("1", "d"), ("2", "c")}
    revisions.replace_revision_files(files("2", ""), path, "2")
    assert {r.path for r in spark.read.schema("path string").parquet(path).collect()} == {"d"}


def test_publishing_shows_whole_revisions(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda repo, rev, slugs: spark.createDataFrame(
        [(repo, rev, s) for s in slugs], "repo_id string, revision_id string, slug string"
    )
    shown = lambda: sorted((r.repo_id, r.slug) for r in revisions.read_published(spark, root).collect())
    revisions.publish_revision(spark, root, 1, rows("a", "a1", "xy").unionByName(rows("b", "b1", "z")), rows("a", "a1", "f"))
    # A publish that dies before its pointers leaves readers on the old revision.
    rows("a", "a2", "q").write.parquet(f"{root}/pages/version=2")
    assert shown() == [("a", "x"), ("a", "y"), ("b", "z")]
    revisions.publish_revision(spark, root, 2, rows("a", "a2", "w"), rows("a", "a2", "g"))
    assert shown() == [("a", "w"), ("b", "z")]
    with pytest.raises(ValueError):
        revisions.publish_revision(spark, root, 2, rows("a", "a3", "v"), rows("a", "a3", "g"))


def test_admission_is_in_order_across_batches_and_late_rows_are_counted(spark, tmp_path):
    src, rng = tmp_path / "in", random.Random(4)
    schema = "attempt_id bigint, client_key string, created_at timestamp"
    make = lambda rows: spark.createDataFrame(rows, "attempt_id bigint, client_key string, s bigint").select(
        "attempt_id", "client_key", F.timestamp_seconds("s").alias("created_at")
    )
    rows = [(i, rng.choice("abc"), 1_704_000_000 + rng.randint(0, 20_000)) for i in range(150)]
    # arrival: up to nine minutes out of order; five files, then a closing row, then a row far too late
    arrived = sorted(rows, key=lambda r: r[2] + rng.randint(0, 540))
    files = [arrived[i : i + 30] for i in range(0, 150, 30)] + [[(-1, "closing", 1_704_200_000)], [(999, "a", 1_704_000_000)]]
    for i, part in enumerate(files):
        make(part).coalesce(1).write.parquet(str(src / f"{i}"))
        for f in (src / f"{i}").glob("part-*"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    late = []
    out = jobs.run_available(jobs.stream_admission(stream, 3, 8), "late", late=late)
    got = sorted((r.attempt_id, r.allowed, r.scope) for r in out.collect() if r.attempt_id >= 0)
    want = sorted((r.attempt_id, r.allowed, r.scope) for r in batch.admission(make(rows), 3, 8).collect())
    assert got == want and sum(late) == 1 and {r[1] for r in want} == {True, False}
    assert out.select("batch").distinct().count() >= 5


def test_session_stops_at_first_boundary(spark):
    ev = lambda seq, kind, msg=None: ("s", seq, None, kind, (msg, msg, None, None, None, None, None))
    from docloom.schemas import EVENTS

    rows = [ev(5, "session.waiting"), ev(6, "message.appended", "a"), ev(7, "session.waiting"), ev(8, "message.completed", "b")]
    df = spark.createDataFrame([(*r, None) for r in rows], EVENTS)
    got = batch.session_fold(df).first()
    assert (got.reply, got.next_index, got.ended) == ("a", 8, True)


def test_artifacts_are_replaced_by_key_and_retry(spark, tmp_path):
    path = f"{tmp_path}/artifacts"
    rows = lambda *items: spark.createDataFrame(
        [("wiki_markdown", "r", "v1", page, text) for page, text in items],
        "kind string, repo_id string, revision_id string, page_id string, text string",
    )
    revisions.write_artifacts(rows(("a", "one"), ("b", "two")), path, 1)
    revisions.write_artifacts(rows(("b", "three")), path, 2)
    revisions.write_artifacts(rows(("b", "three")), path, 2)
    got = revisions.read_artifacts(spark, path).collect()
    assert sorted((r.page_id, r.text) for r in got) == [("a", "one"), ("b", "three")]


def test_readers_list_live_versions_only(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *items: spark.createDataFrame(list(items), "repo_id string, revision_id string, slug string")
    shown = lambda: sorted((r.repo_id, r.revision_id, r.slug) for r in revisions.read_published(spark, root).collect())
    read = lambda: {p.split("version=")[1].split("/")[0] for p in revisions.read_published(spark, root).inputFiles() if "/pages/" in p}
    for version in range(1, 6):
        page = rows(("a", f"a{version}", "x"), *([("b", "b1", "y")] if version == 2 else []))
        revisions.publish_revision(spark, root, version, page, page)
    want = [("a", "a5", "x"), ("b", "b1", "y")]
    assert shown() == want and read() == {"2", "5"}
    with pytest.raises(ValueError, match="more than one revision"):
        two = rows(("c", "c1", "p"), ("c", "c2", "p"))
        revisions.publish_revision(spark, root, 6, two, two)
    assert shown() == want
    revisions.compact_versions(spark, root, 7)
    assert shown() == want and read() == {"7"}
    gone = revisions.remove_dead(spark, root, keep=2)
    assert {x for x in gone if x.startswith("pages")} == {"pages/version=1", "pages/version=3", "pages/version=4", "pages/version=6"}
    assert shown() == want and revisions.remove_dead(spark, root) != [] and shown() == want


def test_sitemaps_are_read_in_rounds(spark):
    site = "https://docs.acme.dev"
    loc = lambda *paths: "".join(f"<url><loc>{site}{p}</loc></url>" for p in paths)
    bodies = [
        (f"{site}/sitemap.xml", loc("/docs/a.xml", "/docs/b.xml")),
        (f"{site}/docs/a.xml", loc("/docs/one", "/docs/two")),
        (f"{site}/docs/b.xml", loc("/docs/c.xml", "/sitemap.xml", "/docs/sitemap-self.xml")),
        (f"{site}/docs/c.xml", loc("/docs/two", "/docs/three")),
        (f"{site}/other.xml", loc("/docs/four", "/docs/a.xml")),
    ]
    landed = spark.createDataFrame(bodies, "url string, html string")
    starts = spark.createDataFrame([("r", f"{site}/sitemap.xml"), ("s", f"{site}/other.xml"), ("t", f"{site}/gone.xml")], "repo_id string, url string")
    rows = lambda **how: sorted((r.repo_id, r.url.rsplit("/", 1)[1], r.sitemap.rsplit("/", 1)[1], r.depth) for r in operators.sitemap_documents(starts, landed, **how).collect())
    first = [("r", "one", "a.xml", 1), ("r", "two", "a.xml", 1), ("s", "four", "other.xml", 0)]
    assert rows() == sorted([*first, ("r", "three", "c.xml", 2)])
    assert rows(depth=1) == first and rows(depth=0) == [("s", "four", "other.xml", 0)]
    assert rows(n=1) == first  # of the nested ones the first by score and place
