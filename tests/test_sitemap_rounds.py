"""A landed sitemap is read once, however many rounds and starts come to it."""

from docloom.operators import corpus
from docloom.session import scratch_dir

SITE = "https://docs.acme.dev"


def _chain(k):
    """Sitemaps that hand on in a row, to themselves and to one that never landed; the last lists a document twice."""
    loc = lambda *paths: "".join(f"<loc>{SITE}{p}</loc>" for p in paths)
    rows = [(f"{SITE}/docs/sitemap-{i}.xml", loc(f"/docs/sitemap-{i + 1}.xml", f"/docs/sitemap-{i}.xml", "/docs/gone.xml")) for i in range(k)]
    return [*rows, (f"{SITE}/docs/sitemap-{k}.xml", loc("/docs/a", "/docs/a#top"))]


def test_bodies_are_read_once(spark):
    root = scratch_dir(spark, "rounds")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    spark.createDataFrame(_chain(3), "url string, html string").write.parquet(f"{root}/in")
    bodies = spark.read.parquet(f"{root}/in").mapInPandas(counted, "url string, html string")
    starts = spark.createDataFrame([("r", f"{SITE}/docs/sitemap-0.xml"), ("s", f"{SITE}/docs/sitemap-2.xml#x"), ("s", f"{SITE}/docs/sitemap-2.xml"), (None, f"{SITE}/none.xml")], "repo_id string, url string")
    found = corpus.sitemap_documents(starts, bodies).orderBy("repo_id").collect()
    assert [(r.repo_id, r.url, r.sitemap, r.depth, r.pos) for r in found] == [(k, f"{SITE}/docs/a", f"{SITE}/docs/sitemap-3.xml", d, 0) for k, d in (("r", 3), ("s", 1))]
    assert read.value == 4
