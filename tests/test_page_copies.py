"""The page stream keeps the first copy of an address, whatever order a file or its tasks hand the copies over."""

from pyspark.sql import functions as F

from docloom.session import scratch_dir
from docloom.streaming import jobs


def test_first_copy_within_a_batch_is_the_least(spark):
    root = scratch_dir(spark, "copies")
    html = "<html><body><main><h1>T</h1><p>page {} of the docs</p><a href='/x'>x</a></main></body></html>"
    # two files, a batch each; in both the larger id of an address comes first
    files = [[(7, "a"), (3, "a/"), (5, "a#top"), (6, "b"), (4, None), (2, None)], [(9, "c/"), (8, "c"), (1, "a")]]
    for i, rows in enumerate(files):
        data = [(p, u and f"https://d.dev/{u}", html.format(p), 1_700_000_000 + p if i == 0 else 1_700_000_100 + p) for p, u in rows]
        df = spark.createDataFrame(data, "page_id bigint, url string, html string, s bigint").coalesce(1)
        df.select("page_id", "url", "html", F.timestamp_micros(F.col("s") * 1_000_000 + 7).alias("landed_at")).write.parquet(f"{root}/in/{i}")
    schema = spark.read.parquet(f"{root}/in/0").schema
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    jobs.stream_pages(landed, f"{root}/out", f"{root}/checkpoint", delay="1000 days").awaitTermination()
    texts = {r.page_id: r.text for r in spark.read.parquet(f"{root}/out/texts").collect()}
    assert sorted(texts) == [2, 3, 6, 8]
    assert all(f"page {p} of the docs" in t for p, t in texts.items())
