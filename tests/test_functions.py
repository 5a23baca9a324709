"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import ids
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.operators import corpus, predicates
from docloom.operators.ordering import natural_key, site_group


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "base,href,expected",
    [
        ("https://A.com/docs/x.html", "y", "https://a.com/docs/y"),
        ("https://a.com/docs/x.html", "/y?q#f", "https://a.com/y?q#f"),
        ("https://a.com", "b/../c/./d", "https://a.com/c/d"),
        ("https://a.com/x/y/", "../../z/..", "https://a.com/"),
        ("http://a.com:80/x", "//B.org", "http://b.org/"),
        ("https://a.com/x", "?p=1", "https://a.com/x?p=1"),
        ("https://a.com/x#t", "#u", "https://a.com/x#u"),
        ("https://a.com/x", "mailto:me@a.com", None),
        ("https://u:p@a.com:443/x", "y", "https://a.com/y"),
    ],
)
def test_resolve(spark, base, href, expected):
    assert one(spark, U.resolve(F.col("b"), F.col("h")), b=base, h=href) == expected


@pytest.mark.parametrize(
    "fn,value,expected",
    [
        (T.slug, "  Hello, World! ", "hello-world"),
        (T.compact, "Re-Act 19", "react19"),
        (T.heading_anchor, "Äpfel & `code`", "äpfel-code"),
        (T.heading_anchor, "???", "section"),
        (T.heading_slug, "??", "section"),
        (T.title_from_slug, "api-reference_guide.html", "API Reference Guide"),
        (T.title_from_slug, "", "Documentation"),
        (T.outline_title_from_slug, "MCP-toolS", "MCP Tools"),
        (T.nav_title, "  rsc and HTTP apis ", "RSC And HTTP Apis"),
        (T.topic_label, "data-FETCHING ui", "Data Fetching UI"),
        (T.heading_title, "[Linked *t*](x.md) - [A](a)", "Linked t"),
        (T.heading_title, "Plain - [A](a) - [B](b)", "Plain"),
        (U.namespace, "https://r.dev/reference/react-dom/server/x", "react-dom-server"),
        (U.namespace, "https://r.dev/docs/guides/auth/x", "auth"),
        (U.namespace, "https://r.dev/blog", None),
        (U.entry_slug, "https://a.com/docs/Latest/Get%20It.md", "get-20it"),
        (U.dedupe_key, "https://a.com/x/#y", "https://a.com/x"),
        (U.registrable_host, "www.docs.acme.dev", "acme.dev"),
        (site_group, "https://a.com/docs/guides/auth", "Guides / Auth"),
        (site_group, "https://a.com/v2/reference/cli", "Reference / CLI"),
        (site_group, "https://a.com/x/overview", "X"),
        (corpus.docs_file_title, "docs/guides/README.md", "Guides"),
        (corpus.docs_file_title, "apps/web/src/app/docs/(g)/auth/page.mdx", "Auth"),
        (corpus.docs_file_group, "x/docs/api/rest/a.md", "API / Rest"),
        (corpus.citation_path, "https://github.com/a/b/blob/main/src/x.ts#L3", "src/x.ts"),
        (corpus.citation_path, "./lib/y.go:12", "lib/y.go"),
        (corpus.citation_path, "not a path.ts", None),
    ],
)
def test_text(spark, fn, value, expected):
    assert one(spark, fn(F.col("v")), v=value) == expected


@pytest.mark.parametrize(
    "word,expected",
    [
        ("queries", ["queries", "query", "querie"]),
        ("caching", ["caching", "cach", "cache"]),
        ("cached", ["cached", "cach"]),
        ("hooks", ["hooks", "hook"]),
    ],
)
def test_stems(spark, word, expected):
    assert sorted(one(spark, T.stem_variants(F.col("w")), w=word)) == sorted(expected)


def test_natural_order(spark):
    paths = ["docs/10-b.md", "docs/2-a.md", "Docs/1-z.md", "docs/002-b.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.p for r in df.orderBy(natural_key(F.col("p")), "p").collect()]
    assert got == ["Docs/1-z.md", "docs/2-a.md", "docs/002-b.md", "docs/10-b.md"]


def test_links_for_publishing(spark):
    image = lambda u: one(
        spark, corpus.image_source(F.col("u"), F.lit("o"), F.lit("r"), F.lit("sha")), u=u
    )
    assert image("./img/a.png") == "https://raw.githubusercontent.com/o/r/sha/img/a.png"
    assert image("https://evil.example/a.png") is None
    assert image("../a.png") is None
    assert image("data:image/png;base64,x") is None
    page = lambda u: one(spark, corpus.page_link(F.col("u"), F.lit("/o/r")), u=u)
    assert page("routing#x") == "/o/r/routing#x"
    assert page("overview") == "/o/r"
    assert page("#top") == "#top"
    assert page("../x") is None
    assert page("javascript:alert(1)") is None


def test_keys(spark):
    import hashlib

    got = one(spark, ids.citation_key(F.col("p"), F.lit(3), F.lit(None).cast("int")), p="a.ts")
    assert got == hashlib.sha256(b"a.ts:3:").hexdigest()
    client = one(spark, ids.client_key(F.col("a"), F.lit(None).cast("string")), a="1.2.3.4")
    assert client == hashlib.sha256(b"1.2.3.4\nunknown").hexdigest()


def test_hosts(spark):
    urls = ["https://github.com/a", "https://x.youtube.com/", "https://notgithub.com/", "https://my.discord.gg/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.url for r in predicates.admit_docs_urls(df).collect()] == ["https://notgithub.com/"]
