"""Long texts cross as few shuffles as can be, at any size."""

import random

from pyspark.sql import functions as F

from docloom.operators import corpus
from docloom.operators.corpus import prose
from docloom.plans import matching, repositories

SF = "/root/testdata/sf0.001"


def exchanged(spark, build, *columns):
    """Shuffles of the plan, nothing broadcast, that carry one of the columns."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, found = [build()._jdf.queryExecution().executedPlan().initialPlan()], 0
        while nodes:
            node = nodes.pop()
            carried = {x.split("#")[0] for x in node.output().mkString(",").split(",")}
            found += node.nodeName() == "Exchange" and not carried.isdisjoint(columns)
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return found


def test_drafts_are_shuffled_once(spark):
    assert exchanged(spark, lambda: matching.page_issues(spark, SF), "markdown", "text") == 1


def test_paths_are_blanked_line_by_line(spark):
    rows = [("see a/b.ts now\n\nsrc/x\nno path\r\n it's'lib/y' end/\n",), ("plain\ntext",), ("a/b\n/c d./e\n",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(prose(F.col("t"))).collect()]
    whole = F.regexp_replace("t", r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+", " ")
    assert got == [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(whole).collect()]


def test_docs_texts_are_not_shuffled(spark):
    assert exchanged(spark, lambda: repositories.repo_docs_index(spark, SF), "text") == 0


def test_headings_are_those_of_all_lines(spark):
    lines = ["# A", "## B ##", "#", "##### deep", "plain", "", "  ", "---", "  === ", "~~~", "```js", "***\t", " ## no", "### C\r", "`````", "x" * 50 + " ", "--", "## D\u2028", "---\u2028"]
    deal = random.Random(5)
    texts = [(str(i), "\n".join(deal.choices(lines, k=deal.randrange(12)))) for i in range(800)] + [("null", None), ("none", "")]
    files = spark.createDataFrame(texts, "path string, text string").coalesce(4)
    every = corpus._headings(corpus.outside_fences(files, ["path"]), ["path"])
    found = lambda df: sorted(tuple(r) for r in df.collect())
    assert found(corpus.markdown_headings(files, ["path"])) == found(every) != []
