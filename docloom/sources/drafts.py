"""Reading page drafts and outlines out of raw model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions.binding import stage
from docloom.functions.ids import positive



def _no_text() -> Column:
    return F.array().cast("array<string>")


def json_text(raw: Column) -> Column:
    """The JSON document in a reply: the whole text, a fenced block, or first to last brace."""
    t = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return (
        F.when(t.startswith("{") & t.endswith("}"), t)
        .when(t.rlike(r"(?is)```(?:json)?\s*(.*?)```"), F.trim(fenced))
        .when(braced != "", braced)
    )


def _blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def parse_drafts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split replies (``repo_id``, ``raw``) into page drafts and rejected replies.

    A reply is an object with ``pages`` or an array of pages. One invalid page rejects the reply.
    Markdown may come as lines; missing arrays are empty; line numbers that are not positive are null.
    """
    wrapped = f"struct<pages:array<{schemas.DRAFT_JSON}>>"
    found = stage(raw, _json=json_text(F.col("raw")))
    parsed = stage(
        found,
        _pages=F.when(
            F.col("_json").startswith("["), F.from_json("_json", f"array<{schemas.DRAFT_JSON}>")
        ).otherwise(F.from_json("_json", wrapped).getField("pages")),
    )

    def clean(p: Column) -> Column:
        return F.struct(
            p["slug"].alias("page_slug"),
            p["title"].alias("title"),
            F.coalesce(p["markdown"], F.array_join(p["markdownLines"], "\n")).alias("markdown"),
            F.coalesce(
                F.transform(
                    p["citations"],
                    lambda c: F.struct(
                        c["path"].alias("path"),
                        positive(c["startLine"]).cast("int").alias("start_line"),
                        positive(c["endLine"]).cast("int").alias("end_line"),
                    ),
                ),
                F.array().cast(f"array<{schemas.CITATION}>"),
            ).alias("citations"),
            F.coalesce(p["relatedPages"], _no_text()).alias("related_pages"),
            F.coalesce(p["coverageNotes"], _no_text()).alias("coverage_notes"),
        )

    def valid(p: Column) -> Column:
        def filled(c: Column) -> Column:
            return F.coalesce(c != "", F.lit(False))

        return (
            filled(p["page_slug"])
            & filled(p["title"])
            & ~_blank(p["markdown"])
            & F.forall(p["citations"], lambda c: filled(c["path"]))
        )

    cleaned = stage(parsed, _pages=F.transform("_pages", clean))
    judged = stage(
        cleaned,
        _ok=F.coalesce((F.size("_pages") > 0) & F.forall("_pages", valid), F.lit(False)),
    )
    keep = [c for c in raw.columns if c != "raw"]
    drafts = judged.filter("_ok").select(*keep, F.posexplode("_pages").alias("pos", "_p"))
    drafts = drafts.select(*keep, "pos", "_p.*")
    rejects = judged.filter(~F.col("_ok")).select(
        *keep,
        "raw",
        F.when(F.col("_json").isNull(), F.lit("no_json"))
        .when(F.col("_pages").isNull(), F.lit("not_pages"))
        .otherwise(F.lit("invalid_page"))
        .alias("reason"),
    )
    return drafts, rejects


def parse_outlines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outline replies as page rows and navigation rows (``schemas.NAV``).

    An unknown priority becomes ``recommended``. Navigation is read to ``schemas.NAV_DEPTH`` levels,
    the depth outlines are generated with; node ids spell the position at each level.
    """
    doc = raw.select("repo_id", F.from_json(json_text(F.col("raw")), schemas.OUTLINE_JSON).alias("o"))
    page = doc.select("repo_id", F.posexplode("o.pages").alias("pos", "p"))
    known = F.col("p.priority").isin("required", "recommended", "optional")
    pages = page.select(
        "repo_id",
        "pos",
        F.col("p.slug").alias("slug"),
        F.col("p.title").alias("title"),
        F.coalesce("p.purpose", F.lit("")).alias("purpose"),
        F.when(known, F.col("p.priority")).otherwise(F.lit("recommended")).alias("priority"),
        F.coalesce("p.sourcePaths", _no_text()).alias("source_paths"),
    )
    level = doc.select(
        "repo_id",
        F.lit(None).cast("string").alias("parent_id"),
        F.col("o.navigation").alias("nodes"),
    )
    rows = None
    for depth in range(1, schemas.NAV_DEPTH + 1):
        node = level.select("repo_id", "parent_id", F.posexplode("nodes").alias("ord", "n"))
        node = node.withColumn(
            "node_id", F.concat_ws(".", "parent_id", F.lpad(F.col("ord").cast("string"), 4, "0"))
        )
        flat = node.select(
            "repo_id",
            "node_id",
            "parent_id",
            F.lit(depth).alias("depth"),
            "ord",
            F.col("n.slug").alias("slug"),
            F.col("n.title").alias("title"),
        )
        rows = flat if rows is None else rows.unionByName(flat)
        if depth < schemas.NAV_DEPTH:
            level = node.select(
                "repo_id", F.col("node_id").alias("parent_id"), F.col("n.children").alias("nodes")
            )
    return pages, rows
