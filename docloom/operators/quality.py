"""Quality checks of outlines and page drafts, as issue rows: repo_id, (page), code, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.functions.binding import let, stage
from docloom.operators.corpus import metric_columns
from docloom.operators.joins import valid_citations
from docloom.operators.matching import match_entries
from docloom.operators.predicates import (
    classify_pages,
    is_generic_title,
    page_budget,
    page_min_sections,
    page_min_words,
    page_text,
)
from docloom.operators.rollups import (
    collected,
    coverage_families,
    duplicate_slugs,
    high_volume_topics,
    journey_coverage,
    missing_topics,
    nav_stats,
    outline_text,
    primitive_families,
    redundant_topics,
)
from docloom.operators.ordering import top_per_group
from docloom.session import joinable

_ISSUE = "struct<code:string,detail:string>"


def _issue(cond: Column, code: str, detail: Column | str = "") -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
    return F.when(
        F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), text.alias("detail"))
    )


def _issue_rows(df: DataFrame, keys: list[str], issues: list[Column]) -> DataFrame:
    found = F.filter(F.array(*issues), lambda i: i.isNotNull())
    return df.select(*keys, F.explode(found).alias("i")).select(*keys, "i.code", "i.detail")


# -- Q1 ---------------------------------------------------------------------------------------


def _named(pages: DataFrame, cond: Column, name: str, n: int = 8) -> DataFrame:
    """First ``n`` slugs and the number of the pages that meet a condition, per repository."""
    hit = pages.filter(cond)
    counts = hit.groupBy("repo_id").agg(F.count(F.lit(1)).alias(f"{name}_n"))
    first = top_per_group(hit.select("repo_id", "pos", "slug"), ["repo_id"], ["pos"], n)
    lists = first.groupBy("repo_id").agg(
        F.array_join(collected("slug", ["pos"]), ", ").alias(f"{name}_slugs")
    )
    return counts.join(lists, "repo_id")


def outline_issues(
    outline: DataFrame, nav: DataFrame, evidence: DataFrame, entries: DataFrame, repos: DataFrame
) -> DataFrame:
    """Issues of each repository's outline: (repo_id, code, detail).

    ``outline``: repo_id, pos, slug, title, purpose, priority, source_paths. ``nav``: adjacency rows.
    ``evidence``: repo_id, file_count, docs_count, link_count. ``entries``: repo_id, pos, group, title, url.
    ``repos``: repo_id, name. Every check is an aggregate per repository; they meet in one row each.
    What several checks read, and each few checks, are stored, as one plan of all would outgrow the driver.
    """
    outline = joinable(outline.select("repo_id", "pos", "slug", "title", "purpose", "priority", "source_paths"), "outline")
    entries = joinable(entries.select("repo_id", "pos", "group", "title", "url"), "outline-entries")
    nav = joinable(nav, "outline-nav")
    pages = joinable(classify_pages(outline), "outline-pages")
    basic = pages.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.size("source_paths") == 0).alias("unsourced"),
        F.min_by("title", F.when(F.col("is_overview"), F.col("pos"))).alias("overview_title"),
        F.bool_or("is_overview").alias("has_overview"),
    )
    budget = page_budget(evidence).select(
        "repo_id", "file_count", "docs_count", F.coalesce("link_count", F.lit(0)).alias("links"), "min_pages"
    )
    text = joinable(outline_text(outline, nav), "outline-text")
    labels = outline_text(outline, nav, labels_only=True)
    families = coverage_families(entries, text)
    missing_families = (
        families.filter("not mentioned")
        .groupBy("repo_id")
        .agg(F.array_join(collected("family", ["ord"]), ", ").alias("missing_families"))
    )
    primitives = primitive_families(entries, labels).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("primitive_families"),
        F.array_join(
            F.transform(
                F.slice(
                    F.array_sort(
                        F.collect_list(F.when(~F.col("mentioned"), F.struct("ord", "family")))
                    ),
                    1,
                    12,
                ),
                lambda s: s["family"],
            ),
            ", ",
        ).alias("missing_primitives"),
    )
    topics = missing_topics(high_volume_topics(entries, evidence), text)
    missing = topics.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("missing_topics_n"),
        F.array_join(
            F.slice(
                F.transform(
                    F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "label"))),
                    lambda s: s["label"],
                ),
                1,
                8,
            ),
            ", ",
        ).alias("missing_topics"),
    )
    matched = joinable(match_entries(outline, entries), "matched")
    named = entries.select("repo_id", F.col("pos").alias("entry_pos"), U.namespace(F.col("url")).alias("_ns"))
    aligned = pages.join(matched.select("repo_id", "pos", "entry_pos"), ["repo_id", "pos"], "left").join(
        named, ["repo_id", "entry_pos"], "left"
    )
    mismatch = (
        is_generic_title(F.col("title"))
        & F.col("_ns").isNotNull()
        & (F.col("_ns") != "react")
        & ~F.contains(T.slug(F.col("slug")), F.col("_ns"))
    )
    unmatched = aligned.filter(~F.col("is_overview") & F.col("entry_pos").isNull()).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("unmatched_n")
    )
    twins = redundant_topics(pages)
    repeated = duplicate_slugs(pages).groupBy("repo_id").agg(
        F.array_join(F.array_sort(F.collect_set("slug")), ", ").alias("repeated")
    )
    parts = [
        budget,
        journey_coverage(outline).drop("pages"),
        nav_stats(nav),
        missing_families,
        primitives,
        missing,
        _named(aligned, mismatch, "mismatch"),
        unmatched,
        _named(pages, F.col("is_planning"), "planning"),
        _named(pages, F.col("is_internal_project"), "internal"),
        _named(twins, F.lit(True), "twins", 10),
        repeated,
        repos.select("repo_id", T.slug(F.col("name")).alias("repo_slug")),
    ]
    row = basic
    for i in range(0, len(parts), 3):
        row = joinable(reduce(lambda a, b: a.join(b, "repo_id", "left"), parts[i : i + 3], row), "outline-checks")
    row = row.fillna(
        0,
        [
            "leaves",
            "root_nodes",
            "root_folders",
            "root_leaves",
            "max_depth",
            "wrapper_children",
            "primitive_families",
            "missing_topics_n",
            "internal_n",
            "unmatched_n",
        ],
    )
    c = F.col
    n, links, docs = c("pages"), c("links"), c("docs_count")
    title = T.slug(c("overview_title"))
    repo_titles = F.array(
        *[F.lit(t) for t in rules.OVERVIEW_TITLES],
        F.concat_ws("-", "repo_slug", F.lit("overview")),
        F.concat_ws("-", "repo_slug", F.lit("documentation-overview")),
    )
    rich = (docs >= 12) | (links >= 30)
    nav_checked = (n >= 6) & (rich | (c("file_count") >= 500))
    has_leaves = nav_checked & (c("leaves") > 0)
    wrapper = (
        (c("root_nodes") == 1)
        & (c("wrapper_children") >= F.least(F.lit(6), n))
    )
    very_rich = rich & ((docs >= 40) | (links >= 60)) & (n >= 10)
    min_roots = F.when(very_rich & (c("max_depth") < 2), 4).otherwise(2)
    broad_tree = rich & (n >= 18) & ((docs >= 80) | (links >= 80))
    framework = c("primitive_families") >= 8
    primitive_checked = (links >= 16) & (c("primitive_families") >= 6)
    primitive_pages = F.least(F.lit(24), F.greatest(F.lit(14), c("primitive_families") + 8))
    alignable = (links >= 120) & (n >= 24)
    issues = [
        _issue(n < c("min_pages"), "too_few_pages", F.concat_ws("/", n, c("min_pages"))),
        _issue((c("file_count") >= 500) & ~c("has_journey"), "no_reader_journey"),
        _issue((docs >= 12) & ~c("has_spine"), "no_docs_spine"),
        _issue(nav_checked & (c("leaves") == 0), "no_navigation"),
        _issue(has_leaves & wrapper, "single_wrapper"),
        _issue(
            has_leaves & (c("root_folders") < min_roots),
            "too_few_sections",
            F.concat_ws("/", c("root_folders"), min_roots),
        ),
        _issue(
            has_leaves & (c("root_leaves") > F.greatest(F.lit(1), F.floor(n / 4))), "leaves_at_root"
        ),
        _issue(has_leaves & broad_tree & (c("max_depth") < 2) & ~framework, "too_flat"),
        _issue((links >= 30) & c("missing_families").isNotNull(), "missing_families", c("missing_families")),
        _issue(
            (links >= 30) & ~framework & (c("missing_topics_n") >= 3), "missing_topics", c("missing_topics")
        ),
        _issue(
            primitive_checked & (c("missing_primitives") != ""), "missing_primitives", c("missing_primitives")
        ),
        _issue(
            primitive_checked & (n < primitive_pages),
            "too_few_primitive_pages",
            F.concat_ws("/", n, primitive_pages),
        ),
        _issue(alignable & (c("internal_n") > 0), "internal_project_pages", c("internal_slugs")),
        _issue(alignable & c("mismatch_n").isNotNull(), "namespace_mismatch", c("mismatch_slugs")),
        _issue(
            alignable
            & (c("internal_n") > 0)
            & (c("unmatched_n") > F.greatest(F.lit(24), F.floor(n * 3 / 5))),
            "unaligned_pages",
            c("unmatched_n"),
        ),
        _issue(c("planning_n").isNotNull(), "planning_pages", c("planning_slugs")),
        _issue(
            (c("file_count") >= 500) & (links < 80) & c("catalogue_dominates"), "catalogue_dominates"
        ),
        _issue(c("twins_n").isNotNull(), "redundant_topics", c("twins_slugs")),
        _issue(c("repeated").isNotNull(), "duplicate_slugs", c("repeated")),
        _issue(~c("has_overview"), "no_overview"),
        _issue(
            c("has_overview") & ~F.array_contains(repo_titles, title),
            "overview_title",
            c("overview_title"),
        ),
        _issue(c("folder_with_slug").isNotNull(), "folder_with_slug", c("folder_with_slug")),
        _issue(
            c("unsourced") > F.greatest(F.lit(1), F.floor(n / 3)), "missing_sources", c("unsourced")
        ),
    ]
    return _issue_rows(row, ["repo_id"], issues)


# -- Q2 ---------------------------------------------------------------------------------------


def has_reference_detail() -> Column:
    return (
        (F.col("table_rows") >= 3)
        | (F.col("fences") >= 2)
        | (F.col("inline_code") >= 8)
        | (F.col("h3") >= 3)
        | (F.col("option_bullets") >= 4)
    )


# The same matches as the rules', searched faster: from the break before a command on, and only where a word can start.
_FIRST_COMMAND, _LATER_COMMAND = (rules.COMMAND_LINE.replace(r"(^|\n)", start) for start in ("^", r"\n"))
_GUIDE_WORDS = r"(?=[CESTWcestw][AEOTXaeotx])" + rules.GUIDE_WORDS


def has_guide_example(markdown: Column, fences: Column) -> Column:
    return (
        (fences >= 2)
        | markdown.rlike(rules.NUMBERED_LINE)
        | markdown.rlike(_FIRST_COMMAND)
        | markdown.rlike(_LATER_COMMAND)
        | markdown.rlike(_GUIDE_WORDS)
    )


def has_title(markdown: Column, title: Column) -> Column:
    start = F.startswith(F.regexp_replace(markdown, r"^\s+", ""), F.concat(F.lit("# "), title))
    return start | markdown.rlike(r"(?m)^#\s+.+")


def _limited_paths() -> Column:
    """Paths in the draft that only belong to some topics, one array for each of these. Texts without a mark are not searched."""
    text = F.concat_ws("\n", "markdown", F.array_join(F.transform("citations", lambda c: c["path"]), "\n"))
    none = F.array().cast("array<string>")

    def found(t: Column) -> Column:
        searched = zip(rules.FORBIDDEN_MARKS, rules.FORBIDDEN_PATHS, strict=True)
        return F.array(
            *[F.when(F.contains(t, F.lit(mark)), F.regexp_extract_all(t, F.lit(path), 0)).otherwise(none) for mark, (_, _, path) in searched]
        )

    return let(text, found)


def _foreign_paths() -> Column:
    """Paths in the draft that belong to other topics than its page."""
    about = T.slug(
        F.concat_ws(" ", "slug", "title", "purpose", F.array_join("source_paths", " "))
    )
    none = F.array().cast("array<string>")
    found = []
    for i, (topic, limited_to, _) in enumerate(rules.FORBIDDEN_PATHS):
        allowed = about.rlike(f"(?i){topic}")
        if limited_to is not None:
            allowed = allowed | ~F.col("slug").rlike(limited_to)
        found.append(F.when(allowed, none).otherwise(F.col("limited_paths")[i]))
    return F.array_sort(F.array_except(F.array_distinct(F.concat(*found)), F.col("source_paths")))


def page_facts(drafts: DataFrame, outline: DataFrame, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """One row per draft with everything its checks need; a draft without an outline page, or a page whose repository has no evidence, has nulls there.

    ``drafts``: repo_id, page_slug, attempt, title, markdown, citations. ``outline``: repo_id, pos, slug,
    title, purpose, source_paths. ``evidence``: file_count, docs_count, link_count per repository. Paths
    are checked against the inventory by key. What the text alone tells is read off where the draft is; all else of a draft is
    joined without its text, which then takes part in one equi-join.
    """
    pages = classify_pages(outline).withColumn("_key", T.slug(F.col("slug")))
    known_size = F.col("file_count").isNotNull()
    needs = (
        pages.join(evidence.select("repo_id", "file_count", "docs_count", "link_count"), "repo_id", "left")
        .withColumn("min_words", F.when(known_size, page_min_words()))
        .withColumn("min_sections", F.when(known_size, page_min_sections()))
        .withColumn("has_evidence", known_size)
    )
    own = needs.select(
        "repo_id",
        "_key",
        "slug",
        F.col("title").alias("page_title"),
        "purpose",
        "source_paths",
        "is_reference",
        "is_guide",
        "is_important",
        "min_words",
        "min_sections",
        "has_evidence",
    )
    ids = ["repo_id", "page_slug", "attempt"]
    known = valid_citations(drafts, files, tuple(ids))
    wanted = outline.select("repo_id", "slug", F.posexplode("source_paths").alias("at", "path"))
    indexed = wanted.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    indexed = indexed.groupBy("repo_id", "slug").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda s: s["path"]).alias(
            "indexed_paths"
        )
    )
    none = F.array().cast("array<string>")
    md = F.col("markdown")
    metrics = metric_columns(md)
    measured = drafts.select(
        *[F.col(c).alias(f"_{c}") for c in ids],
        "markdown",
        *[m.alias(k) for k, m in metrics.items() if k not in ("links", "index_headings")],
        F.size("citations").alias("citations_n"),
        has_title(md, F.col("title")).alias("titled"),
        md.rlike(rules.SOURCE_SECTION).alias("source_section"),
        md.rlike(rules.SOURCES_LINE).alias("sources_line"),
        has_guide_example(md, metrics["fences"]).alias("guide_example"),
        _limited_paths().alias("limited_paths"),
    )
    placed = (
        drafts.select(*ids)
        .distinct()
        .withColumn("_key", T.slug(F.col("page_slug")))
        .join(own.join(indexed, ["repo_id", "slug"], "left"), ["repo_id", "_key"], "left")
        .join(known, ids, "left")
    )
    same = [F.col(f"_{c}") == F.col(c) for c in ids[:2]]
    joined = (
        measured.join(placed, [*same, F.col("_attempt").eqNullSafe(F.col("attempt"))], "left")
        .drop(*ids)
        .withColumnsRenamed({f"_{c}": c for c in ids})
        .withColumn("source_paths", F.coalesce("source_paths", none))
        .withColumn("valid_paths", F.coalesce("valid_paths", none))
        .withColumn("indexed_paths", F.coalesce("indexed_paths", none))
    )
    pool = F.array_union("valid_paths", "indexed_paths")
    visible = F.filter(pool, lambda p: F.contains(md, p))
    near = F.when(F.col("min_words") >= 900, F.col("min_words") - 25).otherwise(
        F.floor(F.col("min_words") * 9 / 10)
    )
    sources = F.col("sources_line")
    detailed = (
        (F.col("prose_words") >= near)
        & (F.col("h2") >= 3)
        & sources
        & (has_reference_detail() | F.col("guide_example"))
    )
    facts = joined.withColumnRenamed("page_title", "title")
    return facts.select(
        *ids,
        "slug",
        F.col("slug").isNotNull().alias("planned"),
        "has_evidence",
        "title",
        "is_reference",
        "is_guide",
        "is_important",
        "min_words",
        "min_sections",
        "prose_words",
        "raw_words",
        "h2",
        "titled",
        "source_section",
        "sources_line",
        "citations_n",
        F.size("valid_paths").alias("valid_n"),
        F.exists("valid_paths", lambda p: F.contains(md, p)).alias("cited_visible"),
        (F.when(sources, F.size(visible)).otherwise(0)).alias("visible_n"),
        (
            (F.size("source_paths") > 0)
            & (F.size("valid_paths") > 0)
            & ~F.arrays_overlap("source_paths", "valid_paths")
        ).alias("off_target"),
        _foreign_paths().alias("foreign_paths"),
        detailed.alias("near_miss_ok"),
        has_reference_detail().alias("reference_detail"),
        "guide_example",
        F.get(
            F.filter(F.slice("source_paths", 1, 3), lambda p: ~F.contains(md, p)), F.lit(0)
        ).alias("unmentioned"),
    )


def _issues_found() -> Column:
    """The issues of a row of facts, as an array."""
    c = F.col
    fixed = [
        _issue(~c("planned"), "no_outline_page"),
        _issue(c("planned") & ~c("has_evidence"), "no_evidence"),
        _issue(~c("titled"), "no_title"),
        _issue(
            c("h2") < c("min_sections"), "too_few_sections", F.concat_ws("/", c("h2"), c("min_sections"))
        ),
        _issue(
            (c("prose_words") < c("min_words")) & ~c("near_miss_ok"),
            "too_few_words",
            F.concat_ws("/", c("prose_words"), c("min_words")),
        ),
        _issue(~c("source_section"), "no_source_section"),
        _issue(~c("sources_line"), "no_sources_line"),
        _issue(c("sources_line") & (c("visible_n") == 0), "no_visible_source"),
        _issue(c("citations_n") == 0, "no_citation"),
        _issue((c("citations_n") > 0) & (c("valid_n") == 0), "no_valid_citation"),
        _issue((c("valid_n") > 0) & ~c("cited_visible"), "citation_not_visible"),
        _issue(c("off_target"), "outline_source_not_cited"),
        _issue(c("is_reference") & ~c("reference_detail"), "no_reference_detail"),
        _issue(c("is_guide") & ~c("guide_example"), "no_guide_example"),
        _issue(c("unmentioned").isNotNull(), "source_not_mentioned", c("unmentioned")),
    ]
    foreign = F.transform(
        "foreign_paths", lambda p: F.struct(F.lit("foreign_path").alias("code"), p.alias("detail"))
    )
    return F.concat(F.filter(F.array(*fixed), lambda i: i.isNotNull()), foreign)


def page_issues_of(facts: DataFrame) -> DataFrame:
    keys = ["repo_id", "page_slug", "attempt"]
    return facts.select(*keys, F.explode(_issues_found()).alias("i")).select(*keys, "i.code", "i.detail")


def page_issues(
    drafts: DataFrame, outline: DataFrame, evidence: DataFrame, files: DataFrame
) -> DataFrame:
    """Issues of each draft attempt: (repo_id, page_slug, attempt, code, detail)."""
    return page_issues_of(page_facts(drafts, outline, evidence, files))


# -- Q3, Q4 -----------------------------------------------------------------------------------

FALLBACK_SAFE = ["too_few_words", "no_reference_detail"]


def accept_drafts(facts: DataFrame) -> DataFrame:
    """Which attempt of each page is published.

    The first attempt without issues; else the last attempt of an important page whose issues are all
    harmless and that has a title, three sections, sources and a visible valid citation; else none.
    """
    # Issues are counted in the row they are found in, so that the texts are judged once.
    c = F.col
    whole = (
        c("is_important")
        & c("titled")
        & (c("h2") >= 3)
        & c("source_section")
        & c("sources_line")
        & (c("valid_n") > 0)
        & c("cited_visible")
        & ((c("raw_words") >= 300) | c("reference_detail") | c("guide_example"))
    )
    codes = F.transform(_issues_found(), lambda i: i["code"])
    counted = stage(facts.select("repo_id", "page_slug", "attempt", whole.alias("_whole"), codes.alias("_codes")), _issues=F.size("_codes"))
    judged = counted.groupBy("repo_id", "page_slug", "attempt").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("_issues").alias("_issues"),
        F.sum(F.size(F.filter("_codes", lambda i: ~i.isin(FALLBACK_SAFE)))).alias("_serious"),
        F.bool_or("_whole").alias("_whole"),
    )
    clean = F.when(c("_issues") == 0, c("attempt"))
    spare = F.when((c("_issues") > 0) & (c("_serious") == 0) & c("_whole"), c("attempt"))
    picked = judged.groupBy("repo_id", "page_slug").agg(
        F.sum("_rows").alias("attempts"),
        F.min(clean).alias("_clean"),
        F.max(spare).alias("_spare"),
    )
    return picked.select(
        "repo_id",
        "page_slug",
        "attempts",
        F.coalesce("_clean", "_spare").alias("attempt"),
        F.when(c("_clean").isNotNull(), F.lit("accepted"))
        .when(c("_spare").isNotNull(), F.lit("accepted_with_warnings"))
        .otherwise(F.lit("failed"))
        .alias("verdict"),
    )


def repair_feedback(issues: DataFrame, facts: DataFrame) -> DataFrame:
    """What the next attempt of a page must change: paths to add and remove, words and flags.

    The word figures follow the repair rule: at least 500 new words, or the deficit and 150 more; a
    draft under 65 percent of its minimum is rewritten instead of kept.
    """
    keys = ["repo_id", "page_slug", "attempt"]

    def paths(code: str) -> Column:
        return F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("code") == code, F.col("detail")))), ", "
        )

    def has(code: str) -> Column:
        return F.bool_or(F.col("code") == code)

    grouped = issues.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("issues"),
        paths("source_not_mentioned").alias("missing_paths"),
        paths("foreign_path").alias("unrelated_paths"),
        has("too_few_words").alias("_short"),
        has("no_reference_detail").alias("needs_reference"),
        has("no_guide_example").alias("needs_example"),
        has("too_few_sections").alias("needs_sections"),
    )
    sized = grouped.join(facts.select(*keys, "prose_words", "min_words"), keys)
    deficit = F.when(F.col("_short"), F.greatest(F.lit(0), F.col("min_words") - F.col("prose_words")))
    return sized.select(
        *keys,
        "issues",
        "missing_paths",
        "unrelated_paths",
        deficit.alias("word_deficit"),
        F.greatest(F.lit(500), deficit + 150).alias("words_to_add"),
        (
            F.col("_short") & (F.col("prose_words") < F.floor(F.col("min_words") * 65 / 100))
        ).alias("rewrite"),
        "needs_reference",
        "needs_example",
        "needs_sections",
    )


__all__ = [
    "accept_drafts",
    "outline_issues",
    "page_facts",
    "page_issues",
    "page_issues_of",
    "page_text",
    "repair_feedback",
]
