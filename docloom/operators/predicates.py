"""Projections, filters and classifications (all narrow: no shuffle unless stated)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions import urls as U


def any_match(c: Column, patterns: Sequence[str]) -> Column:
    return reduce(or_, [c.rlike(p) for p in patterns])


def weighted(c: Column, pairs: Sequence[tuple[str, int]]) -> Column:
    """Sum of the weights of the patterns that match."""
    return reduce(
        lambda a, b: a + b,
        [F.when(c.rlike(p), F.lit(w)).otherwise(F.lit(0)) for p, w in pairs],
    )


def first_match(c: Column, pairs: Sequence[tuple[str, int]], otherwise) -> Column:
    case = None
    for pattern, value in pairs:
        case = (F if case is None else case).when(c.rlike(pattern), F.lit(value))
    return case.otherwise(F.lit(otherwise))


# -- files ------------------------------------------------------------------------------------


def with_language(files: DataFrame) -> DataFrame:
    """Add ``language`` from the file extension; a bare readme is Markdown, unknown is text."""
    base = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    ext = F.lower(F.regexp_extract("path", r"([^.]*)$", 1))
    case = F.when(base == "readme", F.lit("markdown"))
    by_language: dict[str, list[str]] = {}
    for extension, language in rules.LANGUAGE_BY_EXTENSION.items():
        by_language.setdefault(language, []).append(extension)
    for language, extensions in by_language.items():
        case = case.when(ext.isin(extensions), F.lit(language))
    return files.withColumn("language", case.otherwise(F.lit("text")))


def is_useful_path(path: Column) -> Column:
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return ~path.rlike(rules.UNUSED_PATH) & (
        base.isin(rules.NAMED_SOURCE_FILES) | path.rlike(rules.SOURCE_EXTENSION)
    )


def useful_paths(files: DataFrame) -> DataFrame:
    return files.filter(is_useful_path(F.col("path")))


def normalize_paths(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into rows with a clean repository-relative ``path`` and rows whose path is invalid."""
    clean = F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "^/+", "")
    bad = (
        clean.isNull()
        | (clean == "")
        | clean.contains("\u0000")
        | clean.rlike(r"(^|/)\.{1,2}(/|$)")
    )
    flagged = df.withColumn("_clean", clean).withColumn("_bad", bad)
    ok = flagged.filter(~F.col("_bad")).withColumn("path", F.col("_clean"))
    return ok.drop("_clean", "_bad"), flagged.filter("_bad").drop("_clean", "_bad")


def parse_repo_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """Add owner, name, full_name and repo_url; all null when it is not a repository address."""
    u = F.trim(F.col(col))
    owner = F.regexp_extract(u, rules.REPO_URL, 1)
    name = F.regexp_replace(F.regexp_extract(u, rules.REPO_URL, 2), r"(?i)\.git$", "")
    ok = u.rlike(rules.REPO_URL) & owner.rlike(rules.SAFE_REPO_PART) & name.rlike(
        rules.SAFE_REPO_PART
    )
    return (
        df.withColumn("owner", F.when(ok, owner))
        .withColumn("name", F.when(ok, name))
        .withColumn("full_name", F.when(ok, F.concat_ws("/", owner, name)))
        .withColumn(
            "repo_url", F.when(ok, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name))
        )
    )


def is_planning_path(path: Column) -> Column:
    """Internal planning notes below the documentation roots."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return any_match(
        p, [rules.PLANNING_README, rules.PLANNING_DIRECTORY, rules.PLANNING_FILE]
    )


def exclude_internal_planning(files: DataFrame) -> DataFrame:
    return files.filter(~is_planning_path(F.col("path")))


def _usable_markdown(p: Column) -> Column:
    return p.rlike(rules.MARKDOWN_FILE) & ~any_match(p, rules.UNUSABLE_MARKDOWN)


def is_docs_source(path: Column, variant: str = "prompt") -> Column:
    """Documentation source test. ``prompt`` accepts ``documentation/``, ``count`` does not,
    ``fallback`` is Markdown/RST only without translations, legal and blog paths."""
    p = F.lower(path)
    hit = ~is_planning_path(path) & any_match(p, rules.DOCS_SOURCE_PATTERNS[variant])
    if variant == "fallback":
        foreign = p.rlike(rules.TRANSLATION_ROOT) & ~p.rlike(rules.ENGLISH_TRANSLATION_ROOT)
        hit = hit & _usable_markdown(p) & ~foreign
    return hit


def is_guide_readme(path: Column) -> Column:
    p = F.lower(path)
    return (
        ~is_planning_path(path)
        & _usable_markdown(p)
        & p.rlike(rules.GUIDE_README_FILE)
        & ~p.rlike(rules.GUIDE_README_EXCLUDED)
        & ~p.rlike(rules.GUIDE_README_CHANGESET)
        & any_match(p, rules.GUIDE_README_PLACES)
    )


def flag_docs_sources(files: DataFrame, variant: str = "prompt") -> DataFrame:
    return files.withColumn(f"is_docs_{variant}", is_docs_source(F.col("path"), variant))


# -- scoring ----------------------------------------------------------------------------------


def rule_score(c: Column, rule_set: rules.RuleSet) -> Column:
    text = F.lower(c) if rule_set.lower else c
    score = weighted(text, rule_set.rules) if rule_set.rules else F.lit(0)
    if rule_set.first_of:
        score = score + first_match(text, rule_set.first_of, rule_set.otherwise)
    if rule_set.per_slash:
        slashes = F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))
        score = score + slashes * rule_set.per_slash
    if rule_set.penalty:
        weight, cap = rule_set.penalty
        parts = F.size(F.split(text, "/"))
        score = score - F.least(F.lit(cap), parts * weight)
    if rule_set.floor is not None:
        score = F.greatest(F.lit(rule_set.floor), score)
    if rule_set.fixed:
        case = None
        for pattern, value in rule_set.fixed:
            case = (F if case is None else case).when(text.rlike(pattern), F.lit(value))
        score = case.otherwise(score)
    return score.cast("int")


def score_by_rules(
    df: DataFrame, col: str, rule_set: str | rules.RuleSet, out: str = "score"
) -> DataFrame:
    """Add an additive rule score over a text column. Rule sets are data (``rules.RULE_SETS``)."""
    rs = rules.RULE_SETS[rule_set] if isinstance(rule_set, str) else rule_set
    return df.withColumn(out, rule_score(F.col(col), rs))


# -- addresses --------------------------------------------------------------------------------


def _subdomain_of(suffixes: Sequence[str]) -> str:
    return "(^|\\.)(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$"


def is_admitted_host(
    h: Column,
    hosts: Sequence[str] = rules.BLOCKED_HOSTS,
    suffixes: Sequence[str] = rules.BLOCKED_HOST_SUFFIXES,
    parts: Sequence[str] = rules.BLOCKED_HOST_PARTS,
    previews: Sequence[str] = rules.PREVIEW_HOST_SUFFIXES,
) -> Column:
    tests = [h.isin(list(hosts)), h.rlike(_subdomain_of([*suffixes, *previews]))]
    tests += [h.contains(part) for part in parts]
    return (h != "") & ~reduce(or_, tests)


def admit_docs_urls(df: DataFrame, col: str = "url", **blocklists) -> DataFrame:
    """Keep addresses whose host is not blocked. Lists are short configuration, so this is a
    per-row filter and needs no join."""
    return df.filter(is_admitted_host(U.host(F.col(col)), **blocklists))


def is_non_docs_path(p: Column) -> Column:
    return any_match(p, rules.NON_DOCS_PATHS)


def has_docs_shape(p: Column) -> Column:
    return (
        (p != "/")
        & (F.length(p) >= 2)
        & ~is_non_docs_path(p)
        & ~p.rlike(rules.COMPANY_PATH)
        & (F.size(U.segments(p)) <= rules.MAX_DOCS_PATH_SEGMENTS)
    )


def is_docs_page(
    url: Column, source: Column, adjacent: Column | None = None, project: Column | None = None
) -> Column:
    """Is the address a documentation page related to the page it was found on?

    ``adjacent`` marks sources known to be the project's own docs; ``project`` marks addresses whose
    path names the project (see ``joins.entity_mentions``).
    """
    h, p = U.host(url), F.lower(U.path(url))
    related = (h == U.host(source)) | (U.last_two_labels(h) == U.last_two_labels(U.host(source)))
    rejected = (
        p.endswith(".xml")
        | p.rlike(rules.ASSET_FILE)
        | (p == "/")
        | p.rlike(rules.MALFORMED_PATH)
        | U.has_placeholder_segment(url)
        | is_non_docs_path(p)
    )
    shaped = U.is_docs_host(h) if adjacent is None else (U.is_docs_host(h) | adjacent)
    kept = p.rlike(rules.DOCS_PATH) | (shaped & has_docs_shape(p))
    if project is not None:
        kept = kept | project
    return related & ~rejected & kept


def docs_page_urls(
    df: DataFrame,
    url: str = "url",
    source: str = "source_url",
    adjacent: str | None = None,
    project: str | None = None,
) -> DataFrame:
    return df.filter(
        is_docs_page(
            F.col(url),
            F.col(source),
            None if adjacent is None else F.col(adjacent),
            None if project is None else F.col(project),
        )
    )


def first_party_entry(url: Column, title: Column, source: Column) -> Column:
    """An entry of the source's own site with a documentation-shaped path and a real title."""
    h, p = U.host(url), F.lower(U.path(url))
    src = U.host(source)
    same = (h == src) | (U.registrable_host(h) == U.registrable_host(src))
    rejected = (
        is_noise_title(title)
        | (F.length(p) < 2)
        | p.rlike(rules.MALFORMED_PATH)
        | is_non_docs_path(p)
        | p.rlike(rules.ASSET_FILE)
        | p.rlike(rules.ASSET_DIRECTORY)
    )
    shaped = (
        U.is_docs_host(h) | U.is_docs_host(src) | p.rlike(rules.ENTRY_PATH) | has_docs_shape(p)
    )
    return is_admitted_host(h) & same & ~rejected & shaped


# -- titles -----------------------------------------------------------------------------------


def _plain_title(title: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(title)), "[-_]+", " "), r"\s+", " "
    )


def is_chrome_heading(title: Column) -> Column:
    return any_match(
        _plain_title(title),
        [rules.CONTENTS_TITLE, rules.READ_NEXT_TITLE, rules.PAGE_CHROME_TITLE],
    )


def is_noise_title(title: Column) -> Column:
    return _plain_title(title).rlike(rules.ENTRY_CHROME_TITLE) | is_chrome_heading(title)


def is_placeholder_title(title: Column) -> Column:
    return F.trim(title).rlike(rules.PLACEHOLDER_WORD)


def drop_noise_titles(entries: DataFrame, col: str = "title") -> DataFrame:
    """Drop entries whose title is page chrome, empty or a placeholder."""
    t = F.col(col)
    return entries.filter((F.trim(t) != "") & ~is_noise_title(t) & ~is_placeholder_title(t))


def keeps_heading(title: Column, level: Column, file_title: Column) -> Column:
    t = F.lower(title)
    repeated = (level == 1) & ((t == F.lower(file_title)) | (t == "readme"))
    looks_like_code = any_match(
        title,
        [rules.COMMAND_HEADING, rules.CODE_HEADING, rules.SYNTAX_HEADING, rules.LEGAL_HEADING],
    )
    return (
        F.length(title).between(3, 90)
        & ~repeated
        & ~is_chrome_heading(title)
        & ~looks_like_code
    )


def keep_headings(headings: DataFrame) -> DataFrame:
    """Keep headings that name a topic: ``title``, ``level`` and ``file_title`` columns."""
    return headings.filter(keeps_heading(F.col("title"), F.col("level"), F.col("file_title")))


def is_useful_topic(label: Column) -> Column:
    return (
        F.length(label).between(3, 80)
        & ~label.contains("/")
        & ~any_match(label, [rules.TOPIC_BLOG, rules.TOPIC_CHROME, rules.TOPIC_TOO_GENERIC])
    )


def is_useful_coverage(label: Column) -> Column:
    return F.length(label).between(3, 80) & ~any_match(
        label, [rules.TOPIC_CHROME, rules.COVERAGE_TOO_GENERIC]
    )


def is_generic_title(title: Column) -> Column:
    return F.replace(T.slug(title), F.lit("-"), F.lit(" ")).rlike(rules.GENERIC_TITLE)


def is_generic_entry_title(title: Column) -> Column:
    """Like ``is_generic_title`` but with punctuation kept."""
    return _plain_title(title).rlike(rules.GENERIC_TITLE)


# -- quorum -----------------------------------------------------------------------------------


def quorum_filter(
    df: DataFrame,
    keys: Sequence[str],
    pred: Column,
    min_survivors: int,
    applies_from: int = 0,
    at_most_fraction: float | None = None,
) -> DataFrame:
    """Apply ``pred`` within a group only if enough of the group survives it.

    A group smaller than ``applies_from`` is left alone. The needed number of survivors is
    ``min_survivors``, or the given fraction of the group (rounded down) where that is lower.

    Counts are partial aggregates, one small row per group; joining them back lets AQE broadcast
    them or split a group that holds much of the data, which a window over the group could not.
    """
    marked = df.withColumn("_pass", F.coalesce(pred, F.lit(False)))
    counts = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_pass")).alias("_kept")
    )
    needed = F.lit(min_survivors)
    if at_most_fraction is not None:
        needed = F.least(needed, F.floor(F.col("_n") * F.lit(at_most_fraction)))
    verdict = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        ((F.col("_n") >= applies_from) & (F.col("_kept") >= needed)).alias("_filtered"),
    )
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return (
        marked.join(verdict, on)
        .filter(~F.col("_filtered") | F.col("_pass"))
        .drop("_pass", "_filtered", *[f"_k_{k}" for k in keys])
    )


def first_party_entries(entries: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Entries of the source's own site, unless that would leave too few of a real index."""
    pred = first_party_entry(F.col("url"), F.col("title"), F.col("source_url"))
    return quorum_filter(entries, keys, pred, 20, applies_from=20, at_most_fraction=0.5)


def locale_scope(
    df: DataFrame, keys: Sequence[str], url: str = "url", source: str = "source_url"
) -> DataFrame:
    """Keep links in the locale of the source page (no locale: links without one) if ten remain."""
    own = U.locale_segment(U.segments(U.path(F.col(url))))
    wanted = U.locale_segment(U.segments(U.path(F.col(source))))
    return quorum_filter(df, keys, own.eqNullSafe(wanted), 10, applies_from=10)


def topic_scope(
    df: DataFrame, keywords: DataFrame, keys: Sequence[str] = ("repo_id",), url: str = "url"
) -> DataFrame:
    """In a broad index of 200 or more links keep those that mention a keyword, if 30 do.

    ``keywords`` has one row per repository: the keys and ``keywords array<string>`` (at most 16).
    """
    p = T.compact(U.path(F.col(url)))
    joined = df.join(keywords, list(keys), "left")
    pred = F.exists(
        F.coalesce(F.col("keywords"), F.array().cast("array<string>")), lambda k: p.contains(k)
    )
    return quorum_filter(joined, keys, pred, 30, applies_from=200).drop("keywords")


# -- bodies, pages, entries -------------------------------------------------------------------


def body_kind(url: Column, body: Column) -> Column:
    """sitemap, html or text. Only the prologue is inspected for HTML."""
    head = F.substring(body, 1, rules.HTML_PROLOGUE_CHARS)
    sitemap = (
        U.path(url).endswith(".xml")
        | body.rlike(rules.SITEMAP_XML_START)
        | body.rlike(rules.SITEMAP_ROOT_START)
    )
    html = (
        head.rlike(rules.HTML_START)
        | (head.rlike(rules.HTML_BODY_TAGS) & head.rlike(rules.HTML_META_TAGS))
        | (
            head.rlike(rules.HTML_ANCHOR)
            & head.rlike(rules.HTML_ANCHOR_END)
            & head.rlike(rules.HTML_HEADING)
        )
    )
    return F.when(sitemap, F.lit("sitemap")).when(html, F.lit("html")).otherwise(F.lit("text"))


def classify_body(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    return pages.withColumn("kind", body_kind(F.col(url), F.col(body)))


def page_text(lower: bool = True) -> Column:
    text = F.concat_ws(
        " ", F.col("slug"), F.col("title"), F.coalesce(F.col("purpose"), F.lit(""))
    )
    return F.lower(text) if lower else text


def is_broad_topic() -> Column:
    s = F.lower(F.col("slug"))
    return (s == "overview") | s.endswith("-overview") | page_text().rlike(rules.BROAD_TEXT)


def is_reference_like() -> Column:
    named = F.concat_ws(" ", "title", "slug")
    return named.rlike(rules.REFERENCE_TEXT) | (
        F.col("purpose").rlike(rules.REFERENCE_TEXT) & ~is_guide_like()
    )


def is_guide_like() -> Column:
    return F.concat_ws(" ", "title", "slug", "purpose").rlike(rules.GUIDE_TEXT)


def classify_pages(outline: DataFrame) -> DataFrame:
    """Add the page classes that later thresholds depend on.

    Needs ``slug``, ``title``, ``purpose`` and ``source_paths``.
    """
    s = F.lower(F.col("slug"))
    text = page_text()
    # Unknown source paths count as neither few nor none.
    sources = F.coalesce(F.array_size("source_paths"), F.lit(3))
    broad = is_broad_topic()
    narrow = any_match(s, rules.NARROW_SLUGS) | text.rlike(rules.NARROW_TEXT)
    breadth = (
        F.when(narrow, F.lit("narrow"))
        .when(broad, F.lit("broad"))
        .when(s.startswith("guides-") | (sources <= 2), F.lit("narrow"))
        .otherwise(F.lit("normal"))
    )
    all_planning = (sources > 0) & F.coalesce(
        F.forall("source_paths", is_planning_path), F.lit(False)
    )
    return outline.select(
        "*",
        (T.slug(F.col("slug")) == "overview").alias("is_overview"),
        is_reference_like().alias("is_reference"),
        is_guide_like().alias("is_guide"),
        breadth.alias("breadth"),
        ((sources <= 2) & ~broad).alias("is_tiny_leaf"),
        (~broad & text.rlike(rules.PRIMITIVE_TEXT)).alias("is_primitive"),
        text.rlike(rules.JOURNEY_TEXT).alias("is_journey"),
        (s.rlike(rules.FOCUSED_API_SLUG) | text.rlike(rules.FOCUSED_API_TEXT)).alias(
            "is_focused_api"
        ),
        (~broad & text.rlike(rules.SPECIALISED_TEXT)).alias("is_specialised"),
        (all_planning | text.rlike(rules.PLANNING_TEXT)).alias("is_planning"),
        (
            text.rlike(rules.IMPORTANT_PRIMITIVE_TEXT) | text.rlike(rules.JOURNEY_TEXT)
        ).alias("is_important"),
        text.rlike(rules.INTERNAL_PROJECT_TEXT).alias("is_internal_project"),
    )


def classify_entries(entries: DataFrame) -> DataFrame:
    """Add generic / generated / low-level / narrow-member flags to documentation entries."""
    text = F.concat_ws(" ", F.coalesce(F.col("group"), F.lit("")), "title", "url")
    s = T.slug(F.col("title"))
    return entries.select(
        "*",
        is_generic_title(F.col("title")).alias("is_generic"),
        (
            F.col("url").rlike(rules.GENERATED_ENTRY_URL) | text.rlike(rules.GENERATED_ENTRY_TEXT)
        ).alias("is_generated"),
        F.trim("title").rlike(rules.LOW_LEVEL_TITLE).alias("is_low_level"),
        (
            (s != "") & (F.size(F.split(s, "-")) >= 5) & ~s.rlike(rules.WIDE_TITLE_WORDS)
        ).alias("is_narrow_member"),
    )


# -- budgets ----------------------------------------------------------------------------------


def ladder(c: Column, steps: Sequence[tuple[int, int]], otherwise=None) -> Column:
    """Step function: value of the first step whose lower bound is reached."""
    case = None
    for bound, value in steps:
        case = (F if case is None else case).when(c >= bound, F.lit(value))
    return case if otherwise is None else case.otherwise(otherwise)


def _by_evidence(links: Column, docs: Column, by_links, by_docs, baseline: Column) -> Column:
    return F.greatest(
        baseline,
        F.coalesce(ladder(links, by_links), ladder(docs, by_docs), F.lit(0)),
    )


def page_budget(evidence: DataFrame) -> DataFrame:
    """Add max_pages, min_pages and min_words from file_count, docs_count and link_count."""
    files, docs = F.col("file_count"), F.col("docs_count")
    links = F.coalesce(F.col("link_count"), F.lit(0))
    top = F.least(
        F.lit(rules.MAX_PAGES_RUNTIME),
        _by_evidence(
            links,
            docs,
            rules.MAX_PAGES_BY_LINKS,
            rules.MAX_PAGES_BY_DOCS,
            ladder(files, rules.MAX_PAGE_BASELINE),
        ),
    )
    low = F.least(
        top,
        _by_evidence(
            links,
            docs,
            rules.MIN_PAGES_BY_LINKS,
            rules.MIN_PAGES_BY_DOCS,
            ladder(files, rules.MIN_PAGE_BASELINE),
        ),
    )
    words = _by_evidence(
        links, docs, rules.WORDS_BY_LINKS, rules.WORDS_BY_DOCS, ladder(files, rules.WORD_BASELINE)
    )
    return evidence.select(
        "*",
        top.cast("int").alias("max_pages"),
        low.cast("int").alias("min_pages"),
        words.cast("int").alias("min_words"),
    )


def page_min_words() -> Column:
    """Minimum words of one classified page, from its repository's evidence columns."""
    base = ladder(F.col("file_count"), rules.WORD_BASELINE)
    docs = F.col("docs_count")
    links = F.coalesce(F.col("link_count"), F.lit(0))
    leaf, narrow, normal = (F.least(base, F.lit(cap)) for cap in (500, 575, 650))
    breadth = F.col("breadth")
    case = None
    for tier, bound, tiny, journey, primitive, focused, special, wide, slim, plain in (
        rules.PAGE_WORDS_BY_TIER
    ):
        value = (
            F.when(F.col("is_tiny_leaf"), F.greatest(leaf, F.lit(tiny)))
            .when(F.col("is_journey"), F.greatest(narrow, F.lit(journey)))
            .when(F.col("is_primitive"), F.greatest(leaf, F.lit(primitive)))
            .when(F.col("is_focused_api"), F.greatest(leaf, F.lit(focused)))
            .when(F.col("is_specialised"), F.greatest(leaf, F.lit(special)))
            .when(breadth == "broad", F.greatest(base, F.lit(wide)))
            .when(breadth == "narrow", F.greatest(narrow, F.lit(slim)))
            .otherwise(F.greatest(normal, F.lit(plain)))
        )
        hit = (links if tier == "links" else docs) >= bound
        case = (F if case is None else case).when(hit, value)
    some = (
        F.when(F.col("is_tiny_leaf"), F.greatest(base, F.lit(575)))
        .when(breadth == "broad", F.greatest(base, F.lit(800)))
        .when(breadth == "narrow", F.greatest(base, F.lit(700)))
        .otherwise(F.greatest(base, F.lit(750)))
    )
    few = F.greatest(base, F.when(breadth == "narrow", F.lit(650)).otherwise(F.lit(700)))
    return case.when(docs >= 30, some).when(docs >= 12, few).otherwise(base).cast("int")


def page_min_sections() -> Column:
    docs = F.col("docs_count")
    links = F.coalesce(F.col("link_count"), F.lit(0))
    rich = (docs >= 60) | (links >= 60)
    very_rich = (docs >= 100) | (links >= 120)
    broad = (
        (F.col("slug") == "overview")
        | F.col("slug").endswith("-overview")
        | page_text().rlike(rules.BROAD_SECTION_TEXT)
    )
    return (
        F.when(~rich, F.lit(3))
        .when(broad & very_rich, F.lit(5))
        .when(very_rich | (F.col("file_count") >= 500), F.lit(4))
        .otherwise(F.lit(3))
    )
