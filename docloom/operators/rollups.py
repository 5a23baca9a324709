"""Aggregations. Collected lists are always of rows already cut to a stated number per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.functions.ids import from_micros, micros
from docloom.operators.joins import entity_mentions
from docloom.operators.ordering import (
    group_ranks_limited,
    natural_key,
    top_files,
    top_per_group,
)
from docloom.operators.predicates import (
    first_match,
    is_docs_source,
    is_useful_coverage,
    is_useful_topic,
)


def _joined(items: Column, sep: str = ", ") -> Column:
    return F.array_join(items, sep)


def collected(value: str, order: Sequence[str]) -> Column:
    """List of a column in order, for groups already cut to a fixed size."""
    structs = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return F.transform(structs, lambda s: s["_v"])


# -- A1, A2 -----------------------------------------------------------------------------------


def map_group(path: Column) -> Column:
    """Group of a file in the repository map: top directory, or package below a workspace root."""
    parts = F.split(path, "/")
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    return (
        F.when(F.size(parts) == 1, F.lit("root files"))
        .when(first.isin(rules.MAP_GROUP_ROOTS), F.concat_ws("/", first, second))
        .when(
            (first == "turbopack") & (second == "crates") & third.isNotNull(),
            F.concat_ws("/", first, second, third),
        )
        .otherwise(first)
    )


def inventory_map(files: DataFrame) -> DataFrame:
    """Up to 30 groups per repository: files, bytes, top languages, representative examples.

    ``files`` has repo_id, pos, path, language and size.
    """
    keyed = files.select(
        "repo_id", "pos", "path", "language", "size", map_group(F.col("path")).alias("group")
    )
    keys = ["repo_id", "group"]
    by_language = keyed.groupBy(*keys, "language").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("pos").alias("pos")
    )
    # One row per language: the inner list is bounded by the number of languages.
    listed = F.slice(
        F.array_sort(
            F.collect_list(F.struct((-F.col("n")).alias("n"), "pos", "language"))
        ),
        1,
        4,
    )
    groups = by_language.groupBy(*keys).agg(
        F.sum("n").alias("files"),
        F.sum("bytes").alias("bytes"),
        F.min("pos").alias("_pos"),
        _joined(
            F.transform(
                listed,
                lambda s: F.concat_ws(":", s["language"], (-s["n"]).cast("string")),
            )
        ).alias("languages"),
    )
    best = top_per_group(
        groups,
        ["repo_id"],
        [
            first_match(F.col("group"), rules.MAP_GROUP_PRIORITY, 0).desc(),
            F.col("files").desc(),
            "_pos",
        ],
        rules.MAX_MAP_GROUPS,
    )
    shown = top_per_group(
        keyed.filter(F.lower("path").rlike(rules.REPRESENTATIVE_FILE)),
        keys,
        ["pos"],
        rules.MAX_MAP_EXAMPLES,
    )
    examples = shown.groupBy(*keys).agg(_joined(collected("path", ["pos"])).alias("examples"))
    return best.join(examples, keys, "left").select(
        *keys, "files", "bytes", "languages", F.coalesce("examples", F.lit("")).alias("examples")
    )


def docs_tree_group(path: Column) -> Column:
    """Documentation root plus two segments, number prefixes and the file extension removed."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")
    low = F.transform(parts, lambda s: F.lower(s))
    two = F.array_join(F.slice(low, 1, 2), "/")
    at = F.least(
        *[
            F.when(F.array_position(low, r) > 0, F.array_position(low, r)).otherwise(10**6)
            for r in ("docs", "documentation")
        ]
    ).cast("int")
    after, then = F.get(low, at), F.get(low, at + 1)
    nested = (
        F.when((after == "content") & (then == "docs"), at + 2)
        .when(after.rlike(rules.DOCS_TREE_NESTED), at + 1)
        .otherwise(at)
    )
    end = (
        F.when(F.get(low, F.lit(0)).isin("docs", "documentation"), 1)
        .when(two.isin([r for r in rules.DOCS_TREE_ROOTS if "/" in r]), 2)
        .when(at < 10**6, nested)
    )
    root = F.array_join(F.slice(parts, F.lit(1), end), "/")
    inner = F.transform(
        F.slice(parts, end + 1, F.lit(2)), lambda s: F.regexp_replace(s, r"^\d+[-_.]", "")
    )
    tail = F.regexp_replace(F.array_join(inner, "/"), rules.DOCS_TREE_EXTENSION, "")
    return (
        F.when(end.isNull(), F.lit("root documentation"))
        .when(F.size(inner) == 0, root)
        .otherwise(F.concat_ws("/", root, tail))
    )


def docs_groups(files: DataFrame) -> DataFrame:
    """Up to 32 documentation groups per repository with up to 8 examples, from the best 140 paths."""
    best = top_files(files, "docs_tree").withColumn("group", docs_tree_group(F.col("path")))
    keys = ["repo_id", "group"]
    counted = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("paths"))
    shown = group_ranks_limited(best, keys, ["rank"], rules.MAX_DOCS_TREE_EXAMPLES, "_at")
    examples = shown.groupBy(*keys).agg(_joined(collected("path", ["_at"])).alias("examples"))
    order = [natural_key(F.col("group")), "group"]
    kept = top_per_group(counted, ["repo_id"], order, rules.MAX_DOCS_TREE_GROUPS)
    return kept.join(examples, keys)


# -- A3, A9 -----------------------------------------------------------------------------------


def _segment_label(url: Column, label) -> Column:
    segs = F.filter(
        U.segments(U.path(url)),
        lambda s: ~s.rlike(rules.TOPIC_SKIPPED_SEGMENT) & ~s.rlike(rules.TOPIC_VERSION_SEGMENT),
    )
    hit = F.get(F.filter(segs, lambda s: s.rlike(rules.TOPIC_SEGMENT)), F.lit(0))
    return F.when(hit.isNotNull(), label(hit))


def entry_topics(entries: DataFrame, variant: str = "topic") -> DataFrame:
    """Distinct topic labels of each entry, one row each, from its group parts and its address."""
    label, useful = (
        (T.topic_label, is_useful_topic)
        if variant == "topic"
        else (T.coverage_label, is_useful_coverage)
    )
    parts = F.transform(
        F.split(F.coalesce("group", F.lit("")), r"\s+/\s+"), lambda p: label(p)
    )
    labels = F.concat(parts, F.array(_segment_label(F.col("url"), label)))
    kept = F.filter(F.array_distinct(labels), lambda v: v.isNotNull() & useful(v))
    return entries.select("*", F.explode(kept).alias("label"))


def topic_counts(
    entries: DataFrame, min_count: int | Column = 2, top: int | None = None, variant: str = "coverage"
) -> DataFrame:
    """Entries per topic label and repository, most frequent first within ``top``."""
    counts = entry_topics(entries.select("repo_id", "group", "url"), variant).groupBy(
        "repo_id", "label"
    ).agg(F.count(F.lit(1)).alias("count"))
    kept = counts.filter(F.col("count") >= min_count)
    if top is None:
        return kept
    return top_per_group(kept, ["repo_id"], [F.col("count").desc(), "label"], top)


def high_volume_topics(entries: DataFrame, index: DataFrame, top: int = 12) -> DataFrame:
    """The 12 most frequent topics that hold at least max(4, links/80) entries."""
    counts = topic_counts(entries, 1, None, "topic").join(
        index.select("repo_id", "link_count"), "repo_id"
    )
    floor = F.greatest(F.lit(4), F.floor(F.col("link_count") / 80))
    return top_per_group(
        counts.filter(F.col("count") >= floor), ["repo_id"], [F.col("count").desc(), "label"], top
    ).drop("link_count")


def path_keywords(files: DataFrame, repos: DataFrame, top: int = 16) -> DataFrame:
    """Keywords of a repository: first path segments by count, their ``-er`` stems, and description
    words with weight four."""
    segment = T.compact(F.get(F.split("path", "/"), F.lit(0)))
    per_segment = files.select("repo_id", segment.alias("keyword")).groupBy("repo_id", "keyword").agg(
        F.count(F.lit(1)).alias("w")
    )
    kept = per_segment.filter(
        (F.length("keyword") >= 4) & ~F.col("keyword").isin(rules.STOP_PATH_SEGMENTS)
    )
    k = F.col("keyword")
    stems = kept.filter(k.endswith("er") & (F.length(k) > 5)).select(
        "repo_id", F.substr(k, F.lit(1), F.length(k) - 2).alias("keyword"), "w"
    )
    described = repos.select(
        "repo_id",
        F.explode(T.description_words(F.coalesce("description", F.lit("")))).alias("keyword"),
        F.lit(4).cast("bigint").alias("w"),
    )
    summed = kept.unionByName(stems).unionByName(described).groupBy("repo_id", "keyword").agg(
        F.sum("w").alias("weight")
    )
    return group_ranks_limited(summed, ["repo_id"], [F.col("weight").desc(), "keyword"], top)


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """Keywords as one list per repository (16 at most)."""
    return keywords.groupBy("repo_id").agg(collected("keyword", ["rank"]).alias("keywords"))


# -- A4, A5 -----------------------------------------------------------------------------------


def usage_snapshot(
    attempts: DataFrame,
    requests: DataFrame,
    now_us: int,
    cooldown_us: int = rules.GENERATION_LIMITS["cooldown_us"],
    ts: str = "created_at",
) -> DataFrame:
    """Usage of every quota scope at one moment, for each requesting (client, repository).

    ``requests`` has request_id, client_key and repo_full_name. Only attempts inside the longest window
    are read. Window starts are inclusive. The global scope is a one-row subquery.
    """
    retention = max(rules.DAY_US, cooldown_us)
    live = attempts.withColumn("_us", micros(F.col(ts))).filter(
        F.col("_us").between(now_us - retention, now_us)
    )

    def within(window: int, name: str) -> list[Column]:
        inside = F.col("_us") >= now_us - window
        return [
            F.count_if(inside).alias(f"{name}_count"),
            F.min(F.when(inside, F.col("_us"))).alias(f"{name}_oldest"),
        ]

    clients = live.groupBy("client_key").agg(
        *within(rules.HOUR_US, "client_hour"), *within(rules.DAY_US, "client_day")
    )
    repos = live.groupBy("repo_full_name").agg(*within(cooldown_us, "repo_cooldown"))
    overall = live.agg(*within(rules.HOUR_US, "global_hour"))
    both = overall.select(F.struct("global_hour_count", "global_hour_oldest")).scalar()
    joined = (
        requests.join(clients, "client_key", "left")
        .join(repos, "repo_full_name", "left")
        .withColumn("_g", both)
        .select("*", "_g.*")
        .drop("_g")
    )
    counts = [c for c in joined.columns if c.endswith("_count")]
    return joined.fillna(0, counts)


def quota_decision(
    usage: DataFrame, now_us: Column | int, limits: dict[str, int] | None = None
) -> DataFrame:
    """Admission of each row: the first violated scope, its limit, reset time and wait in seconds.

    Scopes in order: repository cooldown, client hour, client day, global hour. A limit of zero turns a
    scope off; the cooldown's limit is one.
    """
    lim = limits or rules.GENERATION_LIMITS
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    scopes = [
        ("client_hour", lim["client_hour"], rules.HOUR_US),
        ("client_day", lim["client_day"], rules.DAY_US),
        ("global_hour", lim["global_hour"], rules.HOUR_US),
    ]
    if lim.get("cooldown_us", 0) > 0:
        scopes.insert(0, ("repo_cooldown", 1, lim["cooldown_us"]))
    case = F.lit(None).cast("struct<scope:string,lim:int,reset:bigint>")
    for name, limit, window in reversed(scopes):
        if limit <= 0:
            continue
        oldest = F.col(f"{name}_oldest")
        denial = F.struct(
            F.lit(name).alias("scope"), F.lit(limit).alias("lim"), (oldest + window).alias("reset")
        )
        hit = (F.col(f"{name}_count") >= limit) & oldest.isNotNull()
        case = F.when(hit, denial).otherwise(case)
    wait = F.greatest(F.lit(1), F.ceil((F.col("_d.reset") - now) / 1_000_000)).cast("bigint")
    return (
        usage.withColumn("_d", case)
        .select(
            "*",
            F.col("_d").isNull().alias("allowed"),
            F.col("_d.scope").alias("scope"),
            F.col("_d.lim").alias("limit"),
            from_micros(F.col("_d.reset")).alias("reset_at"),
            F.when(F.col("_d").isNotNull(), wait).alias("retry_after_seconds"),
        )
        .drop("_d")
    )


# -- A6 .. A8 ---------------------------------------------------------------------------------


def docs_source_counts(files: DataFrame, variant: str = "count") -> DataFrame:
    return files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(is_docs_source(F.col("path"), variant)).alias("docs_count"),
    )


def outline_text(
    outline: DataFrame, nav: DataFrame | None = None, labels_only: bool = False
) -> DataFrame:
    """Searchable text of an outline per repository: titles, slugs, purposes, navigation titles.

    One text per repository, as long as its outline; patterns over phrases need the words in order.
    """
    fields = ["title", "slug"] if labels_only else ["title", "slug", "purpose"]
    lines = outline.select("repo_id", F.lit(1).alias("part"), F.col("pos").cast("string").alias("at"), F.concat_ws(" ", *fields).alias("line"))
    if nav is not None:
        titles = nav.select("repo_id", F.lit(0).alias("part"), F.col("node_id").cast("string").alias("at"), F.col("title").alias("line"))
        lines = lines.unionByName(titles)
    return lines.groupBy("repo_id").agg(
        T.spaced(F.array_join(collected("line", ["part", "at"]), " ")).alias("outline_text")
    )


def _entry_text() -> Column:
    return F.concat_ws(" ", F.coalesce("group", F.lit("")), "title", "url")


def coverage_families(
    entries: DataFrame,
    outline: DataFrame,
    families: Sequence[tuple[str, int, str, str]] = rules.EVIDENCE_FAMILIES,
) -> DataFrame:
    """Families with enough matching entries, and whether the outline mentions them.

    One conditional aggregate for all families, then one row per family. ``outline`` has repo_id and
    outline_text.
    """
    counted = entries.withColumn("_text", _entry_text()).groupBy("repo_id").agg(
        *[F.count_if(F.col("_text").rlike(f[2])).alias(f"_f{i}") for i, f in enumerate(families)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(f[0]).alias("family"),
                F.lit(f[1]).alias("minimum"),
                F.col(f"_f{i}").alias("entries"),
            )
            for i, f in enumerate(families)
        ]
    )
    present = counted.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*").filter(
        F.col("entries") >= F.col("minimum")
    )
    joined = present.join(outline.select("repo_id", "outline_text"), "repo_id", "left")
    text = F.coalesce("outline_text", F.lit(""))
    case = None
    for i, f in enumerate(families):
        case = (F if case is None else case).when(F.col("ord") == i, text.rlike(f[3]))
    return joined.select("repo_id", "ord", "family", "entries", case.alias("mentioned"))


def primitive_families(entries: DataFrame, outline: DataFrame) -> DataFrame:
    """Agent-framework families: one matching entry is enough."""
    families = [(name, 1, seen, shown) for name, seen, shown in rules.PRIMITIVE_FAMILIES]
    return coverage_families(entries, outline, families)


def missing_topics(topics: DataFrame, outline: DataFrame) -> DataFrame:
    """Topics the outline does not mention: not all their words, nor the label run together."""
    words = F.slice(
        F.filter(T.plain_words(T.topic_label(F.col("label"))), lambda w: ~w.isin(rules.GENERIC_TOPIC_WORDS)),
        1,
        4,
    )
    text = F.coalesce("outline_text", F.lit(""))
    joined = topics.join(outline.select("repo_id", "outline_text"), "repo_id", "left")
    mentioned = F.forall(words, lambda w: text.contains(w)) | (
        (F.size(words) > 1) & text.contains(T.compact(F.col("label")))
    )
    return joined.filter(~mentioned).drop("outline_text")


def journey_coverage(outline: DataFrame) -> DataFrame:
    """How many reader-journey and docs-spine groups the pages of a repository cover.

    Also whether implementation catalogue pages dominate.
    """
    label = F.lower(F.concat_ws(" ", "title", "slug", "purpose"))
    text = F.concat_ws(" ", "title", "slug", "purpose")

    def covered(groups: Sequence[str]) -> Column:
        return reduce(
            lambda a, b: a + b, [F.bool_or(label.rlike(g)).cast("int") for g in groups]
        )

    stats = outline.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("pages"),
        covered(rules.JOURNEY_GROUPS).alias("journey_groups"),
        covered(rules.SPINE_GROUPS).alias("spine_groups"),
        F.count_if(text.rlike(rules.CATALOGUE_TEXT)).alias("catalogue_pages"),
        F.count_if(text.rlike(rules.READER_TEXT)).alias("reader_pages"),
    )
    needed = F.when(F.col("pages") < 12, 4).otherwise(5)
    return stats.select(
        "*",
        (F.col("journey_groups") >= 4).alias("has_journey"),
        (F.col("spine_groups") >= needed).alias("has_spine"),
        (
            (F.col("pages") >= 8)
            & (F.col("catalogue_pages") > F.greatest(F.lit(4), F.col("reader_pages") + 2))
        ).alias("catalogue_dominates"),
    )


# -- A10 --------------------------------------------------------------------------------------


def duplicate_slugs(pages: DataFrame) -> DataFrame:
    """Normalised slugs used more than once in a repository."""
    return (
        pages.select("repo_id", T.slug(F.col("slug")).alias("slug"))
        .filter("slug <> ''")
        .groupBy("repo_id", "slug")
        .agg(F.count(F.lit(1)).alias("pages"))
        .filter("pages > 1")
    )


def redundant_topics(pages: DataFrame) -> DataFrame:
    """Group-prefixed twins of a page whose slug is its title; generic titles may repeat.

    The titles that have a canonical page are a small aggregate joined back, so a title shared by very
    many pages is not gathered anywhere.
    """
    keyed = pages.withColumn("_title", T.slug(F.col("title"))).withColumn(
        "_slug", T.slug(F.col("slug"))
    )
    titles = (
        keyed.filter((F.col("_title") != "") & ~F.col("_title").rlike(rules.ALLOWED_DUPLICATE_TITLE))
        .groupBy("repo_id", "_title")
        .agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("_slug") == F.col("_title")).alias("_has"))
        .filter("_n > 1 and _has")
        .select("repo_id", "_title")
    )
    twins = keyed.filter(
        (F.col("_slug") != F.col("_title"))
        & F.endswith(F.col("_slug"), F.concat(F.lit("-"), F.col("_title")))
    )
    return twins.join(titles, ["repo_id", "_title"], "left_semi").drop("_title", "_slug")


def redundant_setup(pages: DataFrame) -> DataFrame:
    """Landing pages of a setup section that has focused leaves (at least two kinds) anyway."""
    named = F.lower(F.concat_ws(" ", "slug", "title"))
    leaves = reduce(
        lambda a, b: a + b,
        [F.bool_or(named.rlike(p)).cast("int") for p in rules.SETUP_LEAF_PATTERNS],
    )
    focused = pages.groupBy("repo_id").agg(leaves.alias("_leaves")).filter("_leaves >= 2")
    s = T.slug(F.col("slug"))
    text = F.lower(F.concat_ws(" ", s, F.col("title"), F.col("purpose")))
    landing = s.rlike(rules.SETUP_LANDING_SLUG) | text.rlike(rules.SETUP_LANDING_TEXT)
    return pages.filter(landing).join(focused, "repo_id", "left_semi")


# -- A11 --------------------------------------------------------------------------------------


def index_score() -> Column:
    """Composite score of a discovered index."""
    w = rules.INDEX_WEIGHTS
    url, links = F.col("source_url"), F.col("link_count")
    kind = (
        F.when(url.rlike(r"(?i)llms-full\.txt$"), F.when(links >= 60, 500).otherwise(0))
        .when(url.rlike(r"(?i)llms.*\.txt$"), F.when(links >= 60, 8_000).otherwise(2_500))
        .when(url.rlike(r"(?i)sitemap.*\.xml$"), 3_000)
        .otherwise(0)
    )
    return (
        F.col("relevance_score") * w["relevance"]
        + F.col("candidate_score") * w["candidate"]
        + F.least(links, F.lit(w["counted"])) * w["links"]
        + F.least(F.col("heading_count"), F.lit(w["counted"])) * w["headings"]
        + kind
        - F.when(url.rlike(rules.LANGUAGE_INDEX), 24_000).otherwise(0)
        + F.when(url.rlike(r"(?i)/docs/sitemap\.xml$"), 22_000).otherwise(0)
        - F.when(url.rlike(r"(?i)/release-notes(?:/|$)"), 4_000).otherwise(0)
    )


def is_strong_index() -> Column:
    url, links, headings = F.col("source_url"), F.col("link_count"), F.col("heading_count")
    return reduce(
        lambda a, b: a | b,
        [
            url.rlike(pattern) & (links >= least_links) & (headings >= least_headings)
            for pattern, least_links, least_headings in rules.INDEX_STRONG
        ],
    )


def best_index(candidates: DataFrame) -> DataFrame:
    """The best discovered index of each repository, with its score and strength."""
    scored = candidates.withColumn("index_score", index_score())
    # Sixteen fields at most per row, and one row per repository survives the map side.
    best = F.max_by(
        F.struct(*[F.col(c) for c in scored.columns if c != "repo_id"]),
        F.struct("index_score", -F.col("pos")),
    )
    picked = scored.groupBy("repo_id").agg(best.alias("b")).select("repo_id", "b.*")
    return picked.withColumn("is_strong", is_strong_index())


def prefer_fallback(best: DataFrame, fallback: DataFrame) -> DataFrame:
    """Choose between a discovered index and the repository's own docs tree, per repository.

    A strong index wins. A weak one loses to a tree that is clearly richer; a repository with only one
    of the two takes that.
    """
    tree = fallback.select(
        "repo_id",
        F.col("source_url").alias("_url"),
        F.col("link_count").alias("_links"),
        F.col("heading_count").alias("_headings"),
    )
    both = best.select("repo_id", "source_url", "link_count", "heading_count", "is_strong").join(
        tree, "repo_id", "full"
    )
    links, headings = F.col("link_count"), F.col("heading_count")
    t_links, t_headings = F.col("_links"), F.col("_headings")
    thin = (links < 20) & (headings < 20) & (t_links >= F.greatest(F.lit(12), links + 4))
    rich = (t_links >= 20) | (t_headings >= 20)
    fuller = (t_links >= links * 2) | ((t_headings >= headings * 2) & (t_links > links))
    better = F.col("_url").rlike(r"(?i)^https://github\.com/") & (thin | (rich & fuller))
    use_tree = F.col("source_url").isNull() | (
        ~F.col("is_strong") & F.coalesce(better, F.lit(False))
    )
    return both.select(
        "repo_id",
        F.when(use_tree, F.col("_url")).otherwise(F.col("source_url")).alias("source_url"),
        F.when(use_tree, t_links).otherwise(links).alias("link_count"),
        F.when(use_tree, t_headings).otherwise(headings).alias("heading_count"),
        use_tree.alias("is_repository_fallback"),
    )


def accepted_indexes(bodies: DataFrame) -> DataFrame:
    """Text indexes worth keeping: ten links, and two headings unless the file is a dense index.

    ``bodies`` has source_url, link_count, heading_count and ``adjacent`` (a known docs source).
    """
    index_file = U.path(F.col("source_url")).rlike(r"(?i)/llms(?:-full)?\.txt$")
    links, headings = F.col("link_count"), F.col("heading_count")
    dense = index_file & (links >= 60)
    trusted = index_file & (links >= 30) & F.coalesce("adjacent", F.lit(False))
    return bodies.filter((links >= 10) & ((headings >= 2) | dense | trusted))


def drop_weak_indexes(candidates: DataFrame, repos: DataFrame, entries: DataFrame) -> DataFrame:
    """Drop indexes that are too broad for the repository or too small to be documentation.

    ``candidates``: repo_id, source_url, discovered_from, relevance_score, link_count. ``entries`` feeds
    the test for tiny sitemaps: under 30 links and fewer than three documentation-shaped entries.
    """
    p = F.lower(F.regexp_replace(F.col("path"), r"^https?://[^/]*", ""))
    text = F.lower(F.concat_ws(" ", F.coalesce("group", F.lit("")), F.col("title"), p))
    shaped = (
        entries.withColumn("path", F.col("url"))
        .groupBy("repo_id", "source_url")
        .agg(
            F.count(F.lit(1)).alias("_entries"),
            F.count_if(text.rlike(rules.DOCS_SHAPED_ENTRY)).alias("_shaped"),
        )
    )
    cols = candidates.columns
    on_source = entity_mentions(candidates, repos, "source_url").withColumnRenamed(
        "repo_specific", "_source_names_repo"
    )
    drop = [
        "owner_specific",
        "topic_specific",
        "homepage_related",
        "homepage_docs",
        "path_specific",
        "is_project_docs",
    ]
    on_seed = entity_mentions(on_source.drop(*drop), url="discovered_from").withColumnRenamed(
        "repo_specific", "_seed_names_repo"
    )
    joined = on_seed.join(shaped, ["repo_id", "source_url"], "left").fillna(0, ["_entries", "_shaped"])
    path = U.path(F.col("source_url"))
    root_map = F.lower(path) == "/sitemap.xml"
    links = F.col("link_count")
    weak_map = (
        root_map
        & ~F.col("_source_names_repo")
        & F.col("_seed_names_repo")
        & ((F.col("relevance_score") < 10) | (links < 120))
    )
    weak_text = (
        path.rlike(r"(?i)^/llms(?:-full)?\.txt$")
        & (U.origin(F.col("source_url")) == U.origin(F.col("discovered_from")))
        & (F.size(U.segments(U.path(F.col("discovered_from")))) >= 2)
        & (
            F.col("_seed_names_repo")
            | ((links >= rules.BROAD_INDEX_LINKS) & (F.col("relevance_score") <= 10))
        )
    )
    tiny = (
        root_map
        & ~U.is_docs_host(U.host(F.col("source_url")))
        & (links < 30)
        & (F.col("_entries") < 30)
        & (F.col("_shaped") < 3)
    )
    kept = joined.filter(
        (F.col("relevance_score") >= rules.MIN_RELEVANCE) & ~weak_map & ~weak_text & ~tiny
    )
    return kept.select(*cols)


def index_relevance(bodies: DataFrame, repos: DataFrame) -> DataFrame:
    """How much an index is about its repository, from its address and its first 32,000 characters.

    ``bodies``: repo_id, source_url, discovered_from, text. ``repos`` adds description.
    """
    flagged = entity_mentions(bodies, repos, "source_url").join(
        repos.select("repo_id", "description"), "repo_id"
    )
    head = F.lower(F.substring("text", 1, 32_000))
    repo = T.compact(F.col("name"))
    n = F.length(repo)
    where = T.compact(
        F.concat(U.host(F.col("source_url")), U.path(F.col("source_url")))
    )
    quoted = F.regexp_replace(F.lower("name"), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    links_repo = F.contains(
        head, F.concat(F.lit("github.com/"), F.lower("owner"), F.lit("/"), F.lower("name"))
    )
    exact = F.regexp_like(head, F.concat(F.lit("(^|[^a-z0-9])"), quoted, F.lit("([^a-z0-9]|$)")))
    named = exact & ((n >= 4) | F.col("repo_specific"))
    in_address = where.contains(repo)
    trusted = (
        F.col("repo_specific")
        | F.col("owner_specific")
        | F.col("homepage_docs")
        | links_repo
        | ((n >= 4) & in_address)
    )
    topic_only = (
        F.col("topic_specific")
        & ~F.col("repo_specific")
        & ~F.col("owner_specific")
        & ~F.col("homepage_docs")
        & ~in_address
        & ~links_repo
        & ~named
    )
    words = T.description_words(F.coalesce("description", F.lit("")))
    described = F.least(F.lit(4), F.size(F.filter(words, lambda w: head.contains(w))))

    def plus(cond: Column, weight: int) -> Column:
        return F.when(cond, F.lit(weight)).otherwise(F.lit(0))

    broad = (
        ~F.col("repo_specific")
        & ~F.col("homepage_docs")
        & F.col("owner_specific")
        & (F.regexp_count(head, F.lit(r"\[[^\]\n]*\]\((?!#)[^)]+?\)")) > 300)
    )
    seed_in_docs = F.lower(U.path(F.col("discovered_from"))).startswith("/docs")
    borrowed = (
        (U.path(F.col("source_url")) == "/docs/llms.txt")
        & ~(F.col("repo_specific") | F.col("owner_specific"))
        & ~seed_in_docs
    )
    score = (
        F.when(F.col("repo_specific"), 7).when(F.col("owner_specific"), 2).otherwise(0)
        + plus(F.col("topic_specific"), 4)
        + plus(F.col("homepage_docs"), 5)
        + plus(in_address & (n >= 5), 4)
        + plus(links_repo, 6)
        + plus(named, 3)
        + described
        + plus(broad, -4)
        + plus(borrowed, -8)
    )
    return flagged.select(
        *bodies.columns,
        F.when(~trusted | topic_only, 0).otherwise(score).cast("int").alias("relevance_score"),
    )


# -- A12 .. A15 -------------------------------------------------------------------------------


def refresh_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status", "stale_reason").agg(F.count(F.lit(1)).alias("repositories"))


def minimum_publishable(pages: Column) -> Column:
    """Pages that must have been generated for an outline of that size to be published."""
    return (
        F.when(pages <= 3, pages)
        .when(pages >= 50, F.greatest(F.lit(48), F.floor(pages * 9 / 10)))
        .when(pages >= 25, F.greatest(F.lit(20), F.floor(pages * 3 / 4)))
        .otherwise(F.greatest(F.lit(3), F.floor(pages * 3 / 5)))
        .cast("int")
    )


def publish_gate(outline: DataFrame, drafts: DataFrame, failures: DataFrame) -> DataFrame:
    """Per repository: planned and generated pages, whether it may be published, first six failures.

    ``failures`` has repo_id, pos, page_slug and error.
    """
    planned = outline.groupBy("repo_id").agg(F.count(F.lit(1)).alias("planned"))
    made = drafts.groupBy("repo_id").agg(F.count(F.lit(1)).alias("generated"))
    failed = failures.groupBy("repo_id").agg(F.count(F.lit(1)).alias("failed"))
    first = top_per_group(failures, ["repo_id"], ["pos"], rules.MAX_REPORTED_FAILURES)
    line = F.concat_ws(": ", "page_slug", "error")
    listed = first.withColumn("_line", line).groupBy("repo_id").agg(
        F.array_join(collected("_line", ["pos"]), "; ").alias("reported")
    )
    joined = (
        planned.join(made, "repo_id", "left")
        .join(failed, "repo_id", "left")
        .join(listed, "repo_id", "left")
        .fillna(0, ["generated", "failed"])
        .fillna("", ["reported"])
    )
    need = minimum_publishable(F.col("planned"))
    return joined.select(
        "*",
        need.alias("needed"),
        ((F.col("generated") > 0) & (F.col("generated") >= need)).alias("publishable"),
    )


def nav_stats(nav: DataFrame) -> DataFrame:
    """Folders, leaves, depth, root folders and root leaves of each navigation tree.

    A node with children is a folder; a node without children but with a slug is a leaf.
    """
    parents = nav.filter(F.col("parent_id").isNotNull()).groupBy(
        "repo_id", F.col("parent_id").alias("node_id")
    ).agg(
        F.count(F.lit(1)).alias("_children"),
        F.count_if(F.col("slug").isNotNull()).alias("_slugged"),
    )
    grand = (
        nav.filter(F.col("parent_id").isNotNull())
        .select("repo_id", "node_id", F.col("parent_id").alias("_p"))
        .join(parents.select("repo_id", "node_id"), ["repo_id", "node_id"], "left_semi")
        .groupBy("repo_id", F.col("_p").alias("node_id"))
        .agg(F.count(F.lit(1)).alias("_subfolders"))
    )
    n = (
        nav.join(parents, ["repo_id", "node_id"], "left")
        .join(grand, ["repo_id", "node_id"], "left")
        .fillna(0, ["_children", "_slugged", "_subfolders"])
    )
    folder = F.col("_children") > 0
    leaf = ~folder & F.col("slug").isNotNull()
    root = F.col("depth") == 1
    flat_children = (F.col("_slugged") == F.col("_children")) & (F.col("_subfolders") == 0)
    return n.groupBy("repo_id").agg(
        F.count_if(folder).alias("folders"),
        F.count_if(leaf).alias("leaves"),
        F.coalesce(F.max(F.when(folder, F.col("depth"))), F.lit(0)).alias("max_depth"),
        F.count_if(folder & root).alias("root_folders"),
        F.count_if(leaf & root).alias("root_leaves"),
        F.count_if(root).alias("root_nodes"),
        F.coalesce(
            F.max(
                F.when(root & F.col("slug").isNull() & folder & flat_children, F.col("_children"))
            ),
            F.lit(0),
        ).alias("wrapper_children"),
        F.min(F.when(folder & F.col("slug").isNotNull(), F.col("title"))).alias("folder_with_slug"),
    )


def stale_metadata(
    seed: DataFrame, stored: DataFrame, now: Column, max_age_hours: int = rules.STALE_METADATA_HOURS
) -> DataFrame:
    """Seed repositories whose stored metadata is missing, incomplete or too old, with the reason."""
    right = stored.select(
        "full_name", "stars", "metadata_refreshed_at", F.lit(True).alias("_stored")
    )
    joined = seed.join(right, "full_name", "left")
    age = F.unix_micros(now) - micros(F.col("metadata_refreshed_at"))
    reason = (
        F.when(F.col("_stored").isNull(), F.lit("missing"))
        .when(F.col("stars").isNull(), F.lit("no_stars"))
        .when(F.col("metadata_refreshed_at").isNull(), F.lit("never"))
        .when(age > max_age_hours * rules.HOUR_US, F.lit("old"))
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_stored")
