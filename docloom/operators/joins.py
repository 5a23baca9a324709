"""Lookups, merges and matching on keys.

Join strategy is left to Spark: keys are equi-join keys throughout, AQE turns small sides into
broadcasts by their measured size and splits hot keys of sort-merge joins. Only key lists handed over
by the caller as Python values are broadcast outright, and their length is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.operators.ordering import cap_per_group, first_wins, top_per_group
from docloom.operators.predicates import (
    is_admitted_host,
    is_planning_path,
    weighted,
)

# -- J1 .. J3 ---------------------------------------------------------------------------------


def lookup_wanted(table: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``table`` whose key is wanted, once per wanted row."""
    return table.join(wanted.select(*keys), list(keys))


def with_current_revision(repos: DataFrame, revisions: DataFrame) -> DataFrame:
    """Repositories with the revision they point at; null revision columns mean never indexed."""
    right = revisions.withColumnRenamed("revision_id", "current_revision_id").drop("repo_id")
    return repos.join(right, "current_revision_id", "left")


def wiki_view(
    repos: DataFrame,
    revisions: DataFrame,
    artifacts: DataFrame,
    pages: DataFrame,
    page_revisions: DataFrame,
    page_slug: str = "overview",
) -> DataFrame:
    """One row per repository with its current revision and one page of it, nulls where missing.

    The slug test belongs to the join: a repository without that page still has its row. Filtering
    the page side first says the same and reaches the scan.
    """
    rev = revisions.select(
        F.col("revision_id").alias("current_revision_id"),
        "commit_sha",
        "generator_version",
        "indexed_at",
        "source_index_artifact_id",
    )
    page = pages.filter(F.col("slug") == page_slug).select(
        "repo_id",
        "page_id",
        F.col("slug").alias("page_slug"),
        F.col("title").alias("page_title"),
        F.col("current_revision_id").alias("page_revision_id"),
    )
    page_rev = page_revisions.select(
        F.col("id").alias("page_revision_id"), "content_artifact_id", "citations_artifact_id"
    )

    def urls_of(prefix: str) -> DataFrame:
        return artifacts.select(
            F.col("artifact_id").alias(f"{prefix}_artifact_id"), F.col("url").alias(f"{prefix}_url")
        )

    return (
        repos.join(rev, "current_revision_id", "left")
        .join(urls_of("source_index"), "source_index_artifact_id", "left")
        .join(page, "repo_id", "left")
        .join(page_rev, "page_revision_id", "left")
        .join(urls_of("content"), "content_artifact_id", "left")
        .join(urls_of("citations"), "citations_artifact_id", "left")
    )


# -- J4 .. J7 ---------------------------------------------------------------------------------


def valid_citations(drafts: DataFrame, files: DataFrame, keys=("repo_id", "page_slug")) -> DataFrame:
    """Cited paths that exist in the inventory: distinct per draft, in first-cited order.

    ``drafts`` has ``citations`` (array of structs with path). Drafts without a valid citation have no
    row. The array is rebuilt per draft, so it is never longer than the draft's own citations.
    """
    cited = drafts.select(*keys, F.posexplode("citations").alias("pos", "c")).select(
        *keys, "pos", F.col("c.path").alias("path")
    )
    distinct = cited.groupBy(*keys, "path").agg(F.min("pos").alias("pos"))
    known = distinct.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    return known.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda s: s["path"]).alias(
            "valid_paths"
        )
    )


def valid_source_paths(outline: DataFrame, files: DataFrame) -> DataFrame:
    """Outline pages with their source paths reduced to indexed, non-planning files."""
    listed = outline.select("repo_id", "pos", F.posexplode("source_paths").alias("at", "path"))
    known = listed.filter(~is_planning_path(F.col("path"))).join(
        files.select("repo_id", "path"), ["repo_id", "path"], "left_semi"
    )
    paths = known.groupBy("repo_id", "pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda s: s["path"]).alias(
            "_paths"
        )
    )
    none = F.array().cast("array<string>")
    return outline.join(paths, ["repo_id", "pos"], "left").withColumn(
        "source_paths", F.coalesce("_paths", none)
    ).drop("_paths")


def missing_pages(outline: DataFrame, drafts: DataFrame) -> DataFrame:
    """Outline pages for which no draft exists, compared on the normalised slug."""
    made = drafts.select("repo_id", T.slug(F.col("page_slug")).alias("_key"))
    return outline.withColumn("_key", T.slug(F.col("slug"))).join(
        made, ["repo_id", "_key"], "left_anti"
    ).drop("_key")


def generated_pages(outline: DataFrame, drafts: DataFrame) -> DataFrame:
    """Outline pages for which a draft exists."""
    made = drafts.select("repo_id", T.slug(F.col("page_slug")).alias("_key"))
    return outline.withColumn("_key", T.slug(F.col("slug"))).join(
        made, ["repo_id", "_key"], "left_semi"
    ).drop("_key")


def prune_related(drafts: DataFrame) -> DataFrame:
    """Related slugs of each draft that were generated in the same repository, as rows in order."""
    related = drafts.select("repo_id", "page_slug", F.posexplode("related_pages").alias("pos", "related"))
    made = drafts.select("repo_id", T.slug(F.col("page_slug")).alias("_key"))
    return related.withColumn("_key", T.slug(F.col("related"))).join(
        made, ["repo_id", "_key"], "left_semi"
    ).drop("_key")


def exclude_known(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path is not known, ignoring case."""
    keys = known.select("repo_id", F.lower("path").alias("_key"))
    return files.withColumn("_key", F.lower("path")).join(
        keys, ["repo_id", "_key"], "left_anti"
    ).drop("_key")


# -- set operations ---------------------------------------------------------------------------


def union_first(a: DataFrame, b: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Rows of ``a`` then rows of ``b``, first occurrence of each key kept, with ``source`` 0 or 1."""
    both = a.withColumn("source", F.lit(0)).unionByName(b.withColumn("source", F.lit(1)))
    return first_wins(both, keys, ["source", pos])


def intersect_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_semi")


def subtract_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


# -- J12 --------------------------------------------------------------------------------------


def pair_tool_calls(events: DataFrame) -> DataFrame:
    """One row per tool call of a session, from its requests and results.

    ``events`` has session_id, seq, kind (request or result), call_id, tool_name, input, output and
    status. In order of seq a request replaces the call, a result overwrites its output and status but
    keeps the requested input; the name falls back to the last one known, then to ``tool``. All of that
    is what came last of each kind, so one partial aggregate does it without a join.
    """
    seq = F.col("seq")
    asked, answered = F.col("kind") == "request", F.col("kind") == "result"
    calls = events.filter(F.col("kind").isin("request", "result")).groupBy("session_id", "call_id").agg(
        F.min(seq).alias("first_seq"),
        F.max(F.when(asked, seq)).alias("_asked"),
        F.max(F.when(answered, seq)).alias("_answered"),
        F.max_by("input", F.when(asked, seq)).alias("input"),
        F.max_by("output", F.when(answered, seq)).alias("_output"),
        F.max_by("status", F.when(answered, seq)).alias("_status"),
        F.max_by("tool_name", F.when(F.col("tool_name").isNotNull(), seq)).alias("_name"),
    )
    done = F.col("_answered").isNotNull() & (
        F.col("_asked").isNull() | (F.col("_answered") > F.col("_asked"))
    )
    return calls.select(
        "session_id",
        "call_id",
        "first_seq",
        F.coalesce("_name", F.lit("tool")).alias("tool_name"),
        "input",
        F.when(done, F.col("_output")).alias("output"),
        F.when(done, F.col("_status")).alias("status"),
        F.when(done & F.col("_asked").isNull(), F.lit("result_only"))
        .when(done, F.lit("done"))
        .otherwise(F.lit("pending"))
        .alias("state"),
    )


# -- J13 .. J15 -------------------------------------------------------------------------------


def merge_pages(current: DataFrame, drafts: DataFrame, revision: str, now: Column) -> DataFrame:
    """Page table after publishing: insert, update, retire (pointer cleared) or keep.

    ``current``: page_id, repo_id, slug, title, current_revision_id, created_at, updated_at.
    ``drafts``: repo_id, slug, title, page_revision_id. Only repositories that publish something have
    pages retired. New ids derive from repository and slug, so a retried job makes the same ones.
    """
    keys = ["repo_id", "slug"]
    publishing = drafts.select("repo_id").distinct().withColumn("_publishing", F.lit(True))
    cur = current.select(*keys, *[F.col(c).alias(f"_c_{c}") for c in current.columns if c not in keys])
    new = drafts.select(*keys, F.col("title").alias("_title"), F.col("page_revision_id").alias("_rev"))
    merged = cur.join(new, keys, "full").join(publishing, "repo_id", "left")
    inserted = F.col("_c_page_id").isNull()
    drafted = F.col("_rev").isNotNull()
    action = (
        F.when(inserted, F.lit("insert"))
        .when(drafted, F.lit("update"))
        .when(F.col("_publishing"), F.lit("retire"))
        .otherwise(F.lit("keep"))
    )
    touched = action != "keep"
    return merged.select(
        F.coalesce("_c_page_id", F.sha2(F.concat_ws("|", "repo_id", "slug"), 256)).alias("page_id"),
        "repo_id",
        "slug",
        F.coalesce("_title", "_c_title").alias("title"),
        F.when(drafted, F.col("_rev"))
        .when(action == "keep", F.col("_c_current_revision_id"))
        .alias("current_revision_id"),
        F.coalesce("_c_created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("_c_updated_at")).alias("updated_at"),
        F.when(drafted, F.lit(revision)).alias("published_in"),
        action.alias("action"),
    )


def upsert_repositories(
    current: DataFrame, incoming: DataFrame, featured: DataFrame, now: Column
) -> DataFrame:
    """Repository table after an upsert on (provider, owner, name) and a sync of the featured list.

    ``featured`` lists full names; every repository on it is flagged, every other is not.
    """
    keys = ["provider", "owner", "name"]
    cur = current.select(*keys, *[F.col(c).alias(f"_c_{c}") for c in current.columns if c not in keys])
    inc = incoming.select(
        *keys, F.col("full_name").alias("_full_name"), F.col("repo_url").alias("_repo_url")
    )
    merged = cur.join(inc, keys, "full")
    given = F.col("_full_name").isNotNull()
    rows = merged.select(
        F.coalesce("_c_repo_id", F.sha2(F.concat_ws("/", *keys), 256)).alias("repo_id"),
        *keys,
        F.coalesce("_full_name", "_c_full_name").alias("full_name"),
        F.coalesce("_repo_url", "_c_repo_url").alias("repo_url"),
        F.coalesce("_c_created_at", now).alias("created_at"),
        F.when(given, now).otherwise(F.col("_c_updated_at")).alias("updated_at"),
        F.when(F.col("_c_repo_id").isNull(), F.lit("insert"))
        .when(given, F.lit("update"))
        .otherwise(F.lit("keep"))
        .alias("action"),
    )
    flags = featured.select("full_name").distinct().withColumn("_featured", F.lit(True))
    return rows.join(flags, "full_name", "left").withColumn(
        "is_featured", F.coalesce("_featured", F.lit(False))
    ).drop("_featured")


def update_metadata(repos: DataFrame, metadata: DataFrame, now: Column) -> DataFrame:
    """Replace the metadata columns of the repositories in ``metadata``; nulls replace as well."""
    fields = ["default_branch", "description", "owner_avatar_url", "stars"]
    fresh = metadata.select("repo_id", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = repos.join(fresh, "repo_id", "left")
    for f in fields:
        joined = joined.withColumn(f, F.when(F.col("_hit"), F.col(f"_{f}")).otherwise(F.col(f)))
    refreshed = F.when(F.col("_hit"), now).otherwise(F.col("metadata_refreshed_at"))
    return joined.withColumn("metadata_refreshed_at", refreshed).drop(
        "_hit", *[f"_{f}" for f in fields]
    )


def with_fallback(
    seed: DataFrame, stored: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Seed rows with each field taken from the stored row where that has one."""
    right = stored.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = seed.join(right, list(keys), "left")
    for f in fields:
        own = F.col(f) if f in seed.columns else F.lit(None)
        joined = joined.withColumn(f, F.coalesce(F.col(f"_{f}"), own))
    return joined.drop(*[f"_{f}" for f in fields])


def featured_cards(seed: DataFrame, stored: DataFrame) -> DataFrame:
    """Seed list with stored metadata; the static star label shows only without a stored count."""
    known = stored.select(
        "full_name", "description", "repo_url", F.col("owner_avatar_url").alias("icon"), "stars"
    )
    cards = with_fallback(seed, known, ["full_name"], ["description", "repo_url", "icon", "stars"])
    owner = F.get(F.split("full_name", "/"), F.lit(0))
    avatar = F.concat(F.lit("https://github.com/"), owner, F.lit(".png?size=40"))
    return cards.withColumn("icon", F.coalesce("icon", avatar)).withColumn(
        "star_label", F.when(F.col("stars").isNull(), F.col("star_label"))
    )


# -- J16 .. J18 -------------------------------------------------------------------------------


def site_key(h: Column) -> Column:
    """Key under which hosts belong together: the exact host on shared deployment domains, the last
    two labels elsewhere."""
    return F.when(U.is_shared_host(h), F.lower(h)).otherwise(U.registrable_host(h))


def related_hosts(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Links paired with the sources of the same site. ``links`` and ``sources`` have ``host``.

    Sources are reduced to distinct hosts per site first, so a popular site multiplies links only by
    its number of hosts.
    """
    src = sources.select(
        F.col("host").alias("source_host"), site_key(F.col("host")).alias("site")
    ).distinct()
    return links.withColumn("site", site_key(F.col("host"))).join(src, "site")


def _contains_any(topics: Column, hit) -> Column:
    return F.exists(F.coalesce(topics, F.array().cast("array<string>")), hit)


def topic_keywords(topics: Column) -> Column:
    kept = F.filter(
        F.transform(topics, T.compact),
        lambda t: (F.length(t) >= 4) & ~t.isin(rules.STOP_TOPICS),
    )
    return F.slice(F.array_distinct(kept), 1, 8)


def _mentions(url: Column) -> dict[str, Column]:
    """How an address names a repository; needs owner, name, homepage_url and topics columns."""
    h, p = U.host(url), U.path(url)
    both = T.compact(F.concat(h, p))
    label = T.compact(U.primary_label(h))
    repo, owner = T.compact(F.col("name")), T.compact(F.col("owner"))
    n = F.length(repo)
    parts = F.transform(U.segments(p), T.compact)
    repo_specific = (
        ((n >= 5) & both.contains(repo))
        | ((n >= 3) & label.startswith(repo))
        | ((n >= 2) & (label == repo))
        | ((n >= 3) & F.array_contains(parts, repo))
    )
    owner_specific = (F.length(owner) >= 4) & (both.contains(owner) | (label == owner))
    topic_specific = _contains_any(
        topic_keywords(F.col("topics")),
        lambda t: both.contains(t) | label.startswith(t),
    )
    home = F.col("homepage_url")
    home_host = U.host(home)
    shared = U.is_shared_host(h) | U.is_shared_host(home_host)
    homepage = U.is_http(home) & F.when(shared, h == home_host).otherwise(
        U.registrable_host(h) == U.registrable_host(home_host)
    )
    home_parts = F.transform(U.segments(U.path(home)), lambda s: F.lower(s))
    own_parts = F.transform(U.segments(p), lambda s: F.lower(s))
    homepage_docs = homepage & (
        (F.size(home_parts) == 0) | repo_specific | F.arrays_overlap(own_parts, home_parts)
    )
    path_text = T.compact(p)
    in_path = ((n >= 5) & path_text.contains(repo)) | (
        (F.length(owner) >= 4) & path_text.contains(owner)
    )
    named = {
        "repo_specific": repo_specific,
        "owner_specific": owner_specific,
        "topic_specific": topic_specific,
        "homepage_related": homepage,
        "homepage_docs": homepage_docs,
        "path_specific": in_path,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in named.items()}


def entity_mentions(urls: DataFrame, repos: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Flag how each address names its repository, and whether it is a likely project docs address.

    The join is on repo_id. Pass ``repos=None`` when the repository columns are already present.
    """
    df = urls if repos is None else urls.join(
        repos.select("repo_id", "owner", "name", "homepage_url", "topics"), "repo_id"
    )
    for name, flag in _mentions(F.col(url)).items():
        df = df.withColumn(name, flag)
    docs_path = F.lower(U.path(F.col(url))).rlike(rules.PROJECT_DOCS_PATH)
    return df.withColumn(
        "is_project_docs",
        is_admitted_host(U.host(F.col(url)))
        & (
            F.col("repo_specific")
            | F.col("owner_specific")
            | F.col("topic_specific")
            | F.col("homepage_related")
            | (docs_path & F.col("path_specific"))
        ),
    )


def _under(base: Column, paths: Sequence[str]) -> list[Column]:
    return [F.concat(base, F.lit(p)) for p in paths]


def _only_if(cond: Column, items: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), items).otherwise(
        F.array().cast("array<string>")
    )


def _landing(base: Column) -> Column:
    repo = F.lower("name")
    return F.array(
        *_under(base, rules.DOCS_LANDING_PATHS),
        F.concat(base, F.lit("/"), repo),
        F.concat(base, F.lit("/"), repo, F.lit("/docs")),
    )


def _position(segs: Column, pattern: str) -> Column:
    """Zero-based index of the first segment that matches, or -1."""
    hits = F.transform(segs, lambda s: s.rlike(pattern))
    return (F.array_position(hits, True) - 1).cast("int")


def _repo_position(segs: Column) -> Column:
    repo = T.compact(F.col("name"))
    hits = F.transform(
        segs,
        lambda s: (T.compact(s) == repo)
        | (T.compact(F.regexp_replace(s, r"(?i)\.[a-z0-9]+$", "")) == repo),
    )
    return (F.array_position(hits, True) - 1).cast("int")


def _index_candidates() -> Column:
    """Likely index addresses of a seed address, from the columns ``expand_candidates`` prepares."""
    o, clean, segs = F.col("_origin"), F.col("_clean"), F.col("_segs")
    project = F.col("repo_specific") | F.col("owner_specific")
    known = project | F.col("topic_specific") | F.col("homepage_related")
    files = ["/llms.txt", "/llms-full.txt", "/sitemap.xml"]
    docs_at, repo_at = F.col("_docs_at"), F.col("_repo_at")

    def prefix(last: Column) -> Column:
        return F.concat(o, F.lit("/"), F.array_join(F.slice(segs, F.lit(1), last + 1), "/"))

    deep_repo = (
        (F.length(T.compact(F.col("name"))) >= 3)
        & (F.size(segs) >= 2)
        & (docs_at >= 0)
        & (repo_at > docs_at)
    )
    repo_prefix = prefix(F.greatest(repo_at, F.lit(0)))
    docs_prefix = prefix(F.greatest(docs_at, F.lit(0)))
    first = F.get(segs, F.lit(0))
    versioned = first.rlike(r"^\d+(?:\.\d+)?$")
    major = F.get(F.split(first, r"\."), F.lit(0))
    at_first = F.concat(o, F.lit("/"), first)
    at_major = F.concat(o, F.lit("/"), major)
    root = F.regexp_replace(U.host(F.col("url")), r"^www\.", "")
    two_labels = U.host(F.col("url")).rlike(r"^(www\.)?[^.]+\.[^.]+$")
    docs_sub = F.concat(F.lit("https://docs."), root)
    doc_sub = F.concat(F.lit("https://doc."), root)

    def subdomain(base: Column) -> Column:
        fixed = ["/", "/llms.txt", "/llms-full.txt", "/docs/llms.txt", "/sitemap.xml"]
        return F.concat(
            F.array(*_under(base, fixed + rules.LOCALIZED_LANDING_PATHS)), _landing(base)
        )

    repo_host = F.regexp_replace(F.lower("name"), "[^a-z0-9-]", "")
    own = F.concat(F.lit("https://"), repo_host, F.lit(".dev"))
    home_names_repo = F.array_contains(
        F.transform(U.segments(U.path(F.col("homepage_url"))), T.compact), T.compact(F.col("name"))
    )
    return F.array_distinct(
        F.concat(
            F.array(
                F.col("url"),
                *_under(o, [*files, "/sitemap/sitemap-index.xml"]),
            ),
            _only_if(known, _landing(o)),
            _only_if(
                known | clean.startswith("/docs"),
                F.array(*_under(o, ["/docs/llms.txt", "/docs/sitemap.xml"])),
            ),
            _only_if(
                (clean != "") & ~clean.rlike(r"\.[A-Za-z0-9]+$"),
                F.array(*_under(F.concat(o, clean), [*files, "/contents.html"])),
            ),
            _only_if(deep_repo, F.array(*_under(repo_prefix, ["", *files, "/contents.html"]))),
            _only_if(docs_at >= 0, F.array(*_under(docs_prefix, ["", *files]))),
            _only_if(
                first.rlike(rules.FIRST_SEGMENT_INDEX),
                F.array(*_under(at_first, ["/llms.txt", "/sitemap.xml"])),
            ),
            _only_if(
                versioned,
                F.array(
                    *_under(at_first, ["/", "/contents.html"]),
                    *_under(
                        at_major,
                        [
                            "/",
                            "/contents.html",
                            "/library/index.html",
                            "/reference/index.html",
                            "/tutorial/index.html",
                        ],
                    ),
                ),
            ),
            _only_if(two_labels, F.concat(subdomain(docs_sub), subdomain(doc_sub))),
            _only_if(
                (F.length(repo_host) >= 3) & home_names_repo,
                F.concat(F.array(*_under(own, files)), _landing(own)),
            ),
        )
    )


def _candidate_score() -> Column:
    """Additive score of an index address, given the flags of it and of its seed (``from_*``)."""
    src, seed = F.col("source_url"), F.col("url")
    p, h = U.path(src), U.host(src)
    base = F.regexp_replace(F.lower(p), "/+$", "")
    bare = F.when(base == "", F.lit("/")).otherwise(base)

    def plus(cond: Column, weight: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(weight)).otherwise(F.lit(0))

    docs_host = h.startswith("docs.") | h.startswith("doc.")
    root_sitemap = bare == "/sitemap.xml"
    segs = U.segments(p)
    scoped = (
        (F.size(segs) >= 3)
        & (F.length(T.compact(F.col("name"))) >= 3)
        & (_position(segs, rules.DOCS_INDEX_ROOT) >= 0)
        & (_repo_position(segs) > _position(segs, rules.DOCS_INDEX_ROOT))
        & p.rlike(rules.INDEX_FILE_KIND)
    )
    repo = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    return (
        plus(F.regexp_replace(src, "/$", "") == F.regexp_replace(seed, "/$", ""), 220)
        + plus(T.compact(U.host(seed)).contains(repo), 50)
        + F.when(F.col("repo_specific"), 160).when(F.col("owner_specific"), 50).otherwise(0)
        + plus(F.col("from_homepage_related"), 80)
        + plus(F.col("from_repo_specific"), 80)
        + plus(F.col("from_topic_specific"), 35)
        + weighted(F.lower(U.path(seed)), rules.CANDIDATE_FROM_RULES)
        + weighted(p, rules.CANDIDATE_PATH_RULES)
        + plus(scoped, 180)
        + plus(p.endswith("/sitemap.xml") & ~p.endswith("/docs/sitemap.xml"), 35)
        + plus(root_sitemap & ~F.col("repo_specific") & F.col("from_repo_specific"), -90)
        + plus(docs_host & ((bare == "/llms.txt") | root_sitemap), 120)
        + plus(docs_host, 20)
        + plus(U.host(seed).endswith(".dev"), 10)
    ).cast("int")


def expand_candidates(urls: DataFrame, repos: DataFrame) -> DataFrame:
    """Likely index addresses per repository with their best score and the seed that gave it.

    ``urls`` has repo_id, pos and url (canonical); the first 40 distinct addresses of a repository
    count. Ties keep the earlier seed.
    """
    seeds = top_per_group(
        first_wins(urls, ["repo_id", "url"], "pos"), ["repo_id"], ["pos"], rules.MAX_URLS_PER_REPO
    )
    flagged = entity_mentions(seeds.select("repo_id", "pos", "url"), repos)
    p = U.path(F.col("url"))
    prepared = (
        flagged.withColumn("_origin", U.origin(F.col("url")))
        .withColumn("_clean", F.regexp_replace(p, "/+$", ""))
        .withColumn("_segs", U.segments(p))
        .withColumn("_docs_at", _position(F.col("_segs"), rules.DOCS_INDEX_ROOT))
        .withColumn("_repo_at", _repo_position(F.col("_segs")))
    )
    flags = ["repo_specific", "topic_specific", "homepage_related"]
    exploded = prepared.select(
        "repo_id",
        "pos",
        "url",
        "owner",
        "name",
        "homepage_url",
        "topics",
        *[F.col(f).alias(f"from_{f}") for f in flags],
        F.explode(_index_candidates()).alias("source_url"),
    )
    scored = entity_mentions(exploded, url="source_url").withColumn("score", _candidate_score())
    return scored.groupBy("repo_id", "source_url").agg(
        F.max("score").alias("score"),
        F.max_by("url", F.struct(F.col("score"), -F.col("pos"))).alias("discovered_from"),
    )


def is_primary_index(url: Column) -> Column:
    """Text and XML indexes are tried before pages."""
    return U.path(url).rlike(rules.PRIMARY_INDEX_FILE)


def limit_candidates(candidates: DataFrame) -> DataFrame:
    """Best 120 candidates of a repository, capped per origin, 100 in all."""
    order = [
        F.col("score").desc(),
        F.length(U.path(F.col("source_url"))),
        F.col("source_url"),
    ]
    best = top_per_group(candidates, ["repo_id"], order, rules.MAX_CANDIDATES)
    marked = best.withColumn("origin", U.origin(F.col("source_url")))
    broad = F.col("origin").rlike(r"//learn\.microsoft\.com$")
    return cap_per_group(
        marked,
        ["repo_id", "origin"],
        order,
        is_primary_index(F.col("source_url")),
        cap=F.when(broad, 8).otherwise(rules.MAX_PER_ORIGIN),
        primary_cap=F.when(broad, 5).otherwise(rules.MAX_PRIMARY_PER_ORIGIN),
        bound=rules.MAX_PER_ORIGIN,
        limit_keys=["repo_id"],
    )
