"""Queries of operators that others build on or that a caller uses beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.ids import micros
from docloom.operators import corpus, joins, matching, ordering, predicates, rollups
from docloom.plans import duck as D
from docloom.plans.catalog import register
from docloom.plans.corpus import _LABEL, _SEG
from docloom.plans.inputs import computed, cte, derive, table
from docloom.plans.repositories import _INDEX, _INDEX_SCORE, top_files_sql, tree

_OUTLINE, _REPOS, _DOC = cte("outline"), cte("repos"), cte("doc")
_NOW = "2024-02-01 00:00:00"


def _with(spark, sf, name: str, columns: str):
    return computed(derive(spark, sf, name), columns)


# -- pages ------------------------------------------------------------------------------------

_DRAFT = "repo_id, pos, CASE pos % 4 WHEN 0 THEN upper(slug) WHEN 1 THEN replace(slug, '-', ' ') || '!' WHEN 2 THEN '--' ELSE slug END AS page_slug"


@register(
    "publishable_pages",
    f"""{_OUTLINE}, d AS (SELECT {_DRAFT} FROM outline QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY pos) <= 40),
    n AS (SELECT repo_id, pos, {D.slug('page_slug')} AS page_slug FROM d)
    SELECT * FROM n WHERE page_slug <> '' QUALIFY row_number() OVER (PARTITION BY repo_id, page_slug ORDER BY pos) = 1""",
)
def publishable_pages(spark, sf):
    return ordering.publishable_pages(_with(spark, sf, "outline", _DRAFT), 40)


@register(
    "generated_pages",
    f"""{_OUTLINE}, d AS (SELECT repo_id, {D.slug('page_slug')} AS k FROM (SELECT {_DRAFT} FROM outline) WHERE pos % 3 = 1)
    SELECT repo_id, pos, slug FROM outline o WHERE EXISTS (SELECT 1 FROM d WHERE d.repo_id = o.repo_id AND d.k = {D.slug('o.slug')})""",
)
def generated_pages(spark, sf):
    drafts = _with(spark, sf, "outline", _DRAFT).where("pos % 3 = 1")
    return joins.generated_pages(derive(spark, sf, "outline").select("repo_id", "pos", "slug"), drafts)


# -- repositories -----------------------------------------------------------------------------

_STORED = """repo_id, full_name, owner, 'main' AS default_branch, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 'about ' || name END AS description,
  'https://a/' || owner || '.png' AS owner_avatar_url, CASE WHEN c_acctbal > 0 THEN c_custkey * 3 END AS stars, c_custkey, is_featured"""
_META = """repo_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'trunk' END AS default_branch, 'now ' || name AS description,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'https://b/' || owner END AS owner_avatar_url, c_custkey AS stars"""


@register(
    "update_metadata",
    f"""{_REPOS}, s AS (SELECT {_STORED} FROM repos), m AS (SELECT {_META} FROM repos WHERE c_custkey % 3 = 0)
    SELECT s.repo_id, CASE WHEN m.repo_id IS NULL THEN s.default_branch ELSE m.default_branch END AS default_branch,
      CASE WHEN m.repo_id IS NULL THEN s.description ELSE m.description END AS description,
      CASE WHEN m.repo_id IS NULL THEN s.owner_avatar_url ELSE m.owner_avatar_url END AS owner_avatar_url,
      CASE WHEN m.repo_id IS NULL THEN s.stars ELSE m.stars END AS stars,
      CASE WHEN m.repo_id IS NULL THEN NULL ELSE epoch_us(TIMESTAMP '{_NOW}') END AS refreshed_us
    FROM s LEFT JOIN m ON m.repo_id = s.repo_id""",
)
def update_metadata(spark, sf):
    """Fresh metadata of every third repository over all that are stored."""
    repos = _with(spark, sf, "repos", _STORED).withColumn("metadata_refreshed_at", F.lit(None).cast("timestamp"))
    fresh = _with(spark, sf, "repos", f"{_META}, c_custkey").where("c_custkey % 3 = 0").drop("c_custkey")
    done = joins.update_metadata(repos, fresh, F.lit(_NOW).cast("timestamp"))
    return done.select(
        "repo_id", "default_branch", "description", "owner_avatar_url", "stars", micros(F.col("metadata_refreshed_at")).alias("refreshed_us")
    )


_SEED = "full_name, 'seed ' || name AS description, 'https://seed/' || full_name AS repo_url, CAST(NULL AS STRING) AS icon, CAST(NULL AS BIGINT) AS stars, '1k' AS star_label"


@register(
    "featured_cards",
    f"""{_REPOS}, k AS (SELECT {_STORED} FROM repos WHERE c_custkey % 2 = 0), s AS (SELECT {_SEED}, owner FROM repos WHERE is_featured)
    SELECT s.full_name, coalesce(k.description, s.description) AS description, coalesce('https://stored/' || k.full_name, s.repo_url) AS repo_url,
      coalesce(k.owner_avatar_url, 'https://github.com/' || s.owner || '.png?size=40') AS icon, k.stars, CASE WHEN k.stars IS NULL THEN '1k' END AS star_label
    FROM s LEFT JOIN k ON k.full_name = s.full_name""",
)
def featured_cards(spark, sf):
    """All featured repositories, half of them with stored metadata."""
    stored = _with(spark, sf, "repos", _STORED).where("c_custkey % 2 = 0").withColumn("repo_url", F.concat(F.lit("https://stored/"), "full_name"))
    seed = _with(spark, sf, "repos", f"{_SEED}, is_featured").where("is_featured").drop("is_featured")
    return joins.featured_cards(seed, stored).select("full_name", "description", "repo_url", "icon", "stars", "star_label")


_TARGET = """full_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_checked_at, c_custkey * 1000 AS enqueued_at_us,
  'c' || CAST(c_custkey AS STRING) AS latest_commit, 'old' AS attempted_commit, 'v1' AS attempted_version, c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'active' WHEN 2 THEN 'current' WHEN 3 THEN 'cooldown' END AS status"""


@register(
    "refresh_records",
    f"""{_REPOS}, t AS (SELECT {_TARGET} FROM repos), n AS (SELECT *, coalesce(status IN ('queued', 'active'), false) AS sent FROM t)
    SELECT full_name, epoch_us(CASE WHEN status IS NOT NULL THEN TIMESTAMP '{_NOW}' ELSE last_checked_at END) AS checked_us,
      CASE WHEN sent THEN epoch_us(TIMESTAMP '{_NOW}') ELSE enqueued_at_us END AS enqueued_at_us,
      CASE WHEN sent THEN latest_commit ELSE attempted_commit END AS attempted_commit, CASE WHEN sent THEN 'v2' ELSE attempted_version END AS attempted_version
    FROM n""",
)
def refresh_records(spark, sf):
    """What a refresh run writes back to every repository, seen by it or not."""
    targets = _with(spark, sf, "repos", _TARGET)
    outcomes = targets.where("status IS NOT NULL").select("full_name", "status")
    done = ordering.refresh_records(outcomes, targets.drop("status"), F.lit(_NOW).cast("timestamp"), "v2")
    return done.withColumn("checked_us", micros(F.col("last_checked_at"))).drop("last_checked_at")


# -- index choice -----------------------------------------------------------------------------


@register(
    "accepted_indexes",
    f"""{_DOC}, i AS (SELECT {_INDEX}, pos % 2 = 0 AS adjacent FROM doc)
    SELECT repo_id, pos, source_url, link_count, heading_count FROM i WHERE link_count >= 10 AND (heading_count >= 2
      OR {D.hit(D.path('source_url'), '(?i)/llms(?:-full)?[.]txt$')} AND (link_count >= 60 OR link_count >= 30 AND adjacent))""",
)
def accepted_indexes(spark, sf):
    bodies = _with(spark, sf, "doc", f"{_INDEX}, pos % 2 = 0 AS adjacent")
    return rollups.accepted_indexes(bodies).select("repo_id", "pos", "source_url", "link_count", "heading_count")


_TREE_INDEX = "repo_id, 'https://' || CASE WHEN doc_id % 3 = 0 THEN 'gitlab' ELSE 'github' END || '.com/' || repo_id AS source_url, CAST(n_chars % 61 AS INT) AS link_count, CAST(n_chars % 67 AS INT) AS heading_count, pos"


@register(
    "prefer_fallback",
    f"""{_DOC}, i AS (SELECT {_INDEX} FROM doc WHERE pos BETWEEN 4 AND 10), s AS (SELECT *, {_INDEX_SCORE} AS index_score FROM i),
    b AS (SELECT *, link_count >= 220 OR (source_url LIKE '%llms%.txt' AND link_count >= 120) OR (source_url LIKE '%sitemap%.xml' AND link_count >= 40)
      OR (link_count >= 20 AND heading_count >= 20) AS is_strong FROM s QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY index_score DESC, pos) = 1),
    f AS (SELECT {_TREE_INDEX} FROM doc WHERE pos = 8 OR pos = 3 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY pos DESC) = 1),
    j AS (SELECT coalesce(b.repo_id, f.repo_id) AS repo_id, b.source_url AS bu, b.link_count AS bl, b.heading_count AS bh, f.source_url AS fu,
      f.link_count AS fl, f.heading_count AS fh, b.source_url IS NULL OR NOT b.is_strong AND coalesce(f.source_url LIKE 'https://github.com/%'
        AND (b.link_count < 20 AND b.heading_count < 20 AND f.link_count >= greatest(12, b.link_count + 4)
          OR (f.link_count >= 20 OR f.heading_count >= 20) AND (f.link_count >= b.link_count * 2 OR f.heading_count >= b.heading_count * 2 AND f.link_count > b.link_count)), false) AS use_tree
      FROM b FULL JOIN f ON b.repo_id = f.repo_id)
    SELECT repo_id, CASE WHEN use_tree THEN fu ELSE bu END AS source_url, CASE WHEN use_tree THEN fl ELSE bl END AS link_count,
      CASE WHEN use_tree THEN fh ELSE bh END AS heading_count FROM j""",
)
def prefer_fallback(spark, sf):
    """The best discovered index of each repository against the tree of its own documents."""
    best = rollups.best_index(_with(spark, sf, "doc", _INDEX).where("pos BETWEEN 4 AND 10"))
    trees = _with(spark, sf, "doc", _TREE_INDEX).where("pos = 8 OR pos = 3")
    tree = ordering.top_per_group(trees, ["repo_id"], [F.col("pos").desc()], 1)
    return rollups.prefer_fallback(best, tree).select("repo_id", "source_url", "link_count", "heading_count")


@register(
    "topic_scope",
    f"""WITH p AS (SELECT page_id, url, {D.compact(D.path('url'))} AS c FROM pages),
    m AS (SELECT *, contains(c, 'en') OR contains(c, '7') AS hit FROM p), n AS (SELECT count(*) AS n, count(*) FILTER (hit) AS k FROM m)
    SELECT page_id, url FROM m, n WHERE hit OR n < 200 OR k < 30""",
)
def topic_scope(spark, sf):
    """One broad index of all pages, cut to those that mention a keyword."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.lit("r").alias("repo_id"))
    words = pages.select("repo_id").distinct().select("repo_id", F.posexplode(F.array(F.lit("en"), F.lit("7"))).alias("rank", "keyword"))
    keywords = rollups.keyword_lists(words)
    return predicates.topic_scope(pages, keywords).select("page_id", "url")


# -- bodies -----------------------------------------------------------------------------------

_BODY = "repo_id, pos, 'https://docs.acme.dev/' || CAST(doc_id AS STRING) AS url, 1 AS rank, 'T' || CAST(pos AS STRING) AS title, CASE WHEN pos % 2 = 0 THEN lang END AS `group`, text"


@register(
    "attach_text",
    f"""{_DOC}, b AS (SELECT {_BODY.replace('`group`', '"group"')} FROM doc)
    SELECT repo_id, pos, rank, 'official-docs:' || url AS path, md5(t) AS text_md5 FROM (SELECT *, 'Official docs page: ' || title || chr(10)
      || CASE WHEN "group" IS NULL THEN '' ELSE 'Section: ' || "group" || chr(10) END || 'URL: ' || url || chr(10) || chr(10) || trim(left(text, 5000)) AS t FROM b)
    WHERE length(trim(t)) >= 200""",
)
def attach_text(spark, sf):
    texts = _with(spark, sf, "doc", _BODY)
    found = matching.attach_text(texts.select("repo_id", "pos", "rank", "url"), texts.select("repo_id", "url", "title", "group", "text"))
    return found.withColumn("text_md5", F.md5("text")).drop("text")


@register(
    "context_texts",
    f"""{_DOC} SELECT repo_id, CAST(doc_id AS STRING) AS path, md5(left(text, 3000)) AS text_md5 FROM doc WHERE pos < 40""",
)
def context_texts(spark, sf):
    files = computed(derive(spark, sf, "doc"), "repo_id, pos, CAST(doc_id AS STRING) AS path, text")
    chosen = files.where("pos < 40").select("repo_id", "path")
    return matching.context_texts(chosen, files, 3000).select("repo_id", "path", F.md5("text").alias("text_md5"))


# -- files and entries ------------------------------------------------------------------------


@register(
    "sandbox_files",
    f"""{cte('tree')}, r AS ({top_files_sql('chat_sandbox', 36)}),
    s AS (SELECT repo_id, path, 0 AS src, pos AS nth FROM tree WHERE pos % 7 = 3 UNION ALL SELECT repo_id, path, 1, rank FROM r),
    u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY src, nth) = 1)
    SELECT repo_id, path, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY src, nth) AS INT) AS rank FROM u
    QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY src, nth) <= 36""",
)
def sandbox_files(spark, sf):
    """The context of a chat, a seventh of the files here, and the best files after it."""
    files = tree(spark, sf)
    context = files.where("pos % 7 = 3").select("repo_id", "path", F.col("pos").alias("rank"))
    return ordering.sandbox_files(files, context)


_COVERED = _LABEL.format(x="p", a=D.strings(rules.NAV_ACRONYMS))


@register(
    "scoped_groups",
    f"""{cte('entries')}, p AS (SELECT *, {_SEG} AS p FROM entries),
    l AS (SELECT repo_id, pos, title, url, coalesce("group", CASE WHEN p IS NOT NULL THEN {_COVERED} END, 'Documentation') AS label FROM p)
    SELECT repo_id, pos, title, url, label AS "group" FROM l QUALIFY row_number() OVER (PARTITION BY repo_id, label ORDER BY pos) <= 3""",
)
def scoped_groups(spark, sf):
    entries = derive(spark, sf, "entries").select("repo_id", "source_url", "pos", "group", "title", "url")
    return corpus.scoped_groups(entries, 3).select("repo_id", "pos", "title", "url", "group")
