"""Queries of the file, entry, outline, draft and navigation operators over derived repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import rules
from docloom.operators import corpus, joins, navtree, ordering, predicates, rollups
from docloom.plans import duck as D
from docloom.plans.catalog import register
from docloom.plans.inputs import TITLES, computed, cte, derive, pick
from docloom.sources.corpus import build_inventory
from docloom.sources.drafts import parse_drafts

_TREE = cte("tree")
_ENTRIES = cte("entries")
_OUTLINE = cte("outline")
_BASE = "lower(regexp_extract(path, '([^/]*)$', 1))"
_EXT = "lower(regexp_extract(path, '([^.]*)$', 1))"
_USEFUL = f"(NOT {D.hit('path', rules.UNUSED_PATH)} AND ({_BASE} IN {D.strings(rules.NAMED_SOURCE_FILES)} OR {D.hit('path', rules.SOURCE_EXTENSION)}))"
_LANGUAGE = (
    f"CASE WHEN {_BASE} = 'readme' THEN 'markdown' "
    + " ".join(f"WHEN {_EXT} = '{e}' THEN '{lang}'" for e, lang in rules.LANGUAGE_BY_EXTENSION.items())
    + " ELSE 'text' END"
)
_PLANNING = D.any_hit(
    "lower(path)", [rules.PLANNING_README, rules.PLANNING_DIRECTORY, rules.PLANNING_FILE]
)


def tree(spark, sf):
    return derive(spark, sf, "tree").select("repo_id", "pos", "path", "size", "doc_id")


def files(spark, sf):
    """Every derived path with its language, in listing order."""
    return predicates.with_language(tree(spark, sf))


_FILES = _TREE + f", files AS (SELECT repo_id, pos, path, size, doc_id, {_LANGUAGE} AS language FROM tree)"


# -- files ------------------------------------------------------------------------------------


@register(
    "build_inventory",
    f"""{_TREE}, u AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS n FROM tree WHERE {_USEFUL})
    SELECT repo_id, pos, path, size, CASE WHEN n > 20 THEN 'file_limit_exceeded' WHEN size > 512000 THEN 'file_too_large' END AS reason,
      CASE WHEN n <= 20 AND size <= 512000 THEN {_LANGUAGE} END AS language FROM u""",
)
def build_inventory_query(spark, sf):
    kept, skipped = build_inventory(tree(spark, sf).drop("doc_id"), max_files=20)
    none = F.lit(None).cast("string")
    return kept.withColumn("reason", none).unionByName(skipped.withColumn("language", none))


@register("with_language", f"{_FILES} SELECT doc_id, path, language FROM files")
def with_language(spark, sf):
    return files(spark, sf).select("doc_id", "path", "language")


@register("useful_paths", f"{_TREE} SELECT doc_id, path FROM tree WHERE {_USEFUL}")
def useful_paths(spark, sf):
    return predicates.useful_paths(tree(spark, sf)).select("doc_id", "path")


_ODD = pick("pos", ["/", "./", "\\", "a/../", "", "//x/"])


@register(
    "normalize_paths",
    f"""{_TREE}, o AS (SELECT doc_id, {_ODD} || path AS path FROM tree),
    c AS (SELECT doc_id, path, regexp_replace(replace(path, '\\', '/'), '^/+', '') AS clean FROM o)
    SELECT doc_id, CASE WHEN bad THEN path ELSE clean END AS path, bad AS invalid FROM
      (SELECT *, clean = '' OR list_contains(string_split(clean, '/'), '..') OR list_contains(string_split(clean, '/'), '.') AS bad FROM c)""",
)
def normalize_paths(spark, sf):
    odd = _ODD.replace("\\", "\\\\")
    raw = tree(spark, sf).selectExpr("doc_id", f"{odd} || path AS path")
    ok, bad = predicates.normalize_paths(raw)
    return ok.withColumn("invalid", F.lit(False)).unionByName(bad.withColumn("invalid", F.lit(True)))


_REPO_URL = pick(
    "doc_id",
    [
        "https://github.com/acme/kit-",
        "HTTPS://GitHub.com/Ac me/",
        "https://github.com/acme/",
        "http://github.com/acme/kit",
        "https://gitlab.com/acme/kit",
    ],
)
_REPO_TAIL = pick("doc_id", ["x.git", "y", "kit.js/", "z", "z"])


@register(
    "parse_repo_urls",
    f"""WITH u AS (SELECT doc_id, {_REPO_URL} || CAST(doc_id AS STRING) || {_REPO_TAIL} AS url FROM documents),
    p AS (SELECT *, regexp_extract(url, {D.q(rules.REPO_URL)}, 1) AS o, regexp_extract(url, {D.q(rules.REPO_URL)}, 2) AS n FROM u)
    SELECT doc_id, url, CASE WHEN ok THEN o END AS owner, CASE WHEN ok THEN n END AS name, CASE WHEN ok THEN o || '/' || n END AS full_name,
      CASE WHEN ok THEN 'https://github.com/' || o || '/' || n END AS repo_url
    FROM (SELECT *, o <> '' AND regexp_full_match(o, '[A-Za-z0-9_.-]+') AND regexp_full_match(n, '[A-Za-z0-9_.-]+') AS ok FROM p)""",
)
def parse_repo_urls(spark, sf):
    urls = derive(spark, sf, "documents").selectExpr(
        "doc_id", f"{_REPO_URL} || CAST(doc_id AS STRING) || {_REPO_TAIL} AS url"
    )
    return predicates.parse_repo_urls(urls)


@register("exclude_internal_planning", f"{_TREE} SELECT doc_id, path FROM tree WHERE NOT {_PLANNING}")
def exclude_internal_planning(spark, sf):
    return predicates.exclude_internal_planning(tree(spark, sf)).select("doc_id", "path")


def docs_source_sql(variant: str) -> str:
    p = "lower(path)"
    hit = f"NOT {_PLANNING} AND {D.any_hit(p, rules.DOCS_SOURCE_PATTERNS[variant])}"
    if variant == "fallback":
        hit += (
            f" AND {D.hit(p, rules.MARKDOWN_FILE)} AND NOT {D.any_hit(p, rules.UNUSABLE_MARKDOWN)}"
            f" AND NOT ({D.hit(p, rules.TRANSLATION_ROOT)} AND NOT starts_with({p}, 'translations/en/'))"
        )
    return f"({hit})"


@register(
    "flag_docs_sources",
    f"{_TREE} SELECT doc_id, path, "
    + ", ".join(f"{docs_source_sql(v)} AS is_docs_{v}" for v in rules.DOCS_SOURCE_PATTERNS)
    + " FROM tree",
)
def flag_docs_sources(spark, sf):
    df = tree(spark, sf).select("doc_id", "path")
    for variant in rules.DOCS_SOURCE_PATTERNS:
        df = predicates.flag_docs_sources(df, variant)
    return df


def score_sql(name: str, x: str = "lower(path)") -> str:
    rs = rules.RULE_SETS[name]
    s = D.weights(x, rs.rules)
    if rs.first_of:
        s += " + " + D.first(x, rs.first_of, rs.otherwise)
    if rs.per_slash:
        s += f" + {rs.per_slash} * (length({x}) - length(replace({x}, '/', '')))"
    if rs.penalty:
        s += f" - least({rs.penalty[1]}, len(string_split({x}, '/')) * {rs.penalty[0]})"
    if rs.floor is not None:
        s = f"greatest({rs.floor}, {s})"
    if rs.fixed:
        s = "CASE " + " ".join(f"WHEN {D.hit(x, p)} THEN {v}" for p, v in rs.fixed) + f" ELSE {s} END"
    return f"CAST({s} AS INT)"


_PATH_SETS = [n for n in rules.RULE_SETS if n != "html_expansion"]


@register(
    "score_by_rules",
    f"{_TREE} SELECT doc_id, path, " + ", ".join(f"{score_sql(n)} AS {n}" for n in _PATH_SETS) + " FROM tree",
)
def score_by_rules(spark, sf):
    df = tree(spark, sf).select("doc_id", "path")
    for name in _PATH_SETS:
        df = predicates.score_by_rules(df, "path", name, name)
    return df


def top_files_sql(name: str, limit: int = 12) -> str:
    rs = rules.RULE_SETS[name]
    where = ["true"]
    if rs.any_of:
        where.append(D.any_hit("lower(path)", rs.any_of))
    if name in ("context", "inventory", "docs_sources", "docs_tree"):
        where.append(f"NOT {_PLANNING}")
    if name == "source_map":
        where.append(f"NOT {D.hit('lower(path)', rules.SOURCE_MAP_UNUSED)}")
        where.append(D.any_hit("lower(path)", rules.SOURCE_MAP_KEPT))
    if rs.max_bytes:
        where.append(f"size <= {rs.max_bytes}")
    direction = "DESC" if rs.descending else "ASC"
    ties = "pos" if name.startswith("chat") or name == "context" else "path, pos"
    extra = " AND score > 0" if rs.floor is not None else ""
    return f"""SELECT '{name}' AS rules, repo_id, path, score, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY score {direction}, {ties}) AS INT) AS rank
      FROM (SELECT *, {score_sql(name)} AS score FROM tree WHERE {' AND '.join(where)}) WHERE true{extra}
      QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score {direction}, {ties}) <= {min(rs.limit, limit)}"""


_TOP_SETS = [n for n in _PATH_SETS if n != "docs_tree"]


@register("top_files", f"{_TREE} " + " UNION ALL ".join(f"({top_files_sql(n)})" for n in _TOP_SETS))
def top_files(spark, sf):
    listing = tree(spark, sf)
    parts = [
        ordering.top_files(listing, name, min(rules.RULE_SETS[name].limit, 12)).select(
            F.lit(name).alias("rules"), "repo_id", "path", "score", "rank"
        )
        for name in _TOP_SETS
    ]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df


_GROUP = """CASE WHEN len(s) = 1 THEN 'root files' WHEN s[1] IN ('packages', 'apps', 'services', 'crates') THEN s[1] || '/' || s[2]
  WHEN s[1] = 'turbopack' AND s[2] = 'crates' AND s[3] IS NOT NULL THEN s[1] || '/' || s[2] || '/' || s[3] ELSE s[1] END"""


@register(
    "inventory_map",
    f"""{_FILES}, g AS (SELECT repo_id, pos, path, size, language, {_GROUP} AS "group" FROM (SELECT *, string_split(path, '/') AS s FROM files)),
    l AS (SELECT repo_id, "group", language, count(*) AS n, min(pos) AS p FROM g GROUP BY ALL),
    ls AS (SELECT repo_id, "group", array_to_string(list(language || ':' || CAST(n AS STRING) ORDER BY n DESC, p)[:4], ', ') AS languages FROM l GROUP BY ALL),
    ex AS (SELECT repo_id, "group", array_to_string(list(path ORDER BY pos)[:5], ', ') AS examples FROM g WHERE {D.hit('lower(path)', rules.REPRESENTATIVE_FILE)} GROUP BY ALL),
    t AS (SELECT repo_id, "group", count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(pos) AS p FROM g GROUP BY ALL)
    SELECT repo_id, "group", files, bytes, languages, coalesce(examples, '') AS examples FROM t JOIN ls USING (repo_id, "group") LEFT JOIN ex USING (repo_id, "group")
    QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY {D.first('"group"', rules.MAP_GROUP_PRIORITY, 0)} DESC, files DESC, p) <= 30""",
)
def inventory_map(spark, sf):
    return rollups.inventory_map(files(spark, sf))


_NATURAL = (
    "array_to_string(list_transform(regexp_extract_all(lower({x}), '\\d+|\\D+'),"
    " lambda s: CASE WHEN regexp_matches(s, '^\\d') THEN lpad(s, 12, '0') ELSE s END), '')"
)
_NAT_PATH, _NAT_GROUP = _NATURAL.format(x="path"), _NATURAL.format(x='"group"')
_ROOT_END = """CASE WHEN low[1] IN ('docs', 'documentation') THEN 1 WHEN low[1] || '/' || low[2] IN ('content/docs', 'site/docs', 'website/docs') THEN 2
  WHEN d IS NULL THEN NULL WHEN low[d + 1] = 'content' AND low[d + 2] = 'docs' THEN d + 2 WHEN low[d + 1] IN ('content', 'pages', 'src', 'app') THEN d + 1 ELSE d END"""


@register(
    "docs_groups",
    f"""{_TREE}, b AS (SELECT repo_id, path, pos, row_number() OVER (PARTITION BY repo_id ORDER BY {score_sql('docs_tree')} DESC, {_NAT_PATH}, path, pos) AS rank
      FROM tree WHERE {docs_source_sql('prompt')} QUALIFY rank <= 140),
    s AS (SELECT *, list_filter(string_split(path, '/'), lambda v: v <> '') AS parts, list_transform(list_filter(string_split(path, '/'), lambda v: v <> ''), lambda v: lower(v)) AS low FROM b),
    e AS (SELECT *, {_ROOT_END} AS e FROM (SELECT *, least(nullif(list_position(low, 'docs'), 0), nullif(list_position(low, 'documentation'), 0)) AS d FROM s)),
    g AS (SELECT repo_id, path, rank, CASE WHEN e IS NULL THEN 'root documentation' WHEN len(parts) = e THEN array_to_string(parts[:e], '/')
        ELSE array_to_string(parts[:e], '/') || '/' || regexp_replace(array_to_string(list_transform(parts[e + 1:e + 2], lambda v: regexp_replace(v, '^\\d+[-_.]', '')), '/'), {D.q(rules.DOCS_TREE_EXTENSION)}, '') END AS "group" FROM e)
    SELECT repo_id, "group", count(*) AS paths, array_to_string(list(path ORDER BY rank)[:8], ', ') AS examples FROM g GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY {_NAT_GROUP}, "group") <= 32""",
)
def docs_groups(spark, sf):
    return rollups.docs_groups(tree(spark, sf))


_EVIDENCE_SQL = f"evidence AS (SELECT repo_id, count(*) AS file_count, count(*) FILTER ({docs_source_sql('count')}) AS docs_count, count(*) * 3 AS link_count FROM tree GROUP BY 1)"


def evidence(spark, sf):
    """Files, documentation files and (three times the files) documentation links per repository."""
    counts = rollups.docs_source_counts(tree(spark, sf))
    return counts.withColumn("link_count", F.col("file_count") * 3)


@register("docs_source_counts", f"{_TREE}, {_EVIDENCE_SQL} SELECT repo_id, file_count, docs_count FROM evidence")
def docs_source_counts(spark, sf):
    return rollups.docs_source_counts(tree(spark, sf))


def _budget(top: str, links, docs, base) -> str:
    by = f"coalesce({D.ladder('link_count', links)}, {D.ladder('docs_count', docs)}, 0)"
    return f"least({top}, greatest({D.ladder('file_count', base)}, {by}))"


_MAX_PAGES = _budget("52", rules.MAX_PAGES_BY_LINKS, rules.MAX_PAGES_BY_DOCS, rules.MAX_PAGE_BASELINE)
_MIN_PAGES = _budget(_MAX_PAGES, rules.MIN_PAGES_BY_LINKS, rules.MIN_PAGES_BY_DOCS, rules.MIN_PAGE_BASELINE)
_WORDS = _budget("99999", rules.WORDS_BY_LINKS, rules.WORDS_BY_DOCS, rules.WORD_BASELINE)


@register(
    "page_budget",
    f"""WITH e AS (SELECT source AS repo_id, lang, count(*) * 7 AS file_count, count(*) FILTER (n_chars > 900) AS docs_count,
        nullif(count(*) FILTER (n_chars > 4000), 1) AS links FROM documents GROUP BY 1, 2),
    evidence AS (SELECT *, coalesce(links, 0) AS link_count FROM e)
    SELECT repo_id, lang, CAST({_MAX_PAGES} AS INT) AS max_pages, CAST({_MIN_PAGES} AS INT) AS min_pages, CAST({_WORDS} AS INT) AS min_words FROM evidence""",
)
def page_budget(spark, sf):
    e = derive(spark, sf, "documents").groupBy(F.col("source").alias("repo_id"), "lang").agg(
        (F.count(F.lit(1)) * 7).alias("file_count"),
        F.count_if(F.col("n_chars") > 900).alias("docs_count"),
        F.nullif(F.count_if(F.col("n_chars") > 4000), F.lit(1)).alias("link_count"),
    )
    budget = predicates.page_budget(e)
    return budget.select("repo_id", "lang", "max_pages", "min_pages", "min_words")


@register(
    "path_keywords",
    f"""{_TREE}, s AS (SELECT repo_id, regexp_replace(lower(string_split(path, '/')[1]), '[^a-z0-9]', '', 'g') AS k FROM tree),
    c AS (SELECT repo_id, k, 1 AS w FROM s WHERE length(k) >= 4 AND k NOT IN {D.strings(rules.STOP_PATH_SEGMENTS)}),
    a AS (SELECT * FROM c UNION ALL SELECT repo_id, k[:-3], 1 FROM c WHERE k LIKE '%er' AND length(k) > 5
      UNION ALL SELECT DISTINCT repo_id, unnest(['router', 'engine', 'streaming']), 4 FROM tree)
    SELECT repo_id, k AS keyword, CAST(sum(w) AS BIGINT) AS weight, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY sum(w) DESC, k) AS INT) AS rank FROM a GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY sum(w) DESC, k) <= 16""",
)
def path_keywords(spark, sf):
    listing = tree(spark, sf)
    described = listing.select("repo_id").distinct().withColumn(
        "description", F.lit("The router engine for streaming web apps, a Router")
    )
    return rollups.path_keywords(listing, described)


@register(
    "exclude_known",
    f"{_TREE} SELECT doc_id, path FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree k WHERE k.repo_id = t.repo_id AND lower(k.path) = lower(t.path) AND {docs_source_sql('prompt').replace('path', 'k.path')})",
)
def exclude_known(spark, sf):
    listing = tree(spark, sf)
    known = listing.filter(predicates.is_docs_source(F.col("path"))).select(
        "repo_id", F.upper("path").alias("path")
    )
    return joins.exclude_known(listing, known).select("doc_id", "path")


# -- entries ----------------------------------------------------------------------------------


def entries(spark, sf):
    return derive(spark, sf, "entries")


_PLAIN = "regexp_replace(regexp_replace(lower(trim({x})), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')"
_CHROME = [rules.CONTENTS_TITLE, rules.READ_NEXT_TITLE, rules.PAGE_CHROME_TITLE]
_ODD_TITLE = pick(
    "pos * 7 + 3",
    ["On this page", "TODO", "Edit", "Routing", "  ", "Next Steps", "npm install", "License", "const a = 1", "Getting Started"],
)


@register(
    "drop_noise_titles",
    f"""{cte('doc')}, t AS (SELECT doc_id, {_ODD_TITLE} AS title FROM doc)
    SELECT doc_id, title FROM t WHERE trim(title) <> '' AND NOT {D.hit('trim(title)', rules.PLACEHOLDER_WORD)}
      AND NOT {D.any_hit(_PLAIN.format(x='title'), [rules.ENTRY_CHROME_TITLE, *_CHROME])}""",
)
def drop_noise_titles(spark, sf):
    titles = derive(spark, sf, "doc").selectExpr("doc_id", f"{_ODD_TITLE} AS title")
    return predicates.drop_noise_titles(titles)


_CODE_LIKE = [rules.COMMAND_HEADING, rules.CODE_HEADING, rules.SYNTAX_HEADING, rules.LEGAL_HEADING]


@register(
    "keep_headings",
    f"""{cte('doc')}, t AS (SELECT doc_id, {_ODD_TITLE} AS title, CAST(pos % 3 + 1 AS INT) AS level, 'Routing' AS file_title FROM doc)
    SELECT doc_id, title, level FROM t WHERE length(title) BETWEEN 3 AND 90 AND NOT (level = 1 AND lower(title) IN ('routing', 'readme'))
      AND NOT {D.any_hit(_PLAIN.format(x='title'), _CHROME)} AND NOT {D.any_hit('title', _CODE_LIKE)}""",
)
def keep_headings(spark, sf):
    heads = derive(spark, sf, "doc").selectExpr(
        "doc_id", f"{_ODD_TITLE} AS title", "CAST(pos % 3 + 1 AS INT) AS level", "'Routing' AS file_title"
    )
    return predicates.keep_headings(heads).drop("file_title")


@register(
    "first_party_entries",
    f"""{_ENTRIES}, m AS (SELECT *, {D.registrable(D.host('url'))} = 'acme.dev' AND NOT {D.any_hit(_PLAIN.format(x='title'), [rules.ENTRY_CHROME_TITLE, *_CHROME])} AS ok FROM entries),
    c AS (SELECT repo_id, count(*) AS n, count(*) FILTER (ok) AS k FROM m GROUP BY 1)
    SELECT repo_id, pos, url FROM m JOIN c USING (repo_id) WHERE NOT (n >= 20 AND k >= least(20, floor(n * 0.5))) OR ok""",
)
def first_party_entries(spark, sf):
    return predicates.first_party_entries(entries(spark, sf)).select("repo_id", "pos", "url")


_ENTRY_TEXT = "coalesce(\"group\", '') || ' ' || title || ' ' || url"
GENERIC_SQL = D.hit(f"replace({D.slug('title')}, '-', ' ')", rules.GENERIC_TITLE)
_LOW = pick("pos", [None, "torch.nn.Linear", "a.b.c()", "numpy.array", None, "auto generated API"])


@register(
    "classify_entries",
    f"""{_ENTRIES}, e AS (SELECT repo_id, pos, "group", coalesce({_LOW}, title) AS title, url FROM entries)
    SELECT repo_id, pos, {GENERIC_SQL} AS is_generic,
      {D.hit('url', rules.GENERATED_ENTRY_URL)} OR {D.hit(_ENTRY_TEXT, rules.GENERATED_ENTRY_TEXT)} AS is_generated,
      {D.hit('trim(title)', rules.LOW_LEVEL_TITLE)} AS is_low_level,
      {D.slug('title')} <> '' AND len(string_split({D.slug('title')}, '-')) >= 5 AND NOT {D.hit(D.slug('title'), rules.WIDE_TITLE_WORDS)} AS is_narrow_member FROM e""",
)
def classify_entries(spark, sf):
    changed = entries(spark, sf).withColumn("title", F.expr(f"coalesce({_LOW}, title)"))
    flags = predicates.classify_entries(changed)
    return flags.select("repo_id", "pos", "is_generic", "is_generated", "is_low_level", "is_narrow_member")


# -- outlines ---------------------------------------------------------------------------------


def outline(spark, sf):
    df = derive(spark, sf, "outline")
    return df.withColumn(
        "source_paths",
        F.when(F.col("pos") % 4 == 0, F.array().cast("array<string>"))
        .when(F.col("pos") % 4 == 1, F.array("source_path"))
        .otherwise(F.array("source_path", F.lit("docs/plans/x.md"), F.lit("src/none.ts"))),
    )


_SOURCES_N = "CASE pos % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END"
_PT = "lower(slug || ' ' || title || ' ' || purpose)"
_BROAD = f"(lower(slug) = 'overview' OR lower(slug) LIKE '%-overview' OR {D.hit(_PT, rules.BROAD_TEXT)})"
_GUIDE = D.hit("title || ' ' || slug || ' ' || purpose", rules.GUIDE_TEXT)
_REFERENCE = f"({D.hit(chr(116) + 'itle || chr(32) || slug', rules.REFERENCE_TEXT)} OR ({D.hit('purpose', rules.REFERENCE_TEXT)} AND NOT {_GUIDE}))"
_BREADTH = f"CASE WHEN {D.any_hit('lower(slug)', rules.NARROW_SLUGS)} OR {D.hit(_PT, rules.NARROW_TEXT)} THEN 'narrow' WHEN {_BROAD} THEN 'broad' WHEN starts_with(lower(slug), 'guides-') OR {_SOURCES_N} <= 2 THEN 'narrow' ELSE 'normal' END"
CLASSES_SQL = f"""{D.slug('slug')} = 'overview' AS is_overview, {_REFERENCE} AS is_reference, {_GUIDE} AS is_guide, {_BREADTH} AS breadth,
  {_SOURCES_N} <= 2 AND NOT {_BROAD} AS is_tiny_leaf, NOT {_BROAD} AND {D.hit(_PT, rules.PRIMITIVE_TEXT)} AS is_primitive,
  {D.hit(_PT, rules.JOURNEY_TEXT)} AS is_journey, {D.hit('lower(slug)', rules.FOCUSED_API_SLUG)} OR {D.hit(_PT, rules.FOCUSED_API_TEXT)} AS is_focused_api,
  NOT {_BROAD} AND {D.hit(_PT, rules.SPECIALISED_TEXT)} AS is_specialised,
  (pos % 4 = 1 AND {_PLANNING.replace('path', 'source_path')}) OR {D.hit(_PT, rules.PLANNING_TEXT)} AS is_planning,
  {D.hit(_PT, rules.IMPORTANT_PRIMITIVE_TEXT)} OR {D.hit(_PT, rules.JOURNEY_TEXT)} AS is_important, {D.hit(_PT, rules.INTERNAL_PROJECT_TEXT)} AS is_internal_project"""


@register("classify_pages", f"{_OUTLINE} SELECT repo_id, pos, {CLASSES_SQL} FROM outline")
def classify_pages(spark, sf):
    pages = predicates.classify_pages(outline(spark, sf))
    own = ["slug", "title", "purpose", "priority", "source_path", "source_paths", "doc_id", "text"]
    return pages.drop(*own)


def _min_words_sql() -> str:
    base = D.ladder("file_count", rules.WORD_BASELINE)
    tiers = []
    for tier, bound, tiny, journey, primitive, focused, special, wide, slim, plain in rules.PAGE_WORDS_BY_TIER:
        column = "link_count" if tier == "links" else "docs_count"
        leaf, narrow, normal = (f"least({base}, {c})" for c in (500, 575, 650))
        tiers.append(
            f"WHEN {column} >= {bound} THEN CASE WHEN is_tiny_leaf THEN greatest({leaf}, {tiny}) WHEN is_journey THEN greatest({narrow}, {journey})"
            f" WHEN is_primitive THEN greatest({leaf}, {primitive}) WHEN is_focused_api THEN greatest({leaf}, {focused})"
            f" WHEN is_specialised THEN greatest({leaf}, {special}) WHEN breadth = 'broad' THEN greatest({base}, {wide})"
            f" WHEN breadth = 'narrow' THEN greatest({narrow}, {slim}) ELSE greatest({normal}, {plain}) END"
        )
    return (
        f"CAST(CASE {' '.join(tiers)} WHEN docs_count >= 30 THEN CASE WHEN is_tiny_leaf THEN greatest({base}, 575) WHEN breadth = 'broad' THEN greatest({base}, 800)"
        f" WHEN breadth = 'narrow' THEN greatest({base}, 700) ELSE greatest({base}, 750) END"
        f" WHEN docs_count >= 12 THEN CASE WHEN breadth = 'narrow' THEN greatest({base}, 650) ELSE greatest({base}, 700) END ELSE {base} END AS INT)"
    )


MIN_WORDS_SQL = _min_words_sql()
MIN_SECTIONS_SQL = f"""CAST(CASE WHEN docs_count < 60 AND link_count < 60 THEN 3
  WHEN (slug = 'overview' OR slug LIKE '%-overview' OR {D.hit(_PT, rules.BROAD_SECTION_TEXT)}) AND (docs_count >= 100 OR link_count >= 120) THEN 5
  WHEN file_count >= 500 OR docs_count >= 100 OR link_count >= 120 THEN 4 ELSE 3 END AS INT)"""


@register(
    "page_minimums",
    f"""{cte('outline', 'tree')}, {_EVIDENCE_SQL}, c AS (SELECT *, {CLASSES_SQL} FROM outline)
    SELECT repo_id, pos, {MIN_WORDS_SQL} AS min_words, {MIN_SECTIONS_SQL} AS min_sections FROM c JOIN evidence USING (repo_id)""",
)
def page_minimums(spark, sf):
    """Word and section minimum of every outline page from its repository's evidence."""
    pages = predicates.classify_pages(outline(spark, sf)).join(evidence(spark, sf), "repo_id")
    return pages.select(
        "repo_id",
        "pos",
        predicates.page_min_words().alias("min_words"),
        predicates.page_min_sections().alias("min_sections"),
    )


def _covered(groups: list[str]) -> str:
    return " + ".join(f"CAST(bool_or({D.hit(_JT, g)}) AS INT)" for g in groups)


_JT = "lower(title || ' ' || slug || ' ' || purpose)"


@register(
    "journey_coverage",
    f"""{_OUTLINE}, s AS (SELECT repo_id || '-' || CAST(pos % 6 AS STRING) AS repo_id, count(*) AS pages, {_covered(rules.JOURNEY_GROUPS)} AS journey_groups, {_covered(rules.SPINE_GROUPS)} AS spine_groups,
      count(*) FILTER ({D.hit("title || ' ' || slug || ' ' || purpose", rules.CATALOGUE_TEXT)}) AS catalogue_pages,
      count(*) FILTER ({D.hit("title || ' ' || slug || ' ' || purpose", rules.READER_TEXT)}) AS reader_pages FROM outline GROUP BY 1)
    SELECT *, journey_groups >= 4 AS has_journey, spine_groups >= CASE WHEN pages < 12 THEN 4 ELSE 5 END AS has_spine,
      pages >= 8 AND catalogue_pages > greatest(4, reader_pages + 2) AS catalogue_dominates FROM s""",
)
def journey_coverage(spark, sf):
    parts = outline(spark, sf).withColumn(
        "repo_id", F.concat_ws("-", "repo_id", (F.col("pos") % 6).cast("string"))
    )
    return rollups.journey_coverage(parts)


@register(
    "coverage_families",
    f"""{cte('entries', 'outline')}, t AS (SELECT repo_id, regexp_replace(lower(string_agg(title || ' ' || slug || ' ' || purpose, ' ' ORDER BY CAST(pos AS STRING))), '[^a-z0-9]+', ' ', 'g') AS outline_text FROM outline GROUP BY 1),
    c AS ("""
    + " UNION ALL ".join(
        f"SELECT repo_id, CAST({i} AS INT) AS ord, {D.q(n)} AS family, count(*) FILTER ({D.hit(_ENTRY_TEXT, seen)}) AS entries, {m} AS minimum, {D.q(shown)} AS shown FROM entries GROUP BY 1"
        for i, (n, m, seen, shown) in enumerate(rules.EVIDENCE_FAMILIES)
    )
    + ") SELECT repo_id, ord, family, entries, regexp_matches(outline_text, shown) AS mentioned FROM c JOIN t USING (repo_id) WHERE entries >= minimum",
)
def coverage_families(spark, sf):
    text = rollups.outline_text(outline(spark, sf))
    return rollups.coverage_families(entries(spark, sf), text)


@register(
    "redundant_topics",
    f"""{_OUTLINE}, k AS (SELECT repo_id, pos, {D.slug('slug')} AS s, {D.slug('title')} AS t FROM outline)
    SELECT repo_id, pos FROM k WHERE s <> t AND ends_with(s, '-' || t) AND NOT {D.hit('t', rules.ALLOWED_DUPLICATE_TITLE)}
      AND EXISTS (SELECT 1 FROM k c WHERE c.repo_id = k.repo_id AND c.t = k.t AND c.s = c.t)""",
)
def redundant_topics(spark, sf):
    return rollups.redundant_topics(outline(spark, sf)).select("repo_id", "pos")


@register(
    "redundant_setup",
    f"""{_OUTLINE}, o AS (SELECT repo_id, pos, CASE WHEN pos = 3 THEN 'create-a-router-app' WHEN pos = 5 THEN 'editor-setup' ELSE slug END AS slug, title, purpose FROM outline),
    f AS (SELECT repo_id FROM o GROUP BY 1 HAVING {' + '.join(f"CAST(bool_or({D.hit("lower(slug || ' ' || title)", p)}) AS INT)" for p in rules.SETUP_LEAF_PATTERNS)} >= 1)
    SELECT repo_id, pos, slug FROM o WHERE repo_id IN (SELECT repo_id FROM f) AND slug = 'create-a-router-app'
      AND (SELECT {' + '.join(f"CAST(bool_or({D.hit("lower(slug || ' ' || title)", p)}) AS INT)" for p in rules.SETUP_LEAF_PATTERNS)} FROM o x WHERE x.repo_id = o.repo_id) >= 2""",
)
def redundant_setup(spark, sf):
    pages = outline(spark, sf).withColumn(
        "slug",
        F.when(F.col("pos") == 3, F.lit("create-a-router-app"))
        .when(F.col("pos") == 5, F.lit("editor-setup"))
        .otherwise(F.col("slug")),
    )
    return rollups.redundant_setup(pages).select("repo_id", "pos", "slug")


# -- indexes ----------------------------------------------------------------------------------

_INDEX_URL = pick(
    "pos",
    [
        "https://docs.acme.dev/llms.txt",
        "https://docs.acme.dev/llms-full.txt",
        "https://acme.dev/sitemap.xml",
        "https://acme.dev/docs/sitemap.xml",
        "https://acme.dev/llms/python.txt",
        "https://acme.dev/release-notes/",
        "https://acme.dev/docs",
    ],
)
_INDEX = f"repo_id, pos, {_INDEX_URL} AS source_url, CAST(n_chars % 40 AS INT) AS candidate_score, CAST(n_chars % 17 AS INT) AS relevance_score, CAST(n_chars % 300 AS INT) AS link_count, CAST(n_chars % 90 AS INT) AS heading_count"
_INDEX_SCORE = f"""relevance_score * 250 + candidate_score * 8 + least(link_count, 800) * 3 + least(heading_count, 800) * 2
  + CASE WHEN source_url LIKE '%llms-full.txt' THEN CASE WHEN link_count >= 60 THEN 500 ELSE 0 END
      WHEN {D.hit('source_url', 'llms.*[.]txt$')} THEN CASE WHEN link_count >= 60 THEN 8000 ELSE 2500 END WHEN {D.hit('source_url', 'sitemap.*[.]xml$')} THEN 3000 ELSE 0 END
  - CASE WHEN source_url LIKE '%/llms/python.txt' THEN 24000 ELSE 0 END + CASE WHEN source_url LIKE '%/docs/sitemap.xml' THEN 22000 ELSE 0 END
  - CASE WHEN source_url LIKE '%/release-notes/%' THEN 4000 ELSE 0 END"""


@register(
    "best_index",
    f"""{cte('doc')}, i AS (SELECT {_INDEX} FROM doc), s AS (SELECT *, {_INDEX_SCORE} AS index_score FROM i)
    SELECT *, link_count >= 220 OR (source_url LIKE '%llms%.txt' AND link_count >= 120) OR (source_url LIKE '%sitemap%.xml' AND link_count >= 40)
      OR (link_count >= 20 AND heading_count >= 20) AS is_strong FROM s
    QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY index_score DESC, pos) = 1""",
)
def best_index(spark, sf):
    found = computed(derive(spark, sf, "doc"), _INDEX)
    best = rollups.best_index(found)
    return best.withColumn("index_score", F.col("index_score").cast("int"))


# -- drafts -----------------------------------------------------------------------------------

_CITED = "[source_path, 'src/none.ts', source_path, 'docs/README.md', CASE WHEN pos % 2 = 0 THEN 'yarn.lock' ELSE 'main.go' END]"


def _citations():
    paths = [
        F.col("source_path"),
        F.lit("src/none.ts"),
        F.col("source_path"),
        F.lit("docs/README.md"),
        F.when(F.col("pos") % 2 == 0, F.lit("yarn.lock")).otherwise(F.lit("main.go")),
    ]
    return F.array(
        *[
            F.struct(
                p.alias("path"), F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line")
            )
            for p in paths
        ]
    )


@register(
    "valid_citations",
    f"""{cte('outline', 'tree')}, c AS (SELECT repo_id, slug || '-' || CAST(pos AS STRING) AS page_slug, unnest({_CITED}) AS path, unnest(range(5)) AS nth FROM outline),
    f AS (SELECT repo_id, page_slug, path, min(nth) AS nth FROM c GROUP BY ALL),
    k AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM tree WHERE tree.repo_id = f.repo_id AND tree.path = f.path))
    SELECT repo_id, page_slug, string_agg(path, ',' ORDER BY nth) AS valid_paths FROM k GROUP BY ALL""",
)
def valid_citations(spark, sf):
    drafts = outline(spark, sf).select(
        "repo_id", F.concat_ws("-", "slug", "pos").alias("page_slug"), _citations().alias("citations")
    )
    valid = joins.valid_citations(drafts, tree(spark, sf))
    return valid.withColumn("valid_paths", F.array_join("valid_paths", ","))


@register(
    "valid_source_paths",
    f"""{cte('outline', 'tree')}, o AS (SELECT repo_id, pos, CASE pos % 4 WHEN 0 THEN [] WHEN 1 THEN [source_path] ELSE [source_path, 'docs/plans/x.md', 'src/none.ts'] END AS p FROM outline),
    u AS (SELECT repo_id, pos, unnest(p) AS path FROM o),
    k AS (SELECT * FROM u WHERE NOT {_PLANNING} AND EXISTS (SELECT 1 FROM tree WHERE tree.repo_id = u.repo_id AND tree.path = u.path))
    SELECT o.repo_id, o.pos, coalesce(string_agg(k.path, ','), '') AS paths FROM o LEFT JOIN k ON k.repo_id = o.repo_id AND k.pos = o.pos GROUP BY 1, 2""",
)
def valid_source_paths(spark, sf):
    kept = joins.valid_source_paths(outline(spark, sf), tree(spark, sf))
    return kept.select("repo_id", "pos", F.array_join("source_paths", ",").alias("paths"))


@register(
    "prune_related",
    f"""{_OUTLINE}, d AS (SELECT repo_id, slug, [upper(slug), 'never-made', replace(lower({pick('pos * 3', TITLES)}), ' ', '-')] AS r FROM outline),
    u AS (SELECT repo_id, slug AS page_slug, unnest(r) AS related, CAST(unnest(range(3)) AS INT) AS pos FROM d)
    SELECT repo_id, page_slug, related, pos FROM u WHERE EXISTS (SELECT 1 FROM outline o WHERE o.repo_id = u.repo_id AND {D.slug('o.slug')} = {D.slug('u.related')})""",
)
def prune_related(spark, sf):
    drafts = outline(spark, sf).select(
        "repo_id",
        F.col("slug").alias("page_slug"),
        F.array(
            F.upper("slug"),
            F.lit("never-made"),
            F.replace(F.lower(F.expr(pick("pos * 3", TITLES))), F.lit(" "), F.lit("-")),
        ).alias("related_pages"),
    )
    return joins.prune_related(drafts)


_RAW = (
    "CASE pos % 6 WHEN 0 THEN '{\"pages\": [' || page || ', ' || page || ']}' WHEN 1 THEN 'Here you are: ```json' || chr(10) || '[' || page || ']' || chr(10) || '```'"
    " WHEN 2 THEN 'Done. {\"pages\": [' || page || ']} Bye' WHEN 3 THEN '{\"pages\": [{\"slug\": \"x\", \"title\": \"\", \"markdown\": \"m\"}]}'"
    " WHEN 4 THEN 'no json here' ELSE '{\"pages\": [{\"slug\": \"x\", \"title\": \"X\", \"markdownLines\": [\" \"]}]}' END"
)
_PAGE = (
    "'{\"slug\": \"p' || CAST(pos AS STRING) || '\", \"title\": \"' || title || '\", \"markdownLines\": [\"# T\", \"' || purpose || '\"],"
    " \"citations\": [{\"path\": \"a.ts\", \"startLine\": ' || CAST(pos - 9 AS STRING) || ', \"endLine\": 3}]}'"
)


@register(
    "parse_drafts",
    f"""{_OUTLINE}, n AS (SELECT *, unnest(CASE WHEN pos % 6 = 0 THEN [0, 1] WHEN pos % 6 IN (1, 2) THEN [0] ELSE [-1] END) AS i FROM outline)
    SELECT repo_id, doc_id, CASE WHEN i >= 0 THEN CAST(i AS INT) END AS page_no, CASE WHEN i >= 0 THEN 'p' || CAST(pos AS STRING) END AS page_slug,
      CASE WHEN i >= 0 THEN '# T' || chr(10) || purpose END AS markdown, CASE WHEN i >= 0 AND pos > 9 THEN CAST(pos - 9 AS INT) END AS start_line,
      CASE WHEN i < 0 THEN CASE pos % 6 WHEN 4 THEN 'no_json' ELSE 'invalid_page' END END AS reason FROM n""",
)
def parse_drafts_query(spark, sf):
    raw = computed(outline(spark, sf), f"repo_id, doc_id, {_PAGE} AS page, pos")
    raw = computed(raw, f"repo_id, doc_id, {_RAW} AS raw")
    drafts, rejects = parse_drafts(raw)
    good = drafts.select(
        "repo_id",
        "doc_id",
        F.col("pos").alias("page_no"),
        "page_slug",
        "markdown",
        F.get("citations", F.lit(0))["start_line"].alias("start_line"),
        F.lit(None).cast("string").alias("reason"),
    )
    bad = rejects.select("repo_id", "doc_id", "reason")
    return good.unionByName(bad, allowMissingColumns=True)


@register(
    "publish_gate",
    f"""{_OUTLINE}, o AS (SELECT *, pos % 6 IN (4, 5) AND doc_id % 20 < 9 OR pos % 2 = 0 AND doc_id % 20 >= 9 AS bad FROM outline),
    s AS (SELECT repo_id, count(*) AS planned, count(*) FILTER (NOT bad) AS generated, count(*) FILTER (bad) AS failed,
      coalesce(array_to_string(list(slug || ': thin' ORDER BY pos) FILTER (bad)[:6], '; '), '') AS reported FROM o GROUP BY 1),
    n AS (SELECT *, CAST(CASE WHEN planned <= 3 THEN planned WHEN planned >= 50 THEN greatest(48, floor(planned * 0.9)) WHEN planned >= 25 THEN greatest(20, floor(planned * 0.75)) ELSE greatest(3, floor(planned * 0.6)) END AS INT) AS needed FROM s)
    SELECT *, generated > 0 AND generated >= needed AS publishable FROM n""",
)
def publish_gate(spark, sf):
    late, half = F.col("doc_id") % 20 < 9, F.col("doc_id") % 20 >= 9
    bad = ((F.col("pos") % 6).isin(4, 5) & late) | ((F.col("pos") % 2 == 0) & half)
    pages = outline(spark, sf).select("repo_id", "pos", F.col("slug").alias("page_slug"), bad.alias("bad"))
    failures = pages.filter("bad").withColumn("error", F.lit("thin"))
    return rollups.publish_gate(pages, pages.filter("not bad"), failures)


# -- Markdown ---------------------------------------------------------------------------------

_MD_INDEX = " || chr(10) || ".join(
    [
        "'# Index'",
        "'## Guides'",
        "'- [Start](/start)'",
        "'#### Deep ' || lang",
        "'- [Deep `API`](deep.md)'",
        "'### Mid'",
        "'- [Start again](/start/)'",
        "'- [todo](/x)'",
        "'- [Mid](https://other.org/m)'",
        "'## [Linked](l.md) - [A](a.md) - [B](b.md)'",
        "'URL: https://docs.acme.dev/u' || CAST(pos AS STRING)",
        "text",
    ]
)
_MD_SOURCE = "'https://docs.acme.dev/llms/' || CAST(doc_id AS STRING) || '.txt'"


@register(
    "markdown_entries",
    f"""{cte('doc')}, e AS (SELECT repo_id, {_MD_SOURCE} AS source_url, unnest([
        {{'p': 1, 'g': 'Guides', 't': 'Start', 'u': 'https://docs.acme.dev/start'}},
        {{'p': 2, 'g': 'Guides / Deep ' || lang, 't': 'Deep API', 'u': 'https://docs.acme.dev/llms/deep.md'}},
        {{'p': 3, 'g': 'Guides / Mid', 't': 'Mid', 'u': 'https://other.org/m'}},
        {{'p': 4, 'g': 'Linked', 't': 'Linked', 'u': 'https://docs.acme.dev/llms/l.md'}},
        {{'p': 5, 'g': 'Linked', 't': 'A', 'u': 'https://docs.acme.dev/llms/a.md'}},
        {{'p': 6, 'g': 'Linked', 't': 'B', 'u': 'https://docs.acme.dev/llms/b.md'}},
        {{'p': 7, 'g': 'Linked', 't': 'Linked', 'u': 'https://docs.acme.dev/u' || CAST(pos AS STRING)}}]) AS e FROM doc)
    SELECT repo_id, source_url, CAST(e.p AS INT) AS pos, e.g AS "group", e.t AS title, e.u AS url FROM e""",
)
def markdown_entries(spark, sf):
    docs = derive(spark, sf, "doc").selectExpr(
        "repo_id", f"{_MD_SOURCE} AS source_url", f"{_MD_INDEX} AS text"
    )
    return corpus.markdown_entries(docs)


_LEVEL = "CASE WHEN pos % 3 = 2 THEN NULL ELSE CAST(2 + (n_chars + pos) % 5 AS INT) END"


def _open_title(level: int) -> str:
    deeper = f"y.level < {level} AND y.pos > x.pos AND y.pos <= r.pos AND y.repo_id = r.repo_id"
    return (
        f"(SELECT x.heading FROM l x WHERE x.repo_id = r.repo_id AND x.level = {level} AND x.pos <= r.pos"
        f" AND NOT EXISTS (SELECT 1 FROM l y WHERE {deeper}) ORDER BY x.pos DESC LIMIT 1)"
    )


@register(
    "heading_groups",
    f"""{cte('doc')}, l AS (SELECT repo_id, pos, {_LEVEL} AS level, {pick('n_chars', TITLES)} AS heading FROM doc),
    g AS (SELECT repo_id, pos, list_filter([{', '.join(_open_title(i) for i in range(2, 7))}], lambda v: v IS NOT NULL) AS t FROM l r)
    SELECT repo_id, pos, nullif(array_to_string({D.distinct_in_order('t')}[:4], ' / '), '') AS "group" FROM g""",
)
def heading_groups(spark, sf):
    lines = derive(spark, sf, "doc").selectExpr(
        "repo_id", "pos", f"{_LEVEL} AS level", f"{pick('n_chars', TITLES)} AS heading"
    )
    lines = lines.withColumn("heading", F.when(F.col("level").isNotNull(), F.col("heading")))
    return corpus.heading_groups(lines, ["repo_id"], "pos").select("repo_id", "pos", "group")


_MD_FILE = " || chr(10) || ".join(
    [
        "'# README'",
        "'Intro for ' || lang",
        "'## Install {#install}'",
        "'```bash'",
        "'# not a heading'",
        "'```'",
        "'Usage'",
        "'-----'",
        "'### Usage ###'",
        "'## npm install'",
        "'## License'",
        "'~~~'",
        "'## hidden'",
        "'~~~'",
        "'## Äpfel & `code` ' || CAST(pos AS STRING)",
        "text",
    ]
)


@register(
    "outside_fences",
    """WITH d AS (SELECT doc_id, lang FROM documents)
    SELECT doc_id, CAST(n AS INT) AS line_no, CASE n WHEN 0 THEN 'a ' || lang WHEN 2 THEN 'b' WHEN 5 THEN 'c' ELSE 'd' END AS line,
      CASE n WHEN 0 THEN 'b' WHEN 2 THEN '~~~' WHEN 5 THEN 'd' END AS next_line
    FROM (SELECT doc_id, lang, unnest([0, 1, 5, 6]) AS k FROM d), LATERAL (SELECT CASE k WHEN 1 THEN 2 ELSE k END AS n)""".replace(
        "CASE n WHEN 0 THEN 'b' WHEN 2 THEN '~~~'", "CASE n WHEN 0 THEN '' WHEN 2 THEN '~~~'"
    ).replace(
        "WHEN 2 THEN 'b' WHEN 5", "WHEN 1 THEN '' WHEN 2 THEN 'b' WHEN 5"
    ).replace(
        "unnest([0, 1, 5, 6]) AS k FROM d), LATERAL (SELECT CASE k WHEN 1 THEN 2 ELSE k END AS n)",
        "unnest([0, 1, 2, 5, 6]) AS n FROM d)",
    ).replace(
        "CASE n WHEN 0 THEN '' WHEN 2", "CASE n WHEN 0 THEN '' WHEN 1 THEN 'b' WHEN 2"
    ),
)
def outside_fences(spark, sf):
    text = "'a ' || lang || chr(10) || chr(10) || 'b  ' || chr(10) || '~~~' || chr(10) || '```' || chr(10) || 'c' || chr(10) || 'd'"
    docs = derive(spark, sf, "documents").selectExpr("doc_id", f"{text} AS text")
    return corpus.outside_fences(docs, ["doc_id"])


@register(
    "headings_per_file",
    f"""{cte('doc')} SELECT repo_id, path, CAST(e.p AS INT) AS pos, CAST(e.l AS INT) AS level, e.t AS title FROM (SELECT repo_id, 'docs/f' || CAST(pos AS STRING) || '.md' AS path, unnest([
        {{'p': 2, 'l': 2, 't': 'Install'}}, {{'p': 6, 'l': 2, 't': 'Usage'}}, {{'p': 8, 'l': 3, 't': 'Usage'}},
        {{'p': 14, 'l': 2, 't': 'Äpfel & code ' || CAST(pos AS STRING)}}]) AS e FROM doc)""",
)
def headings_per_file(spark, sf):
    docs = derive(spark, sf, "doc").selectExpr(
        "repo_id", "'docs/f' || CAST(pos AS STRING) || '.md' AS path", f"{_MD_FILE} AS text"
    )
    heads = corpus.markdown_headings(docs).withColumn("file_title", corpus.docs_file_title(F.col("path")))
    return ordering.headings_per_file(heads).drop("file_title")


@register(
    "repo_docs_index",
    f"""{cte('doc')}, e AS (SELECT repo_id, pos AS f, lang, unnest([
        {{'p': -1, 't': 'F' || CAST(pos AS STRING), 'a': ''}}, {{'p': 2, 't': 'Install', 'a': '#install'}}, {{'p': 6, 't': 'Usage', 'a': '#usage'}}, {{'p': 8, 't': 'Usage', 'a': '#usage-1'}},
        {{'p': 14, 't': 'Äpfel & code ' || CAST(pos AS STRING), 'a': '#äpfel-code-' || CAST(pos AS STRING)}}]) AS e FROM doc)
    SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id, e.p ORDER BY 'docs/guides/f' || CAST(f AS STRING) || '.md') AS INT) AS pos, CAST(e.p AS INT) AS at,
      'Guides / F' || CAST(f AS STRING) AS "group", e.t AS title, 'https://github.com/acme/' || repo_id || '/blob/main/docs/guides/f' || CAST(f AS STRING) || '.md' || e.a AS url FROM e""",
)
def repo_docs_index(spark, sf):
    docs = derive(spark, sf, "doc").selectExpr(
        "repo_id", "pos", "'docs/guides/f' || CAST(pos AS STRING) || '.md' AS path", f"{_MD_FILE} AS text", "n_chars AS size"
    )
    repos = docs.select("repo_id").distinct().select(
        "repo_id", F.lit("acme").alias("owner"), F.col("repo_id").alias("name"), F.lit("main").alias("default_branch")
    )
    index = corpus.repo_docs_index(docs.drop("text"), docs.select("repo_id", "path", "text"), repos)
    return index.drop("path")


@register(
    "linked_indexes",
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'llms-full.txt' WHEN doc_id % 3 = 1 THEN 'llms-small.txt' ELSE 'none.txt' END AS f FROM documents)
    SELECT CAST(doc_id AS STRING) AS repo_id, 'https://d' || CAST(doc_id AS STRING) || '.acme.dev/llms.txt' AS source_url,
      'https://d' || CAST(doc_id AS STRING) || '.acme.dev/' || f AS linked_url, CAST(2 AS INT) AS links,
      CAST(2 + 3 + CASE WHEN f = 'llms-full.txt' THEN 60 ELSE -30 END AS INT) AS text_score FROM d WHERE f <> 'none.txt'""",
)
def linked_indexes(spark, sf):
    docs = derive(spark, sf, "documents")
    site = "'https://d' || CAST(doc_id AS STRING) || '.acme.dev/'"
    own = docs.selectExpr(
        "CAST(doc_id AS STRING) AS repo_id",
        f"{site} || 'llms.txt' AS source_url",
        f"'# I' || chr(10) || '[small](llms-small.txt) [self](llms.txt) ' || {site} || 'llms-full.txt.' AS text",
    ).withColumn("text", F.regexp_replace("text", r"\[self\]\(llms\.txt\) ", ""))
    landed = docs.filter("doc_id % 3 < 2").selectExpr(
        f"{site} || CASE WHEN doc_id % 3 = 0 THEN 'llms-full.txt' ELSE 'llms-small.txt' END AS source_url",
        "'## A' || chr(10) || '[a](a.md) [b](b.md) [c](#c)' AS text",
    )
    return corpus.linked_indexes(own, landed)


@register(
    "section_text",
    """WITH p AS (SELECT page_id, 'https://docs.acme.dev/p' || CAST(page_id AS STRING) AS url FROM pages)
    SELECT CAST(page_id AS STRING) AS repo_id, k AS title, url || CASE k WHEN 'plain' THEN '' ELSE '#' || k END AS url, k IN ('one', 'two') AS is_section,
      CASE k WHEN 'one' THEN 'One' || chr(10) || ' ' || repeat('alpha ', 40) || chr(10) || ' Sub' || chr(10) || ' ' || 'sub text' || chr(10) || ' '
        WHEN 'two' THEN 'Two' || chr(10) || ' ' || repeat('beta ', 50) || chr(10) END AS text
    FROM p, (SELECT unnest(['one', 'two', 'plain', 'gone']) AS k) WHERE k IN ('one', 'two')""".replace(
        "|| chr(10) || ' ' || repeat('alpha ', 40) || chr(10) || ' Sub' || chr(10) || ' ' || 'sub text' || chr(10) || ' '",
        "|| chr(10) || rtrim(repeat('alpha ', 40)) || chr(10) || 'Sub' || chr(10) || 'sub text'",
    ).replace("|| chr(10) || ' ' || repeat('beta ', 50) || chr(10) END", "|| chr(10) || rtrim(repeat('beta ', 50)) END"),
)
def section_text(spark, sf):
    """Two anchored sections of a page that wraps each crawled body."""
    body = (
        "'<h1>T</h1>' || '<h2 id=\"one\">One</h2><p>' || repeat('alpha ', 40) || '</p><h3 id=sub>Sub</h3><p>sub text</p>'"
        " || '<h2 id=''two''>Two</h2>' || repeat('beta ', 50) || '<h2>Rest</h2>' || html"
    )
    pages = derive(spark, sf, "pages").selectExpr(
        "page_id", "'https://docs.acme.dev/p' || CAST(page_id AS STRING) AS url", f"{body} AS html"
    )
    ids = F.explode(F.array(F.lit("one"), F.lit("two")))
    wanted = pages.select(F.col("page_id").cast("string").alias("repo_id"), "url", ids.alias("title"))
    wanted = wanted.select(
        "repo_id", "title", F.lit("G").alias("group"), F.concat_ws("#", "url", "title").alias("url")
    )
    found = corpus.section_text(pages.select("url", "html"), wanted).drop("group")
    return found.withColumn("text", F.regexp_replace("text", r" *\n *", "\n"))


# -- navigation -------------------------------------------------------------------------------

_NAV = """repo_id, CAST(n AS STRING) AS node_id, CASE WHEN n < 4 THEN NULL WHEN n < 14 THEN CAST(n % 4 AS STRING) WHEN n < 30 THEN CAST(4 + n % 10 AS STRING)
  ELSE CAST(14 + n % 16 AS STRING) END AS parent_id, CAST(CASE WHEN n < 4 THEN 1 WHEN n < 14 THEN 2 WHEN n < 30 THEN 3 ELSE 4 END AS INT) AS depth, CAST(n AS INT) AS ord,
  CASE WHEN n < 3 OR (n >= 4 AND n < 9) OR (n >= 14 AND n < 24) THEN NULL ELSE 's' || CAST(n AS STRING) END AS slug, 'T' || CAST(n AS STRING) AS title"""
_NAV_SQL = f"{cte('doc')}, nav AS (SELECT {_NAV} FROM (SELECT repo_id, pos AS n FROM doc))"


def nav(spark, sf):
    """Four-level trees of fifty nodes, one per repository."""
    rows = derive(spark, sf, "doc").selectExpr("repo_id", "pos AS n")
    return computed(rows, _NAV)


@register(
    "nav_stats",
    f"""{_NAV_SQL}, c AS (SELECT nav.*, (SELECT count(*) FROM nav x WHERE x.repo_id = nav.repo_id AND x.parent_id = nav.node_id) AS kids FROM nav)
    SELECT repo_id, count(*) FILTER (kids > 0) AS folders, count(*) FILTER (kids = 0 AND slug IS NOT NULL) AS leaves,
      coalesce(max(depth) FILTER (kids > 0), 0) AS max_depth, count(*) FILTER (kids > 0 AND depth = 1) AS root_folders,
      count(*) FILTER (kids = 0 AND slug IS NOT NULL AND depth = 1) AS root_leaves, min(title) FILTER (kids > 0 AND slug IS NOT NULL) AS folder_with_slug FROM c GROUP BY 1""",
)
def nav_stats(spark, sf):
    stats = rollups.nav_stats(nav(spark, sf))
    return stats.drop("root_nodes", "wrapper_children")


_LINE = """l AS (SELECT n.*, p.node_id AS u1, q.node_id AS u2, r.node_id AS u3 FROM nav n LEFT JOIN nav p ON p.repo_id = n.repo_id AND p.node_id = n.parent_id
      LEFT JOIN nav q ON q.repo_id = n.repo_id AND q.node_id = p.parent_id LEFT JOIN nav r ON r.repo_id = n.repo_id AND r.node_id = q.parent_id)"""


@register(
    "prune_nav",
    f"""{_NAV_SQL}, {_LINE}, k AS (SELECT repo_id, unnest([node_id, u1, u2, u3]) AS node_id FROM l WHERE slug IN ('s12', 's34', 's3', 's26'))
    SELECT nav.* FROM nav SEMI JOIN k ON k.repo_id = nav.repo_id AND k.node_id = nav.node_id""",
)
def prune_nav(spark, sf):
    tree_rows = nav(spark, sf)
    wanted = tree_rows.filter("slug IN ('s12', 's34', 's3', 's26')").select(
        "repo_id", F.upper("slug").alias("slug")
    )
    return navtree.prune_nav(tree_rows, wanted)


@register(
    "collapse_nav",
    f"""{_NAV_SQL}, c AS (SELECT *, (SELECT count(*) FROM nav x WHERE x.repo_id = nav.repo_id AND x.parent_id = nav.node_id) AS kids FROM nav),
    {_LINE}, m AS (SELECT l.repo_id, l.node_id, CASE WHEN coalesce(p.kids = 1 AND p.slug IS NULL, false) THEN CASE WHEN coalesce(q.kids = 1 AND q.slug IS NULL, false)
        THEN CASE WHEN coalesce(r.kids = 1 AND r.slug IS NULL, false) THEN [u1, u2, u3] ELSE [u1, u2] END ELSE [u1] END END AS chain
      FROM l JOIN c ON c.repo_id = l.repo_id AND c.node_id = l.node_id AND c.kids = 0 AND c.slug IS NOT NULL
      LEFT JOIN c p ON p.repo_id = l.repo_id AND p.node_id = u1 LEFT JOIN c q ON q.repo_id = l.repo_id AND q.node_id = u2
      LEFT JOIN c r ON r.repo_id = l.repo_id AND r.node_id = u3)
    SELECT n.repo_id, n.node_id, CASE WHEN t.node_id IS NULL THEN n.parent_id ELSE t.parent_id END AS parent_id, coalesce(t.depth, n.depth) AS depth,
      coalesce(t.ord, n.ord) AS ord, n.slug, n.title FROM nav n LEFT JOIN m ON m.repo_id = n.repo_id AND m.node_id = n.node_id
    LEFT JOIN nav t ON t.repo_id = n.repo_id AND t.node_id = m.chain[-1]
    WHERE NOT EXISTS (SELECT 1 FROM m g WHERE g.repo_id = n.repo_id AND list_contains(g.chain, n.node_id))""",
)
def collapse_nav(spark, sf):
    return navtree.collapse_nav(nav(spark, sf))


@register(
    "rewrite_nav_slugs",
    f"""{_NAV_SQL} SELECT * REPLACE (CASE WHEN slug IN ('s12', 's43') THEN slug || '-new' ELSE slug END AS slug,
      CASE WHEN slug IN ('s12', 's43') THEN 'New ' || title ELSE title END AS title) FROM nav""",
)
def rewrite_nav_slugs(spark, sf):
    tree_rows = nav(spark, sf)
    fresh = tree_rows.filter("slug IN ('s12', 's43')").select(
        "repo_id",
        "slug",
        F.concat(F.col("slug"), F.lit("-new")).alias("new_slug"),
        F.concat(F.lit("New "), F.col("title")).alias("new_title"),
    )
    return navtree.rewrite_nav_slugs(tree_rows, fresh)


