"""Queries of the corpus operators over the crawled pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import urls as U
from docloom.operators import corpus, joins, ordering, predicates, rollups
from docloom.plans import duck as D
from docloom.plans.catalog import register
from docloom.plans.inputs import computed, cte, derive, table
from docloom.sources.corpus import landed_bodies
from docloom.sources.revisions import artifact_rows

# -- links, as DuckDB sees them ---------------------------------------------------------------

_HREF = r"(?i)\bhref=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"


def _links_sql(source: str = "pages") -> str:
    """Links of the pages: page_id, page_url, pos, href, url (resolved, no fragment)."""
    raw = (
        f"SELECT page_id, url AS page_url, unnest(m) AS m, unnest(range(len(m))) AS pos FROM "
        f"(SELECT page_id, url, regexp_extract_all(html, {D.q(_HREF)}) AS m FROM {source})"
    )
    value = "regexp_replace(m, '(?i)^href=', '')"
    bare = (
        f"CASE WHEN {value} LIKE '\"%\"' OR {value} LIKE '''%''' THEN {value}[2:-2] ELSE {value} END"
    )
    href = f"trim({D.decode(bare)})"
    origin = (
        "lower(regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
    )
    directory = f"regexp_replace({D.path('page_url')}, '[^/]*$', '')"
    scheme = "lower(regexp_extract(page_url, '^([a-zA-Z]+):', 1))"
    absolute = "regexp_matches(href, '(?i)^https?://')"
    head = "lower(regexp_extract(href, '^([A-Za-z]+://[^/?#]*)', 1))"
    rest = "regexp_replace(href, '^[A-Za-z]+://[^/?#]*', '')"
    target = (
        f"CASE WHEN {absolute} THEN {head} || CASE WHEN {rest} = '' OR {rest}[1] IN ('?', '#') THEN '/' || {rest} ELSE {rest} END"
        f" WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL"
        f" WHEN starts_with(href, '//') THEN {scheme} || ':' || href"
        f" WHEN starts_with(href, '/') THEN {origin} || href"
        f" WHEN starts_with(href, '?') THEN {origin} || {D.path('page_url')} || href"
        f" ELSE {origin} || {directory} || href END"
    )
    kept = "href <> '' AND NOT regexp_matches(href, '^(#|mailto:|javascript:)')"
    return (
        f"SELECT * FROM (SELECT page_id, page_url, CAST(pos AS INT) AS pos, href, regexp_replace({target}, '#.*$', '') AS url FROM "
        f"(SELECT page_id, page_url, pos, {href} AS href FROM ({raw})) WHERE {kept}) WHERE url IS NOT NULL"
    )


LINKS_SQL = _links_sql()


@register(
    "scan_pages", "SELECT page_id, url, length(html) AS chars FROM pages WHERE length(html) BETWEEN 1 AND 10000000"
)
def scan_pages(spark, sf):
    pages = landed_bodies(table(spark, sf, "pages"))
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@register("extract_links", LINKS_SQL)
def extract_links(spark, sf):
    return corpus.extract_links(table(spark, sf, "pages"))


_SITE_SQL = D.registrable("host")


@register(
    "site_links",
    f"""WITH l AS ({LINKS_SQL}),
    f AS (SELECT *, {D.host('url')} AS host FROM l
      QUALIFY row_number() OVER (PARTITION BY page_id, {D.key('url')} ORDER BY pos) = 1),
    s AS (SELECT DISTINCT {D.host('url')} AS source_host, {D.registrable(D.host('url'))} AS site FROM pages),
    r AS (SELECT page_id, host, url, {_SITE_SQL} AS site FROM f)
    SELECT r.site, count(*) AS links, count(DISTINCT r.host) AS hosts, count(DISTINCT r.page_id) AS pages,
      max(n.source_hosts) AS source_hosts
    FROM r JOIN (SELECT site, count(*) AS source_hosts FROM s GROUP BY 1) n ON n.site = r.site GROUP BY 1""",
)
def site_links(spark, sf):
    """First-wins links per site of the crawl, with the hosts they point at."""
    pages = table(spark, sf, "pages")
    links = corpus.extract_links(pages)
    unique = ordering.dedupe_urls(links, ["page_id"]).select(
        "page_id", U.host(F.col("url")).alias("host")
    )
    per_host = unique.groupBy("host", "page_id").agg(F.count(F.lit(1)).alias("n"))
    sources = pages.select(U.host(F.col("url")).alias("host"))
    sites = sources.select(F.col("host"), joins.site_key(F.col("host")).alias("site")).distinct()
    counted = sites.groupBy("site").agg(F.count(F.lit(1)).alias("source_hosts"))
    placed = per_host.withColumn("site", joins.site_key(F.col("host"))).join(counted, "site")
    return placed.groupBy("site").agg(
        F.sum("n").alias("links"),
        F.count_distinct("host").alias("hosts"),
        F.count_distinct("page_id").alias("pages"),
        F.max("source_hosts").alias("source_hosts"),
    )


@register(
    "related_hosts",
    f"""WITH l AS (SELECT DISTINCT {D.host('url')} AS host FROM ({LINKS_SQL})),
    s AS (SELECT DISTINCT {D.host('url')} AS source_host FROM pages)
    SELECT l.host, s.source_host, {D.registrable('l.host')} AS site FROM l
    JOIN s ON {D.registrable('l.host')} = {D.registrable('s.source_host')}""",
)
def related_hosts(spark, sf):
    pages = table(spark, sf, "pages")
    links = corpus.extract_links(pages).select(U.host(F.col("url")).alias("host")).distinct()
    return joins.related_hosts(links, pages.select(U.host(F.col("url")).alias("host")))


@register(
    "first_wins",
    f"""SELECT page_id, url FROM pages
    QUALIFY row_number() OVER (PARTITION BY {D.key('url')} ORDER BY page_id) = 1""",
)
def first_wins(spark, sf):
    return ordering.dedupe_urls(table(spark, sf, "pages").select("page_id", "url"), pos="page_id")


# -- headings, text, kinds --------------------------------------------------------------------

_H = "|".join(rf"<h{i}\b[^>]*>.*?</h{i}>" for i in range(1, 5))
_INNER = r"(?is)^<h[1-4]\b[^>]*>(.*)</h[1-4]>$"


def _strip_sql(x: str) -> str:
    x = f"regexp_replace({x}, {D.q('(?is)<script' + chr(92) + 'b.*?</script>')}, ' ', 'g')"
    x = f"regexp_replace({x}, {D.q('(?is)<style' + chr(92) + 'b.*?</style>')}, ' ', 'g')"
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def _headings_sql() -> str:
    raw = (
        f"SELECT page_id, page_url, unnest(m) AS m, unnest(range(len(m))) AS pos FROM (SELECT page_id, url AS page_url,"
        f" regexp_extract_all(html, {D.q('(?is)' + _H)}) AS m FROM pages)"
    )
    attr = r"(?is)^<h[1-4]\b[^>]*?\bid=(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))[^>]*>.*$"
    inner = D.decode(_strip_sql(f"regexp_extract(m, {D.q(_INNER)}, 1)"))
    title = f"trim(regexp_replace({inner}, '\\s+', ' ', 'g'))"
    ident = "trim(" + D.decode(" || ".join(f"regexp_extract(m, {D.q(attr)}, {g})" for g in (1, 2, 3))) + ")"
    base = "regexp_extract(page_url, '^[A-Za-z]+://[^/?#]*', 0)"
    tail = "regexp_replace(page_url, '^[A-Za-z]+://[^/?#]*', '')"
    canon = f"lower({base}) || CASE WHEN starts_with({tail}, '/') THEN {tail} ELSE '/' || {tail} END"
    return f"""SELECT page_id, page_url, CAST(pos AS INT) AS pos, level, title, url FROM (
      SELECT page_id, page_url, pos, CAST(regexp_extract(m, '(?i)^<h([1-4])', 1) AS INT) AS level, {title} AS title,
        CASE WHEN {ident} = '' THEN {canon} ELSE regexp_replace({canon}, '#.*$', '') || '#' || {ident} END AS url
      FROM ({raw})) WHERE length(title) BETWEEN 2 AND 120 AND NOT {D.hit('title', rules.CHROME_HEADING)}
    QUALIFY row_number() OVER (PARTITION BY page_id, level, lower(title), url ORDER BY pos) = 1"""


HEADINGS_SQL = _headings_sql()


@register("html_headings", HEADINGS_SQL)
def html_headings(spark, sf):
    return corpus.html_headings(table(spark, sf, "pages"))


def _readable_sql(x: str) -> str:
    bs = "\\"
    for tag in ("script", "style", "svg"):
        x = f"regexp_replace({x}, {D.q(f'(?is)<{tag}{bs}b.*?</{tag}>')}, ' ', 'g')"
    chrome = "|".join(rf"<{t}\b.*?</{t}>" for t in ("nav", "header", "footer", "aside"))
    x = f"regexp_replace({x}, {D.q('(?is)' + chrome)}, ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</(h[1-6]|p|li|pre|tr|blockquote)>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({D.decode(x)}, '^\\s+|\\s+$', '', 'g')"


READABLE_SQL = f"SELECT page_id, {_readable_sql('html')} AS text FROM pages"


@register("readable_text", READABLE_SQL)
def readable_text(spark, sf):
    return corpus.readable_text(table(spark, sf, "pages")).select("page_id", "text")


_HEAD = "left(html, 4096)"
KIND_SQL = f"""CASE WHEN ends_with({D.path('url')}, '.xml') OR {D.hit('html', rules.SITEMAP_XML_START)} OR {D.hit('html', rules.SITEMAP_ROOT_START)} THEN 'sitemap'
  WHEN {D.hit(_HEAD, rules.HTML_START)} OR ({D.hit(_HEAD, rules.HTML_BODY_TAGS)} AND {D.hit(_HEAD, rules.HTML_META_TAGS)})
    OR ({D.hit(_HEAD, rules.HTML_ANCHOR)} AND {D.hit(_HEAD, rules.HTML_ANCHOR_END)} AND {D.hit(_HEAD, rules.HTML_HEADING)}) THEN 'html'
  ELSE 'text' END"""


@register("classify_body", f"SELECT page_id, {KIND_SQL} AS kind FROM pages")
def classify_body(spark, sf):
    return predicates.classify_body(table(spark, sf, "pages")).select("page_id", "kind")


# -- addresses --------------------------------------------------------------------------------


def admitted_sql(h: str) -> str:
    suffixes = "|".join(
        s.replace(".", "\\.") for s in rules.BLOCKED_HOST_SUFFIXES + rules.PREVIEW_HOST_SUFFIXES
    )
    parts = " OR ".join(f"contains({h}, {D.q(p)})" for p in rules.BLOCKED_HOST_PARTS)
    suffix = D.hit(h, f"(^|\\.)({suffixes})$")
    return f"({h} <> '' AND NOT ({h} IN {D.strings(rules.BLOCKED_HOSTS)} OR {suffix} OR {parts}))"


_BLOCKED_SITE = r"(^|\.)example\.org$"


@register(
    "admit_docs_urls",
    f"""SELECT page_id, url FROM pages WHERE {D.host('url')} <> ''
    AND NOT {D.hit(D.host('url'), _BLOCKED_SITE)} AND NOT contains({D.host('url')}, 'spam')""",
)
def admit_docs_urls(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return predicates.admit_docs_urls(pages, suffixes=["example.org"], parts=["spam"])


def docs_page_sql(url: str, source: str, adjacent: str = "false") -> str:
    h, p = D.host(url), f"lower({D.path(url)})"
    src = D.host(source)
    segs = D.segments(p)
    shape = (
        f"({p} <> '/' AND length({p}) >= 2 AND NOT {D.any_hit(p, rules.NON_DOCS_PATHS)} AND NOT {D.hit(p, rules.COMPANY_PATH)}"
        f" AND len({segs}) <= 6)"
    )
    label = f"string_split(regexp_replace({h}, '^www\\.', ''), '.')[1]"
    placeholder = f"len(list_filter({segs}, lambda s: {D.hit('s', rules.PLACEHOLDER_WORD)})) > 0"
    return (
        f"(({h} = {src} OR {D.last_two(h)} = {D.last_two(src)}) AND NOT (ends_with({p}, '.xml') OR {D.hit(p, rules.ASSET_FILE)}"
        f" OR {p} = '/' OR {D.hit(p, rules.MALFORMED_PATH)} OR {placeholder} OR {D.any_hit(p, rules.NON_DOCS_PATHS)})"
        f" AND ({D.hit(p, rules.DOCS_PATH)} OR (({label} IN {D.strings(rules.DOCS_HOST_LABELS)} OR {adjacent}) AND {shape})))"
    )


@register(
    "docs_page_urls",
    f"SELECT page_id, pos, url FROM ({LINKS_SQL}) WHERE {docs_page_sql('url', 'page_url', 'true')}",
)
def docs_page_urls(spark, sf):
    links = corpus.extract_links(table(spark, sf, "pages")).withColumn("adjacent", F.lit(True))
    kept = predicates.docs_page_urls(links, "url", "page_url", adjacent="adjacent")
    return kept.select("page_id", "pos", "url")


_LOCALE = "^[a-z]{2}(?:-[a-z]{2})?$"
_LOCALE_SQL = (
    f"CASE WHEN {D.hit('lower(' + D.segments(D.path('url')) + '[1])', _LOCALE)} THEN lower({D.segments(D.path('url'))}[1]) END"
)


@register(
    "locale_scope",
    f"""WITH p AS (SELECT page_id, url, {D.registrable(D.host('url'))} AS site, {_LOCALE_SQL} AS locale FROM pages),
    c AS (SELECT site, count(*) AS n, count(*) FILTER (locale = 'en') AS kept FROM p GROUP BY 1)
    SELECT page_id, url, p.site FROM p JOIN c USING (site) WHERE NOT (n >= 10 AND kept >= 10) OR locale = 'en'""",
)
def locale_scope(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id",
        "url",
        U.registrable_host(U.host(F.col("url"))).alias("site"),
        F.lit("https://example.com/en/").alias("source_url"),
    )
    return predicates.locale_scope(pages, ["site"]).select("page_id", "url", "site")


@register(
    "cap_per_group",
    f"""WITH p AS (SELECT page_id, url, {D.registrable(D.host('url'))} AS site, {D.hit('url', '^https')} AS prim,
        length({D.path('url')}) AS n FROM pages),
    a AS (SELECT * FROM p QUALIFY NOT prim OR row_number() OVER (PARTITION BY site, prim ORDER BY n DESC, page_id) <= 18),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, page_id) <= 28)
    SELECT page_id, url, site FROM b""",
)
def cap_per_group(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", "url", U.registrable_host(U.host(F.col("url"))).alias("site")
    )
    order = [F.length(U.path(F.col("url"))).desc(), "page_id"]
    capped = ordering.cap_per_group(pages, ["site"], order, F.col("url").startswith("https"))
    return capped.select("page_id", "url", "site")


_ORDER_SQL = f"CAST({D.first('lower(' + D.path('url') + ')', rules.URL_ORDER, 4)} AS STRING) || ':' || lower({D.path('url')})"


@register("docs_order", f"SELECT page_id, {_ORDER_SQL} AS order_key FROM pages")
def docs_order(spark, sf):
    return ordering.docs_order(table(spark, sf, "pages")).select("page_id", "order_key")


def sampled_sql(source: str, key: str, group: str, order: str, n: int, score: str) -> str:
    """Balanced sample in SQL: ``source`` has the key, the group and the order columns."""
    return f"""SELECT s.*, CAST(row_number() OVER (PARTITION BY s.{key} ORDER BY rnd, grp) AS INT) AS take_order FROM
      (SELECT *, row_number() OVER (PARTITION BY {key}, {group} ORDER BY {order}) AS rnd FROM {source}) s
      JOIN (SELECT {key} AS gk, {group} AS gg, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, {group}) AS grp
        FROM (SELECT {key}, {group}, count(*) AS size FROM {source} GROUP BY 1, 2)) g ON g.gk = s.{key} AND g.gg = s.{group}
      QUALIFY take_order <= {n}"""


@register(
    "balanced_sample",
    f"""WITH p AS (SELECT page_id, {D.registrable(D.host('url'))} AS site, {D.host('url')} AS host FROM pages)
    SELECT page_id, site, host, take_order FROM ({sampled_sql('p', 'site', 'host', 'page_id', 60, 'least(size, 80) + ' + D.weights('host', rules.GROUP_SCORES))})""",
)
def balanced_sample(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id",
        U.registrable_host(U.host(F.col("url"))).alias("site"),
        U.host(F.col("url")).alias("host"),
    )
    return ordering.balanced_sample(pages, ["site"], "host", ["page_id"], 60)


@register(
    "cursor_sample",
    f"""WITH RECURSIVE p AS (SELECT page_id, {D.registrable(D.host('url'))} AS site, {D.host('url')} AS host FROM pages),
    z AS (SELECT site, host, count(*) AS size, min(page_id) AS first FROM p GROUP BY 1, 2),
    g AS (SELECT *, least(size, 80) + {D.weights('host', rules.GROUP_SCORES)} AS score FROM z),
    l AS (SELECT site, list(host ORDER BY score DESC, first) AS hosts, list(size ORDER BY score DESC, first) AS sizes FROM g GROUP BY 1),
    f AS (SELECT site, 0 AS i, 0 AS cursor, hosts, sizes, CAST(NULL AS VARCHAR) AS host FROM l
      UNION ALL
      SELECT site, i + 1, CASE WHEN sizes[nth] = 1 THEN 0 ELSE cursor + 1 END,
        CASE WHEN sizes[nth] = 1 THEN list_concat(hosts[:nth - 1], hosts[nth + 1:]) ELSE hosts END,
        CASE WHEN sizes[nth] = 1 THEN list_concat(sizes[:nth - 1], sizes[nth + 1:]) ELSE list_concat(list_append(sizes[:nth - 1], sizes[nth] - 1), sizes[nth + 1:]) END, hosts[nth]
      FROM (SELECT *, cursor % len(hosts) + 1 AS nth FROM f WHERE len(hosts) > 0 AND i < 60)),
    v AS (SELECT site, host, i, row_number() OVER (PARTITION BY site, host ORDER BY i) AS k FROM f WHERE i > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY site, host ORDER BY page_id) AS k FROM p)
    SELECT r.page_id, r.site, r.host, CAST(v.i AS INT) AS take_order FROM v JOIN r ON r.site = v.site AND r.host = v.host AND r.k = v.k""",
)
def cursor_sample(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id",
        U.registrable_host(U.host(F.col("url"))).alias("site"),
        U.host(F.col("url")).alias("host"),
    )
    return ordering.cursor_sample(pages, ["site"], "host", ["page_id"], 60).select("page_id", "site", "host", "take_order")


_TITLE_FROM_SLUG = (
    "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace({x}, '(?i)\\.[a-z0-9]+$', ''), '[-_]+'), lambda w: w <> ''),"
    " lambda w: CASE WHEN lower(w) IN {a} THEN upper(w) ELSE replace(upper(w[1]), 'ẞ', 'SS') || w[2:] END), ' ')"
)


def slug_title_sql(x: str) -> str:
    t = _TITLE_FROM_SLUG.format(x=x, a=D.strings(rules.SLUG_ACRONYMS))
    return f"(CASE WHEN {t} = '' THEN 'Documentation' ELSE {t} END)"


def site_group_sql(url: str) -> str:
    """Section title of an address, following the path from its first section segment."""
    segs = D.segments(D.path(url))
    return f"""(SELECT array_to_string(list_transform(list_filter(CASE
        WHEN i IS NOT NULL AND ((i = 1 AND NOT {D.hit('s[1]', rules.PLAIN_DOCS_SEGMENT)}) OR {D.hit('lower(CASE WHEN i = 1 THEN s[-1] ELSE s[i - 1] END)', rules.VERSION_SEGMENT)})
          THEN [s[i], CASE WHEN NOT {D.hit('lower(s[i + 1])', rules.LEAD_IN_SEGMENT)} THEN s[i + 1] END]
        WHEN i IS NOT NULL THEN [coalesce(s[i + 1], s[i]), CASE WHEN NOT {D.hit('lower(s[i + 2])', rules.LEAD_IN_SEGMENT)} THEN s[i + 2] END]
        ELSE [coalesce(s[1], 'docs'), CASE WHEN NOT {D.hit('lower(s[2])', rules.LEAD_IN_SEGMENT)} THEN s[2] END] END,
        lambda v: v IS NOT NULL), lambda v: {slug_title_sql('v')}), ' / ')
      FROM (SELECT {segs} AS s, nullif(list_position(list_transform({segs}, lambda v: {D.hit('v', rules.SECTION_SEGMENT)}), true), 0) AS i))"""


_SITE_GROUP = site_group_sql("url")


@register(
    "link_index",
    f"""WITH l AS (SELECT page_id, pos, url, page_url FROM ({LINKS_SQL}) WHERE {docs_page_sql('url', 'page_url', 'true')}
      QUALIFY row_number() OVER (PARTITION BY page_id, {D.key('url')} ORDER BY pos) = 1),
    loc AS (SELECT *, {_LOCALE_SQL} AS own, {_LOCALE_SQL.replace('url', 'page_url')} AS wanted FROM l),
    c AS (SELECT page_id, count(*) AS n, count(*) FILTER (own IS NOT DISTINCT FROM wanted) AS kept FROM loc GROUP BY 1),
    sc AS (SELECT page_id, url, {_SITE_GROUP} AS grp_title, {_ORDER_SQL} AS ord FROM loc JOIN c USING (page_id)
      WHERE NOT (n >= 10 AND kept >= 10) OR own IS NOT DISTINCT FROM wanted),
    h AS ({HEADINGS_SQL}),
    k AS (SELECT p.page_id, coalesce(lc.n, 0) AS links, coalesce(lc.g, 0) AS groups, coalesce(hc.n, 0) AS heads,
        lower({D.path('url')}) AS path FROM pages p
      LEFT JOIN (SELECT page_id, count(*) AS n, count(DISTINCT grp_title) AS g FROM sc GROUP BY 1) lc USING (page_id)
      LEFT JOIN (SELECT page_id, count(*) AS n FROM h GROUP BY 1) hc USING (page_id)),
    ch AS (SELECT page_id, CASE WHEN heads >= 10 AND (heads >= greatest(30, links * 3) OR (heads >= 20 AND {D.hit('path', rules.HEADING_INDEX_PATH)})) THEN 'headings'
        WHEN links < 10 AND links >= 5 AND groups >= 2 THEN 'links' WHEN links < 10 AND heads >= 10 THEN 'headings'
        WHEN links >= 10 AND groups >= 2 THEN 'links' END AS kind FROM k)
    SELECT page_id, kind, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord, url) AS INT) AS pos, grp_title AS "group",
      {slug_title_sql('list_last(' + D.segments(D.path('url')) + ')')} AS title, url FROM sc JOIN ch USING (page_id) WHERE kind = 'links'
    UNION ALL
    SELECT page_id, kind, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS pos,
      coalesce(last_value(CASE WHEN level <= 2 THEN title END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos), 'Documentation') AS "group",
      title, url FROM h JOIN ch USING (page_id) WHERE kind = 'headings'""",
)
def link_index(spark, sf):
    return corpus.link_index(table(spark, sf, "pages"), adjacent=F.lit(True))


_LABEL = "array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace({x}, '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: CASE WHEN lower(w) IN {a} THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ')"
_TOPIC = _LABEL.format(x="p", a=D.strings(rules.TOPIC_ACRONYMS))
_SEG = f"list_filter({D.segments(D.path('url'))}, lambda s: NOT {D.hit('s', rules.TOPIC_SKIPPED_SEGMENT)} AND NOT {D.hit('s', rules.TOPIC_VERSION_SEGMENT)} AND {D.hit('s', rules.TOPIC_SEGMENT)})[1]"
_USEFUL_TOPIC = f"length(label) BETWEEN 3 AND 80 AND NOT contains(label, '/') AND NOT {D.any_hit('label', [rules.TOPIC_BLOG, rules.TOPIC_CHROME, rules.TOPIC_TOO_GENERIC])}"


@register(
    "topic_counts",
    f"""{cte('entries')}, p AS (SELECT repo_id, pos, unnest(list_append(string_split_regex(coalesce("group", ''), '\\s+/\\s+'), {_SEG})) AS p FROM entries),
    l AS (SELECT DISTINCT repo_id, pos, {_TOPIC} AS label FROM p WHERE p IS NOT NULL)
    SELECT repo_id, label, count(*) AS count FROM l WHERE {_USEFUL_TOPIC} GROUP BY 1, 2 HAVING count(*) >= 3
    QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, label) <= 12""",
)
def topic_counts(spark, sf):
    return rollups.topic_counts(derive(spark, sf, "entries"), 3, 12, "topic")


@register(
    "sitemap_urls",
    f"""WITH p AS (SELECT page_id, url AS page_url, '<urlset><loc>' || url || '</loc><loc> https://' || {D.host('url')} || '/en/sitemap.xml </loc><loc>https://' || {D.host('url')} || '/docs/latest/sitemap.xml</loc></urlset>' AS html FROM pages),
    l AS (SELECT page_id, page_url, unnest(m) AS loc, unnest(range(len(m))) AS pos FROM (SELECT page_id, page_url, regexp_extract_all(html, '(?i)<loc>\\s*([^<]+?)\\s*</loc>', 1) AS m FROM p)),
    u AS (SELECT page_id, page_url, CAST(pos AS INT) AS pos, loc AS url, {D.path('loc')} AS path FROM l)
    SELECT page_id, page_url, pos, url, ends_with(lower(path), '.xml') AND {D.hit('lower(path)', rules.NESTED_SITEMAP)} AS is_nested,
      {D.hit('path', rules.ENGLISH_SITEMAP)} AS is_english, {D.hit('path', rules.DOCS_SITEMAP)} AS has_docs_path,
      CAST(CASE WHEN {D.hit('path', rules.ENGLISH_SITEMAP)} THEN 100 ELSE 0 END + CASE WHEN {D.hit('path', rules.DOCS_SITEMAP)} THEN 50 ELSE 0 END
        + CASE WHEN contains(lower(path), '/latest/') THEN 20 ELSE 0 END AS INT) AS nested_score FROM u""",
)
def sitemap_urls(spark, sf):
    pages = table(spark, sf, "pages")
    site = F.concat(F.lit("https://"), U.host(F.col("url")))
    body = F.concat(
        F.lit("<urlset><loc>"),
        F.col("url"),
        F.lit("</loc><loc> "),
        site,
        F.lit("/en/sitemap.xml </loc><loc>"),
        site,
        F.lit("/docs/latest/sitemap.xml</loc></urlset>"),
    )
    return corpus.sitemap_urls(pages.select("page_id", "url", body.alias("html")))


# A landed sitemap for every page: of each three, one lists its page and a document beside it, the others hand on to
# sitemaps of later pages, to each other and to one that never landed.
_MAP_URL = "'https://' || {h} || CASE WHEN {n} % 2 = 0 THEN '/docs/sitemap-' ELSE '/en-x/docs-sitemap-' END || CAST({n} AS STRING) || '.xml'"


def _map_body(n: str, h: str, url: str) -> str:
    def loc(x: str) -> str:
        return f"'<sitemap><loc>' || {x} || '</loc></sitemap>'"

    nested = [_MAP_URL.format(h=h, n=f"({n} * 2 + {i})") for i in (1, 2)] + [_MAP_URL.format(h=h, n=n), f"'https://' || {h} || '/docs/absent-sitemap.xml'"]
    nested += [f"'https://' || {h} || '/blog/sitemap.txt.xml'", f"'https://' || {h} || '/en/sitemap.xml'"]
    nested[-1] = f"'https://' || {h} || CASE WHEN {n} % 7 = 0 THEN '/en/sitemap.xml' ELSE '/guide/sitemap-a.xml' END"
    handing = " || ".join(loc(x) for x in nested)
    own, beside = f"regexp_replace({url}, '#.*$', '')", f"'https://' || {h} || '/docs/page-' || CAST({n} AS STRING)"
    return f"CASE WHEN {n} % 3 = 1 THEN {loc(own)} || {loc(beside)} ELSE {handing} END"


_MAP_HOST = "'docs' || CAST(page_id % 5 AS STRING) || '.acme.dev'"
_MAP_N = "CAST(floor(page_id / 5) AS BIGINT)"
_MAPS = f"page_id, {_MAP_URL.format(h=_MAP_HOST, n=_MAP_N)} AS url, {_map_body(_MAP_N, _MAP_HOST, 'url')} AS html"


@register(
    "sitemap_documents",
    f"""WITH RECURSIVE m AS (SELECT page_id, {_MAP_URL.format(h=_MAP_HOST, n=_MAP_N)} AS url, {_map_body(_MAP_N, _MAP_HOST, 'pages.url')} AS html FROM pages),
    l AS (SELECT url AS sitemap, unnest(x) AS loc, unnest(range(len(x))) AS pos FROM (SELECT url, regexp_extract_all(html, '(?i)<loc>\\s*([^<]+?)\\s*</loc>', 1) AS x FROM m)),
    f AS (SELECT *, {D.path('loc')} AS path, {D.hit(D.path('loc'), rules.ENGLISH_SITEMAP)} AS en, {D.hit(D.path('loc'), rules.DOCS_SITEMAP)} AS dp FROM l),
    d AS (SELECT sitemap, loc AS url FROM f WHERE NOT ends_with(lower(path), '.xml')),
    g AS (SELECT * FROM f WHERE ends_with(lower(path), '.xml') AND {D.hit('lower(path)', rules.NESTED_SITEMAP)} AND sitemap NOT IN (SELECT sitemap FROM d)),
    e AS (SELECT sitemap, loc FROM (SELECT *, bool_or(en) OVER (PARTITION BY sitemap) AS any_en FROM g) WHERE NOT any_en OR en OR dp
      QUALIFY row_number() OVER (PARTITION BY sitemap ORDER BY CASE WHEN en THEN 100 ELSE 0 END + CASE WHEN dp THEN 50 ELSE 0 END
        + CASE WHEN contains(lower(path), '/latest/') THEN 20 ELSE 0 END DESC, pos) <= 3),
    r AS (SELECT page_id, url FROM m UNION SELECT r.page_id, e.loc FROM r JOIN e ON e.sitemap = r.url)
    SELECT DISTINCT r.page_id, d.url FROM r JOIN d ON d.sitemap = r.url""",
)
def sitemap_documents(spark, sf):
    """Documents reachable from every landed sitemap, through all that are nested in it."""
    maps = computed(table(spark, sf, "pages"), _MAPS)
    return corpus.sitemap_documents(maps.select("page_id", "url"), maps, ["page_id"], n=3).select("page_id", "url")


# -- documents --------------------------------------------------------------------------------


def _metrics_sql(t: str) -> str:
    bs = "\\"
    p = f"regexp_replace({t}, '(?s)```.*?```', ' ', 'g')"
    p = f"regexp_replace({p}, {D.q('`[^`' + bs + 'n]+`')}, ' ', 'g')"
    p = f"regexp_replace({p}, {D.q('(?im)^.*' + bs + 'bSources:' + bs + 's*.*$')}, ' ', 'g')"
    p = f"regexp_replace({p}, {D.q('https?://' + bs + 'S+')}, ' ', 'g')"
    p = f"regexp_replace({p}, '[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+', ' ', 'g')"
    c = {
        "prose_words": D.count(p, "[A-Za-z0-9][A-Za-z0-9'-]*"),
        "raw_words": f"CAST(len(list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')) AS BIGINT)",
        "h2": D.count(t, r"(?m)^##\s+"),
        "h3": D.count(t, r"(?m)^###\s+"),
        "index_headings": D.count(t, r"#{2,6}\s+"),
        "links": f"{D.count(t, r'\[[^\]\n]*\]\([^)]+?\)')} - {D.count(t, r'\[[^\]\n]*\]\(#[^)]*?\)')}",
        "table_rows": D.count(t, r"(?m)^\|.+\|$"),
        "fences": D.count(t, "(?m)^```"),
        "inline_code": D.count(t, r"`[^`\n]+`"),
        "option_bullets": D.count(t, r"(?m)^\s*[-*]\s+`[^`\n]+`"),
    }
    return ", ".join(f"{v} AS {k}" for k, v in c.items())


def draft_markdown_sql() -> str:
    """A Markdown page around each document's text, in SQL both engines read."""
    return (
        "'# Notes' || chr(10) || chr(10) || '## Relevant Source Files' || chr(10) || '- `src/index.ts`: entry' || chr(10)"
        " || '## Use' || chr(10) || text || chr(10) || '### Options' || chr(10) || '| a | b |' || chr(10) || '```' || chr(10)"
        " || 'npm install' || chr(10) || '```' || chr(10) || '[guide](/docs/guide) and [top](#top)' || chr(10) || 'Sources: src/index.ts'"
    )


@register(
    "text_metrics",
    f"SELECT doc_id, {_metrics_sql('text')} FROM (SELECT doc_id, {draft_markdown_sql()} AS text FROM documents)",
)
def text_metrics(spark, sf):
    docs = computed(table(spark, sf, "documents"), f"doc_id, {draft_markdown_sql()} AS text")
    metrics = corpus.text_metrics(docs).drop("text")
    return metrics.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in metrics.columns if c != "doc_id"]
    )


@register(
    "artifact_rows",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'wiki_markdown' ELSE 'file_inventory' END AS kind,
      CASE WHEN doc_id % 2 = 0 THEN 'repos/' || source || '/wiki/p' || CAST(doc_id AS STRING) || '/revisions/r1.md'
        ELSE 'repos/' || source || '/revisions/r1/file-inventory.json' END AS key,
      CASE WHEN doc_id % 2 = 0 THEN 'text/markdown; charset=utf-8' ELSE 'application/json' END AS content_type,
      sha256(text) AS sha256, CAST(strlen(text) AS INT) AS byte_size FROM documents""",
)
def artifact_rows_query(spark, sf):
    even = F.col("doc_id") % 2 == 0
    content = table(spark, sf, "documents").select(
        "doc_id",
        F.when(even, F.lit("wiki_markdown")).otherwise(F.lit("file_inventory")).alias("kind"),
        F.col("source").alias("repo_id"),
        F.lit("r1").alias("revision_id"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("page_id"),
        "text",
    )
    return artifact_rows(content).select("doc_id", "kind", "key", "content_type", "sha256", "byte_size")


@register(
    "duplicate_texts",
    """SELECT source AS repo_id, sha256(text) AS slug, count(*) AS pages FROM documents GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_texts(spark, sf):
    """Exact repeats of a text within a source, by content hash as the slug."""
    pages = table(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), F.sha2("text", 256).alias("slug")
    )
    return rollups.duplicate_slugs(pages)


@register(
    "recent_history",
    """SELECT conv_id, turn, role, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 4000) AS content FROM conversations
    WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8""",
)
def recent_history(spark, sf):
    return ordering.recent_history(table(spark, sf, "conversations"))


_CITING = (
    "text || ' see `src/app/' || CAST(turn AS STRING) || '.ts` and [the docs](./docs/guide-' || CAST(conv_id % 5 AS STRING) || '.md#top)'"
    " || ' or https://github.com/acme/kit/blob/main/lib/x' || CAST(turn AS STRING) || '.py#L3 and lib/y.go:12.'"
)


@register(
    "extract_citations",
    """WITH c AS (SELECT conv_id, turn, list_distinct(['src/app/' || CAST(turn AS STRING) || '.ts']) AS a,
        ['docs/guide-' || CAST(conv_id % 5 AS STRING) || '.md'] AS b, ['lib/x' || CAST(turn AS STRING) || '.py'] AS c,
        ['lib/y.go'] AS d FROM conversations)
    SELECT conv_id, turn, CAST(unnest(range(4)) AS INT) AS pos, unnest(list_concat(list_concat(a, b), list_concat(c, d))) AS path FROM c""",
)
def extract_citations(spark, sf):
    """Files cited by messages that end in one citation of every form."""
    messages = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_CITING} AS text")
    return corpus.extract_citations(messages)


@register(
    "toc",
    """WITH r AS (SELECT doc_id, unnest(range(4)) AS n, lang FROM documents)
    SELECT doc_id AS page_id, CAST(n AS INT) AS pos, CAST(CASE WHEN n = 2 THEN 3 ELSE 2 END AS INT) AS depth,
      CASE n WHEN 0 THEN 'Use in ' || lang WHEN 1 THEN 'Options' WHEN 2 THEN 'Options' ELSE 'The guide' END AS title,
      CASE n WHEN 0 THEN 'use-in-' || lang WHEN 1 THEN 'options' WHEN 2 THEN 'options-2' ELSE 'the-guide' END AS id FROM r""",
)
def toc(spark, sf):
    md = (
        "'## Use in ' || lang || chr(10) || '## `Options`' || chr(10) || '### Options' || chr(10) || '## The [guide](x.md)'"
        " || chr(10) || '#### deep' || chr(10) || text"
    )
    pages = table(spark, sf, "documents").selectExpr("doc_id AS page_id", f"{md} AS markdown")
    return corpus.toc(pages)


@register(
    "url_mentions",
    f"""{cte('doc')}, m AS (SELECT repo_id, pos AS doc_pos, unnest(['https://docs.acme.dev/p' || CAST(pos % 45 AS STRING), 'https://www.acme.dev/']) AS url,
        unnest([0, 1]) AS nth FROM doc),
    f AS (SELECT *, row_number() OVER (PARTITION BY repo_id, url ORDER BY doc_pos, nth) AS n FROM m)
    SELECT repo_id, url, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY doc_pos, nth) AS INT) AS pos FROM f WHERE n = 1
    QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY doc_pos, nth) <= 40""",
)
def url_mentions(spark, sf):
    text = (
        "text || ' See https://docs.acme.dev/p' || CAST(pos % 45 AS STRING) || '#top, (https://WWW.acme.dev) and https://github.com/a/b.'"
    )
    docs = derive(spark, sf, "doc").selectExpr("repo_id", "pos", f"{text} AS text")
    return corpus.url_mentions(docs).select("repo_id", "url", "pos")
