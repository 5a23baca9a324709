"""Queries of the scored matching, quality and candidate operators over derived repositories.

The SQL side scores every pair of a repository; the operators must find the same without doing so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import urls as U
from docloom.operators import joins, matching, navtree, ordering, quality, rollups
from docloom.plans import duck as D
from docloom.plans.catalog import register
from docloom.plans.corpus import _SEG, _TOPIC, _USEFUL_TOPIC
from docloom.plans.inputs import cte, table
from docloom.plans.repositories import (
    _EVIDENCE_SQL,
    CLASSES_SQL,
    GENERIC_SQL,
    MIN_SECTIONS_SQL,
    MIN_WORDS_SQL,
    _PLAIN,
    entries,
    evidence,
    nav,
    outline,
    tree,
)
from docloom.session import joinable

_NAME = "acme-router"


def repos(spark, sf):
    ids = tree(spark, sf).select("repo_id").distinct()
    return ids.select("repo_id", F.lit("acme").alias("owner"), F.lit(_NAME).alias("name"))


def _case(cond: str, weight: object) -> str:
    return f"CASE WHEN coalesce({cond}, false) THEN {weight} ELSE 0 END"


# -- pages and entries ------------------------------------------------------------------------

_NS = f"CASE {' '.join(f'WHEN {D.hit(chr(112), p)} THEN {D.q(n)}' for p, n in rules.URL_NAMESPACES)} ELSE nullif(regexp_extract(p, {D.q(rules.DOCS_FAMILY_NAMESPACE)}, 1), '') END"
_URL_SLUG = f"""list_filter(list_transform(string_split(regexp_replace({D.path('url')}, '(?i)\\.(md|mdx|html?)$', ''), '/'), lambda v: {D.slug('v')}),
  lambda v: v <> '' AND NOT {D.hit('v', rules.GENERIC_URL_PART)})[-1]"""
_E_SQL = f"""e AS (SELECT repo_id, pos AS entry_pos, url AS entry_url, {D.slug('title')} AS et, {GENERIC_SQL} AS g, {_URL_SLUG} AS es,
    (SELECT {_NS} FROM (SELECT lower({D.path('url')}) AS p)) AS ns, {D.slug("coalesce(\"group\", '') || ' ' || title || ' ' || url")} AS etext,
    list_filter(string_split({D.slug("coalesce(\"group\", '')")}, '-'), lambda w: length(w) >= 4 AND w NOT IN {D.strings(rules.GENERIC_MATCH_WORDS)})[:8] AS ws FROM entries)"""
_TOPIC_SQL = f"""list_filter([CASE WHEN s LIKE '%-overview' THEN s[:-10] END, CASE WHEN s LIKE 'overview-%' THEN s[10:] END,
    CASE WHEN t LIKE '%-overview' THEN t[:-10] END, CASE WHEN t LIKE 'overview-%' THEN t[10:] END],
    lambda v: v IS NOT NULL AND length(v) >= 2 AND NOT {D.hit('v', rules.SECTION_TOPIC_TOO_GENERIC)})[1]"""
_P_SQL = f"""p0 AS (SELECT repo_id, pos, {D.slug('slug')} AS s, {D.slug('title')} AS t, {D.slug('purpose')} AS pu FROM outline),
    p AS (SELECT *, s || ' ' || t || ' ' || pu AS txt, {_TOPIC_SQL} AS topic FROM p0 WHERE NOT (s = 'overview' AND contains(t, 'overview')))"""
_OTHER_REACT = "(^|-)(react-dom|react-compiler|eslint-plugin-react-hooks|rules-of-react)(-|$)"
_NS_HIT = f"CASE WHEN ns = 'react' THEN {D.hit('s', '(^|-)react(-|$)')} AND NOT {D.hit('s', _OTHER_REACT)} ELSE contains(s, ns) OR contains(t, ns) END"
_MATCH_SCORE = " + ".join(
    [
        _case("et <> '' AND t = et", "CASE WHEN g THEN 8 ELSE 36 END"),
        _case("et <> '' AND s = et", 34),
        _case("et <> '' AND ends_with(s, '-' || et)", 24),
        _case("et <> '' AND NOT g AND contains(txt, et)", 18),
        _case("s = es", 34),
        _case("ends_with(s, '-' || es)", 24),
        _case("contains(txt, es)", 12),
        _case(f"ns IS NOT NULL AND g AND ({_NS_HIT})", 46),
        _case(f"ns IS NOT NULL AND g AND NOT ({_NS_HIT}) AND contains(txt, 'react')", -32),
        "6 * len(list_filter(ws, lambda w: contains(s, w) OR contains(t, w) OR contains(pu, w)))",
    ]
)
_BEST_SQL = f"""{_E_SQL}, {_P_SQL}, best AS (SELECT repo_id, pos, entry_pos, entry_url, CAST(score AS INT) AS score FROM
    (SELECT *, CASE WHEN topic IS NOT NULL AND g AND NOT (contains(etext, topic) OR (topic LIKE '%s' AND contains(etext, topic[:-2]))) THEN 0 ELSE {_MATCH_SCORE} END AS score
     FROM p JOIN e USING (repo_id)) WHERE score >= 35
    QUALIFY row_number() OVER (PARTITION BY repo_id, pos ORDER BY score DESC, entry_url, entry_pos) = 1)"""


@register("match_entries", f"{cte('entries', 'outline')}, {_BEST_SQL} SELECT * FROM best")
def match_entries(spark, sf):
    return matching.match_entries(outline(spark, sf), entries(spark, sf))


# -- entries and files ------------------------------------------------------------------------


def _camel(x: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def _list(values) -> str:
    return "[" + ", ".join(D.q(v) for v in values) + "]"


_ETEXT = "coalesce(\"group\", '') || ' ' || title || ' ' || url"
_OWN = [w for w in _NAME.split("-") if len(w) >= 4]
_ADDED = ", ".join(f"CASE WHEN {D.hit(_ETEXT, p)} THEN {D.q(t)} END" for p, t in rules.ADDED_TERMS)
_TERMS = f"""list_distinct(list_filter(list_concat(list_filter({_camel(_ETEXT)}, lambda w: (length(w) >= 4 OR w IN {D.strings(rules.USEFUL_SHORT_TERMS)})
    AND w NOT IN {D.strings(rules.GENERIC_SOURCE_TERMS)} AND w NOT IN {D.strings(_OWN)}),
  [{_ADDED}, CASE WHEN {D.hit(D.slug('title'), rules.ALWAYS_TERMS)} THEN {D.slug('title')} END]), lambda w: w IS NOT NULL))"""


def _comparable(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '^\\d+-', ''), '[^a-z0-9]+', '-', 'g'), '-')"


_E_SEGS = f"list_filter(list_transform(string_split({D.path('url')}, '/'), lambda v: {_comparable('v')}), lambda v: v <> '' AND NOT {D.hit('v', rules.GENERIC_DOCS_ROOT)})"
_RAW_SEGS = f"list_filter(list_transform(string_split(regexp_replace(path, {D.q(rules.COMPARABLE_EXTENSION)}, ''), '/'), lambda v: {_comparable('v')}), lambda v: v <> '')"
_F_SEGS = (
    "CASE "
    + " ".join(
        f"WHEN r[:{len(p.split('/'))}] = {_list(p.split('/'))} THEN r[{len(p.split('/')) + 1}:]"
        for p in rules.DOCS_CONTENT_PREFIXES
    )
    + " ELSE [] END"
)


def _any_of(lst: str, words) -> str:
    return f"list_has_any({lst}, {_list(words)})"


def _asked(rule: rules.SurfaceRule) -> str:
    tests = [_any_of("terms", rule.any_of)]
    tests += [" AND ".join(f"list_contains(terms, {D.q(x)})" for x in words) for words in rule.all_of]
    return "(" + " OR ".join(f"({t})" for t in tests) + ")"


_SURFACE = " + ".join(_case(f"{_asked(r)} AND {_any_of('words', r.path_words)}", r.weight) for r in rules.SURFACE_RULES)
_TERM_SUM = """coalesce(list_sum(list_transform(terms, lambda x: CASE WHEN list_contains(words, x) THEN CASE WHEN length(x) <= 3 THEN 28 WHEN length(x) > 6 THEN 18 ELSE 14 END
  WHEN length(x) <= 3 OR NOT contains(lower(path), x) THEN 0 WHEN length(x) > 6 THEN 8 ELSE 4 END)), 0)"""
_SIDES = {k: D.hit("lower(path)", p) for k, p in rules.SIDE_PATHS.items()}


def _has(term: str) -> str:
    return f"list_contains(terms, '{term}')"


_BOTH = f"({_has('client')} AND {_has('server')})"
_REST = " + ".join(
    [
        D.weights("path", rules.PATH_BOOSTS),
        *[
            f"CASE WHEN {D.hit('path', p)} THEN CASE WHEN {_any_of('terms', words)} THEN {yes} ELSE {no} END ELSE 0 END"
            for p, words, yes, no in rules.PATH_BOOSTS_BY_TERM
        ],
        f"CASE WHEN {D.hit('lower(path)', rules.LINT_PATH)} OR ({_any_of('terms', rules.LINT_TERMS)} AND {D.hit('lower(path)', rules.LINT_RULE_PATH)})"
        f" THEN CASE WHEN {_any_of('terms', rules.LINT_TERMS)} THEN 32 ELSE -56 END ELSE 0 END",
        _case(f"{_has('client')} AND {_SIDES['client']}", 22),
        _case(f"{_has('client')} AND NOT {_BOTH} AND ({_SIDES['server']} OR {_SIDES['static']})", -44),
        _case(f"{_has('server')} AND {_SIDES['server']}", 22),
        _case(f"{_has('server')} AND NOT {_BOTH} AND ({_SIDES['client']} OR {_SIDES['static']})", -44),
        _case(f"{_has('static')} AND {_SIDES['static']}", 22),
        _case(f"{_has('static')} AND ({_SIDES['client']} OR {_SIDES['server']})", -44),
    ]
)


def _ends(a: str, b: str) -> str:
    return f"(len({b}) > 0 AND len({b}) <= len({a}) AND {a}[len({a}) - len({b}) + 1:] = {b})"


_DOCS = (
    f"CASE WHEN len(fs) = 0 OR len(es) = 0 THEN 0 ELSE CASE WHEN {_ends('fs', 'es')} THEN 160 WHEN {_ends('fs', 'es[2:]')} THEN 120"
    f" WHEN fs[-1] = es[-1] THEN 72 ELSE 0 END + CASE WHEN {D.hit('path', rules.DOCS_CONTENT_PATH)} THEN 24 ELSE 0 END END"
)
_FALLBACK = f"CAST(greatest(0, {D.weights('lower(path)', rules.RULE_SETS['path_fallback'].rules)} + CASE WHEN {D.hit('lower(path)', '^packages/acme-router/(index|package[.]json|src/(index|main|reactclient)[.](ts|tsx|js|jsx|mjs|cjs))$')} THEN 90 ELSE 0 END) AS INT)"


@register(
    "match_source_paths",
    f"""{cte('entries', 'tree')}, e AS (SELECT repo_id, pos, {_TERMS} AS terms, {_E_SEGS} AS es FROM entries),
    f AS (SELECT repo_id, path, words, {_F_SEGS} AS fs FROM (SELECT DISTINCT repo_id, path, {_camel('path')} AS words, {_RAW_SEGS} AS r FROM tree)),
    x AS (SELECT *, {_DOCS} AS docs, {_TERM_SUM} + CASE WHEN {_has('dom')} AND contains(lower(path), 'react-dom') THEN 12 ELSE 0 END AS gain, {_SURFACE} AS su FROM e JOIN f USING (repo_id)),
    y AS (SELECT repo_id, pos, path, CAST(docs AS INT) AS docs_score, CAST(docs + gain + su + CASE WHEN su > 0 AND {D.hit('path', '(?i)^docs?/')} THEN 18 ELSE 0 END + {_REST} AS INT) AS score
      FROM x WHERE docs + gain + su <> 0),
    z AS (SELECT * FROM y WHERE score >= 10),
    d AS (SELECT repo_id, pos, path, score, docs_score, row_number() OVER (PARTITION BY repo_id, pos ORDER BY docs_score DESC, score DESC, path) AS rank, 'docs' AS source FROM z WHERE docs_score >= 140 QUALIFY rank <= 3),
    s AS (SELECT repo_id, pos, path, score, docs_score, row_number() OVER (PARTITION BY repo_id, pos ORDER BY score DESC, path) AS rank, 'scored' AS source FROM z
      WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.repo_id = z.repo_id AND d.pos = z.pos) QUALIFY rank <= 6),
    fb AS (SELECT repo_id, path, score, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) AS rank FROM (SELECT DISTINCT repo_id, path, {_FALLBACK} AS score FROM tree) WHERE score > 0 QUALIFY rank <= 6),
    found AS (SELECT * FROM d UNION ALL SELECT * FROM s)
    SELECT repo_id, pos, path, score, docs_score, CAST(rank AS INT) AS rank, source FROM found
    UNION ALL SELECT e.repo_id, e.pos, fb.path, fb.score, CAST(0 AS INT), CAST(fb.rank AS INT), 'fallback' FROM e JOIN fb USING (repo_id)
      WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.repo_id = e.repo_id AND found.pos = e.pos)""",
)
def match_source_paths(spark, sf):
    return matching.match_source_paths(entries(spark, sf), tree(spark, sf), repos(spark, sf))


# -- snippets ---------------------------------------------------------------------------------


def _stems(words: str, limit: int) -> str:
    variants = (
        "[w, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' END, CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN w[:-4] END,"
        " CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN w[:-4] || 'e' END, CASE WHEN w LIKE '%ed' AND length(w) > 4 THEN w[:-3] END,"
        " CASE WHEN w LIKE '%s' AND length(w) > 4 THEN w[:-2] END]"
    )
    flat = f"flatten(list_transform({words}, lambda w: list_filter({variants}, lambda v: v IS NOT NULL AND length(v) >= 3)))"
    return f"(SELECT {D.distinct_in_order('fl')}[:{limit}] FROM (SELECT {flat} AS fl))"


_CONCEPT_RAW = f"list_filter({D.words('title')}, lambda w: w NOT IN {D.strings(rules.GENERIC_TITLE_WORDS)})"
_KEYWORD_RAW = f"list_filter({D.words(chr(39) + chr(39) + ' || title || chr(32) || slug || chr(32) || purpose')}, lambda w: w NOT IN {D.strings(rules.PAGE_KEYWORD_STOP_WORDS)})"


def _n_in(lst: str, text: str) -> str:
    return f"len(list_filter({lst}, lambda w: contains({text}, w)))"


_SNIPPET = " + ".join(
    [
        _case("length(pt) >= 4 AND contains(t, pt)", 55),
        _case("length(ps) >= 4 AND contains(u, ps)", 34),
        f"24 * {_n_in('ws', 't')} + 46 * len(list_filter(ws, lambda w: starts_with(t, w))) + 12 * len(list_filter(ws, lambda w: list_contains(tk, w))) + 8 * {_n_in('ws', 'u')}",
        _case(f"len(ws) > 0 AND {_n_in('ws', 't')} + {_n_in('ws', 'u')} = 0", -28),
        _case(f"len(ws) >= 2 AND {_n_in('ws', 't')} + {_n_in('ws', 'u')} >= 2", 18),
        f"14 * {_n_in('kw', 't')} + 7 * len(list_filter(kw, lambda w: list_contains(tk, w))) + 9 * {_n_in('kw', 'g')} + 3 * {_n_in('kw', 'u')}",
        _case(f"{_n_in('kw', 't')} >= 2", f"9 * {_n_in('kw', 't')}"),
        _case("list_has_any(ptk, tk)", 8),
        _case(D.hit("g", rules.GUIDE_GROUP_TEXT), 6),
        f"CASE WHEN NOT ref THEN {D.weights('url', rules.GUIDE_PAGE_URL_RULES)} ELSE 0 END",
        _case(f"{D.hit(_PLAIN.format(x='etitle'), rules.GENERIC_TITLE)} AND NOT contains(pt, t)", -18),
        _case(D.hit("t", rules.INTRO_TITLE_TEXT), 3),
    ]
)
_DIRECT = f"((length(pt) >= 4 AND contains(t, pt)) OR (length(ps) >= 4 AND contains(u, ps)) OR {_n_in('ws', 't')} + {_n_in('ws', 'u')} + len(list_filter(ws, lambda w: list_contains(tk, w))) + {_n_in('kw', 't')} + {_n_in('kw', 'g')} + {_n_in('kw', 'u')} + len(list_filter(kw, lambda w: list_contains(tk, w))) > 0)"
_SUPPLEMENT = (
    "SELECT repo_id, {i} AS i, arg_max(struct_pack(url := url, k := {k}), (score, -pos)) AS o FROM (SELECT *, 1 + CASE WHEN {t} THEN 80 ELSE 0 END + CASE WHEN {g} THEN 28 ELSE 0 END"
    " + CASE WHEN {u} THEN 18 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)/docs?/') THEN 8 ELSE 0 END AS score FROM entries WHERE {any}) GROUP BY 1"
)
_EXTRAS = " UNION ALL ".join(
    _SUPPLEMENT.format(
        i=i,
        k=D.compact("title"),
        t=D.hit("title", p),
        g=D.hit("coalesce(\"group\", '')", p),
        u=D.hit("url", p),
        any=D.hit("coalesce(\"group\", '') || ' ' || title || ' ' || url", p),
    )
    for i, (p, _) in enumerate(rules.SUPPLEMENTS)
)


@register(
    "select_snippets",
    f"""{cte('entries', 'outline').replace('WITH', 'WITH RECURSIVE', 1)}, p AS (SELECT repo_id, pos, {D.compact('title')} AS pt, {D.compact('slug')} AS ps,
      {D.distinct_in_order(_CONCEPT_RAW)}[:8] AS cs, {_stems(f'({D.distinct_in_order(_CONCEPT_RAW)}[:8])', 8)} AS ws, {_stems(_KEYWORD_RAW, 24)} AS kw,
      {D.words("title || ' ' || slug")} AS ptk, {D.hit("title || ' ' || slug", rules.REFERENCE_PAGE_TEXT)} AS ref, {D.hit("slug || ' ' || title || ' ' || purpose", rules.START_PAGE_TEXT)} AS is_start FROM outline),
    e AS (SELECT repo_id, pos AS ep, url, title AS etitle, {D.compact('title')} AS t, {D.compact("coalesce(\"group\", '')")} AS g, {D.compact('url')} AS u, {D.words('title')} AS tk, {D.words("title || ' ' || url")} AS atk FROM entries),
    sc AS (SELECT p.repo_id, p.pos, e.ep, e.url, e.t, e.atk, {_SNIPPET} AS score FROM p JOIN e USING (repo_id) WHERE {_DIRECT}),
    pool AS (SELECT * FROM sc WHERE score > 0),
    steps AS (SELECT repo_id, pos, unnest(list_concat(cs, ['*', '*', '*', '*'])) AS w, unnest(range(len(cs) + 4)) AS i FROM p),
    gr AS (SELECT DISTINCT repo_id, pos, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(url VARCHAR, k VARCHAR)[]) AS picks FROM pool
      UNION ALL
      SELECT gr.repo_id, gr.pos, gr.i + 1, CASE WHEN b.url IS NULL OR len(gr.picks) >= 4 THEN gr.picks ELSE list_append(gr.picks, struct_pack(url := b.url, k := b.t)) END
      FROM gr JOIN steps s ON s.repo_id = gr.repo_id AND s.pos = gr.pos AND s.i = gr.i
      LEFT JOIN LATERAL (SELECT pool.url, pool.t FROM pool WHERE pool.repo_id = gr.repo_id AND pool.pos = gr.pos AND (s.w = '*' OR list_contains(pool.atk, s.w))
        AND len(list_filter(gr.picks, lambda o: o.url = pool.url OR o.k = pool.t)) = 0 ORDER BY score DESC, ep LIMIT 1) b ON true),
    done AS (SELECT repo_id, pos, picks FROM gr QUALIFY row_number() OVER (PARTITION BY repo_id, pos ORDER BY i DESC) = 1),
    x AS ({_EXTRAS}),
    r0 AS (SELECT d.repo_id, d.pos, is_start, picks, x0.o AS o0, x1.o AS o1, x2.o AS o2 FROM done d JOIN p USING (repo_id, pos)
      LEFT JOIN x x0 ON x0.repo_id = d.repo_id AND x0.i = 0 LEFT JOIN x x1 ON x1.repo_id = d.repo_id AND x1.i = 1 LEFT JOIN x x2 ON x2.repo_id = d.repo_id AND x2.i = 2),
    r1 AS (SELECT * REPLACE (CASE WHEN NOT is_start OR o0 IS NULL OR len(list_filter(picks, lambda o: o.url = o0.url)) > 0 THEN picks ELSE list_append(picks[:3], o0) END AS picks) FROM r0),
    r2 AS (SELECT * REPLACE (CASE WHEN NOT is_start OR o1 IS NULL OR len(list_filter(picks, lambda o: o.url = o1.url)) > 0 THEN picks ELSE list_append(picks[:3], o1) END AS picks) FROM r1),
    r3 AS (SELECT * REPLACE (CASE WHEN NOT is_start OR o2 IS NULL OR len(picks) >= 4 OR len(list_filter(picks, lambda o: o.url = o2.url)) > 0 THEN picks ELSE list_append(picks, o2) END AS picks) FROM r2)
    SELECT repo_id, pos, CAST(unnest(range(1, len(picks) + 1)) AS INT) AS rank, unnest(list_transform(picks, lambda o: o.url)) AS url, 'scored' AS source FROM r3
    UNION ALL SELECT p.repo_id, p.pos, CAST(f.n AS INT), f.url, 'first' FROM p JOIN (SELECT repo_id, url, row_number() OVER (PARTITION BY repo_id ORDER BY ep) AS n FROM e) f ON f.repo_id = p.repo_id AND f.n <= 4
      WHERE NOT EXISTS (SELECT 1 FROM pool WHERE pool.repo_id = p.repo_id AND pool.pos = p.pos)""",
)
def select_snippets(spark, sf):
    return matching.select_snippets(outline(spark, sf), entries(spark, sf))


# -- context ----------------------------------------------------------------------------------


@register(
    "assemble_context",
    f"""{cte('outline', 'tree')}, o AS (SELECT repo_id, pos, CASE pos % 4 WHEN 0 THEN [] WHEN 1 THEN [source_path] ELSE [source_path, 'docs/plans/x.md', 'src/none.ts'] END AS sp, slug || ' ' || title || ' ' || purpose AS txt FROM outline),
    sn AS (SELECT repo_id, pos AS nth, path FROM tree),
    a AS (SELECT repo_id, pos, path, 0 AS tier, nth FROM (SELECT repo_id, pos, unnest(sp) AS path, unnest(range(len(sp))) AS nth FROM o) c WHERE EXISTS (SELECT 1 FROM tree WHERE tree.repo_id = c.repo_id AND tree.path = c.path AND size <= 64000)),
    b AS (SELECT o.repo_id, o.pos, sn.path, 1 AS tier, nth FROM o JOIN sn USING (repo_id) WHERE {D.hit('lower(sn.path)', rules.FOUNDATION_PATH)}),
    c AS (SELECT o.repo_id, o.pos, sn.path, 2 AS tier, nth FROM o JOIN sn USING (repo_id) WHERE len(list_filter({D.words('txt', 4)}, lambda w: contains(lower(sn.path), w))) > 0),
    s AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
    d AS (SELECT o.repo_id, o.pos, sn.path, 3 AS tier, nth FROM o JOIN sn USING (repo_id) WHERE nth < 4 AND NOT EXISTS (SELECT 1 FROM s WHERE s.repo_id = o.repo_id AND s.pos = o.pos)),
    u AS (SELECT * FROM (SELECT * FROM s UNION ALL SELECT * FROM d) QUALIFY row_number() OVER (PARTITION BY repo_id, pos, path ORDER BY tier, nth) = 1)
    SELECT repo_id, pos, path, CAST(tier AS INT) AS tier, CAST(row_number() OVER (PARTITION BY repo_id, pos ORDER BY tier, nth) AS INT) AS rank FROM u
    QUALIFY row_number() OVER (PARTITION BY repo_id, pos ORDER BY tier, nth) <= 12""",
)
def assemble_context(spark, sf):
    listing = tree(spark, sf)
    snippets = listing.select("repo_id", "pos", "path")
    chosen = matching.assemble_context(outline(spark, sf), listing, snippets)
    return chosen.select("repo_id", "pos", "path", "tier", "rank")


# -- filling and navigation -------------------------------------------------------------------


@register("fill_outline")
def fill_outline(spark, sf):
    """Twenty pages added to each outline where its entries hold as many new topics."""
    pages = outline(spark, sf)
    targets = pages.groupBy("repo_id").agg((F.count(F.lit(1)) + 20).alias("target_pages"))
    return matching.fill_outline(pages, entries(spark, sf), targets)


_NAV_WORD = f"CASE WHEN lower(w) IN {D.strings(rules.NAV_ACRONYMS)} THEN upper(w) WHEN regexp_matches(w, '^[A-Z0-9]{{2,}}$') THEN w ELSE upper(w[1]) || w[2:] END"


def _nav_title(x: str) -> str:
    words = f"string_split(trim(regexp_replace(regexp_replace({x}, '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: {_NAV_WORD}), ' ')"


def _folders(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda v: {_nav_title('v')}), lambda label: {_USEFUL_TOPIC})"


_GROUP_SLUGS = f"list_filter(list_transform(string_split_regex(coalesce(\"group\", ''), '\\s+/\\s+'), lambda v: {D.slug('v')}), lambda v: v <> '')"
_PATH_SEGS = f"list_filter({D.segments(D.path('url'))}, lambda v: NOT {D.hit('v', rules.TOPIC_SKIPPED_SEGMENT)} AND NOT {D.hit('v', rules.TOPIC_VERSION_SEGMENT)})"


def _with_ns(p: str) -> str:
    return (
        f"CASE WHEN ns IS NULL OR NOT g THEN {p} WHEN coalesce({p}[1], '') = 'react' AND starts_with(ns, 'react-') THEN list_concat([ns], {p}[2:])"
        f" WHEN NOT list_contains({p}, ns) THEN list_concat([ns], {p}) ELSE {p} END"
    )


_TAIL = f"{_GROUP_SLUGS}[greatest(len({_GROUP_SLUGS}) - 1, 1):]"
_TITLE_WORD = f"CASE WHEN lower(w) IN {D.strings(rules.OUTLINE_ACRONYMS)} THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END"
_QUALIFIER_PARTS = f"list_filter(list_transform(string_split_regex(coalesce(\"group\", ''), '\\s+/\\s+'), lambda v: trim(v)), lambda v: v <> '' AND NOT regexp_matches(v, '(?i)^(api reference|apis?|docs?|documentation|learn|reference)$'))"


@register(
    "normalize_outline",
    f"""{cte('entries', 'outline')}, {_BEST_SQL},
    k0 AS (SELECT repo_id, pos AS entry_pos, {D.slug('title')} AS et, {GENERIC_SQL} AS g, {_URL_SLUG} AS es, (SELECT {_NS} FROM (SELECT lower({D.path('url')}) AS p)) AS ns,
      {_TAIL} AS tail, {_nav_title(f'{_QUALIFIER_PARTS}[-1]')} AS gq FROM entries),
    k1 AS (SELECT *, {_with_ns('tail')} AS placed FROM k0),
    k2 AS (SELECT *, CASE WHEN et <> '' AND placed[-1] = et THEN placed[:-2] WHEN et <> '' AND NOT g AND list_contains(placed, et) THEN [] ELSE placed END AS kept FROM k1),
    k AS (SELECT *, coalesce(nullif({D.slug("array_to_string(list_append(kept, et), '-')")}, ''), 'official-docs-page') AS page_slug,
      CASE WHEN ns = 'react' THEN coalesce(gq, 'React') WHEN ns IS NOT NULL THEN {_nav_title('ns')} ELSE gq END AS qualifier FROM k2),
    x AS (SELECT o.repo_id, o.pos, o.slug, o.title, {D.slug('o.slug')} AS cur, {GENERIC_SQL.replace('title', 'o.title')} AS generic, k.* EXCLUDE (repo_id, kept, placed, tail)
      FROM outline o LEFT JOIN best USING (repo_id, pos) LEFT JOIN k ON k.repo_id = best.repo_id AND k.entry_pos = best.entry_pos),
    y AS (SELECT *, et <> '' AND contains(cur, et || '-' || et) AS rt, es IS NOT NULL AND contains(cur, es || '-' || es) AS rs, g AND ns IS NOT NULL AND et <> '' AS gn, string_split(ns, '-')[-1] AS nt FROM x),
    z AS (SELECT *, CASE WHEN ns <> 'react' AND NOT contains(cur, ns) THEN [page_slug] WHEN rt OR rs THEN list_filter([CASE WHEN rs THEN es END, CASE WHEN rt THEN replace(cur, et || '-' || et, et) END,
        CASE WHEN rs THEN replace(cur, es || '-' || es, es) END, CASE WHEN gn THEN {D.slug("ns || '-' || et")} END,
        CASE WHEN gn AND starts_with(et, nt || '-') THEN {D.slug("ns || '-' || et[length(nt) + 2:]")} END, es, et], lambda v: v IS NOT NULL AND v <> '') ELSE [] END AS options FROM y),
    w AS (SELECT repo_id, pos, cur, unnest(options) AS wish, unnest(range(len(options))) AS nth FROM z),
    f AS (SELECT repo_id, pos, wish FROM w WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.repo_id = w.repo_id AND z.cur = w.wish) QUALIFY row_number() OVER (PARTITION BY repo_id, pos ORDER BY nth) = 1),
    n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY repo_id, wish ORDER BY pos) = 1),
    q AS (SELECT z.*, coalesce(n.wish, cur) AS new_slug, CASE WHEN entry_pos IS NOT NULL AND generic AND qualifier IS NOT NULL AND NOT starts_with({D.slug('title')}, {D.slug('qualifier')}) THEN qualifier || ' ' || title ELSE title END AS full_title
      FROM z LEFT JOIN n ON n.repo_id = z.repo_id AND n.pos = z.pos),
    c AS (SELECT *, trim(regexp_replace(regexp_replace(full_title, {D.q(rules.NAV_CHROME_PHRASE)}, '', 'g'), '\\s+', ' ', 'g')) AS clean FROM q)
    SELECT repo_id, pos, slug, title, new_slug, CASE WHEN entry_pos IS NULL THEN title WHEN clean = '' THEN full_title
      WHEN {D.hit(D.slug('new_slug'), rules.SETUP_SLUG)} AND {D.hit('clean', rules.SETUP_TITLE)} THEN array_to_string(list_transform(list_filter(string_split_regex({D.slug('new_slug')}, '[-_]+'), lambda v: v <> ''), lambda w: {_TITLE_WORD}), ' ')
      ELSE clean END AS new_title FROM c""",
)
def normalize_outline(spark, sf):
    named = matching.normalize_outline(outline(spark, sf), entries(spark, sf))
    return named.select("repo_id", "pos", "slug", "title", "new_slug", "new_title")



_PARTS_SQL = f"""n0 AS (SELECT repo_id, pos AS entry_pos, url, {GENERIC_SQL} AS g, (SELECT {_NS} FROM (SELECT lower({D.path('url')}) AS p)) AS ns,
      list_filter({_GROUP_SLUGS}, lambda v: NOT {D.hit('v', '^(docs?|documentation)$')})[:3] AS named FROM entries),
    n1 AS (SELECT *, {_folders(_with_ns('named'))} AS own, {_folders(f'{_PATH_SEGS}[:2]')} AS derived FROM n0),
    parts AS (SELECT repo_id, entry_pos, CASE WHEN len(own) > 0 THEN own WHEN len(derived) > 0 THEN derived ELSE ['Official Docs'] END AS parts FROM n1)"""


@register(
    "build_nav",
    f"""{cte('entries', 'outline')}, {_BEST_SQL}, {_PARTS_SQL},
    l AS (SELECT o.repo_id, o.pos, o.slug, o.title, CASE WHEN {D.slug('o.slug')} = 'overview' THEN ['Start Here'] WHEN parts IS NULL THEN ['Additional Topics'] ELSE parts[:3] END AS parts
      FROM outline o LEFT JOIN best USING (repo_id, pos) LEFT JOIN parts USING (repo_id, entry_pos)),
    d AS (SELECT repo_id, pos, unnest(list_transform(range(1, len(parts) + 1), lambda k: parts[:k])) AS p FROM l)
    SELECT repo_id, 'dir:' || array_to_string(p, '/') AS node_id, CASE WHEN len(p) > 1 THEN 'dir:' || array_to_string(p[:-2], '/') END AS parent_id,
      CAST(len(p) AS INT) AS depth, CAST(min(pos) AS INT) AS ord, CAST(NULL AS STRING) AS slug, p[-1] AS title FROM d GROUP BY repo_id, p
    UNION ALL SELECT repo_id, 'page:' || slug, 'dir:' || array_to_string(parts, '/'), CAST(len(parts) + 1 AS INT), CAST(pos AS INT), slug, title FROM l""",
)
def build_nav(spark, sf):
    return navtree.build_nav(outline(spark, sf), entries(spark, sf))


_GROUPS = [
    ("Start Here", [r"\bgetting started\b", r"\boverview\b", r"\binstallation\b"]),
    ("Server", [r"\bserver\b", r"\bedge\b", r"\bcaching\b", r"\brouting\b"]),
    ("One Page", [r"\bvector search 31\b"]),
    ("Deployment and Reference", [r"\breference\b", r"\bcli\b", r"\bdeployment\b"]),
]
_NAV_LABEL = f"replace({D.slug('slug')} || ' ' || {D.slug('title')}, '-', ' ')"


def _nav_rules_sql() -> str:
    """One pair of CTEs per group: is it large enough among the pages still free, and who joins it."""
    names = [n for n, _ in _GROUPS]
    out = [f"s0 AS (SELECT repo_id, pos, slug || '-' || CAST(pos AS STRING) AS slug, title, {_NAV_LABEL.replace(D.slug('slug'), D.slug("(slug || '-' || CAST(pos AS STRING))"))} AS label, CAST(NULL AS INT) AS grp FROM outline)"]
    for i, (_, patterns) in enumerate(_GROUPS):
        hit = f"(grp IS NULL AND {D.any_hit('label', patterns)})"
        out.append(f"n{i} AS (SELECT repo_id, count(*) FILTER ({hit}) AS n FROM s{i} GROUP BY 1)")
        out.append(
            f"s{i + 1} AS (SELECT repo_id, pos, slug, title, label, CASE WHEN {hit} AND n >= 2 THEN {i} ELSE grp END AS grp"
            f" FROM s{i} JOIN n{i} USING (repo_id))"
        )
    k = names.index("Deployment and Reference")
    name = " ".join(f"WHEN {i} THEN {D.q(n)}" for i, n in enumerate(names))
    place = " ".join(f"WHEN {D.q(n)} THEN {i}" for i, n in enumerate(names))
    out.append(f"h AS (SELECT repo_id, coalesce(bool_or(grp = {k}), FALSE) AS has FROM s{len(names)} GROUP BY 1)")
    out.append(
        f"f AS (SELECT repo_id, pos, slug, title, CASE grp {name} ELSE CASE WHEN has THEN {D.q(names[k])} ELSE 'Reference and Operations' END END"
        f" AS folder FROM s{len(names)} JOIN h USING (repo_id))"
    )
    return f"""{cte('outline')}, {', '.join(out)}
    SELECT repo_id, 'page:' || slug AS node_id, 'dir:' || folder AS parent_id, CAST(2 AS INT) AS depth, CAST(pos AS INT) AS ord, slug, title FROM f
    UNION ALL SELECT DISTINCT repo_id, 'dir:' || folder, NULL, CAST(1 AS INT), CAST(CASE folder {place} ELSE {len(names)} END AS INT), NULL, folder FROM f"""


@register("build_nav_by_rules", _nav_rules_sql())
def build_nav_by_rules(spark, sf):
    pages = outline(spark, sf).withColumn("slug", F.concat_ws("-", "slug", "pos"))
    return navtree.build_nav_by_rules(pages, _GROUPS)


# -- quality ----------------------------------------------------------------------------------

_MD = (
    "CASE WHEN pos % 5 = 4 THEN '' ELSE '# ' || title || chr(10) END || text || chr(10) || '## Relevant Source Files' || chr(10) || '- ' || source_path || chr(10)"
    " || CASE WHEN pos % 3 = 0 THEN '## Use' || chr(10) || '## Tips' || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' || chr(10) || 'Sources: ' || source_path ELSE '' END"
    " || CASE WHEN pos % 7 = 0 THEN ' packages/eslint-plugin-react-hooks/src/a.ts' ELSE '' END"
)


def drafts(spark, sf):
    """One Markdown draft per outline page, two attempts where the page number is even."""
    pages = outline(spark, sf)
    md = pages.select(
        "repo_id",
        F.concat_ws("-", "slug", "pos").alias("page_slug"),
        F.explode(F.when(F.col("pos") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("attempt"),
        "title",
        F.expr(_MD).alias("markdown"),
        F.when(
            F.col("pos") % 6 == 5, F.array().cast("array<struct<path:string,start_line:int,end_line:int>>")
        ).otherwise(
            F.array(
                F.struct(
                    F.when(F.col("pos") % 6 == 1, F.lit("no/such.ts")).otherwise(F.col("source_path")).alias("path"),
                    F.lit(1).alias("start_line"),
                    F.lit(2).alias("end_line"),
                )
            )
        ).alias("citations"),
    )
    return md


def planned(spark, sf):
    return outline(spark, sf).withColumn("slug", F.concat_ws("-", "slug", "pos"))


def _facts(spark, sf):
    return quality.page_facts(drafts(spark, sf), planned(spark, sf), evidence(spark, sf), tree(spark, sf))




def _issues_sql() -> str:
    md = "md"
    words = f"regexp_replace({md}, '(?s)```.*?```', ' ', 'g')"
    words = f"regexp_replace({words}, {D.q('`[^`' + chr(92) + 'n]+`')}, ' ', 'g')"
    words = f"regexp_replace({words}, {D.q('(?im)^.*' + chr(92) + 'bSources:' + chr(92) + 's*.*$')}, ' ', 'g')"
    words = f"regexp_replace({words}, {D.q('https?://' + chr(92) + 'S+')}, ' ', 'g')"
    words = f"regexp_replace({words}, '[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+', ' ', 'g')"
    detail = (
        f"({D.count(md, chr(40) + '?m)^' + chr(92) + '|.+' + chr(92) + '|$')} >= 3 OR {D.count(md, '(?m)^```')} >= 2 OR {D.count(md, '`[^`' + chr(92) + 'n]+`')} >= 8"
        f" OR {D.count(md, '(?m)^###' + chr(92) + 's+')} >= 3 OR {D.count(md, '(?m)^' + chr(92) + 's*[-*]' + chr(92) + 's+`[^`' + chr(92) + 'n]+`')} >= 4)"
    )
    example = f"({D.count(md, '(?m)^```')} >= 2 OR {D.any_hit(md, [rules.NUMBERED_LINE, rules.COMMAND_LINE, rules.GUIDE_WORDS])})"
    lint = rules.FORBIDDEN_PATHS[0]
    about = D.slug("slug || ' ' || title || ' ' || purpose || ' ' || array_to_string(sp, ' ')")
    classes = CLASSES_SQL
    return f"""{cte('outline', 'tree')}, {_EVIDENCE_SQL},
    o AS (SELECT * REPLACE (slug || '-' || CAST(pos AS STRING) AS slug), {_MD} AS md,
        CASE pos % 4 WHEN 0 THEN [] WHEN 1 THEN [source_path] ELSE [source_path, 'docs/plans/x.md', 'src/none.ts'] END AS sp,
        CASE WHEN pos % 6 = 5 THEN [] WHEN pos % 6 = 1 THEN ['no/such.ts'] ELSE [source_path] END AS ci FROM outline),
    c AS (SELECT *, {classes} FROM o),
    m AS (SELECT c.*, {MIN_WORDS_SQL} AS min_words, {MIN_SECTIONS_SQL} AS min_sections, {D.count(words, "[A-Za-z0-9][A-Za-z0-9'-]*")} AS pw, {D.count(md, '(?m)^##' + chr(92) + 's+')} AS h2,
        {detail} AS detail, {example} AS example,
        contains(lower(md), 'sources:') AS sources FROM c JOIN evidence USING (repo_id)),
    v AS (SELECT m.*, coalesce(k.ok, false) AS src_known, CASE WHEN pos % 6 IN (1, 5) THEN [] WHEN coalesce(k.ok, false) THEN [source_path] ELSE [] END AS valid
      FROM m LEFT JOIN (SELECT DISTINCT repo_id, path, true AS ok FROM tree) k ON k.repo_id = m.repo_id AND k.path = m.source_path),
    w AS (SELECT *, pw >= CASE WHEN min_words >= 900 THEN min_words - 25 ELSE floor(min_words * 0.9) END AND h2 >= 3 AND sources AND (detail OR example) AS near,
        CASE WHEN len(valid) > 0 OR (src_known AND pos % 4 <> 0) THEN 1 ELSE 0 END AS visible FROM v),
    i AS (SELECT repo_id, slug AS page_slug, pos, unnest(list_filter([
      CASE WHEN NOT (starts_with(ltrim(md), '# ' || title) OR regexp_matches(md, '(?m)^#\\s+.+')) THEN {{'c': 'no_title', 'd': ''}} END,
      CASE WHEN h2 < min_sections THEN {{'c': 'too_few_sections', 'd': CAST(h2 AS STRING) || '/' || CAST(min_sections AS STRING)}} END,
      CASE WHEN pw < min_words AND NOT near THEN {{'c': 'too_few_words', 'd': CAST(pw AS STRING) || '/' || CAST(min_words AS STRING)}} END,
      CASE WHEN NOT sources THEN {{'c': 'no_sources_line', 'd': ''}} END,
      CASE WHEN sources AND visible = 0 THEN {{'c': 'no_visible_source', 'd': ''}} END,
      CASE WHEN len(ci) = 0 THEN {{'c': 'no_citation', 'd': ''}} END,
      CASE WHEN len(ci) > 0 AND len(valid) = 0 THEN {{'c': 'no_valid_citation', 'd': ''}} END,
      CASE WHEN is_reference AND NOT detail THEN {{'c': 'no_reference_detail', 'd': ''}} END,
      CASE WHEN is_guide AND NOT example THEN {{'c': 'no_guide_example', 'd': ''}} END,
      CASE WHEN len(sp) > 1 THEN {{'c': 'source_not_mentioned', 'd': 'docs/plans/x.md'}} END,
      CASE WHEN pos % 7 = 0 AND NOT {D.hit(about, lint[0])} THEN {{'c': 'foreign_path', 'd': 'packages/eslint-plugin-react-hooks/src/a.ts'}} END], lambda x: x IS NOT NULL)) AS e FROM w)"""


_ISSUES_SQL = _issues_sql()


@register(
    "page_issues",
    _ISSUES_SQL
    + " SELECT repo_id, page_slug, CAST(unnest(CASE WHEN pos % 2 = 0 THEN [1, 2] ELSE [1] END) AS INT) AS attempt, e.c AS code, e.d AS detail FROM i",
)
def page_issues(spark, sf):
    return quality.page_issues(drafts(spark, sf), planned(spark, sf), evidence(spark, sf), tree(spark, sf))


_SECTION = rules.SOURCE_SECTION.replace("(?im)^", r"(?i)(^|\n)").replace(r"\b", "")


@register(
    "accept_drafts",
    _ISSUES_SQL
    + f""", j AS (SELECT repo_id, page_slug, pos, count(*) AS n, count(*) FILTER (e.c NOT IN {D.strings(quality.FALLBACK_SAFE)}) AS serious FROM i GROUP BY 1, 2, 3),
    f AS (SELECT w.repo_id, w.slug AS page_slug, CASE WHEN w.pos % 2 = 0 THEN 2 ELSE 1 END AS attempts, coalesce(j.n, 0) AS n,
        is_important AND coalesce(j.serious, 0) = 0 AND (starts_with(ltrim(md), '# ' || title) OR regexp_matches(md, '(?m)^#\\s+.+')) AND h2 >= 3 AND {D.hit('md', _SECTION)}
          AND sources AND len(valid) > 0 AND ({D.count('md', chr(92) + 'S+')} >= 300 OR detail OR example) AS publishable
      FROM w LEFT JOIN j ON j.repo_id = w.repo_id AND j.page_slug = w.slug AND j.pos = w.pos)
    SELECT repo_id, page_slug, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(coalesce(min(1) FILTER (n = 0), max(attempts) FILTER (n > 0 AND publishable)) AS INT) AS attempt,
      CASE WHEN bool_or(n = 0) THEN 'accepted' WHEN bool_or(publishable) THEN 'accepted_with_warnings' ELSE 'failed' END AS verdict FROM f GROUP BY 1, 2""",
)
def accept_drafts(spark, sf):
    return quality.accept_drafts(_facts(spark, sf))


@register(
    "repair_feedback",
    _ISSUES_SQL
    + """, k AS (SELECT repo_id, page_slug, pos, count(*) AS issues, coalesce(string_agg(DISTINCT e.d, ', ' ORDER BY e.d) FILTER (e.c = 'source_not_mentioned'), '') AS missing_paths,
        coalesce(string_agg(DISTINCT e.d, ', ' ORDER BY e.d) FILTER (e.c = 'foreign_path'), '') AS unrelated_paths, bool_or(e.c = 'too_few_words') AS short,
        bool_or(e.c = 'no_reference_detail') AS needs_reference, bool_or(e.c = 'no_guide_example') AS needs_example, bool_or(e.c = 'too_few_sections') AS needs_sections FROM i GROUP BY 1, 2, 3),
    z AS (SELECT k.*, w.pw, w.min_words, CASE WHEN short THEN greatest(0, w.min_words - w.pw) END AS deficit
      FROM k JOIN w ON w.repo_id = k.repo_id AND w.slug = k.page_slug AND w.pos = k.pos)
    SELECT repo_id, page_slug, CAST(unnest(CASE WHEN pos % 2 = 0 THEN [1, 2] ELSE [1] END) AS INT) AS attempt, issues, missing_paths, unrelated_paths, CAST(deficit AS INT) AS word_deficit,
      CAST(CASE WHEN deficit > 350 THEN deficit + 150 ELSE 500 END AS INT) AS words_to_add, short AND pw < floor(min_words * 0.65) AS rewrite, needs_reference, needs_example, needs_sections FROM z""",
)
def repair_feedback(spark, sf):
    facts = joinable(_facts(spark, sf), "facts")  # both sides of a join: the texts are judged once
    return quality.repair_feedback(quality.page_issues_of(facts), facts)


@register("outline_issues")
def outline_issues(spark, sf):
    return quality.outline_issues(
        outline(spark, sf), nav(spark, sf), evidence(spark, sf), entries(spark, sf), repos(spark, sf)
    )


@register(
    "missing_topics",
    f"""{cte('entries', 'outline', 'tree')}, {_EVIDENCE_SQL}, p AS (SELECT repo_id, pos, doc, unnest(list_append(string_split_regex(coalesce("group", ''), '\\s+/\\s+'), {_SEG})) AS p
        FROM (SELECT *, row_number() OVER () AS doc FROM entries)),
    l AS (SELECT DISTINCT repo_id, doc, {_TOPIC} AS label FROM p WHERE p IS NOT NULL),
    c AS (SELECT repo_id, label, count(*) AS count FROM l WHERE {_USEFUL_TOPIC} GROUP BY 1, 2),
    h AS (SELECT c.* FROM c JOIN evidence USING (repo_id) WHERE count >= greatest(4, link_count // 80) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count DESC, label) <= 12),
    t AS (SELECT repo_id, regexp_replace(lower(string_agg(title || ' ' || slug || ' ' || purpose, ' ' ORDER BY CAST(pos AS STRING))), '[^a-z0-9]+', ' ', 'g') AS txt FROM outline GROUP BY 1),
    x AS (SELECT h.*, coalesce(txt, '') AS txt, list_filter({D.words('label')}, lambda v: v NOT IN {D.strings(rules.GENERIC_TOPIC_WORDS)})[:4] AS ws FROM h LEFT JOIN t USING (repo_id))
    SELECT repo_id, label, count FROM x WHERE NOT (len(list_filter(ws, lambda v: NOT contains(txt, v))) = 0 OR (len(ws) > 1 AND contains(txt, {D.compact('label')})))""",
)
def missing_topics(spark, sf):
    text = rollups.outline_text(outline(spark, sf))
    return rollups.missing_topics(
        rollups.high_volume_topics(entries(spark, sf), evidence(spark, sf)), text
    )


# -- candidates -------------------------------------------------------------------------------


def _sites(spark, sf):
    """Crawled sites as repositories: the site's host label names owner and repository."""
    pages = table(spark, sf, "pages").select("page_id", U.canonical(F.col("url")).alias("url"))
    host = U.host(F.col("url"))
    keyed = pages.withColumn("repo_id", F.concat_ws("/", U.registrable_host(host), U.primary_label(host)))
    names = keyed.groupBy("repo_id").agg(F.min("url").alias("homepage_url"))
    known = names.select(
        "repo_id",
        F.get(F.split("repo_id", r"[./]"), F.lit(0)).alias("owner"),
        F.get(F.split("repo_id", "/"), F.lit(1)).alias("name"),
        "homepage_url",
        F.array(F.lit("blog"), F.lit("spam-farm")).alias("topics"),
    )
    return keyed.select("repo_id", F.col("page_id").alias("pos"), "url"), known


_SITE_ROWS = f"""s0 AS (SELECT page_id AS pos, regexp_replace(url, '^([a-z]+://[^/?#]*)$', '\\1/') AS url FROM pages),
    s AS (SELECT *, {D.registrable(D.host('url'))} || '/' || string_split(regexp_replace({D.host('url')}, '^www\\.', ''), '.')[1] AS repo_id FROM s0),
    r AS (SELECT repo_id, string_split_regex(repo_id, '[./]')[1] AS owner, string_split(repo_id, '/')[2] AS name, min(url) AS homepage_url FROM s GROUP BY 1)"""
_BOTH_TEXT = f"regexp_replace(lower({D.host('url')} || {D.path('url')}), '[^a-z0-9]', '', 'g')"
_LABEL = f"regexp_replace(string_split(regexp_replace({D.host('url')}, '^www\\.', ''), '.')[1], '[^a-z0-9]', '', 'g')"
_REPO_HIT = f"((length(rc) >= 5 AND contains({_BOTH_TEXT}, rc)) OR (length(rc) >= 3 AND starts_with({_LABEL}, rc)) OR (length(rc) >= 2 AND {_LABEL} = rc) OR (length(rc) >= 3 AND list_contains(list_transform({D.segments(D.path('url'))}, lambda v: {D.compact('v')}), rc)))"
_OWNER_HIT = f"(length(oc) >= 4 AND (contains({_BOTH_TEXT}, oc) OR {_LABEL} = oc))"
_TOPIC_HIT = " OR ".join(
    f"(contains({_BOTH_TEXT}, '{t}') OR starts_with({_LABEL}, '{t}'))" for t in ("blog", "spamfarm")
)


@register(
    "entity_mentions",
    f"""WITH {_SITE_ROWS}, j AS (SELECT s.*, r.homepage_url, {D.compact('r.name')} AS rc, {D.compact('r.owner')} AS oc FROM s JOIN r USING (repo_id))
    SELECT pos, url, {_REPO_HIT} AS repo_specific, {_OWNER_HIT} AS owner_specific, {_TOPIC_HIT} AS topic_specific,
      {D.registrable(D.host('url'))} = {D.registrable(D.host('homepage_url'))} AS homepage_related,
      (length(rc) >= 5 AND contains({D.compact(D.path('url'))}, rc)) OR (length(oc) >= 4 AND contains({D.compact(D.path('url'))}, oc)) AS path_specific FROM j""",
)
def entity_mentions(spark, sf):
    urls, known = _sites(spark, sf)
    flagged = joins.entity_mentions(urls, known)
    return flagged.select(
        "pos", "url", "repo_specific", "owner_specific", "topic_specific", "homepage_related", "path_specific"
    )


def _below(base: str, paths) -> str:
    return "[" + ", ".join(f"{base} || {D.q(p)}" for p in paths) + "]"


def _where(cond: str, items: str) -> str:
    return f"CASE WHEN {cond} THEN {items} ELSE [] END"


def _landing(base: str) -> str:
    return f"list_concat({_below(base, rules.DOCS_LANDING_PATHS)}, [{base} || '/' || lower(name), {base} || '/' || lower(name) || '/docs'])"


def _subdomain(base: str) -> str:
    fixed = ["/", "/llms.txt", "/llms-full.txt", "/docs/llms.txt", "/sitemap.xml", *rules.LOCALIZED_LANDING_PATHS]
    return f"list_concat({_below(base, fixed)}, {_landing(base)})"


def _all(*lists: str) -> str:
    out = lists[0]
    for more in lists[1:]:
        out = f"list_concat({out}, {more})"
    return out


def _first_at(cond: str) -> str:
    return f"coalesce(list_position(list_transform({D.segments(D.path('url'))}, lambda v: {cond}), true), 0) - 1"


_INDEX_FILES = ["/llms.txt", "/llms-full.txt", "/sitemap.xml"]
_DOCS_AT = _first_at(D.hit("v", rules.DOCS_INDEX_ROOT))
_REPO_AT = _first_at(f"{D.compact('v')} = rc OR {D.compact(chr(114) + 'egexp_replace(v, ' + D.q('(?i)[.][a-z0-9]+$') + ', ' + D.q('') + ')')} = rc")
_ORIGIN = f"lower(regexp_extract(url, {D.q('^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)')}, 1))"
_FLAGS = f"{_REPO_HIT} AS rs, {_OWNER_HIT} AS os, ({_TOPIC_HIT}) AS ts, {D.registrable(D.host('url'))} = {D.registrable(D.host('homepage_url'))} AS hr, {_DOCS_AT} AS docs_at, {_REPO_AT} AS repo_at, {D.segments(D.path('url'))} AS segs"
_CANDIDATES_OF_SEED = _all(
    "[url]",
    _below("o", [*_INDEX_FILES, "/sitemap/sitemap-index.xml"]),
    _where("known", _landing("o")),
    _where("known OR starts_with(clean, '/docs')", _below("o", ["/docs/llms.txt", "/docs/sitemap.xml"])),
    _where(f"clean <> '' AND NOT {D.hit('clean', '[.][A-Za-z0-9]+$')}", _below("o || clean", [*_INDEX_FILES, "/contents.html"])),
    _where(
        "length(rc) >= 3 AND len(segs) >= 2 AND docs_at >= 0 AND repo_at > docs_at",
        _below("o || '/' || array_to_string(segs[:repo_at + 1], '/')", ["", *_INDEX_FILES, "/contents.html"]),
    ),
    _where("docs_at >= 0", _below("o || '/' || array_to_string(segs[:docs_at + 1], '/')", ["", *_INDEX_FILES])),
    _where(D.hit("segs[1]", rules.FIRST_SEGMENT_INDEX), _below("o || '/' || segs[1]", ["/llms.txt", "/sitemap.xml"])),
    _where(
        D.hit("segs[1]", "^[0-9]+(?:[.][0-9]+)?$"),
        _all(
            _below("o || '/' || segs[1]", ["/", "/contents.html"]),
            _below(
                "o || '/' || string_split(segs[1], '.')[1]",
                ["/", "/contents.html", "/library/index.html", "/reference/index.html", "/tutorial/index.html"],
            ),
        ),
    ),
    _where(
        D.hit(D.host("url"), "^(www[.])?[^.]+[.][^.]+$"),
        _all(_subdomain("'https://docs.' || root"), _subdomain("'https://doc.' || root")),
    ),
    _where(
        f"length(own) >= 3 AND list_contains(list_transform({D.segments(D.path('homepage_url'))}, lambda v: {D.compact('v')}), rc)",
        _all(_below("'https://' || own || '.dev'", _INDEX_FILES), _landing("'https://' || own || '.dev'")),
    ),
)
_BARE = f"coalesce(nullif(regexp_replace(lower({D.path('url')}), '/+$', ''), ''), '/')"
_DOCS_HOST = f"(starts_with({D.host('url')}, 'docs.') OR starts_with({D.host('url')}, 'doc.'))"
_CANDIDATE = " + ".join(
    [
        _case("regexp_replace(url, '/$', '') = regexp_replace(seed, '/$', '')", 220),
        _case(f"contains({D.compact(D.host('seed'))}, regexp_replace(lower(name), '[^a-z0-9]', '', 'g'))", 50),
        "CASE WHEN rs THEN 160 WHEN os THEN 50 ELSE 0 END",
        _case("from_hr", 80),
        _case("from_rs", 80),
        _case("from_ts", 35),
        D.weights(f"lower({D.path('seed')})", rules.CANDIDATE_FROM_RULES),
        D.weights(D.path("url"), rules.CANDIDATE_PATH_RULES),
        _case(f"len(segs) >= 3 AND length(rc) >= 3 AND docs_at >= 0 AND repo_at > docs_at AND {D.hit(D.path('url'), rules.INDEX_FILE_KIND)}", 180),
        _case(f"{D.path('url')} LIKE '%/sitemap.xml' AND {D.path('url')} NOT LIKE '%/docs/sitemap.xml'", 35),
        _case(f"{_BARE} = '/sitemap.xml' AND NOT rs AND from_rs", -90),
        _case(f"{_DOCS_HOST} AND {_BARE} IN ('/llms.txt', '/sitemap.xml')", 120),
        _case(_DOCS_HOST, 20),
        _case(f"{D.host('seed')} LIKE '%.dev'", 10),
    ]
)
_CANDIDATE_ORDER = f"score DESC, length({D.path('source_url')}), source_url"


@register(
    "expand_candidates",
    f"""WITH {_SITE_ROWS}, u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY repo_id, url ORDER BY pos) = 1),
    seeds AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY pos) <= {rules.MAX_URLS_PER_REPO}),
    j AS (SELECT seeds.*, r.name, r.homepage_url, {D.compact('r.name')} AS rc, {D.compact('r.owner')} AS oc FROM seeds JOIN r USING (repo_id)),
    f AS (SELECT *, {_FLAGS}, {_ORIGIN} AS o, regexp_replace({D.path('url')}, '/+$', '') AS clean, regexp_replace({D.host('url')}, '^www[.]', '') AS root, regexp_replace(lower(name), '[^a-z0-9-]', '', 'g') AS own FROM j),
    k AS (SELECT *, rs OR os OR ts OR hr AS known FROM f),
    c AS (SELECT repo_id, pos, url AS seed, name, homepage_url, rc, oc, rs AS from_rs, ts AS from_ts, hr AS from_hr, unnest(list_distinct({_CANDIDATES_OF_SEED})) AS url FROM k),
    g AS (SELECT *, {_FLAGS} FROM c),
    x AS (SELECT repo_id, pos, seed, url, {_CANDIDATE} AS score FROM g),
    m AS (SELECT repo_id, url AS source_url, CAST(max(score) AS INT) AS score, arg_max(seed, (score, -pos)) AS discovered_from, any_value({_ORIGIN}) AS origin FROM x GROUP BY 1, 2),
    t AS (SELECT *, {D.hit(D.path('source_url'), rules.PRIMARY_INDEX_FILE)} AS prim FROM m QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY {_CANDIDATE_ORDER}) <= {rules.MAX_CANDIDATES}),
    a AS (SELECT * FROM t QUALIFY NOT prim OR row_number() OVER (PARTITION BY repo_id, origin, prim ORDER BY {_CANDIDATE_ORDER}) <= {rules.MAX_PRIMARY_PER_ORIGIN}),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY repo_id, origin ORDER BY {_CANDIDATE_ORDER}) <= {rules.MAX_PER_ORIGIN})
    SELECT repo_id, source_url, score, discovered_from, origin FROM b QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY {_CANDIDATE_ORDER}) <= {rules.MAX_CANDIDATES_KEPT}""",
)
def expand_candidates(spark, sf):
    urls, known = _sites(spark, sf)
    return joins.limit_candidates(joins.expand_candidates(urls, known))


