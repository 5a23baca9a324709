"""Links, headings, sections, entries and metrics out of HTML and Markdown, as table jobs.

A body is read once, by one regular expression per kind of thing, and exploded with positions. What
follows a body through a shuffle are the small extracted rows, never the body.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.functions.binding import let, stage
from docloom.operators.ordering import (
    balanced_sample,
    docs_path_order_key,
    first_wins,
    group_ranks_limited,
    headings_per_file,
    numbered_slugs,
    site_group,
    top_files,
    top_per_group,
    url_order_key,
)
from docloom.operators.predicates import (
    is_admitted_host,
    is_docs_page,
    is_docs_source,
    is_guide_readme,
    is_noise_title,
    is_placeholder_title,
    keep_headings,
    locale_scope,
    weighted,
)
from docloom.session import joinable
from docloom.operators.rollups import map_group  # noqa: F401  (re-exported for callers)

_HREF = r"(?i)\bhref=(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
_ASSET = r"(?i)\b(?:href|src)=(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
_ID = r"(?i)\bid\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
_HEADING = r"(?is)<h([1-4])\b([^>]*)>(.*?)</h\1>"
_LOC = r"(?i)<loc>\s*([^<]+?)\s*</loc>"
_MD_LINK = r"\[([^\]\n]+)\]\(([^)]+)\)"
_MD_LINK_COUNTED = r"\[[^\]\n]*\]\((?!#)[^)]+?\)"
_MD_HEADING_COUNTED = r"#{2,6}\s+"
_URL_LINE = r"(?i)^\s*URL:\s*(https?://\S+)"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def _value(match: Column, pattern: str) -> Column:
    """The quoted or bare value of an attribute match: one of three groups is non-empty."""
    return F.concat(*[F.regexp_extract(match, pattern, g) for g in (1, 2, 3)])


# -- X1 .. X4 ---------------------------------------------------------------------------------


def extract_links(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), url: str = "url", body: str = "html"
) -> DataFrame:
    """Every link of a page in order: href as written (entities decoded) and resolved address."""
    return _resolved(pages, keys, url, body, _HREF).filter(
        (F.col("href") != "") & ~F.col("href").rlike(r"^(#|mailto:|javascript:)") & F.col("url").isNotNull()
    )


def _resolved(pages: DataFrame, keys: Sequence[str], url: str, body: str, pattern: str) -> DataFrame:
    """Attribute values of a page with their resolved address, null where that is no web address."""

    def link(m: Column) -> Column:
        href = F.trim(T.decode_entities(_value(m, pattern)))
        return let(
            href,
            lambda h: F.struct(
                h.alias("href"), U.without_fragment(U.resolve(F.col(url), h)).alias("url")
            ),
        )

    links = F.transform(_all(F.col(body), pattern), link)
    found = pages.select(*keys, F.col(url).alias("page_url"), F.posexplode(links).alias("pos", "l"))
    return found.select(*keys, "page_url", "pos", "l.href", "l.url")


def extract_assets(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), url: str = "url", body: str = "html"
) -> DataFrame:
    """Linked files of the page's own site (href and src), first occurrence of each."""
    resolved = _resolved(pages, keys, url, body, _ASSET).filter(
        (F.col("href") != "") & ~F.col("href").startswith("data:") & F.col("url").isNotNull()
    )
    h, src = U.host(F.col("url")), U.host(F.col("page_url"))
    own = resolved.filter((h == src) | (U.last_two_labels(h) == U.last_two_labels(src)))
    return first_wins(own, [*keys, U.dedupe_key(F.col("url"))], "pos")


def html_headings(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), url: str = "url", body: str = "html"
) -> DataFrame:
    """Headings h1 to h4 with a plain title and the address of their anchor; repeats dropped."""
    found = pages.select(*keys, F.col(url).alias("page_url"), F.posexplode(_all(F.col(body), _HEADING)).alias("pos", "m"))
    attribute = r"(?i)^.*?\bid=(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)).*$"
    ident = F.trim(T.decode_entities(_value(F.regexp_extract("m", _HEADING, 2), attribute)))
    inner = T.decode_entities(T.strip_tags(F.regexp_extract("m", _HEADING, 3)))

    def address(base: Column) -> Column:
        anchored = F.concat(U.without_fragment(base), F.lit("#"), F.col("_id"))
        return F.when(F.col("_id") == "", base).otherwise(anchored)

    parts = stage(
        found,
        level=F.regexp_extract("m", _HEADING, 1).cast("int"),
        _id=ident,
        title=F.trim(F.regexp_replace(inner, r"\s+", " ")),
    ).filter(F.length("title").between(2, 120) & ~F.col("title").rlike(rules.CHROME_HEADING))
    rows = stage(parts.drop("m"), url=let(U.canonical(F.col("page_url")), address))
    distinct = first_wins(rows, [*keys, "level", F.lower("title"), "url"], "pos")
    return top_per_group(distinct, keys, ["pos"], rules.MAX_HEADINGS_PER_PAGE).select(
        *keys, "page_url", "pos", "level", "title", "url"
    )


def readable(html: Column) -> Column:
    """Text of a page without scripts, navigation and tags; block ends become line breaks."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style>", " ")
    t = F.regexp_replace(t, r"(?is)<svg\b.*?</svg>", " ")
    t = F.regexp_replace(t, r"(?is)<(nav|header|footer|aside)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</(h[1-6]|p|li|pre|tr|blockquote)>", "\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(T.decode_entities(t), r"^\s+|\s+$", "")


def readable_text(pages: DataFrame, body: str = "html") -> DataFrame:
    return pages.withColumn("text", readable(F.col(body)))


# -- X2 ---------------------------------------------------------------------------------------


def _best_source(headings: Column, links: Column, groups: Column, path: Column, adjacent: Column) -> Column:
    """links, headings or null: what a page's index is made of."""
    prefer = (headings >= 10) & (
        (headings >= F.greatest(F.lit(30), links * 3))
        | ((headings >= 20) & path.rlike(rules.HEADING_INDEX_PATH))
    )
    few = links < 10
    return (
        F.when(prefer, F.lit("headings"))
        .when(few & (links >= 5) & adjacent & (groups >= 2), F.lit("links"))
        .when(few & (headings >= 10), F.lit("headings"))
        .when(~few & (groups >= 2), F.lit("links"))
    )


def link_index(
    pages: DataFrame,
    keys: Sequence[str] = ("page_id",),
    url: str = "url",
    body: str = "html",
    adjacent: Column | None = None,
) -> DataFrame:
    """Documentation entries of landing pages: group, title and address in reading order.

    Links to documentation pages of the same site are deduplicated, scoped to the page's locale,
    sampled evenly over sections down to 600 and grouped by section. Pages with few links and many
    headings give their headings instead; pages with neither give nothing. ``adjacent`` marks pages
    known to be the project's documentation.
    """
    keys = list(keys)
    near = F.lit(False) if adjacent is None else adjacent
    marked = pages.withColumn("_near", near)
    links = extract_links(marked, [*keys, "_near"], url, body)
    docs = links.filter(is_docs_page(F.col("url"), F.col("page_url"), F.col("_near")))
    unique = first_wins(docs, [*keys, U.dedupe_key(F.col("url"))], "pos")
    scoped = stage(
        locale_scope(unique, keys, "url", "page_url").select(*keys, "page_url", "url"),
        group=site_group(F.col("url")),
        _order=url_order_key(U.path(F.col("url"))),
    )
    heads = html_headings(pages, keys, url, body)
    link_counts = scoped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_links"), F.count_distinct("group").alias("_groups")
    )
    head_counts = heads.groupBy(*keys).agg(F.count(F.lit(1)).alias("_heads"))
    path = F.lower(U.path(F.col(url)))
    choice = (
        marked.select(*keys, "_near", path.alias("_path"))
        .join(link_counts, keys, "left")
        .join(head_counts, keys, "left")
        .fillna(0, ["_links", "_groups", "_heads"])
        .select(
            *keys,
            _best_source(
                F.col("_heads"), F.col("_links"), F.col("_groups"), F.col("_path"), F.col("_near")
            ).alias("kind"),
        )
        .filter("kind is not null")
    )
    sampled = balanced_sample(
        scoped.join(choice.filter("kind = 'links'"), keys, "left_semi"),
        keys,
        "group",
        ["_order", "url"],
        rules.MAX_LINKS_PER_INDEX,
    )
    segs = U.segments(U.path(F.col("url")))
    last = F.coalesce(U.last_segment(segs), U.host(F.col("url")))
    by_order = Window.partitionBy(*keys).orderBy("_order", "url")
    from_links = sampled.select(
        *keys,
        F.lit("links").alias("kind"),
        F.row_number().over(by_order).alias("pos"),
        "group",
        T.title_from_slug(last).alias("title"),
        "url",
    )
    chosen = heads.join(choice.filter("kind = 'headings'"), keys, "left_semi")
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("level") <= 2, F.col("title")), ignorenulls=True).over(so_far)
    from_heads = chosen.select(
        *keys,
        F.lit("headings").alias("kind"),
        F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).alias("pos"),
        F.coalesce(section, F.lit("Documentation")).alias("group"),
        "title",
        "url",
    )
    return from_links.unionByName(from_heads)


def scoped_groups(entries: DataFrame, n: int = rules.MAX_GROUP_ENTRIES) -> DataFrame:
    """First ``n`` entries per group of each source, the group taken from the address where missing."""
    from docloom.operators.rollups import _segment_label

    label = F.coalesce(
        "group", _segment_label(F.col("url"), T.coverage_label), F.lit("Documentation")
    )
    return top_per_group(
        entries.withColumn("group", label),
        ["repo_id", "source_url", "group"],
        ["pos"],
        n,
    )


# -- X5 ---------------------------------------------------------------------------------------


def _ids(html: Column) -> Column:
    raw = F.transform(_all(html, _ID), lambda m: F.trim(_value(m, _ID)))
    decoded = F.transform(
        raw, lambda v: F.trim(T.decode_entities(F.coalesce(F.try_url_decode(v), v)))
    )
    return F.array_distinct(F.concat(raw, decoded))


def section_text(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Text of each entry: its section where the address has a fragment, else the whole page.

    ``pages``: url, html. ``entries``: repo_id, title, group, url. A section starts at the heading at or
    before the id (or at the tag itself before any heading) and ends at the next heading of the same or
    a higher level; under 200 characters the whole page is used.
    """
    bodies = first_wins(
        pages.select(U.dedupe_key(F.col("url")).alias("_key"), "html", F.col("url").alias("_u")),
        ["_key"],
        "_u",
    )
    joined = entries.withColumn("_key", U.dedupe_key(F.col("url"))).join(bodies, "_key")
    raw = U.fragment(F.col("url"))
    plain = F.coalesce(F.try_url_decode(raw), raw)
    wanted = F.filter(
        F.transform(F.array(raw, plain, T.decode_entities(raw)), lambda v: F.trim(v)),
        lambda v: v != "",
    )
    parts = joined.withColumn("_wanted", wanted).withColumn(
        "_parts", F.split("html", r"(?i)(?=<h[1-6]\b)")
    )
    has_id = F.transform("_parts", lambda s: F.arrays_overlap(_ids(s), F.col("_wanted")))
    at = parts.withColumn("_at", (F.array_position(has_id, True) - 1).cast("int"))
    level = lambda s: F.regexp_extract(s, r"(?i)^<h([1-6])\b", 1).try_cast("int")
    start = F.get("_parts", F.col("_at"))
    own_level = F.coalesce(level(start), F.lit(2))
    rest = F.slice("_parts", F.col("_at") + 2, F.size("_parts"))
    shallow = F.transform(rest, lambda s: F.coalesce(level(s) <= own_level, F.lit(False)))
    stop = F.array_position(shallow, True).cast("int")
    inner = F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)
    # Before any heading the section starts at the tag that carries the id.
    quoted = F.concat(F.lit(r"(?is)(<[^<>]*\bid\s*=\s*[\"']?\Q"), raw, F.lit(r"\E.*)$"))
    opening = F.when(level(start).isNull(), F.call_function("regexp_extract", start, quoted, F.lit(1))).otherwise(start)
    section = F.regexp_replace(
        F.concat(opening, F.array_join(inner, "")), r"^\s+|\s+$", ""
    )
    usable = (F.size("_wanted") > 0) & (F.col("_at") >= 0) & (F.length(section) >= 200)
    scoped = at.withColumn("_section", F.when(F.coalesce(usable, F.lit(False)), section))
    return scoped.select(
        "repo_id",
        "title",
        "group",
        "url",
        F.col("_section").isNotNull().alias("is_section"),
        readable(F.coalesce("_section", "html")).alias("text"),
    )


# -- X6 ---------------------------------------------------------------------------------------


def sitemap_urls(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), url: str = "url", body: str = "html"
) -> DataFrame:
    """Addresses listed by sitemaps, with nested sitemaps flagged and scored."""
    found = pages.select(*keys, F.col(url).alias("page_url"), F.posexplode(_all(F.col(body), _LOC, 1)).alias("pos", "loc"))
    locs = stage(found, url=U.canonical(F.trim("loc"))).drop("loc").filter(F.col("url").isNotNull())
    h, src, p = U.host(F.col("url")), U.host(F.col("page_url")), U.path(F.col("url"))
    related = (h == src) | (U.last_two_labels(h) == U.last_two_labels(src))
    english = p.rlike(rules.ENGLISH_SITEMAP)
    score = (
        F.when(english, 100).otherwise(0)
        + F.when(p.rlike(rules.DOCS_SITEMAP), 50).otherwise(0)
        + F.when(p.rlike(r"(?i)/latest/"), 20).otherwise(0)
    )
    return locs.select(
        "*",
        (
            related & F.lower(p).endswith(".xml") & F.lower(p).rlike(rules.NESTED_SITEMAP)
        ).alias("is_nested"),
        english.alias("is_english"),
        p.rlike(rules.DOCS_SITEMAP).alias("has_docs_path"),
        score.alias("nested_score"),
    )


def nested_sitemaps(locs: DataFrame, keys: Sequence[str] = ("page_id",), n: int | None = 6) -> DataFrame:
    """Nested sitemaps to read next, the best ``n`` per sitemap (None: all); English ones push out other locales."""
    nested = locs.filter("is_nested")
    english = nested.groupBy(*keys).agg(F.bool_or("is_english").alias("_any"))
    kept = nested.join(english, list(keys)).filter(
        ~F.col("_any") | F.col("is_english") | F.col("has_docs_path")
    )
    kept = kept.drop("_any")
    return kept if n is None else top_per_group(kept, keys, [F.col("nested_score").desc(), "pos"], n)


def sitemap_documents(
    starts: DataFrame,
    bodies: DataFrame,
    keys: Sequence[str] = ("repo_id",),
    n: int | None = 6,
    depth: int | None = None,
    is_document: Callable[[Column], Column] | None = None,
    url: str = "url",
    body: str = "html",
) -> DataFrame:
    """Documents that sitemaps list, through the sitemaps nested in them: ``keys``, url, sitemap (that lists it), depth, pos.

    ``starts``: ``keys`` and the address of a sitemap. ``bodies``: landed addresses and bodies. A sitemap that lists documents (``is_document`` of
    their address; by default all but ``.xml``) gives these; one that lists none hands on to its best ``n`` nested ones (None: all). Every landed body is read
    once, before the rounds, and what landed sitemaps hand on to each other is stored; a round joins only these addresses with those it comes from. A sitemap counts once for each of ``keys``
    whatever names it, so cycles end. Rounds go on until nothing is new, or for ``depth`` rounds beyond the first. An address listed
    several times comes once, from the shallowest sitemap.
    """
    keys = list(keys)
    document = is_document or (lambda u: ~F.lower(U.path(u)).endswith(".xml"))
    landed = bodies.select(U.dedupe_key(F.col(url)).alias("_key"), F.col(body).alias("_body")).dropDuplicates(["_key"])
    # The key has the host of every address it stands for, so what a sitemap lists is told apart without knowing who named it.
    locs = sitemap_urls(landed, ["_key"], "_key", "_body").withColumn("_document", document(F.col("url"))).drop("page_url")
    locs = joinable(locs, "sitemap-locs")
    listing = locs.filter("_document").select("_key", "url", "pos")
    handing = locs.join(listing.select("_key").distinct(), "_key", "left_anti")
    handed = nested_sitemaps(handing, ["_key"], n).select("_key", F.col("url").alias("sitemap"), U.dedupe_key(F.col("url")).alias("_next"))
    known = locs.select(F.col("_key").alias("_next")).distinct()
    handed = joinable(handed.filter("_next <> _key").join(known, "_next", "left_semi"), "sitemaps-handed")

    def unique(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, "_key").agg(F.min("sitemap").alias("sitemap"))

    frontier = starts.select(*keys, F.col(url).alias("sitemap"), U.dedupe_key(F.col(url)).alias("_key"))
    frontier = joinable(unique(frontier), "sitemaps")
    seen, level = [frontier.withColumn("depth", F.lit(0))], 0
    while level != depth:
        level += 1
        new = unique(frontier.drop("sitemap").join(handed, "_key").drop("_key").withColumnRenamed("_next", "_key"))
        past = reduce(DataFrame.unionByName, seen).select(*keys, "_key")
        frontier = joinable(new.join(past, [*keys, "_key"], "left_anti"), "sitemaps")
        if frontier.isEmpty():
            break
        seen.append(frontier.withColumn("depth", F.lit(level)))
    documents = reduce(DataFrame.unionByName, seen).join(listing, "_key").withColumn("_key", U.dedupe_key(F.col("url")))
    documents = documents.select(*keys, "url", "sitemap", "depth", "pos", "_key")
    return first_wins(documents, [*keys, "_key"], ["depth", "sitemap", "pos"]).drop("_key")


# -- X7, W3, W4, X8 ---------------------------------------------------------------------------


def logical_text(text: Column) -> Column:
    """Index text with every heading and list link on a line of its own."""
    t = F.regexp_replace(text, "\r\n", "\n")
    t = F.regexp_replace(t, r"\s+(#{2,6}\s+)", "\n$1")
    t = F.regexp_replace(t, r"\s+-\s+\[", "\n- [")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def heading_groups(lines: DataFrame, keys: Sequence[str], pos: str = "line_no") -> DataFrame:
    """Heading path of every line: distinct titles of the open headings, at most four.

    Needs ``level`` (2 to 6 on heading lines, else null) and ``heading``. A heading closes all of its
    level and deeper, so a level is open iff its last heading came after that of every higher level.
    """
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    titles, places = {}, {}
    for level in range(2, 7):
        here = F.col("level") == level
        titles[level] = F.last(F.when(here, F.col("heading")), ignorenulls=True).over(w)
        places[level] = F.last(F.when(here, F.col(pos)), ignorenulls=True).over(w)
    df = lines.select(
        "*",
        *[titles[i].alias(f"_t{i}") for i in range(2, 7)],
        *[places[i].alias(f"_p{i}") for i in range(2, 7)],
    )
    open_titles = [F.col("_t2")]
    for level in range(3, 7):
        above = [F.coalesce(F.col(f"_p{i}"), F.lit(-1)) for i in range(2, level)]
        last_above = above[0] if len(above) == 1 else F.greatest(*above)
        open_titles.append(F.when(F.col(f"_p{level}") > last_above, F.col(f"_t{level}")))
    kept = F.slice(F.array_distinct(F.filter(F.array(*open_titles), lambda t: t.isNotNull())), 1, 4)
    group = F.array_join(kept, " / ")
    drop = [f"_{k}{i}" for k in "tp" for i in range(2, 7)]
    return df.withColumn("group", F.when(group != "", group)).drop(*drop)


def _document_lines(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    split = docs.select(*keys, F.posexplode(F.split(logical_text(F.col("text")), "\n")).alias("line_no", "line"))
    # Most lines are neither headings nor entries: drop them before anything is parsed.
    telling = split.filter(
        F.col("line").rlike(r"^\s*#{2,6}\s") | F.col("line").rlike(_MD_LINK) | F.col("line").rlike(_URL_LINE)
    )
    lines = stage(telling, line=F.regexp_replace("line", r"^\s+|\s+$", ""))
    pattern = r"^(#{2,6})\s+(.+)$"
    parsed = stage(
        lines,
        _marks=F.length(F.regexp_extract("line", pattern, 1)),
        _title=T.heading_title(F.regexp_extract("line", pattern, 2)),
    )
    named = (F.col("_marks") > 0) & (F.col("_title") != "")
    return parsed.select(
        *keys,
        "line_no",
        "line",
        F.when(named, F.col("_marks")).alias("level"),
        F.when(named, F.col("_title")).alias("heading"),
    )


def markdown_entries(docs: DataFrame, keys: Sequence[str] = ("repo_id", "source_url")) -> DataFrame:
    """Documentation entries of Markdown indexes: links and ``URL:`` lines with their heading path.

    Only heading lines and lines with a link go through the per-document window.
    """
    keys = list(keys)
    explicit = _URL_LINE
    has_entry = F.col("line").rlike(_MD_LINK) | F.col("line").rlike(explicit)
    lines = _document_lines(docs, keys).filter(F.col("level").isNotNull() | has_entry)
    grouped = heading_groups(lines, keys)
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    current = grouped.withColumn("_current", F.last("heading", ignorenulls=True).over(w))
    links = F.transform(
        _all(F.col("line"), _MD_LINK),
        lambda m: F.struct(
            T.entry_title(F.regexp_extract(m, _MD_LINK, 1)).alias("title"),
            F.trim(F.regexp_extract(m, _MD_LINK, 2)).alias("href"),
        ),
    )
    url_line = F.when(
        F.col("line").rlike(explicit),
        F.array(
            F.struct(
                F.coalesce("_current", "group", F.lit("Documentation")).alias("title"),
                F.regexp_extract("line", explicit, 1).alias("href"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<title:string,href:string>>"))
    rows = current.select(
        *keys, "line_no", "group", F.posexplode(F.concat(links, url_line)).alias("at", "e")
    )
    entries = stage(
        rows.select(*keys, "line_no", "at", "group", "e.title", "e.href"),
        url=U.resolve(F.col("source_url"), F.col("href")),
    ).filter(
        (F.col("title") != "")
        & F.col("url").isNotNull()
        & ~is_placeholder_title(F.col("title"))
        & ~U.has_placeholder_segment(F.col("url"))
    )
    place = ["line_no", "at"]
    unique = first_wins(entries, [*keys, F.regexp_replace("url", "/$", "")], place)
    return group_ranks_limited(unique, keys, place, rules.MAX_ENTRIES_PER_SOURCE, "pos").select(
        *keys, "pos", "group", "title", "url"
    )


_FENCE = r"^\s*(```|~~~)"


def _without_end(line: Column) -> Column:
    return F.rtrim(F.regexp_replace(line, r"\s+$", ""))


def _outside(lines: DataFrame, keys: Sequence[str], **more: Column) -> DataFrame:
    """Lines outside code fences; ``more`` is computed over all lines of a file in order."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    fence = F.col("line").rlike(_FENCE)
    seen = F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    columns = {"_fence": fence, "_inside": seen % 2, **{k: v.over(w) for k, v in more.items()}}
    flagged = lines.select("*", *[v.alias(k) for k, v in columns.items()])
    return flagged.filter(~F.col("_fence") & (F.col("_inside") == 0)).drop("_fence", "_inside")


def outside_fences(files: DataFrame, keys: Sequence[str] = ("repo_id", "path")) -> DataFrame:
    """Lines of Markdown files outside code fences, with the line that follows each."""
    lines = files.select(*keys, F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    return _outside(lines.withColumn("line", _without_end(F.col("line"))), keys, next_line=F.lead("line"))


def _heading_lines(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lines that may be or underline headings, and those of fences, each with the line after it; the text stays behind."""
    lines = F.split("text", r"\r?\n")
    pairs = F.arrays_zip(lines.alias("line"), F.slice(lines, 2, 2_147_483_647).alias("next_line"))
    split = files.select(*keys, F.posexplode(pairs).alias("line_no", "_pair")).select(*keys, "line_no", "_pair.line", "_pair.next_line")
    underlined = F.coalesce(F.col("next_line").rlike(r"^ *([=~`#*-])\1{2}"), F.lit(False))
    telling = split.filter(F.col("line").rlike(r"^#{1,4}\s") | underlined | F.col("line").rlike(_FENCE))
    return stage(telling, line=_without_end(F.col("line")), next_line=_without_end(F.col("next_line")))


def markdown_headings(files: DataFrame, keys: Sequence[str] = ("repo_id", "path")) -> DataFrame:
    """ATX and underlined headings of Markdown/RST files, levels 1 to 4, outside code fences."""
    return _headings(_heading_lines(files, keys), keys)


def _headings(telling: DataFrame, keys: Sequence[str]) -> DataFrame:
    lines = _outside(telling, keys)
    atx = r"^(#{1,4})\s+(.+?)\s*#*$"
    under = F.trim(F.coalesce("next_line", F.lit("")))
    underline = under.rlike(r"^(=|-|~|`|#|\*)\1{2,}$")
    first = F.substring(under, 1, 1)
    is_atx = F.col("line").rlike(atx)
    # A line that underlines the heading before it is spent: it cannot be a heading itself.
    w = Window.partitionBy(*keys).orderBy("line_no")
    level = F.when(is_atx, F.length(F.regexp_extract("line", atx, 1))).when(
        underline, F.when(first == "=", 1).when(first == "-", 2).otherwise(3)
    )
    raw = F.when(is_atx, F.regexp_extract("line", atx, 2)).otherwise(F.col("line"))
    t = F.regexp_replace(raw, "<[^>]+>", " ")
    t = F.regexp_replace(t, r"\{#[^}]+\}", "")
    t = F.regexp_replace(t, r"[`*_~\[\]]", "")
    title = T.heading_title(F.trim(F.regexp_replace(t, r"\s+", " ")))
    marked = lines.select(
        *keys,
        "line_no",
        level.alias("level"),
        title.alias("title"),
        (underline & ~is_atx).alias("_takes_next"),
    )
    return (
        marked.withColumn(
            "_spent",
            F.coalesce(
                F.lag("_takes_next").over(w) & (F.lag("line_no").over(w) == F.col("line_no") - 1),
                F.lit(False),
            ),
        )
        .filter(F.col("level").isNotNull() & ~F.col("_spent"))
        .select(*keys, F.col("line_no").alias("pos"), "level", "title")
    )


def docs_file_title(path: Column) -> Column:
    """Title of a documentation file: its route, its directory for index files, else its name."""
    parts = F.split(path, "/")
    base = F.get(parts, F.size(parts) - 1)
    route = _route_segments(path)
    stem = F.regexp_replace(base, r"(?i)\.(md|mdx|rst)$", "")
    parent = F.get(parts, F.size(parts) - 2)
    named = F.when(base.rlike(rules.INDEX_FILE), F.coalesce(parent, stem)).otherwise(stem)
    return T.title_from_slug(
        F.when(route.isNotNull(), F.coalesce(U.last_segment(route), F.lit("overview"))).otherwise(named)
    )


def _route_segments(path: Column) -> Column:
    """Route of a page file below ``src/app`` without group folders; null for other files."""
    parts = F.split(path, "/")
    inside = F.regexp_extract(path, r"(?:^|/)src/app/(.*)$", 1)
    base = F.get(parts, F.size(parts) - 1)
    is_route = path.rlike(r"(?:^|/)src/app/") & base.rlike(rules.ROUTE_PAGE_FILE)
    folders = F.filter(
        F.split(F.regexp_replace(inside, r"[^/]*$", ""), "/"),
        lambda s: (s != "") & ~s.rlike(r"^\(.+\)$"),
    )
    return F.when(is_route, folders)


def docs_file_group(path: Column) -> Column:
    """Group of a documentation file: first two route or path parts below the docs root."""
    route = _route_segments(path)
    parts = F.split(path, "/")
    hits = F.transform(parts, lambda s: s.rlike(rules.DOCS_ROOT_SEGMENT))
    at = (F.array_position(hits, True) - 1).cast("int")
    below = F.array(F.get(parts, at + 1), F.get(parts, at + 2))
    top = F.array(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    routed = F.when(F.size(route) == 0, F.array(F.lit("overview"))).otherwise(F.slice(route, 1, 2))
    return T.slug_path_title(
        F.when(route.isNotNull(), routed).when(at >= 0, below).otherwise(top)
    )


def count_links(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_MD_LINK_COUNTED))


def count_headings(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_MD_HEADING_COUNTED))


def linked_indexes(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """For thin text indexes the best same-origin index file they link to, among landed bodies.

    ``docs`` and ``bodies``: source_url, text (docs also repo_id). Indexes that are rich enough, or
    compact but organised, have no row. The top eight links by address score are looked up.
    """
    src = F.col("source_url")
    own = docs.select(
        "repo_id", "source_url", "text", count_links(F.col("text")).alias("own_links"), count_headings(F.col("text")).alias("own_headings")
    )
    prologue = F.substring("text", 1, 12_000)
    organised = reduce(lambda a, b: a | b, [prologue.rlike(p) for p in rules.COMPACT_INDEX_PROLOGUE])
    compact = F.lower(U.path(src)).endswith("/llms.txt") & (F.col("own_links") >= 20) & organised
    rich = (F.col("own_links") >= 30) & (F.col("own_headings") >= 4)
    thin = own.filter(~compact & ~rich)
    hrefs = F.concat(
        F.transform(_all(F.col("text"), r"\[[^\]\n]*\]\(([^)]+)\)", 1), lambda h: F.trim(h)),
        F.transform(
            _all(F.col("text"), rules.URL_IN_TEXT), lambda u: F.coalesce(U.mention(u), u)
        ),
    )
    linked = stage(
        thin.select("repo_id", "source_url", "own_links", F.posexplode(hrefs).alias("pos", "href")),
        linked_url=U.resolve(src, F.col("href")),
    )
    p = U.path(F.col("linked_url"))
    index_files = linked.filter(
        F.col("linked_url").isNotNull()
        & (U.origin(F.col("linked_url")) == U.origin(src))
        & p.rlike(r"(?i)llms")
        & p.rlike(r"(?i)\.txt$")
        & (F.col("linked_url") != U.canonical(src))
    )
    unique = first_wins(index_files, ["repo_id", "source_url", "linked_url"], "pos")
    scored = unique.withColumn("url_score", weighted(F.lower(p), rules.LINKED_INDEX_RULES))
    best = top_per_group(
        scored, ["repo_id", "source_url"], [F.col("url_score").desc(), "pos"], 8
    )
    text_score = (
        count_links(F.col("text"))
        + count_headings(F.col("text")) * 3
        + weighted(U.path(F.col("source_url")), rules.LINKED_TEXT_RULES)
    )
    landed = bodies.select(
        F.col("source_url").alias("linked_url"),
        count_links(F.col("text")).alias("links"),
        text_score.alias("text_score"),
    )
    found = best.join(landed, "linked_url").filter(F.col("links") >= F.col("own_links"))
    pick = F.struct("linked_url", "links", "text_score")
    order = F.struct("text_score", "url_score", -F.col("pos"))
    return found.groupBy("repo_id", "source_url").agg(F.max_by(pick, order).alias("b")).select(
        "repo_id", "source_url", "b.*"
    )


# -- X9 ---------------------------------------------------------------------------------------


def fallback_docs_paths(files: DataFrame) -> DataFrame:
    """Documentation files of a repository in reading order: docs sources, joined by guide READMEs
    when there are fewer than five."""
    path = F.col("path")
    marked = files.select(
        "repo_id",
        "path",
        is_docs_source(path, "fallback").alias("_docs"),
        is_guide_readme(path).alias("_guide"),
    )
    counts = marked.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.count_if("_docs").alias("_primary")
    )
    kept = marked.filter(F.col("_docs") | F.col("_guide")).join(counts, "repo_id")
    used = kept.filter(F.col("_docs") | (F.col("_primary") < 5)).dropDuplicates(["repo_id", "path"])
    totals = used.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("docs_paths"),
        F.bool_or(path.rlike(rules.ROOT_README)).alias("_root"),
        F.first("file_count").alias("_files"),
    )
    enough = (F.col("docs_paths") >= 2) | (F.col("_root") & (F.col("_files") <= 400))
    eligible = used.join(totals.filter(enough).select("repo_id", "docs_paths"), "repo_id")
    return group_ranks_limited(
        eligible.select("repo_id", "path", "docs_paths"),
        ["repo_id"],
        [docs_path_order_key(path), "path"],
        rules.MAX_LINKS_PER_INDEX,
        "pos",
    )


def repo_docs_index(files: DataFrame, texts: DataFrame, repos: DataFrame) -> DataFrame:
    """Documentation entries from a repository's own docs tree.

    ``files``: repo_id, pos, path, size. ``texts``: repo_id, path, text. ``repos``: repo_id, owner, name,
    default_branch. One entry per documentation file and per kept heading of the first 80 files; a
    source map is added when that gives under 20 links.
    """
    paths = joinable(fallback_docs_paths(files), "docs-paths")
    path = F.col("path")
    # Texts that may be documentation are cut to their telling lines where they are; these meet the paths, not the texts.
    lines = _heading_lines(texts.filter(is_docs_source(path, "fallback") | is_guide_readme(path)), ["repo_id", "path"])
    read = lines.join(
        paths.filter(F.col("pos") <= rules.MAX_FALLBACK_FILES).select("repo_id", "path"),
        ["repo_id", "path"],
        "left_semi",
    )
    heads = _headings(read, ["repo_id", "path"]).withColumn("file_title", docs_file_title(path))
    kept = headings_per_file(heads).withColumn("_base", T.heading_anchor(F.col("title")))
    anchored = numbered_slugs(
        kept, ["repo_id", "path"], "_base", ["pos"], "anchor", first_suffix=1
    )
    blob = F.concat(
        F.lit("https://github.com/"),
        F.concat_ws("/", "owner", "name", F.lit("blob"), "default_branch", "path"),
    )
    root = repos.select("repo_id", "owner", "name", "default_branch")
    file_rows = paths.select(
        "repo_id",
        "path",
        "pos",
        F.lit(-1).alias("at"),
        docs_file_group(F.col("path")).alias("group"),
        docs_file_title(F.col("path")).alias("title"),
        F.lit(None).cast("string").alias("anchor"),
    )
    heading_rows = anchored.join(paths.select("repo_id", "path", F.col("pos").alias("_file_pos")), ["repo_id", "path"]).select(
        "repo_id",
        "path",
        F.col("_file_pos").alias("pos"),
        F.col("pos").alias("at"),
        docs_file_group(F.col("path")).alias("group"),
        "title",
        "anchor",
    )
    docs_rows = file_rows.unionByName(heading_rows)
    # Only files that were read count towards the source map threshold.
    links = docs_rows.filter(F.col("pos") <= rules.MAX_FALLBACK_FILES).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("_links")
    )
    sparse = links.filter(F.col("_links") < 20).select("repo_id")
    known = paths.select("repo_id", "path")
    from docloom.operators.joins import exclude_known

    spare = exclude_known(files.join(sparse, "repo_id", "left_semi"), known)
    source_map = top_files(spare, "source_map").select(
        "repo_id",
        "path",
        (F.col("rank") + rules.MAX_LINKS_PER_INDEX).alias("pos"),
        F.lit(-1).alias("at"),
        F.lit("Source Map").alias("group"),
        F.col("path").alias("title"),
        F.lit(None).cast("string").alias("anchor"),
    )
    rows = docs_rows.unionByName(source_map).join(root, "repo_id")
    fragment = F.when(F.col("anchor").isNotNull(), F.concat(F.lit("#"), F.col("anchor"))).otherwise("")
    entries = rows.select(
        "repo_id", "pos", "at", "path", "group", "title", F.concat(blob, fragment).alias("url")
    )
    return first_wins(entries, ["repo_id", "url"], ["pos", "at"])


# -- X10 --------------------------------------------------------------------------------------


def _rewritten(c: Column, mark: str, pattern: str) -> Column:
    """Matches of ``pattern`` blanked; texts without ``mark``, a part of every match, are left alone."""
    return let(c, lambda t: F.when(~F.contains(t, F.lit(mark)), t).otherwise(F.regexp_replace(t, pattern, " ")))


def prose(markdown: Column) -> Column:
    """Markdown without code, source lines, addresses and paths."""
    t = _rewritten(markdown, "```", r"(?s)```.*?```")
    t = _rewritten(t, "`", r"`[^`\n]+`")
    t = let(
        t,
        lambda x: F.when(~F.contains(F.lower(x), F.lit("sources:")), x).otherwise(
            F.regexp_replace(x, r"(?im)^.*\bSources:\s*.*$", " ")
        ),
    )
    t = _rewritten(t, "://", r"https?://\S+")
    # No path goes beyond its line, so only lines with a slash are searched; a word without one is tried once, from its start.
    path = r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]++/[A-Za-z0-9_./-]+"

    def by_line(x: Column) -> Column:
        lines = F.transform(F.split(x, "\n"), lambda line: F.when(F.contains(line, F.lit("/")), F.regexp_replace(line, path, " ")).otherwise(line))
        return F.when(~F.contains(x, F.lit("/")), x).otherwise(F.array_join(lines, "\n"))

    return let(t, by_line)


def count_matches(c: Column, pattern: str, mark: str | None = None) -> Column:
    """Matches of ``pattern``; a text without ``mark``, a part of every match, is not searched."""
    found = F.regexp_count(c, F.lit(pattern))
    return found if mark is None else F.when(~F.contains(c, F.lit(mark)), 0).otherwise(found)


def metric_columns(c: Column) -> dict[str, Column]:
    return {
        "prose_words": count_matches(prose(c), r"[A-Za-z0-9][A-Za-z0-9'-]*"),
        "raw_words": count_matches(c, r"\S+"),
        "h2": count_matches(c, r"(?m)^##\s+", "##"),
        "h3": count_matches(c, r"(?m)^###\s+", "###"),
        "index_headings": count_headings(c),
        "links": count_links(c),
        "table_rows": count_matches(c, r"(?m)^\|.+\|$", "|"),
        "fences": count_matches(c, r"(?m)^```", "```"),
        "inline_code": count_matches(c, r"`[^`\n]+`", "`"),
        "option_bullets": count_matches(c, r"(?m)^\s*[-*]\s+`[^`\n]+`", "`"),
    }


def text_metrics(docs: DataFrame, col: str = "text") -> DataFrame:
    """Add word, heading, link, table, fence and code counts of Markdown text."""
    return docs.select("*", *[m.alias(n) for n, m in metric_columns(F.col(col)).items()])


# -- X11 .. X13 -------------------------------------------------------------------------------


def _repo_file(value: Column) -> Column:
    """Path in a repository file address, or null."""
    path = F.regexp_extract(value, r"(?i)^https?://github\.com(/[^?#]*)", 1)

    def below(segs: Column) -> Column:
        marker = F.transform(segs, lambda s: s.isin("blob", "tree"))

        def cut(at: Column) -> Column:
            inside = F.array_join(F.slice(segs, F.greatest(at + 3, F.lit(1)), F.size(segs)), "/")
            return F.when((at >= 0) & (at + 2 < F.size(segs)), inside)

        return let((F.array_position(marker, True) - 1).cast("int"), cut)

    return let(F.filter(F.split(path, "/"), lambda s: s != ""), below)


def citation_path(value: Column) -> Column:
    """A cited file path in normal form, or null when the text is not a path of a known kind."""
    p = F.coalesce(_repo_file(value), F.trim(value))
    p = F.regexp_replace(p, r"^<|>$", "")
    p = F.regexp_replace(p, r"[?#].*$", "")
    p = F.regexp_replace(p, r":\d+(?::\d+)?$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"^\./+", ""), "^/+", "")

    def known(c: Column) -> Column:
        bad = (c == "") | c.contains("://") | c.rlike(r"\s") | ~c.rlike(rules.CITED_EXTENSION)
        return F.when(~bad, c)

    return let(p, known)


def extract_citations(
    messages: DataFrame,
    keys: Sequence[str] = ("conv_id", "turn"),
    col: str = "text",
    limit: int = rules.MAX_CITATIONS_PER_MESSAGE,
) -> DataFrame:
    """Files a message cites, one row each in order: code spans, links, repository addresses, bare
    paths; distinct, at most twelve per message."""
    c = F.col(col)
    pairs = F.flatten(
        F.transform(
            _all(c, rules.MARKDOWN_LINK),
            lambda m: F.array(*[F.regexp_extract(m, rules.MARKDOWN_LINK, g) for g in (1, 2)]),
        )
    )
    raw = F.concat(
        _all(c, rules.CODE_SPAN, 1), pairs, _all(c, rules.REPO_FILE_URL), _all(c, rules.BARE_PATH, 1)
    )
    paths = F.array_distinct(F.filter(F.transform(raw, citation_path), lambda p: p.isNotNull()))
    return messages.select(*keys, F.posexplode(F.slice(paths, 1, limit)).alias("pos", "path"))


def toc(pages: DataFrame, keys: Sequence[str] = ("page_id",), col: str = "markdown", n: int = 24) -> DataFrame:
    """Table of contents: second and third level headings with unique ids, at most 24 per page."""
    lines = pages.select(*keys, F.posexplode(F.split(col, "\n")).alias("pos", "line"))
    pattern = r"^(#{2,3})\s+(.+)$"
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    heads = lines.withColumn("line", line).filter(F.col("line").rlike(pattern))
    t = F.regexp_replace(F.regexp_extract("line", pattern, 2), r"`([^`]+)`", "$1")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    title = F.trim(F.regexp_replace(t, r"[*_~]", ""))
    rows = heads.select(
        *keys, "pos", F.length(F.regexp_extract("line", pattern, 1)).alias("depth"), title.alias("title")
    ).filter("title <> ''")
    based = rows.withColumn("_base", T.slug(F.col("title")))
    ids = numbered_slugs(based, keys, "_base", ["pos"], "id", first_suffix=2).drop("_base")
    return top_per_group(ids, keys, ["pos"], n)


def url_mentions(
    docs: DataFrame,
    keys: Sequence[str] = ("repo_id",),
    pos: str = "pos",
    col: str = "text",
    n: int = rules.MAX_URLS_PER_REPO,
) -> DataFrame:
    """Addresses mentioned in a repository's texts, cleaned, first 40 distinct ones in order."""
    found = docs.select(*keys, F.col(pos).alias("doc_pos"), F.posexplode(_all(F.col(col), rules.URL_IN_TEXT)).alias("at", "raw"))
    clean = stage(found, url=U.mention(F.col("raw"))).filter(
        F.col("url").isNotNull() & is_admitted_host(U.host(F.col("url")))
    )
    order = ["doc_pos", "at"]
    unique = first_wins(clean.drop("raw"), [*keys, "url"], order)
    return group_ranks_limited(unique, keys, order, n, "pos").drop("doc_pos", "at")


def image_source(url: Column, owner: Column, name: Column, commit: Column) -> Column:
    """Image address for publishing: raw-content addresses stay, repository-relative ones are pinned to
    the commit, everything else is dropped."""
    u = F.trim(url)
    rel = F.regexp_replace(F.regexp_replace(u, r"^\./", ""), "^/+", "")
    raw = F.lit("https://raw.githubusercontent.com")
    safe = rel.rlike(rules.IMAGE_OR_PAGE_PATH) & ~rel.startswith("../")
    return (
        F.when(u.rlike("(?i)^https:"), F.when(U.host(u) == "raw.githubusercontent.com", U.canonical(u)))
        .when(u.rlike("(?i)^(http:|data:)") | u.contains("://"), F.lit(None))
        .when(safe, F.concat_ws("/", raw, owner, name, F.coalesce(commit, F.lit("main")), rel))
    )


def page_link(url: Column, base_path: Column) -> Column:
    """Link target for publishing: absolute ones stay, page slugs become paths, unsafe ones are null."""
    u = F.trim(url)
    rel = F.regexp_replace(u, r"^\./", "")
    slug_part = F.regexp_replace(rel, "#.*$", "")
    anchor = F.regexp_extract(rel, r"(#.*)$", 1)
    safe = rel.rlike(rules.IMAGE_OR_PAGE_PATH) & ~rel.startswith("../") & ~rel.contains("://")
    page = F.when(slug_part == "overview", base_path).otherwise(F.concat_ws("/", base_path, slug_part))
    return (
        F.when(u.startswith("#") | u.rlike("(?i)^(https?:|mailto:|tel:)") | u.startswith("/"), u)
        .when(safe, F.concat(page, anchor))
    )
