"""URL parts and URL resolution as Column expressions.

Written with regular expressions rather than ``parse_url``: the latter rejects host names and paths
that real pages contain, and these stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.binding import let
from docloom.functions.text import slug

def is_http(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/?#\s]+")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    )


def origin(url: Column) -> Column:
    """Scheme and authority, lower-cased, without user information and default port."""
    o = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    o = F.regexp_replace(o, "://[^@]*@", "://")
    return F.regexp_replace(F.regexp_replace(o, "^(https://.*):443$", "$1"), "^(http://.*):80$", "$1")


def _after_origin(url: Column) -> Column:
    """Path, query and fragment; the path at least a slash."""
    tail = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    return F.regexp_replace(tail, r"^(?=[?#]|$)", "/")


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(p, "^$", "/")


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def registrable_host(h: Column) -> Column:
    """Last two labels of the host without a leading www."""
    return last_two_labels(F.regexp_replace(F.lower(h), r"^www\.", ""))


def last_two_labels(h: Column) -> Column:
    return F.regexp_extract(h, r"([^.]*\.[^.]*|[^.]*)$", 1)


def primary_label(h: Column) -> Column:
    return F.get(F.split(F.regexp_replace(F.lower(h), r"^www\.", ""), r"\."), F.lit(0))


def is_shared_host(h: Column) -> Column:
    """Hosts where unrelated projects live next to each other."""
    return F.lower(h).rlike(rules.SHARED_DEPLOYMENT_HOST)


def is_docs_host(h: Column) -> Column:
    return primary_label(h).isin(rules.DOCS_HOST_LABELS)


def segments(p: Column) -> Column:
    return F.filter(F.transform(F.split(p, "/"), lambda s: F.trim(s)), lambda s: s != "")


def last_segment(segs: Column) -> Column:
    return F.try_element_at(segs, F.lit(-1))


def locale_segment(segs: Column) -> Column:
    """Leading locale segment of a path, or null."""
    first = F.lower(F.get(segs, F.lit(0)))
    return F.nullif(F.regexp_extract(first, "^([a-z]{2}(?:-[a-z]{2})?)$", 1), F.lit(""))


def is_version_segment(s: Column) -> Column:
    return F.lower(s).rlike(rules.VERSION_SEGMENT)


def has_placeholder_segment(url: Column) -> Column:
    return F.exists(segments(path(url)), lambda s: s.rlike(rules.PLACEHOLDER_WORD))


def _without_dot_segments(tail: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        return (
            F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    p = F.regexp_extract(tail, "^([^?#]*)", 1)
    rest = F.regexp_replace(tail, "^[^?#]*", "")
    folded = F.aggregate(F.slice(F.split(p, "/"), 2, 1000000), F.array(F.lit("")), step)
    closed = F.concat(
        F.array_join(folded, "/"), F.when(p.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    )
    return F.concat(F.regexp_replace(closed, "^$", "/"), rest)


def canonical(url: Column) -> Column:
    """Scheme and host lower-cased, default port and dot segments removed, empty path a slash."""

    def tidy(tail: Column) -> Column:
        return F.when(tail.rlike(r"^[^?#]*/\.{1,2}(/|[?#]|$)"), _without_dot_segments(tail)).otherwise(
            tail
        )

    return let(
        url,
        lambda u: F.when(is_http(u), F.concat(origin(u), let(_after_origin(u), tidy))),
    )


def resolve(base: Column, href: Column) -> Column:
    """Resolve a link against the page it was found on; null when it is not a web address."""

    def target(h: Column) -> Column:
        directory = F.regexp_replace(path(base), "[^/]*$", "")
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin(base), h))
            .when(h.startswith("?"), F.concat(origin(base), path(base), h))
            .when((h == "") | h.startswith("#"), F.concat(without_fragment(base), h))
            .otherwise(F.concat(origin(base), directory, h))
        )

    return canonical(let(href, target))


def dedupe_key(url: Column) -> Column:
    """Key under which two addresses are the same page: no fragment, no trailing slash."""
    return F.regexp_replace(without_fragment(url), "/$", "")


def mention(url: Column) -> Column:
    """Clean an address found in prose: trailing punctuation and the fragment go."""
    return canonical(without_fragment(F.regexp_replace(url, "[.,;:!?]+$", "")))


def entry_slug(url: Column) -> Column:
    """Slug of the last path part that is not a generic docs word; null when there is none."""
    parts = F.transform(
        F.split(F.regexp_replace(path(url), r"(?i)\.(md|mdx|html?)$", ""), "/"), slug
    )
    kept = F.filter(parts, lambda s: (s != "") & ~s.rlike(rules.GENERIC_URL_PART))
    return F.when(is_http(url), last_segment(kept))


def namespace(url: Column) -> Column:
    """Product namespace of a reference URL, or null."""

    def lookup(p: Column) -> Column:
        case = None
        for pattern, name in rules.URL_NAMESPACES:
            case = (F if case is None else case).when(p.rlike(pattern), F.lit(name))
        family = F.regexp_extract(p, rules.DOCS_FAMILY_NAMESPACE, 1)
        return case.otherwise(F.nullif(family, F.lit("")))

    return F.when(is_http(url), let(F.lower(path(url)), lookup))


def comparable_segment(s: Column) -> Column:
    s = F.regexp_replace(F.lower(s), r"^\d+-", "")
    s = F.regexp_replace(s, r"\[\[?\.{3}(.+?)\]?\]", "$1")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def comparable_url_segments(url: Column) -> Column:
    parts = F.transform(F.split(path(url), "/"), comparable_segment)
    return F.when(
        is_http(url),
        F.filter(parts, lambda s: (s != "") & ~s.rlike(rules.GENERIC_DOCS_ROOT)),
    ).otherwise(F.array().cast("array<string>"))


def comparable_path_segments(p: Column) -> Column:
    """Path segments below a known documentation root; empty outside of one."""
    segs = F.filter(
        F.transform(
            F.split(F.regexp_replace(p, rules.COMPARABLE_EXTENSION, ""), "/"),
            comparable_segment,
        ),
        lambda s: s != "",
    )

    def below(raw: Column) -> Column:
        case = None
        for prefix in rules.DOCS_CONTENT_PREFIXES:
            parts = prefix.split("/")
            n = len(parts)
            hit = (F.size(raw) >= n) & (F.slice(raw, 1, n) == F.array(*map(F.lit, parts)))
            case = (F if case is None else case).when(hit, F.slice(raw, n + 1, 1000000))
        return case.otherwise(F.array().cast("array<string>"))

    return let(segs, below)


def ends_with(segs: Column, suffix: Column) -> Column:
    n, k = F.size(segs), F.size(suffix)
    return (k > 0) & (k <= n) & (F.slice(segs, F.greatest(n - k + 1, F.lit(1)), k) == suffix)
