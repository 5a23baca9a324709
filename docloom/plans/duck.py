"""Small pieces of DuckDB SQL for the checks."""

from __future__ import annotations

from collections.abc import Iterable


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


def compact(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def host(x: str) -> str:
    pattern = q("^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
    return f"lower(regexp_extract({x}, {pattern}, 1))"


def path(x: str) -> str:
    p = f"regexp_extract({x}, {q('^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)')}, 1)"
    return f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"


def key(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '#.*$', ''), '/$', '')"


def last_two(h: str) -> str:
    parts = f"string_split({h}, '.')"
    return f"array_to_string({parts}[greatest(len({parts}) - 1, 1):], '.')"


def registrable(h: str) -> str:
    return last_two(f"regexp_replace(lower({h}), '^www\\.', '')")


def segments(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda s: trim(s) <> '')"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def any_hit(x: str, patterns: Iterable[str]) -> str:
    return "(" + " OR ".join(hit(x, p) for p in patterns) + ")"


def weights(x: str, pairs: Iterable[tuple[str, int]]) -> str:
    return "(" + " + ".join(f"CASE WHEN {hit(x, p)} THEN {w} ELSE 0 END" for p, w in pairs) + ")"


def first(x: str, pairs: Iterable[tuple[str, object]], otherwise: object) -> str:
    def lit(v: object) -> str:
        return q(v) if isinstance(v, str) else str(v)

    body = " ".join(f"WHEN {hit(x, p)} THEN {lit(v)}" for p, v in pairs)
    return f"(CASE {body} ELSE {lit(otherwise)} END)"


def ladder(x: str, steps: Iterable[tuple[int, int]], otherwise: str | None = None) -> str:
    body = " ".join(f"WHEN {x} >= {b} THEN {v}" for b, v in steps)
    tail = "" if otherwise is None else f" ELSE {otherwise}"
    return f"(CASE {body}{tail} END)"


def strings(values: Iterable[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def words(x: str, n: int = 3) -> str:
    return (
        f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) >= {n})"
    )


def decode(x: str) -> str:
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(pattern)})) AS BIGINT)"


def distinct_in_order(lst: str) -> str:
    return f"list_filter({lst}, lambda v, i: list_position({lst}, v) = i)"
