"""Text normalisers, tokenisers and title builders as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.binding import let


def slug(c: Column) -> Column:
    """Lower-case, runs of non-alphanumerics become one dash, outer dashes removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def heading_slug(c: Column) -> Column:
    """Slug of a rendered heading; an empty one becomes ``section``."""
    return F.regexp_replace(slug(c), "^$", "section")


def compact(c: Column) -> Column:
    """Lower-case with every non-alphanumeric removed."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def spaced(c: Column) -> Column:
    """Lower-case with runs of non-alphanumerics turned into one blank."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")


def heading_anchor(c: Column) -> Column:
    """Anchor of a Markdown heading: letters and digits of any script are kept."""
    a = F.regexp_replace(F.lower(c), "<[^>]+>", "")
    a = F.regexp_replace(a, "[`*_~]", "")
    a = F.regexp_replace(a, "&[a-z0-9#]+;", "")
    a = F.regexp_replace(a, r"[^\p{L}\p{N}\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(a), r"\s+", "-"), "^$", "section")


# -- tokenisers -------------------------------------------------------------------------------


def _min_length(words: Column, n: int) -> Column:
    return F.filter(words, lambda w: F.length(w) >= n)


def plain_words(c: Column, min_length: int = 3) -> Column:
    return _min_length(F.split(F.lower(c), "[^a-z0-9]+"), min_length)


def camel_words(c: Column, min_length: int = 1) -> Column:
    """Words with a break between a lower-case letter or digit and an upper-case letter."""
    return plain_words(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), min_length)


def source_words(c: Column) -> Column:
    """Camel-split words of at least four letters, plus a short list of useful short ones."""
    return F.filter(
        camel_words(c), lambda w: (F.length(w) >= 4) | w.isin(rules.USEFUL_SHORT_TERMS)
    )


def stem_variants(word: Column) -> Column:
    """The word and its crude stems (-ies, -ing, -ing+e, -ed, -s)."""
    n = F.length(word)

    def cut(k: int) -> Column:
        return F.substr(word, F.lit(1), n - k)

    ing = word.endswith("ing") & (n > 5)
    candidates = F.array(
        word,
        F.when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))),
        F.when(ing, cut(3)),
        F.when(ing, F.concat(cut(3), F.lit("e"))),
        F.when(word.endswith("ed") & (n > 4), cut(2)),
        F.when(word.endswith("s") & (n > 4), cut(1)),
    )
    return F.array_distinct(
        F.filter(candidates, lambda v: v.isNotNull() & (F.length(v) >= 3))
    )


def _with_variants(words: Column, limit: int) -> Column:
    return F.slice(F.array_distinct(F.flatten(F.transform(words, stem_variants))), 1, limit)


def title_concepts(title: Column) -> Column:
    """Up to eight distinct title words that say what the page is about."""
    kept = F.filter(plain_words(title), lambda w: ~w.isin(rules.GENERIC_TITLE_WORDS))
    return F.slice(F.array_distinct(kept), 1, 8)


def title_words(title: Column) -> Column:
    return _with_variants(title_concepts(title), 8)


def page_keywords(title: Column, page_slug: Column, purpose: Column) -> Column:
    text = F.concat_ws(" ", title, page_slug, purpose)
    kept = F.filter(plain_words(text), lambda w: ~w.isin(rules.PAGE_KEYWORD_STOP_WORDS))
    return _with_variants(kept, 24)


def description_words(description: Column) -> Column:
    kept = F.filter(
        plain_words(description, 5), lambda w: ~w.isin(rules.DESCRIPTION_STOP_WORDS)
    )
    return F.slice(F.array_distinct(kept), 1, 8)


# -- titles -----------------------------------------------------------------------------------


def _capitalised(word: Column, lower_tail: bool) -> Column:
    tail = F.substr(word, F.lit(2))
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(tail) if lower_tail else tail)


def _cased(words: Column, acronyms: Sequence[str], lower_tail: bool, keep_caps: bool = False):
    def one(w: Column) -> Column:
        case = F.when(F.lower(w).isin(list(acronyms)), F.upper(w))
        if keep_caps:
            case = case.when(w.rlike("^[A-Z0-9]{2,}$"), w)
        return case.otherwise(_capitalised(w, lower_tail))

    return F.array_join(F.transform(words, one), " ")


def _non_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def title_from_slug(c: Column) -> Column:
    """Title of a URL or file slug: extension dropped, acronyms upper-cased."""
    base = F.regexp_replace(c, r"(?i)\.[a-z0-9]+$", "")
    title = _cased(_non_empty(F.split(base, "[-_]+")), rules.SLUG_ACRONYMS, lower_tail=False)
    return F.regexp_replace(title, "^$", "Documentation")


def outline_title_from_slug(c: Column) -> Column:
    words = _non_empty(F.split(c, "[-_]+"))
    return _cased(words, rules.OUTLINE_ACRONYMS, lower_tail=True)


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def nav_title(c: Column) -> Column:
    """Sidebar title: acronyms and all-capital words kept, first letters capitalised."""
    return _cased(
        F.split(_squeezed(c), " "), rules.NAV_ACRONYMS, lower_tail=False, keep_caps=True
    )


def topic_label(c: Column) -> Column:
    text = _squeezed(F.regexp_replace(c, "[-_]+", " "))
    return _cased(F.split(text, " "), rules.TOPIC_ACRONYMS, lower_tail=True)


def coverage_label(c: Column) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[-_]+", " "))
    return _cased(F.split(text, " "), rules.NAV_ACRONYMS, lower_tail=True)


def slug_path_title(segments: Column) -> Column:
    """First two present segments as titles, joined by a slash."""
    kept = F.slice(F.filter(segments, lambda s: s.isNotNull() & (s != "")), 1, 2)
    title = F.array_join(F.transform(kept, title_from_slug), " / ")
    return F.regexp_replace(title, "^$", "Documentation")


def decode_entities(c: Column) -> Column:
    for entity, char in rules.HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style\b.*?</style>", " ")
    return F.regexp_replace(c, "<[^>]+>", " ")


def entry_title(c: Column) -> Column:
    """Title of a documentation entry with inline Markdown and list marks removed."""
    t = F.regexp_replace(decode_entities(c), r"\[([^\]\n]+)\]\([^)]+\)", "$1")
    t = F.regexp_replace(t, "[`*_]", "")
    t = F.regexp_replace(t, r"\s*§\s*$", "")
    t = F.regexp_replace(t, r"^[-*]\s+", "")
    return _squeezed(t)


def heading_title(c: Column) -> Column:
    """Title of a heading line: the text of a leading link, else the part before a link list."""
    # A leading link leaves only its text; what follows " - [" is the link list of the section.
    linked = F.regexp_replace(F.trim(c), r"(?s)^\[([^\]\n]+)\]\([^)]+\).*$", "$1")
    return entry_title(F.get(F.split(linked, r"\s+-\s+\["), F.lit(0)))


def qualified_title(title: Column, qualifier: Column) -> Column:
    """Put the qualifier before a generic title unless it already starts with it."""
    starts = F.startswith(slug(title), slug(qualifier))
    return F.when(qualifier.isNull() | starts, title).otherwise(
        F.concat_ws(" ", qualifier, title)
    )


def quiet_title(page_slug: Column, title: Column) -> Column:
    """Outline title without navigation chrome; setup pages take the title of their slug."""
    s = slug(page_slug)

    def pick(cleaned: Column) -> Column:
        setup = s.rlike(rules.SETUP_SLUG) & cleaned.rlike(rules.SETUP_TITLE)
        return (
            F.when(cleaned == "", title)
            .when(setup, outline_title_from_slug(s))
            .otherwise(cleaned)
        )

    return let(_squeezed(F.regexp_replace(title, rules.NAV_CHROME_PHRASE, "")), pick)
