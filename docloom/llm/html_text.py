"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides what it can: blocks in menus, headers, footers,
sidebars, notices, adverts, forms, comments and the like are bad by their element, role, class or id; link-dense blocks
are bad; long blocks rich in stop words are good; short ones, and ones poor in stop words inside an article,
stay ambiguous. The second pass gives every ambiguous block the label of its nearest decided neighbours in
its own region (article or rest); where they disagree, or none is decided, the region decides.
An article only shifts thresholds: blocks outside it are judged as on a page without one. On a page whose long blocks have next to
no listed stop words, its language is not listed, and length and links alone decide.

A class or id marks an element only by a whole name: an unwanted word, alone, with the word of a container behind it (``comment-list``) or of a
place before it (``site-footer``); ``has-sidebar`` or ``ad-free`` mark nothing. And names and forms are only claims: an element that holds most of the page's
long blocks, while hardly any stand outside all such elements, is read as if it had none.

Pages are independent rows, so there is no shuffle; memory is one page, and time grows with its length alone, however broken it is: open elements are counted, not
searched, and a search that found nothing is not made again.

A null or empty page gives an empty text. Character references are decoded, white space in a block becomes one space,
blocks are joined by one space in page order. Unclosed elements (a link ends with the block it stands in), stray end tags, tags inside scripts and truncated pages
are read as browsers do, roughly. Repeated rows are each extracted; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import table
from docloom.llm.registry import register

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    (
        "a an and are as at be but by for from had has have he her his i in is it its not of on one or she so that the "
        "their they this to was we were which who will with you "
        "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes mon ne nos "
        "nous on ou par pas plus pour qu que qui sa se ses son sur ta te un une vous y "
        "aber als am an auch auf aus bei bin bis das dass dem den der des die dies durch ein eine einem einen einer "
        "er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und von vor war "
        "was wenn wie wir wird zu zum zur "
        "al como con cual cuando de del desde donde e el ella en entre era es esta este fue ha hay la las le les lo "
        "los más mi muy no nos o para pero por que quien se ser si sin sobre su sus también te tiene un una y ya"
    ).split()
)
# Elements that are never the article, raw ones whose content is no markup, and void ones.
BOILERPLATE = frozenset("nav header footer aside menu dialog button select option iframe object noscript template svg canvas".split())
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
UNWANTED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar "
    "toolbar share sharing social related recommended comment comments commentlist reply replies disqus respond form "
    "search skip hidden".split()
)
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
WANTED_NAMES = frozenset("article content post entry story main maincontent body-text articlebody".split())

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
STOP_LEAST = 0.06  # below it in all long blocks, the page's language is not a listed one
LINKS_HIGH, LINKS_ARTICLE = 0.2, 0.5

# Words that stand behind or before an unwanted one in the name of its container.
CONTAINERS = frozenset(
    "area bar block body box button buttons card cards col column container content entries feed group header heading holder icons inner item items "
    "label link links list main message module news outer panel post posts row section slot stories tab tabs text thread title top unit wrap wrapper".split()
)
PLACES = frozenset(
    "article blog bottom content desktop entry fixed global left local main mobile page post primary right secondary site sticky story sub top user "
    "web website".split()
)

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
WORD = re.compile(r"\w+")
QUOTE = re.compile(r"=\s*(?:(\")|('))|[\"']")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
UNSTACKED = frozenset("p li td th tr dt dd option h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    text: str
    linked: int
    region: str  # "article", "rest" or "out"
    claim: int = -1  # the innermost element around it that is unwanted by its name, or a form
    label: str = ""


def _unwanted(token: str) -> bool:
    parts = [x for x in re.split("[_-]+", token) if x]
    if not parts:
        return False
    if parts[0] in UNWANTED_NAMES:
        return all(x in UNWANTED_NAMES or x in CONTAINERS or x.isdigit() for x in parts[1:])
    return parts[-1] in UNWANTED_NAMES and all(x in PLACES for x in parts[:-1])


def _kind(tag: str, attributes: str) -> str:
    """What an element says about its content: "out", "claim" (out by its name), "in" or nothing."""
    if tag in BOILERPLATE:
        return "out"
    found = {}
    if attributes and not attributes.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        return "out"
    if found.get("role", "").lower() in UNWANTED_ROLES:
        return "out"
    if tag in ("article", "main") or found.get("role", "").lower() in ("main", "article"):
        return "in"
    tokens = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    if tag == "form" or tag not in ("body", "html") and any(map(_unwanted, tokens)):
        return "claim"
    if tag in ("div", "section") and any(WANTED_NAMES.intersection((t, *re.split("[_-]+", t))) for t in tokens):
        return "in"
    return ""


class _Finder:
    """``str.find`` that does not look twice for what is not there."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.gone.add(what)
        return i


def _tag_end(page: str, at: int, find: _Finder) -> int:
    """The position of the ``>`` that ends the tag at ``at``; one in a quoted value does not, if the quote is closed. -1: none."""
    start = at
    while (end := find.find(">", at)) >= 0:
        quote = ""
        for m in QUOTE.finditer(page, start, end):
            if not quote and (m[1] or m[2]):
                quote = m[1] or m[2]
            elif quote and (m[0][-1] == quote):
                quote = ""
        if not quote:
            return end
        close = find.find(quote, end)
        if close < 0:
            return end
        start = at = close + 1
    return -1


def tags(page: str):
    """(text before, name in lower case or "", whether it ends an element, attributes) of every tag; the last has no name."""
    find, at, n, open_text = _Finder(page), 0, len(page), 0
    while (i := find.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = find.find("-->", i + 2)
            close, name = (n if end < 0 else end + 3), None
        elif page.startswith("<![CDATA[", i):
            end = find.find("]]>", i)
            close, name = (n if end < 0 else end + 3), None
        elif page.startswith(("<!", "<?"), i):
            end = find.find(">", i)
            close, name = end + 1, None
            if end < 0:
                break
        elif name := NAME.match(page, i):
            end = _tag_end(page, name.end(), find)
            close = end + 1
            if end < 0:
                break
        else:
            at = i + 1
            continue
        tag = name[1].lower() if name else ""
        ends = name is not None and page[i + 1] == "/"
        yield page[open_text:i], tag, ends, page[name.end() : end] if name else ""
        if tag in RAW and not ends:
            m = RAW_END[tag].search(page, close) if tag not in find.gone else None
            if not m:
                find.gone.add(tag)
            close = m.end() if m else n
        at = open_text = close
    yield page[open_text:], "", False, ""


def blocks(page: str) -> list[Block]:
    """The blocks of a page with their link characters and region, empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = []  # open elements that are not inline, their kind, whether inside an article, the claim before
    opened: dict[str, int] = {}  # how many of each are on the stack
    count = {"in": 0, "out": 0, "": 0, "claim": 0}
    parents: list[int] = []  # of each claim, the one around it
    texts: list[str] = []
    since: dict[str, int] | None = None  # blocks opened since the open link began
    linked, claim, region = 0, -1, "rest"

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            out.append(Block(text, linked, region, claim))
        texts.clear()
        linked = 0

    def push(tag: str, kind: str) -> None:
        nonlocal claim
        stack.append((tag, kind, count["in"] > 0, claim))
        opened[tag] = opened.get(tag, 0) + 1
        count[kind] += 1
        if kind == "claim":
            parents.append(claim)
            claim = len(parents) - 1

    def pop() -> str:
        nonlocal claim
        tag, kind, _, claim = stack.pop()
        opened[tag] -= 1
        count[kind] -= 1
        return tag

    for text, tag, ends, attributes in tags(page):
        if text and region != "out":
            texts.append(text)
            if since is not None:
                linked += len(" ".join(html.unescape(text).split()))
        if not tag:
            continue
        if tag == "a":
            since = None if ends else {}
        if tag in INLINE:
            kind = "" if ends or tag in VOID else _kind(tag, attributes)
            if tag in ("br", "wbr", "img"):
                texts.append(" ")
            elif kind in ("out", "claim"):
                flush()
                push(tag, kind)
            elif ends and stack and stack[-1][0] == tag and stack[-1][1] in ("out", "claim"):
                flush()
                pop()
            else:
                continue
        else:
            flush()
            if tag in VOID:
                continue
            if not ends:
                if since is not None:
                    since[tag] = since.get(tag, 0) + 1
                kind = "out" if tag == "head" else _kind(tag, attributes)
                if kind or tag not in UNSTACKED:
                    push(tag, kind)
            else:
                if since is not None:
                    since[tag] = since.get(tag, 0) - 1
                    if since[tag] < 0:  # the block that the link stands in
                        since = None
                if opened.get(tag):
                    while pop() != tag:
                        pass
        if count["out"]:
            # a header inside an article may hold its headline
            headline = count["out"] == 1 and count["in"] and tag in ("h1", "h2") and not ends and _in_header(stack)
            region = "article" if headline else "out"
        else:
            region = "article" if count["in"] else "rest"
    flush()
    return _settled(out, parents)


def _in_header(stack: list) -> bool:
    """Whether the only unwanted element is a header within an article; it is near the top of the stack if a headline stands in it."""
    for tag, kind, inside, _ in reversed(stack[-8:]):
        if kind == "out":
            return tag == "header" and inside
    return False


def _settled(found: list[Block], parents: list[int]) -> list[Block]:
    """Blocks in elements that are unwanted by name become "out", unless such an element holds the page's text."""
    if not parents:
        return found
    held, total, free = [0] * len(parents), 0, 0
    for b in found:
        if b.region != "out" and len(b.text) >= LENGTH_LOW and b.linked <= LINKS_HIGH * len(b.text):
            total += len(b.text)
            if b.claim < 0:
                free += len(b.text)
            else:
                held[b.claim] += len(b.text)
    for i in range(len(parents) - 1, -1, -1):
        if parents[i] >= 0:
            held[parents[i]] += held[i]
    unwanted: list[bool] = []
    for i, parent in enumerate(parents):
        own = not (2 * held[i] > total and free < LENGTH_HIGH)
        unwanted.append(own or (parent >= 0 and unwanted[parent]))
    for b in found:
        if b.claim >= 0 and unwanted[b.claim]:
            b.region = "out"
    return [b for b in found if b.region != "out"]


def _weight(text: str) -> int:
    """Length in letters of an alphabet; a character of a script without spaces counts twice."""
    return len(text) + sum(c >= "\u2e80" for c in text)


def classify(found: list[Block]) -> list[Block]:
    """Label every block good or bad, in two passes."""
    measured, all_words, all_stops = [], 0, 0
    for b in found:
        words = WORD.findall(b.text.lower())
        size, links = _weight(b.text), b.linked / max(len(b.text), 1)
        stops = sum(w in STOP_WORDS for w in words)
        if size >= LENGTH_LOW and links <= LINKS_HIGH:
            all_words, all_stops = all_words + len(words), all_stops + stops
        measured.append((size, links, stops / max(len(words), 1)))
    unlisted = all_stops < STOP_LEAST * all_words
    for b, (size, links, stops) in zip(found, measured):
        inside = b.region == "article"
        if links > (LINKS_ARTICLE if inside else LINKS_HIGH):
            b.label = "bad"
        elif size < LENGTH_LOW:
            b.label = "short"
        elif stops >= STOP_HIGH or unlisted:
            b.label = "good" if size > LENGTH_HIGH or inside else "near"
        elif stops >= STOP_LOW:
            b.label = "near"
        else:
            b.label = "near" if inside else "bad"
    decided = [(i, b) for i, b in enumerate(found) if b.label in ("good", "bad")]
    after = {}
    for i, b in reversed(decided):
        after[i] = b
    positions = [i for i, _ in decided]
    j = 0
    for i, b in enumerate(found):
        while j < len(positions) and positions[j] < i:
            j += 1
        if b.label in ("good", "bad"):
            continue
        near = [after[p] for p in positions[max(j - 1, 0) : j + 1] if after[p].region == b.region]
        labels = {x.label for x in near}
        if len(labels) == 1:
            (verdict,) = labels
        else:
            verdict = "good" if b.region == "article" or (labels and b.label == "near") else "bad"
        b.text, b.label = b.text, f"{b.label}>{verdict}"
    for b in found:
        b.label = b.label.rpartition(">")[2]
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def _extract(batches):
    for batch in batches:
        texts = pa.array([main_text(t.as_py()) for t in batch.column(0)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], [*batch.schema.names[1:], "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    source = pages.select(F.col(html_col).alias("html"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in source.schema.fields[1:])
    return source.mapInArrow(_extract, f"{kinds}, text string")


SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c"""


@register("op4_html_text", SQL)
def op4(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
