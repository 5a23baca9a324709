"""Licence mentions by ordered signature rules.

Each licence family has hand-written name patterns; four templates (an SPDX tag, a grant, a name with its
version, the bare name) make the rules, some hundreds in all. A rule runs only on texts that hold its
keyword. Of overlapping detections one that lies inside another of at least its priority is dropped (on equal
spans the earlier rule wins), so "CC BY" inside "CC BY-NC 4.0" does not count on its own.

Patterns run on the words of the text, each between two blanks of its own, so a match begins and ends at
words and its place is counted in words. Only texts with a keyword keep their words beyond the scan; the
suppression is a window over the detections of a row. DataFrame expressions throughout; rules are a constant table.

A null or empty text has no words, no places and score 0. Repeated rows and repeated or null ids are each
judged alone (rows have a key of their own). Equal labels of one text are named once. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.base import plain_words, table
from docloom.llm.registry import register
from docloom.session import materialized

# The phrases of the base and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, keyword, name pattern over lower-case words, versions that are told apart.
FAMILIES = (
    ("gpl", "gnu", "gnu general public licen[sc]e", ("1", "2", "3")),
    ("gpl", "gpl", "gpl", ("1", "2", "3")),
    ("gpl", "gplv2", "gplv2", ()),
    ("gpl", "gplv3", "gplv3", ()),
    ("lgpl", "lesser", "(gnu )?lesser general public licen[sc]e", ("2", "2 1", "3")),
    ("lgpl", "library", "(gnu )?library general public licen[sc]e", ("2",)),
    ("lgpl", "lgpl", "lgpl", ("2", "2 1", "3")),
    ("agpl", "affero", "(gnu )?affero general public licen[sc]e", ("1", "3")),
    ("agpl", "agpl", "agpl", ("3",)),
    ("gfdl", "documentation", "gnu free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("gfdl", "gfdl", "gfdl", ("1 2", "1 3")),
    ("apache", "apache", "apache( software)?", ("1 0", "1 1", "2 0")),
    ("apache", "asl", "asl", ("2 0",)),
    ("mit", "mit", "mit( x11)?", ()),
    ("mit", "expat", "expat", ()),
    ("x11", "x11", "x11", ()),
    ("bsd-2-clause", "bsd", "(bsd 2 clause|2 clause bsd|simplified bsd)", ()),
    ("bsd-3-clause", "bsd", "(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", ()),
    ("bsd-4-clause", "bsd", "(bsd 4 clause|4 clause bsd|original bsd)", ()),
    ("0bsd", "0bsd", "0bsd", ()),
    ("0bsd", "bsd", "zero clause bsd", ()),
    ("bsd", "bsd", "bsd( style)? licen[sc]e", ()),
    ("isc", "isc", "isc", ()),
    ("mpl", "mozilla", "mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[sc]e", ("1 0", "2 0")),
    ("epl", "epl", "epl", ("1 0", "2 0")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cddl", "development", "common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cpl", "common", "common public licen[sc]e", ("1 0",)),
    ("eupl", "eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("eupl", "european", "european union public licen[sc]e", ("1 1", "1 2")),
    ("artistic", "artistic", "(perl )?artistic licen[sc]e", ("1 0", "2 0")),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", ()),
    ("bsl", "boost", "boost software licen[sc]e", ("1 0",)),
    ("busl", "business", "business source licen[sc]e", ("1 1",)),
    ("sspl", "sspl", "sspl", ("1",)),
    ("sspl", "server", "server side public licen[sc]e", ("1",)),
    ("elastic", "elastic", "elastic licen[sc]e", ("1 0", "2 0")),
    ("unlicense", "unlicense", "(the )?unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("zlib", "zlib", "zlib( libpng)?", ()),
    ("libpng", "libpng", "libpng licen[sc]e", ("2",)),
    ("openssl", "openssl", "openssl licen[sc]e", ()),
    ("ofl", "sil", "sil open font licen[sc]e", ("1 0", "1 1")),
    ("ofl", "ofl", "ofl", ("1 0", "1 1")),
    ("psf", "psf", "psf licen[sc]e", ("2",)),
    ("psf", "python", "python( software foundation)? licen[sc]e", ("2",)),
    ("php", "php", "php licen[sc]e", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby licen[sc]e", ()),
    ("postgresql", "postgresql", "postgresql licen[sc]e", ()),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source)? licen[sc]e", ()),
    ("upl", "universal", "universal permissive licen[sc]e", ("1 0",)),
    ("afl", "academic", "academic free licen[sc]e", ("2 1", "3 0")),
    ("osl", "osl", "osl", ("3 0",)),
    ("osl", "software", "open software licen[sc]e", ("2 1", "3 0")),
    ("blueoak", "oak", "blue oak model licen[sc]e", ("1 0 0",)),
    ("odbl", "odbl", "odbl", ("1 0",)),
    ("odbl", "database", "open( data commons)? database licen[sc]e", ("1 0",)),
    ("odc-by", "odc", "odc by", ("1 0",)),
    ("pddl", "pddl", "pddl", ("1 0",)),
    ("openrail", "openrail", "((bigscience|creativeml) )?openrail( m)?", ()),
    ("llama", "llama", "llama( 2| 3)? community licen[sc]e", ()),
    ("ogl", "government", "open government licen[sc]e", ("1 0", "2 0", "3 0")),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc0", "cc", "cc zero", ("1 0",)),
    ("cc-by", "cc", "cc by", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", "cc by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative", "creative commons attribution", ("2 0", "3 0", "4 0")),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike", ("2 0", "3 0", "4 0")),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial", ("2 0", "3 0", "4 0")),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(ative)?s", ("2 0", "3 0", "4 0")),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike", ("3 0", "4 0")),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(ative)?s", ("3 0", "4 0")),
    ("creative-commons", "creative", "creative commons", ()),
    ("public-domain", "domain", "(in|into|to) the public domain", ()),
    ("proprietary", "reserved", "all rights reserved", ()),
    ("proprietary", "confidential", "proprietary and confidential", ()),
)
# Keywords whose names stand for a licence without that word.
BARE = tuple(
    "gpl gplv2 gplv3 lgpl agpl gfdl mpl epl cddl eupl sspl wtfpl unlicense ofl odbl pddl openrail 0bsd bsd cc cc0 "
    "creative odc domain reserved confidential".split()
)
GRANT = "(licen[sc]ed|released|distributed|available|published|provided|shared) under( the)?( terms of)?( the)?( a| an)? "
VERSION = "( international| unported| generic)?( licen[sc]e)?( version| v)? "


def _pattern(words: str) -> str:
    """A pattern over words in single blanks, as one over words that each have two blanks of their own."""
    return " " + words.replace(" ?", "~").replace(" ", "  ").replace("~", "(  )?") + " "


def rules() -> list[tuple[int, str, str, int, str, float]]:
    """(rule, keyword, pattern, priority, label, confidence) of every family and template."""
    out = []
    for label, keyword, name, versions in FAMILIES:
        for v in (*versions, None):
            own = label if v is None else f"{label}-{v.replace(' ', '.')}"
            if v is not None:
                out += [(keyword, f"{GRANT}({name}){VERSION}{v}", 3, own, 1.0)]
                out += [(keyword, f"({name}){VERSION}{v}", 2, own, 0.9)]
            else:
                out += [(keyword, f"spdx licen[sc]e identifier ({name})( [0-9]+){{0,3}}", 4, own, 1.0)]
                out += [(keyword, f"{GRANT}({name})( licen[sc]e)?", 2, own, 0.95)]
                plain = name if "licen" in name or keyword in BARE else f"{name} licen[sc]e"
                out += [(keyword, f"({plain})", 1, own, 0.6)]
    return [(i, k, _pattern(p), pr, lb, c) for i, (k, p, pr, lb, c) in enumerate(out)]


PRIORITIES = (1, 2, 3, 4)


def _places(words: Column, phrase: str) -> Column:
    """Word positions where ``phrase`` stands; texts without it cost one substring search."""
    parts = phrase.split()
    same = lambda i: F.get(words, i) == parts[0]

    def here(i: Column) -> Column:
        out = same(i)
        for j, part in enumerate(parts[1:], 1):
            out = out & F.coalesce(F.get(words, i + j) == part, F.lit(False))
        return out

    return F.when(
        F.col("canon").contains(" " + "  ".join(parts) + " "),
        F.filter(F.sequence(F.lit(0), F.size(words) - 1), here),
    ).otherwise(F.array().cast("array<int>"))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A narrow row per text: counts, base places, keywords, and its words if it has a keyword."""
    keywords = sorted({k for _, k, *_ in rules()} | {p.split()[0] for p, _ in BASE})
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        plain_words(F.col(text_col)).alias("w"),
    )
    rows = rows.select("*", F.array_intersect("w", F.array(*map(F.lit, keywords))).alias("keywords"))
    canon = F.when(F.size("keywords") > 0, F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")))
    rows = rows.select("*", canon.alias("canon"))
    places = [_places(F.col("w"), p) for p, _ in BASE]
    rows = rows.select(
        "row", "doc_id", F.size("w").cast("long").alias("n_words"), "keywords", "canon", F.array(*places).alias("places")
    )
    every = F.flatten("places")
    return rows.select(
        "row",
        "doc_id",
        "n_words",
        "keywords",
        "canon",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(
            F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(lb)) for i, (_, lb) in enumerate(BASE)])
        ).alias("base_labels"),
    )


def detections(texts: DataFrame) -> DataFrame:
    """(row, rule, priority, label, confidence, start, end) of every rule match, in words, end exclusive."""
    names = ("rule", "keyword", "pattern", "priority", "label", "confidence")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rules()])
    known = texts.sparkSession.range(1).select(F.inline(rows))
    gated = texts.where("canon IS NOT NULL").select("row", "canon", F.explode("keywords").alias("keyword"))
    tried = gated.join(F.broadcast(known), "keyword").where(F.rlike("canon", F.col("pattern")))  # constant rows
    count = lambda s: F.regexp_count(s, F.lit("[^ ]+"))
    between = F.transform(F.split("canon", F.col("pattern")), count)
    inside = F.transform(F.regexp_extract_all("canon", F.col("pattern"), F.lit(0)), count)
    parts = tried.select(
        "row",
        "rule",
        "priority",
        "label",
        "confidence",
        F.posexplode(F.arrays_zip(between.alias("before"), inside.alias("n"))).alias("i", "x"),
    ).where("x.n IS NOT NULL")
    run = W.partitionBy("row", "rule").orderBy("i")
    end = F.sum(F.col("x.before") + F.col("x.n")).over(run)
    return parts.select("row", "rule", "priority", "label", "confidence", (end - F.col("x.n")).alias("start"), end.alias("end"))


def outermost(found: DataFrame) -> DataFrame:
    """Drop what lies inside a detection of at least its priority; of equal spans the first rule stays.

    Sorted by start, longest first, everything that contains a row stands before it, so running maxima of
    the ends per priority decide; no pairs are made.
    """
    before = W.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule")
    before = before.rowsBetween(W.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before).alias(f"reach_{p}") for p in PRIORITIES]
    found = found.select("*", *reach)
    inside = F.coalesce(
        *[F.when(F.col("priority") == p, F.col(f"reach_{p}") >= F.col("end")) for p in PRIORITIES], F.lit(False)
    )
    return found.where(~inside)


def license_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, mentions): a row per text with its counts, and the detections that stand, by ``row``."""
    texts = materialized(scanned(docs, id_col, text_col), "license-texts")
    return texts, outermost(detections(texts))


def _sql() -> str:
    """The same in DuckDB's SQL, with containment decided pair by pair."""
    values = ", ".join(f"({i}, '{k}', '{p}', {pr}, '{lb}', {c!r})" for i, k, p, pr, lb, c in rules())
    base = " UNION ALL ".join(
        f"SELECT k, '{lb}' AS label, i FROM (SELECT k, w, unnest(range(len(w))) AS i FROM d) WHERE "
        + " AND ".join(f"w[i + {j + 1}] = '{part}'" for j, part in enumerate(p.split()))
        for p, lb in BASE
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
rule(rule, keyword, pattern, priority, label, confidence) AS (VALUES {values}),
tried AS (
  SELECT k, rule, priority, label, confidence, pattern, ' ' || array_to_string(w, '  ') || ' ' AS canon
  FROM d, rule WHERE list_contains(w, keyword) AND regexp_matches(' ' || array_to_string(w, '  ') || ' ', pattern)),
cut AS (
  SELECT *, string_split_regex(canon, pattern) AS gaps, regexp_extract_all(canon, pattern, 0) AS found FROM tried),
part AS (
  SELECT k, rule, priority, label, confidence, i, len(regexp_extract_all(gaps[i], '[^ ]+')) AS before,
    len(regexp_extract_all(found[i], '[^ ]+')) AS n
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut)),
det AS (
  SELECT k, rule, priority, label, confidence, sum(before + n) OVER (PARTITION BY k, rule ORDER BY i) AS e,
    sum(before + n) OVER (PARTITION BY k, rule ORDER BY i) - n AS s FROM part),
kept AS (
  SELECT * FROM det x WHERE NOT EXISTS (
    SELECT 1 FROM det y WHERE y.k = x.k AND y.s <= x.s AND y.e >= x.e AND y.priority >= x.priority
      AND (y.s < x.s OR y.e > x.e OR y.priority > x.priority OR y.rule < x.rule))),
base AS ({base}),
bs AS (
  SELECT k, count(*) AS n, min(i) AS first_word, max(i) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY k),
own AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT k, label FROM kept UNION ALL SELECT k, label FROM base) GROUP BY k),
best AS (SELECT k, max(confidence) AS c FROM kept GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(bs.labels, '') AS base_labels, coalesce(own.labels, '') AS labels,
  CAST(greatest(coalesce(c, 0), CASE WHEN n > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN bs USING (k) LEFT JOIN own USING (k) LEFT JOIN best USING (k)"""


@register("op7_licenses", _sql())
def op7(spark, sf_dir):
    texts, mentions = license_mentions(table(spark, sf_dir, "documents"))
    per_row = mentions.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("confidence").alias("best"))
    rows = texts.drop("canon", "keywords").join(per_row, "row", "left")
    labels = F.array_union("base_labels", F.coalesce("own", F.array().cast("array<string>")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
