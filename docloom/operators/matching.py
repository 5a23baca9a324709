"""Scored matching of planned pages, documentation entries and source files.

No operator here pairs everything of a repository with everything else of it. Scores are sums of
signals, and each kind of signal has a join key of its own: equal slugs, equal leaves, shared words, and
for "contains" tests a gram of the contained text. Pairs that share no signal can only differ by what
either side is on its own, so they are ranked once per class of rows instead of pair by pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.functions.binding import let, stage
from docloom.operators.ordering import (
    balanced_sample,
    first_wins,
    group_ranks_limited,
    page_slugs,
    top_per_group,
)
from docloom.session import discard, joinable
from docloom.operators.predicates import (
    classify_entries,
    is_generic_entry_title,
    is_generic_title,
    is_noise_title,
    is_useful_topic,
    rule_score,
    weighted,
)

GRAM = 4
_NO_STRINGS = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NO_STRINGS)


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of length ``n``, by one pass of a pattern that moves on by a character."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def containment_pairs(
    needles: DataFrame, texts: DataFrame, keys: Sequence[str], text_id: Sequence[str], min_len: int = 1
) -> DataFrame:
    """Exact (needle, text) pairs where the text contains the needle, without comparing all of them.

    ``needles``: keys and ``needle`` (none shorter than ``min_len``). ``texts``: keys, ``text_id`` columns
    and ``text``. A contained needle has all its grams in the text, so a needle meets texts on the one of its grams that the
    fewest texts of its keys have; a needle with a gram that none has meets nothing. Gram rows carry ids only, and
    only of grams that needles have; the text is attached once, to the pairs that are left to be verified.
    The pairs are stored, so that plans that go on from them do not hold the search for them.
    """
    lengths = range(min(min_len, GRAM), GRAM + 1)
    wanted = needles.select(*keys, "needle").filter(F.length("needle") >= min_len).distinct()
    own = F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(_grams(F.col("needle"), GRAM))
    sought = joinable(wanted.select(*keys, "needle", F.explode(own).alias("_gram")), "needle-grams")
    grams = F.concat(*[_grams(F.col("text"), n) for n in lengths])
    spread = texts.select(*keys, *text_id, F.explode(grams).alias("_gram"))
    met = joinable(spread.join(sought.select(*keys, "_gram").distinct(), [*keys, "_gram"]), "text-grams")
    counted = met.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    ranked = sought.join(counted, [*keys, "_gram"], "left")
    rarest = ranked.groupBy(*keys, "needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
    rarest = rarest.filter("_r.n > 0").select(*keys, "needle", F.col("_r._gram").alias("_gram"))
    pairs = rarest.join(met, [*keys, "_gram"]).select(*keys, "needle", *text_id)
    found = pairs.join(texts.select(*keys, *text_id, "text"), [*keys, *text_id]).filter(F.contains("text", "needle"))
    found = joinable(found.select(*keys, "needle", *text_id).distinct(), "contained")
    discard(sought, met)
    return found


# -- J8 ---------------------------------------------------------------------------------------


def section_topic(page_slug: Column, title: Column) -> Column:
    """Topic of a section overview page (``x-overview``), or null."""

    def options(c: Column) -> Column:
        n = F.length(c)
        return F.array(
            F.when(c.endswith("-overview"), F.substr(c, F.lit(1), n - 9)),
            F.when(c.startswith("overview-"), F.substr(c, F.lit(10))),
        )

    found = F.filter(
        F.concat(options(page_slug), options(title)),
        lambda t: t.isNotNull() & (F.length(t) >= 2) & ~t.rlike(rules.SECTION_TOPIC_TOO_GENERIC),
    )
    return F.get(found, F.lit(0))


def _entry_features(entries: DataFrame) -> DataFrame:
    url = F.col("url")
    group = F.coalesce("group", F.lit(""))
    words = F.filter(
        F.split(T.slug(group), "-"),
        lambda w: (F.length(w) >= 4) & ~w.isin(rules.GENERIC_MATCH_WORDS),
    )
    return stage(
        entries.select("repo_id", F.col("pos").alias("entry_pos"), "group", "title", "url"),
        entry_url=url,
        e_title=T.slug(F.col("title")),
        e_generic=is_generic_title(F.col("title")),
        e_slug=U.entry_slug(url),
        e_ns=U.namespace(url),
        e_words=F.slice(words, 1, 8),
        e_text=T.slug(F.concat_ws(" ", group, F.col("title"), url)),
    ).drop("group", "title", "url")


def _page_features(outline: DataFrame) -> DataFrame:
    slugs = stage(
        outline.select("repo_id", F.col("pos").alias("page_pos"), "slug", "title", "purpose"),
        p_slug=T.slug(F.col("slug")),
        p_title=T.slug(F.col("title")),
        p_purpose=T.slug(F.coalesce("purpose", F.lit(""))),
    ).drop("slug", "title", "purpose")
    return stage(
        slugs,
        p_text=F.concat_ws(" ", "p_slug", "p_title", "p_purpose"),
        p_topic=section_topic(F.col("p_slug"), F.col("p_title")),
    ).filter(~((F.col("p_slug") == "overview") & F.col("p_title").contains("overview")))


def _namespace_match() -> Column:
    s, t, ns = F.col("p_slug"), F.col("p_title"), F.col("e_ns")
    other = r"(^|-)(react-dom|react-compiler|eslint-plugin-react-hooks|rules-of-react)(-|$)"
    plain = s.rlike("(^|-)react(-|$)") & ~s.rlike(other)
    return F.when(ns == "react", plain).otherwise(F.contains(s, ns) | F.contains(t, ns))


def _entry_score() -> Column:
    s, t, text = F.col("p_slug"), F.col("p_title"), F.col("p_text")
    et, es, ns = F.col("e_title"), F.col("e_slug"), F.col("e_ns")
    generic = F.col("e_generic")

    def plus(cond: Column, weight) -> Column:
        value = F.lit(weight) if isinstance(weight, int) else weight
        return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(0)

    def tail(c: Column, suffix: Column) -> Column:
        return F.endswith(c, F.concat(F.lit("-"), suffix))

    titled = et != ""
    topic = F.col("p_topic")
    stem = F.substr(topic, F.lit(1), F.length(topic) - 1)
    mentions = (
        F.contains(F.col("e_text"), topic)
        | (topic.endswith("s") & F.contains(F.col("e_text"), stem))
    )
    off_topic = topic.isNotNull() & generic & ~mentions
    named = ns.isNotNull() & generic
    words = F.size(F.filter("e_words", lambda w: F.contains(s, w) | F.contains(t, w) | F.contains(F.col("p_purpose"), w)))
    score = (
        plus(titled & (t == et), F.when(generic, 8).otherwise(36))
        + plus(titled & (s == et), 34)
        + plus(titled & tail(s, et), 24)
        + plus(titled & ~generic & F.contains(text, et), 18)
        + plus(s == es, 34)
        + plus(tail(s, es), 24)
        + plus(F.contains(text, es), 12)
        + plus(named & _namespace_match(), 46)
        - plus(named & ~_namespace_match() & text.contains("react"), 32)
        + words * 6
    )
    return F.when(off_topic, 0).otherwise(score).cast("int")


MATCH_THRESHOLD = 35
MIN_GROUP_WORDS = 6  # words of six points each that reach the threshold on their own


def match_entries(outline: DataFrame, entries: DataFrame) -> DataFrame:
    """Best documentation entry of each outline page, where one scores at least 35.

    ``outline``: repo_id, pos, slug, title, purpose. ``entries``: repo_id, pos, group, title, url. A pair can
    only reach 35 through the entry's title or address slug being part of the page text, through its
    namespace, or through six group words; each of those has its own blocked join.
    """
    # Both sides feed several joins: their features are computed once.
    e, p = joinable(_entry_features(entries), "entries"), joinable(_page_features(outline), "pages")
    texts = p.select("repo_id", "page_pos", F.col("p_text").alias("text"))
    ids = ["page_pos"]
    # Every title, address and namespace signal of a page implies containment in its text.
    signal = F.array_distinct(
        F.filter(
            F.array("e_title", "e_slug", F.when(F.col("e_generic"), F.col("e_ns"))),
            lambda v: v.isNotNull() & (v != ""),
        )
    )
    signals = e.select("repo_id", "entry_pos", F.explode(signal).alias("needle"))
    hits = containment_pairs(signals, texts, ["repo_id"], ids)
    by_signal = hits.join(signals, ["repo_id", "needle"]).select("repo_id", "page_pos", "entry_pos")
    wordy = e.filter(F.size("e_words") >= MIN_GROUP_WORDS)
    groups = wordy.select("repo_id", "e_words").distinct()
    words = groups.select("repo_id", F.explode("e_words").alias("needle"))
    word_hits = containment_pairs(words, texts, ["repo_id"], ids, min_len=4)
    listed = groups.select("repo_id", "e_words", F.explode("e_words").alias("needle")).join(
        word_hits, ["repo_id", "needle"]
    )
    full = listed.groupBy("repo_id", "page_pos", "e_words").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= MIN_GROUP_WORDS
    )
    by_words = full.join(wordy.select("repo_id", "e_words", "entry_pos"), ["repo_id", "e_words"]).select(
        "repo_id", "page_pos", "entry_pos"
    )
    pairs = joinable(by_signal.unionByName(by_words).distinct(), "entry-pairs")
    joined = pairs.join(p, ["repo_id", "page_pos"]).join(e, ["repo_id", "entry_pos"])
    scored = (
        stage(joined, score=_entry_score())
        .select("repo_id", "page_pos", "entry_pos", "entry_url", "score")
        .filter(F.col("score") >= MATCH_THRESHOLD)
    )
    best = top_per_group(
        scored, ["repo_id", "page_pos"], [F.col("score").desc(), "entry_url", "entry_pos"], 1
    )
    return best.select(
        "repo_id", F.col("page_pos").alias("pos"), "entry_pos", "entry_url", "score"
    )


# -- J9 ---------------------------------------------------------------------------------------


def entry_terms(text: Column, title: Column, repo_name: Column) -> Column:
    """Terms that a source file of the entry is expected to mention."""
    own = T.source_words(repo_name)
    terms = F.filter(
        T.source_words(text),
        lambda w: ~w.isin(rules.GENERIC_SOURCE_TERMS) & ~F.array_contains(own, w),
    )
    added = [F.when(text.rlike(p), F.lit(t)) for p, t in rules.ADDED_TERMS]
    key = T.slug(title)
    added.append(F.when(key.rlike(rules.ALWAYS_TERMS), key))
    return F.array_distinct(
        F.filter(F.concat(terms, F.array(*added)), lambda t: t.isNotNull())
    )


def _has_any(terms: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(terms, F.array(*[F.lit(w) for w in wanted]))


def _asked(terms: Column, rule: rules.SurfaceRule) -> Column:
    """Any of the rule's words, or all of one of its groups."""
    tests = [_has_any(terms, rule.any_of)]
    tests += [reduce(lambda a, b: a & b, [F.array_contains(terms, w) for w in words]) for words in rule.all_of]
    return reduce(lambda a, b: a | b, tests)


def _bits(tests: Sequence[Column]) -> Column:
    """Flags packed into one number: the class of a row."""
    return reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(t, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, t in enumerate(tests)],
    )


def _term_flags(terms: Column, has_url: Column) -> list[Column]:
    wants = [
        _has_any(terms, words)
        for words in (
            rules.CI_TERMS,
            rules.TOOLING_TERMS,
            rules.BENCH_TERMS,
            rules.EXAMPLE_TERMS + rules.TEST_TERMS,
            rules.EXAMPLE_TERMS,
            rules.LINT_TERMS,
        )
    ]
    sides = [F.array_contains(terms, s) for s in rules.SIDE_PATHS]
    return [has_url, *wants, *sides]


def _path_flags(path: Column) -> list[Column]:
    low = F.lower(path)
    places = [path.rlike(p) for p, *_ in rules.PATH_BOOSTS_BY_TERM]
    lint = [low.rlike(rules.LINT_PATH), low.rlike(rules.LINT_RULE_PATH)]
    sides = [low.rlike(p) for p in rules.SIDE_PATHS.values()]
    return [path.rlike(rules.DOCS_CONTENT_PATH), *places, *lint, *sides]


def _bit(mask: str, i: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << i).cast("bigint")) != 0


def _surface(entry_mask: Column, path_mask: Column, is_docs_dir: Column) -> Column:
    def total(shared: Column) -> Column:
        return reduce(
            lambda a, b: a + b,
            [
                F.when(shared.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, w).otherwise(0)
                for i, w in enumerate(r.weight for r in rules.SURFACE_RULES)
            ],
        )

    bonus = F.when(is_docs_dir, rules.SURFACE_DOCS_BONUS).otherwise(0)
    return let(
        let(entry_mask.bitwiseAND(path_mask), total), lambda t: t + F.when(t > 0, bonus).otherwise(0)
    )


def _class_parts() -> tuple[Column, Column]:
    """(base, rest) that a pair gets from the classes of its entry and its path alone."""
    has_url, wants = _bit("e_flags", 0), [_bit("e_flags", i) for i in range(1, 7)]
    client, server, static = (_bit("e_flags", i) for i in (7, 8, 9))
    docs, places = _bit("f_flags", 0), [_bit("f_flags", i) for i in range(1, 6)]
    lint, lint_rule = _bit("f_flags", 6), _bit("f_flags", 7)
    p_client, p_server, p_static = (_bit("f_flags", i) for i in (8, 9, 10))

    def plus(cond: Column, weight: int) -> Column:
        return F.when(cond, F.lit(weight)).otherwise(F.lit(0))

    base = plus(docs & has_url, 24) + _surface(
        F.col("e_surface"), F.col("f_surface"), F.col("f_docs_dir")
    )
    rest = F.lit(0)
    for (_, _, yes, no), place, want in zip(rules.PATH_BOOSTS_BY_TERM, places, wants[:5]):
        rest = rest + F.when(place, F.when(want, yes).otherwise(no)).otherwise(0)
    wants_lint = wants[5]
    rest = rest + F.when(
        lint | (wants_lint & lint_rule), F.when(wants_lint, 32).otherwise(-56)
    ).otherwise(0)
    both = client & server
    rest = (
        rest
        + plus(client & p_client, 22)
        + plus(client & ~both & (p_server | p_static), -44)
        + plus(server & p_server, 22)
        + plus(server & ~both & (p_client | p_static), -44)
        + plus(static & p_static, 22)
        + plus(static & (p_client | p_server), -44)
    )
    return base, rest


def term_weight(term: Column, is_word: Column) -> Column:
    n = F.length(term)
    exact = F.when(n <= 3, 28).when(n > 6, 18).otherwise(14)
    return F.when(is_word, exact).when(n <= 3, 0).when(n > 6, 8).otherwise(4)


DOCS_MATCH_THRESHOLD = 140
SOURCE_THRESHOLD = 10
MAX_SOURCE_PATHS = 6
MAX_DOCS_SOURCES = 3


def _source_features(files: DataFrame) -> DataFrame:
    path = F.col("path")
    worded = stage(
        files.select("repo_id", "path").distinct(), f_words=F.array_distinct(T.camel_words(path))
    )
    return stage(
        worded,
        text=F.lower("path"),
        f_segs=U.comparable_path_segments(path),
        f_flags=_bits(_path_flags(path)),
        f_surface=_bits(
            [_has_any(F.col("f_words"), r.path_words) for r in rules.SURFACE_RULES]
        ),
        f_docs_dir=path.rlike("(?i)^docs?/"),
        f_own=weighted(path, rules.PATH_BOOSTS),
    )


def _wanted_features(entries: DataFrame, repos: DataFrame) -> DataFrame:
    joined = entries.join(repos.select("repo_id", F.col("name").alias("_repo")), "repo_id")
    text = F.concat_ws(" ", F.coalesce("group", F.lit("")), "title", "url")
    named = stage(
        joined.select("repo_id", F.col("pos").alias("entry_pos"), "group", "title", "url", "_repo"),
        e_terms=entry_terms(text, F.col("title"), F.col("_repo")),
        e_segs=U.comparable_url_segments(F.col("url")),
    )
    t = F.col("e_terms")
    return stage(
        named.select("repo_id", "entry_pos", "e_terms", "e_segs"),
        e_flags=_bits(_term_flags(t, F.size("e_segs") > 0)),
        e_surface=_bits([_asked(t, r) for r in rules.SURFACE_RULES]),
    )


def _suffix_score() -> Column:
    segs, wanted = F.col("f_segs"), F.col("e_segs")
    tail = F.slice(wanted, F.lit(2), F.greatest(F.size(wanted) - 1, F.lit(0)))
    return F.when(U.ends_with(segs, wanted), 160).when(U.ends_with(segs, tail), 120).otherwise(72)


def match_source_paths(entries: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """Up to six source files per documentation entry, best first.

    ``entries``: repo_id, pos, group, title, url. ``files``: repo_id, pos, path. ``repos``: repo_id, name.
    Files score by terms in their path, by matching the entry's address and by rules on their place;
    at least 10 is needed. Files that match the address (140 or more) push out all others, best three.
    An entry without any file gets the repository's most representative ones.

    Pairs without a shared term or address leaf score by class only. They are covered by the best six
    files of each (entry class, file class), so the full entry x file product never exists.
    """
    # Both sides feed several blocked joins: their features are computed once.
    e = joinable(_wanted_features(entries, repos), "wanted")
    f = joinable(_source_features(files), "sources")
    f_class = ["f_flags", "f_surface", "f_docs_dir"]
    e_class = ["e_flags", "e_surface"]
    order = [F.col("f_own").desc(), "path"]
    # Best six files of each file class, then of each entry class.
    class_top = top_per_group(
        f.select("repo_id", "path", "f_own", *f_class), ["repo_id", *f_class], order, MAX_SOURCE_PATHS
    )
    base, rest = _class_parts()
    classes = e.select("repo_id", *e_class).distinct().join(class_top, "repo_id")
    by_class = (
        stage(classes, _base=base, _rest=rest)
        .filter("_base <> 0")
        .withColumn("_score", F.col("_base") + F.col("_rest") + F.col("f_own"))
    )
    class_best = top_per_group(
        by_class, ["repo_id", *e_class], [F.col("_score").desc(), "path"], MAX_SOURCE_PATHS
    )
    from_class = e.select("repo_id", "entry_pos", *e_class).join(
        class_best.select("repo_id", *e_class, "path"), ["repo_id", *e_class]
    ).select("repo_id", "entry_pos", "path", F.lit(0).alias("gain"), F.lit(0).alias("docs"))
    # Terms: long ones by containment in the path, short ones as whole words only.
    terms = e.select("repo_id", "entry_pos", F.explode("e_terms").alias("needle"))
    long_terms = terms.filter(F.length("needle") > 3)
    contained = containment_pairs(long_terms, f, ["repo_id"], ["path", "f_words"], min_len=4)
    short_words = f.select("repo_id", "path", "f_words", F.explode("f_words").alias("needle"))
    short = terms.filter(F.length("needle") <= 3).select("repo_id", "needle").distinct().join(
        short_words, ["repo_id", "needle"]
    ).select("repo_id", "needle", "path", "f_words")
    weighted_terms = contained.unionByName(short).select(
        "repo_id",
        "needle",
        "path",
        term_weight(F.col("needle"), F.array_contains("f_words", F.col("needle"))).alias("w"),
    )
    from_terms = terms.join(weighted_terms, ["repo_id", "needle"]).groupBy(
        "repo_id", "entry_pos", "path"
    ).agg(
        (
            F.sum("w")
            + F.max(
                F.when((F.col("needle") == "dom") & F.lower("path").contains("react-dom"), 12).otherwise(0)
            )
        ).cast("int").alias("gain")
    )
    # Address leaf: any match of the address implies equal last segments.
    e_leaf = e.filter(F.size("e_segs") > 0).select(
        "repo_id", "entry_pos", "e_segs", U.last_segment(F.col("e_segs")).alias("_leaf")
    )
    f_leaf = f.filter(F.size("f_segs") > 0).select(
        "repo_id", "path", "f_segs", U.last_segment(F.col("f_segs")).alias("_leaf")
    )
    from_leaf = e_leaf.join(f_leaf, ["repo_id", "_leaf"]).select(
        "repo_id", "entry_pos", "path", _suffix_score().alias("docs")
    )
    gains = (
        from_class.unionByName(from_terms.withColumn("docs", F.lit(0)))
        .unionByName(from_leaf.withColumn("gain", F.lit(0)).select(*from_class.columns))
        .groupBy("repo_id", "entry_pos", "path")
        .agg(F.sum("gain").alias("gain"), F.max("docs").alias("docs"))
    )
    gains = joinable(gains, "gains")  # read several times below, like the scores and what is found
    detail = gains.join(e.select("repo_id", "entry_pos", *e_class), ["repo_id", "entry_pos"]).join(
        f.select("repo_id", "path", "f_own", *f_class), ["repo_id", "path"]
    )
    docs_bonus = F.when(_bit("f_flags", 0) & _bit("e_flags", 0), 24).otherwise(0)
    measured = stage(detail, _base=base + F.col("gain") + F.col("docs"), _rest=rest, _bonus=docs_bonus)
    scored = (
        measured.filter("_base <> 0")
        .select(
            "repo_id",
            "entry_pos",
            "path",
            (F.col("_base") + F.col("_rest") + F.col("f_own")).cast("int").alias("score"),
            (F.col("docs") + F.col("_bonus")).cast("int").alias("docs_score"),
        )
        .filter(F.col("score") >= SOURCE_THRESHOLD)
    )
    scored = joinable(scored, "scored")
    ids = ["repo_id", "entry_pos"]
    strong = group_ranks_limited(
        scored.filter(F.col("docs_score") >= DOCS_MATCH_THRESHOLD),
        ids,
        [F.col("docs_score").desc(), F.col("score").desc(), "path"],
        MAX_DOCS_SOURCES,
    ).withColumn("source", F.lit("docs"))
    plain = group_ranks_limited(
        scored.join(strong.select(*ids), ids, "left_anti"),
        ids,
        [F.col("score").desc(), "path"],
        MAX_SOURCE_PATHS,
    ).withColumn("source", F.lit("scored"))
    found = joinable(strong.unionByName(plain), "found")
    lost = e.select(*ids).join(found.select(*ids), ids, "left_anti")
    spare = lost.join(fallback_sources(files, repos), "repo_id").select(
        "repo_id",
        "entry_pos",
        "path",
        "score",
        F.lit(0).alias("docs_score"),
        "rank",
        F.lit("fallback").alias("source"),
    )
    return found.unionByName(spare).withColumnRenamed("entry_pos", "pos")


def fallback_sources(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Six most representative files of each repository; files of the package named like the
    repository count more."""
    rs = rules.RULE_SETS["path_fallback"]
    joined = files.select("repo_id", "path").join(repos.select("repo_id", "name"), "repo_id")
    quoted = F.regexp_replace(F.lower("name"), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    own = F.regexp_like(
        F.lower("path"),
        F.concat(
            F.lit("^packages/"),
            quoted,
            F.lit(r"/(index|package\.json|src/(index|main|reactclient)\.(ts|tsx|js|jsx|mjs|cjs))$"),
        ),
    )
    plain = rule_score(F.col("path"), rules.RuleSet(rules=rs.rules))
    score = F.greatest(F.lit(0), plain + F.when(own, 90).otherwise(0))
    scored = joined.select("repo_id", "path", score.cast("int").alias("score")).filter("score > 0")
    return group_ranks_limited(
        scored.distinct(), ["repo_id"], [F.col("score").desc(), "path"], MAX_SOURCE_PATHS
    )


# -- J10 --------------------------------------------------------------------------------------


def _count_in(words: Column, text: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def _snippet_score() -> Column:
    """Score of an entry for a page; null without a direct signal."""
    title, group, url = F.col("t"), F.col("g"), F.col("u")
    tokens = F.col("tokens")
    words, keywords = F.col("words"), F.col("keywords")
    def plus(cond: Column, weight) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), weight).otherwise(0)

    title_in = (F.length("pt") >= 4) & F.contains(title, F.col("pt"))
    slug_in = (F.length("ps") >= 4) & F.contains(url, F.col("ps"))
    w_title, w_url = _count_in(words, title), _count_in(words, url)
    w_start = F.size(F.filter(words, lambda w: F.startswith(title, w)))
    w_token = F.size(F.filter(words, lambda w: F.array_contains(tokens, w)))
    n_words = F.size(words)
    hits = w_title + w_url
    k_title, k_group, k_url = (_count_in(keywords, c) for c in (title, group, url))
    k_token = F.size(F.filter(keywords, lambda k: F.array_contains(tokens, k)))
    direct = title_in | slug_in | (hits + w_token + k_title + k_group + k_url + k_token > 0)
    guide = ~F.col("reference_like")
    generic = is_generic_entry_title(F.col("title")) & ~F.contains(F.col("pt"), title)
    score = (
        plus(title_in, 55)
        + plus(slug_in, 34)
        + w_title * 24
        + w_start * 46
        + w_token * 12
        + w_url * 8
        + plus((n_words > 0) & (hits == 0), -28)
        + plus((n_words >= 2) & (hits >= 2), 18)
        + k_title * 14
        + k_token * 7
        + k_group * 9
        + k_url * 3
        + plus(k_title >= 2, k_title * 9)
        + plus(F.arrays_overlap(F.col("page_tokens"), tokens), 8)
        + plus(group.rlike(rules.GUIDE_GROUP_TEXT), 6)
        + F.when(guide, weighted(F.col("url"), rules.GUIDE_PAGE_URL_RULES)).otherwise(0)
        + plus(generic, -18)
        + plus(title.rlike(rules.INTRO_TITLE_TEXT), 3)
    )
    return F.when(direct, score).cast("int")


def _supplement_score(pattern: str) -> Column:
    group = F.coalesce("group", F.lit(""))
    hit = F.concat_ws(" ", group, "title", "url").rlike(pattern)
    score = (
        F.lit(1)
        + F.when(F.col("title").rlike(pattern), 80).otherwise(0)
        + F.when(group.rlike(pattern), 28).otherwise(0)
        + F.when(F.col("url").rlike(pattern), 18).otherwise(0)
        + F.when(F.col("url").rlike("(?i)/docs?/"), 8).otherwise(0)
        - F.when(is_noise_title(F.col("title")), 100).otherwise(0)
    )
    return F.when(hit & (score > 0), score)


_PICK = "struct<url:string,key:string>"


def _choosable(rows: DataFrame, keys: list[str], best: list, n: int) -> DataFrame:
    """The rows of each list that a greedy choice of ``n``, no two alike in address or title, can reach.

    A pick blocks one address and one title. A row below ``n`` others of its address with other titles can
    not be chosen while one of those is free, as they are only blocked one title at a time; the same
    holds for titles. Then every pick blocks at most 2n rows, so 2n * n rows are enough to find n.
    """
    once = top_per_group(rows, [*keys, "url", "t"], best, 1)
    few = top_per_group(top_per_group(once, [*keys, "url"], best, n), [*keys, "t"], best, n)
    return top_per_group(few, keys, best, 2 * n * n)


def select_snippets(
    outline: DataFrame, entries: DataFrame, n: int = rules.MAX_SNIPPETS_PER_PAGE
) -> DataFrame:
    """Up to four documentation entries per page that cover its title words, best first.

    First each significant title word takes the best unused entry that has it as a word, then the best
    remaining ones follow; no two share a title. Getting-started pages also take the repository's best
    introduction, connection and tool entries. A page without any scored entry takes the first four.

    Scoring is by containment of page words in entry text (three letters at least), so pairs meet on
    grams. Before the greedy pass each list is cut to what it can still choose from (``_choosable``).
    """
    purpose = F.coalesce("purpose", F.lit(""))
    p = stage(
        outline.select("repo_id", F.col("pos").alias("page_pos"), "slug", "title", "purpose"),
        pt=T.compact(F.col("title")),
        ps=T.compact(F.col("slug")),
        words=T.title_words(F.col("title")),
        concepts=T.title_concepts(F.col("title")),
        keywords=T.page_keywords(F.col("title"), F.col("slug"), purpose),
        page_tokens=T.plain_words(F.concat_ws(" ", "title", "slug")),
        reference_like=F.concat_ws(" ", "title", "slug").rlike(rules.REFERENCE_PAGE_TEXT),
        is_start=F.concat_ws(" ", F.col("slug"), F.col("title"), purpose).rlike(rules.START_PAGE_TEXT),
    ).drop("slug", "title", "purpose")
    p = joinable(p, "pages")
    e = stage(
        entries.select("repo_id", F.col("pos").alias("entry_pos"), "group", "title", "url"),
        t=T.compact(F.col("title")),
        g=T.compact(F.coalesce("group", F.lit(""))),
        u=T.compact(F.col("url")),
        tokens=F.array_distinct(T.plain_words(F.col("title"))),
        all_tokens=F.array_distinct(T.plain_words(F.concat_ws(" ", "title", "url"))),
    )
    e = joinable(e, "entries")
    # Everything that can be a direct signal is contained in the joined entry text.
    signal = F.array_distinct(
        F.filter(
            F.concat("words", "keywords", F.array("pt", "ps")), lambda v: F.length(v) >= 3
        )
    )
    needles = p.filter(F.size("keywords") > 0).select(
        "repo_id", "page_pos", F.explode(signal).alias("needle")
    )
    texts = e.select("repo_id", "entry_pos", F.concat_ws(" ", "t", "g", "u").alias("text"))
    hits = containment_pairs(needles, texts, ["repo_id"], ["entry_pos"], min_len=3)
    pairs = hits.join(needles, ["repo_id", "needle"]).select(
        "repo_id", "page_pos", "entry_pos"
    ).distinct()
    ids = ["repo_id", "page_pos"]
    joined = pairs.join(p, ids).join(e, ["repo_id", "entry_pos"])
    scored = joinable(stage(joined, score=_snippet_score()).filter(F.col("score") > 0), "scored")
    best = [F.col("score").desc(), "entry_pos"]
    pool = scored.select(*ids, "entry_pos", "url", "t", "score", "concepts", "all_tokens")
    by_word = pool.select(
        *ids,
        "entry_pos",
        "url",
        "t",
        "score",
        F.posexplode("concepts").alias("word_no", "word"),
        "all_tokens",
    ).filter(F.array_contains("all_tokens", F.col("word"))).drop("all_tokens", "word")
    cover = _choosable(by_word, [*ids, "word_no"], best, n)
    fill = _choosable(pool.drop("concepts", "all_tokens"), ids, best, n).withColumn("word_no", F.lit(99))
    chosen = cover.select(*fill.columns).unionByName(fill)
    item = F.struct(
        F.col("word_no").alias("w"),
        (-F.col("score")).alias("s"),
        F.col("entry_pos").alias("p"),
        F.struct("url", F.col("t").alias("key")).alias("pick"),
    )
    lists = chosen.groupBy(*ids).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def take(acc: Column, it: Column) -> Column:
        seen = F.exists(
            acc["out"],
            lambda o: (o["url"] == it["pick"]["url"]) | (o["key"] == it["pick"]["key"]),
        )
        # A title word is served once; filling (99) goes on.
        served = (it["w"] == acc["w"]) & (it["w"] != 99)
        full = F.size(acc["out"]) >= n
        skip = seen | served | full
        return F.struct(
            F.when(skip, acc["w"]).otherwise(it["w"]).alias("w"),
            F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(it["pick"]))).alias("out"),
        )

    start = F.struct(F.lit(-1).alias("w"), F.array().cast(f"array<{_PICK}>").alias("out"))
    greedy = lists.select(*ids, F.aggregate("items", start, take)["out"].alias("picks"))
    extras = entries.groupBy("repo_id").agg(
        *[
            F.max_by(
                F.struct("url", T.compact(F.col("title")).alias("key")),
                F.when(
                    _supplement_score(pattern).isNotNull(),
                    F.struct(_supplement_score(pattern), -F.col("pos")),
                ),
            ).alias(f"x{i}")
            for i, (pattern, _) in enumerate(rules.SUPPLEMENTS)
        ]
    )

    def add(picks: Column, extra: Column, force: bool) -> Column:
        known = F.exists(picks, lambda o: o["url"] == extra["url"])
        full = F.size(picks) >= n
        swapped = F.concat(F.slice(picks, 1, n - 1), F.array(extra))
        when_full = swapped if force and n > 1 else picks
        return (
            F.when(extra["url"].isNull() | known, picks)
            .when(full, when_full)
            .otherwise(F.concat(picks, F.array(extra)))
        )

    supplemented = greedy.join(p.select(*ids, "is_start"), ids).join(extras, "repo_id", "left")
    picks = F.col("picks")
    for i, (_, force) in enumerate(rules.SUPPLEMENTS):
        supplemented = supplemented.withColumn(
            "picks", F.when(F.col("is_start"), add(picks, F.col(f"x{i}"), force)).otherwise(picks)
        )
    rows = supplemented.select(*ids, F.posexplode("picks").alias("rank", "o")).select(
        *ids, (F.col("rank") + 1).alias("rank"), F.col("o.url").alias("url"), F.lit("scored").alias("source")
    )
    first = group_ranks_limited(entries.select("repo_id", "pos", "url"), ["repo_id"], ["pos"], n)
    lost = p.select(*ids).join(greedy.select(*ids), ids, "left_anti")
    defaults = lost.join(first, "repo_id").select(*ids, "rank", "url", F.lit("first").alias("source"))
    return rows.unionByName(defaults).withColumnRenamed("page_pos", "pos")


def attach_text(selected: DataFrame, texts: DataFrame) -> DataFrame:
    """Snippet rows for selected entries: a header, then at most 5,000 characters; short ones drop.

    ``texts``: repo_id, url, title, group, text.
    """
    joined = selected.join(texts, ["repo_id", "url"])
    body = F.trim(F.substring("text", 1, rules.MAX_SNIPPET_CHARS))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Official docs page: "), F.col("title")),
        F.concat(F.lit("Section: "), F.col("group")),
        F.concat(F.lit("URL: "), F.col("url")),
        F.lit(""),
        body,
    )
    return joined.select(
        "repo_id", "pos", "rank", F.concat(F.lit("official-docs:"), F.col("url")).alias("path"), text.alias("text")
    ).filter(F.length(F.trim("text")) >= rules.MIN_SNIPPET_CHARS)


# -- J11 --------------------------------------------------------------------------------------


def assemble_context(
    outline: DataFrame, files: DataFrame, snippets: DataFrame, n: int = rules.MAX_PAGE_SOURCE_FILES
) -> DataFrame:
    """Up to twelve context files per page: its source paths, foundational files, files whose path
    names a page word; pages without any take the repository's first four snippets.

    ``files``: repo_id, path, size, text. ``snippets`` (a repository's ranked context): repo_id, pos, path,
    text. Texts are attached after the choice, so only chosen ones are shuffled.
    """
    ids = ["repo_id", "pos"]
    cited = outline.select(*ids, F.posexplode("source_paths").alias("at", "path"))
    known = files.filter(F.col("size") <= 8 * rules.MAX_CONTEXT_CHARS).select("repo_id", "path")
    tier0 = cited.join(known, ["repo_id", "path"], "left_semi").select(
        *ids, "path", F.lit(0).alias("tier"), F.col("at").cast("bigint").alias("at")
    )
    listed = snippets.select("repo_id", F.col("pos").cast("bigint").alias("at"), "path")
    base = F.lower("path").rlike(rules.FOUNDATION_PATH)
    tier1 = outline.select(*ids).join(listed.filter(base), "repo_id").select(
        *ids, "path", F.lit(1).alias("tier"), "at"
    )
    text = F.concat_ws(" ", "slug", "title", F.coalesce("purpose", F.lit("")))
    terms = outline.select(*ids, F.explode(F.array_distinct(T.plain_words(text, 4))).alias("needle"))
    low = listed.withColumn("text", F.lower("path"))
    named = containment_pairs(terms, low, ["repo_id"], ["path", "at"], min_len=4)
    tier2 = terms.join(named, ["repo_id", "needle"]).select(*ids, "path", F.lit(2).alias("tier"), "at")
    some = tier0.unionByName(tier1).unionByName(tier2)
    head = top_per_group(listed, ["repo_id"], ["at"], 4)
    lost = outline.select(*ids).join(some.select(*ids), ids, "left_anti")
    tier3 = lost.join(head, "repo_id").select(*ids, "path", F.lit(3).alias("tier"), "at")
    unique = first_wins(some.unionByName(tier3), [*ids, "path"], ["tier", "at"])
    return group_ranks_limited(unique, ids, ["tier", "at"], n)


def context_texts(chosen: DataFrame, files: DataFrame, max_chars: int = rules.MAX_CONTEXT_CHARS) -> DataFrame:
    body = files.select("repo_id", "path", F.substring("text", 1, max_chars).alias("text"))
    return chosen.join(body, ["repo_id", "path"])


# -- K8 ---------------------------------------------------------------------------------------


def topic_key(title: Column, url: Column) -> Column:
    """Key under which entries are one topic: namespaced generic title, title, or address slug."""
    t, generic = T.slug(title), is_generic_title(title)

    def by_namespace(ns: Column) -> Column:
        return F.when(ns.isNotNull() & generic, F.concat_ws(":", F.lit("namespaced"), ns, t))

    by_title = F.when((t != "") & ~generic, F.concat(F.lit("title:"), t))
    by_url = F.concat(F.lit("url:"), F.coalesce(U.entry_slug(url), T.slug(url)))
    return F.coalesce(let(U.namespace(url), by_namespace), by_title, by_url)


def _with_namespace(parts: Column, ns: Column, generic: Column) -> Column:
    def placed(p: Column) -> Column:
        rest = F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
        return (
            F.when(ns.isNull() | ~generic, p)
            .when((F.get(p, F.lit(0)) == "react") & ns.startswith("react-"), F.concat(F.array(ns), rest))
            .when(~F.array_contains(p, ns), F.concat(F.array(ns), p))
            .otherwise(p)
        )

    return let(parts, placed)


def _group_slugs(group: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(group, F.lit("")), r"\s+/\s+"), T.slug)
    return F.filter(parts, lambda s: s != "")


def nav_parts(group: Column, title: Column, url: Column) -> Column:
    """Sidebar folders of an entry, from its group or else its address."""

    def folders(parts: Column) -> Column:
        titled = F.transform(parts, lambda s: T.nav_title(F.regexp_replace(s, "[-_]+", " ")))
        return F.filter(titled, is_useful_topic)

    named = F.slice(
        F.filter(_group_slugs(group), lambda s: ~s.rlike("^(docs?|documentation)$")), 1, 3
    )
    segs = F.filter(
        F.split(U.path(url), "/"),
        lambda s: (s != "") & ~s.rlike(rules.TOPIC_SKIPPED_SEGMENT) & ~s.rlike(rules.TOPIC_VERSION_SEGMENT),
    )
    derived = F.when(U.is_http(url), folders(F.slice(segs, 1, 2)))
    default = F.array(F.lit("Official Docs"))

    def filled(parts: Column, other: Column) -> Column:
        return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(other))

    own = let(
        U.namespace(url), lambda ns: folders(_with_namespace(named, ns, is_generic_title(title)))
    )
    return filled(own, filled(derived, default))


def entry_page_slug(group: Column, title: Column, url: Column) -> Column:
    """Slug a page made from the entry starts from: group tail and title without repeats."""

    def tail(parts: Column) -> Column:
        return F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))

    def kept(parts: Column) -> Column:
        t = T.slug(title)
        but_last = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        return (
            F.when((t != "") & (U.last_segment(parts) == t), but_last)
            .when((t != "") & ~is_generic_title(title) & F.array_contains(parts, t), _empty())
            .otherwise(parts)
        )

    placed = let(
        U.namespace(url),
        lambda ns: _with_namespace(let(_group_slugs(group), tail), ns, is_generic_title(title)),
    )
    joined = F.array_join(F.concat(let(placed, kept), F.array(T.slug(title))), "-")
    return F.regexp_replace(T.slug(joined), "^$", "official-docs-page")


def simpler_slug_options(current: Column, t: Column, s: Column, ns: Column, generic: Column) -> Column:
    """Slugs to try instead of one that repeats its title slug ``t`` or address slug ``s``; empty when
    it does not."""
    twice_t = F.concat_ws("-", t, t)
    twice_s = F.concat_ws("-", s, s)
    rep_t = (t != "") & F.contains(current, twice_t)
    rep_s = F.coalesce(F.contains(current, twice_s) & s.isNotNull(), F.lit(False))
    generic = generic & ns.isNotNull() & (t != "")
    ns_tail = U.last_segment(F.split(ns, "-"))
    cut = F.substr(t, F.length(ns_tail) + 2)
    options = F.array(
        F.when(rep_s, s),
        F.when(rep_t, F.replace(current, twice_t, t)),
        F.when(rep_s, F.replace(current, twice_s, s)),
        F.when(generic, T.slug(F.concat_ws("-", ns, t))),
        F.when(
            generic & F.startswith(t, F.concat(ns_tail, F.lit("-"))), T.slug(F.concat_ws("-", ns, cut))
        ),
        s,
        F.when(t != "", t),
    )
    distinct = F.array_distinct(F.filter(options, lambda o: o.isNotNull() & (o != "")))
    return F.when(rep_t | rep_s, distinct).otherwise(_empty())


def group_qualifier(group: Column) -> Column:
    parts = F.filter(
        F.transform(F.split(F.coalesce(group, F.lit("")), r"\s+/\s+"), lambda s: F.trim(s)),
        lambda s: (s != "") & ~s.rlike("(?i)^(api reference|apis?|docs?|documentation|learn|reference)$"),
    )
    return T.nav_title(F.regexp_replace(U.last_segment(parts), "[-_]+", " "))


def title_qualifier(group: Column, url: Column) -> Column:
    """What a generic title is about: its namespace, else the last telling group part."""

    def qualifier(ns: Column) -> Column:
        named = T.nav_title(F.regexp_replace(ns, "[-_]+", " "))
        g = group_qualifier(group)
        return (
            F.when(ns == "react", F.coalesce(g, F.lit("React"))).when(ns.isNotNull(), named).otherwise(g)
        )

    return let(U.namespace(url), qualifier)


def normalize_outline(outline: DataFrame, entries: DataFrame) -> DataFrame:
    """Outline pages with qualified titles and simplified slugs, from their matched entries.

    Adds new_slug and new_title. A simpler slug is only taken when no other page of the repository has
    it; two pages after the same one are settled by position.
    """
    matched = joinable(match_entries(outline, entries), "matched").select(
        "repo_id", "pos", "entry_pos"
    )
    named = entries.select(
        "repo_id", F.col("pos").alias("entry_pos"), F.col("group").alias("_group"), F.col("title").alias("_title"), F.col("url").alias("_url")
    )
    joined = outline.join(matched, ["repo_id", "pos"], "left").join(
        named, ["repo_id", "entry_pos"], "left"
    )
    g, t, u = F.col("_group"), F.col("_title"), F.col("_url")
    current, ns = F.col("_current"), F.col("_ns")
    joined = stage(
        joined,
        _current=T.slug(F.col("slug")),
        _ns=U.namespace(u),
        _slug=U.entry_slug(u),
        _qualifier=title_qualifier(g, u),
        _page_slug=entry_page_slug(g, t, u),
        _generic=is_generic_title(F.col("title")),
    )
    title = F.when(
        F.col("entry_pos").isNotNull() & F.col("_generic"),
        T.qualified_title(F.col("title"), F.col("_qualifier")),
    ).otherwise(F.col("title"))
    foreign = F.coalesce((ns != "react") & ~F.contains(current, ns), F.lit(False))
    options = F.when(foreign, F.array("_page_slug")).otherwise(
        simpler_slug_options(current, T.slug(t), F.col("_slug"), ns, is_generic_title(t))
    )
    # Stored without the pages' other columns, which only the result needs.
    wishes = joinable(
        stage(joined, _options=F.coalesce(options, _empty())).select("repo_id", "pos", "_current", "_options"), "wishes"
    )
    taken = wishes.select("repo_id", F.col("_current").alias("_wish")).distinct()
    tried = wishes.select("repo_id", "pos", "_current", F.posexplode("_options").alias("_at", "_wish"))
    free = tried.join(taken, ["repo_id", "_wish"], "left_anti")
    first_free = top_per_group(free, ["repo_id", "pos"], ["_at"], 1)
    settled = joinable(
        first_wins(first_free, ["repo_id", "_wish"], "pos").select("repo_id", "pos", F.col("_wish").alias("_new")), "settled"
    )
    result = joined.join(settled, ["repo_id", "pos"], "left")
    new_slug = F.coalesce("_new", current)
    return result.select(
        *outline.columns,
        new_slug.alias("new_slug"),
        F.when(F.col("entry_pos").isNotNull(), T.quiet_title(new_slug, title))
        .otherwise(F.col("title"))
        .alias("new_title"),
    )


def outline_candidates(entries: DataFrame) -> DataFrame:
    """Best entry per topic with its folders and score."""
    text = F.concat_ws(
        " ", F.array_join("parts", " "), F.coalesce("group", F.lit("")), "title", "url"
    )
    p = rules.OUTLINE_ENTRY_PENALTIES
    score = (
        weighted(text, rules.OUTLINE_ENTRY_RULES)
        + weighted(F.col("url"), rules.OUTLINE_ENTRY_URL_RULES)
        + F.when(F.col("is_generated"), p["generated"]).otherwise(0)
        + F.when(F.col("is_low_level"), p["low_level"]).otherwise(0)
        + F.when(F.col("is_narrow_member"), p["narrow_member"]).otherwise(0)
    )
    g, t, u = F.col("group"), F.col("title"), F.col("url")
    keyed = stage(
        classify_entries(entries),
        parts=nav_parts(g, t, u),
        topic_key=topic_key(t, u),
        base_slug=entry_page_slug(g, t, u),
    )
    scored = stage(keyed, score=score.cast("int"))
    first_seen = scored.groupBy("repo_id", "topic_key").agg(F.min("pos").alias("topic_pos"))
    best = first_wins(scored, ["repo_id", "topic_key"], [F.col("score").desc(), "pos"])
    return best.join(first_seen, ["repo_id", "topic_key"])


def fill_outline(outline: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Pages to add to each outline until its target size: new slug, folders and entry, in order.

    ``targets``: repo_id and target_pages (52 at most). Topics that the outline covers already are left
    out; the rest are taken evenly over folders, best entries first.
    """
    best = joinable(match_entries(outline, entries), "matched")
    titles = entries.select("repo_id", F.col("pos").alias("entry_pos"), "title", "url")
    covered = stage(
        best.join(titles, ["repo_id", "entry_pos"]), topic_key=topic_key(F.col("title"), F.col("url"))
    ).select("repo_id", "topic_key")
    unmatched = outline.join(best.select("repo_id", "pos"), ["repo_id", "pos"], "left_anti").select(
        "repo_id", T.slug(F.col("title")).alias("_t")
    ).filter("_t <> ''").select("repo_id", F.concat(F.lit("title:"), F.col("_t")).alias("topic_key"))
    known = joinable(covered.unionByName(unmatched).distinct(), "known")
    fresh = outline_candidates(entries).join(known, ["repo_id", "topic_key"], "left_anti")
    sizes = outline.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_have"))
    need = targets.join(sizes, "repo_id", "left").select(
        "repo_id",
        (F.col("target_pages") - F.coalesce("_have", F.lit(0))).alias("needed"),
    ).filter("needed > 0")
    wanted = joinable(
        fresh.join(need, "repo_id").withColumn("folder", F.array_join("parts", " / ")), "candidates"
    )
    # Slugs in use come first in order, so they are never changed.
    used = (
        outline.select("repo_id", T.slug(F.col("slug")).alias("_base"))
        .filter("_base <> ''")
        .groupBy("repo_id", "_base")
        .agg(F.lit(-1).cast("bigint").alias("_order"))
    )
    named = wanted.select("repo_id", F.col("base_slug").alias("_base"), F.col("topic_pos").cast("bigint").alias("_order"))
    bases = joinable(named.unionByName(used), "slugs")
    slugs = page_slugs(bases, ["repo_id"], "_base", "_order", "slug").filter(
        "_order >= 0"
    ).select("repo_id", F.col("_order").alias("topic_pos"), "slug")
    rows = joinable(wanted.join(slugs, ["repo_id", "topic_pos"]), "named")
    folder = F.col("folder")
    per_folder = rows.groupBy("repo_id", "folder").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("score") >= 50).alias("_good"),
        F.bool_and("is_generated").alias("_all_generated"),
    )
    score = (
        F.least(F.greatest(F.col("_good"), F.ceil(F.col("_n") / 6)), F.lit(80))
        + weighted(folder, rules.OUTLINE_GROUP_RULES)
        - F.when((F.col("_n") >= 6) & F.col("_all_generated"), 55).otherwise(0)
    )
    taken = balanced_sample(
        rows,
        ["repo_id"],
        "folder",
        [F.col("score").desc(), "title", "url"],
        F.col("needed"),
        group_scores=per_folder.select("repo_id", "folder", score.alias("group_score")),
        bound=rules.MAX_PAGES_SCHEMA,
    )
    return taken.select(
        "repo_id", "take_order", "slug", "title", "url", "folder", "score", F.col("pos").alias("entry_pos")
    )

