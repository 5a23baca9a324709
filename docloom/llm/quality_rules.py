"""Quality rules whose cutoffs come from labelled documents with a guaranteed false-rejection rate.

A rule rejects a document when its measure exceeds a cutoff. Cutoffs are tested per stratum from the loosest
to the strictest (fixed-sequence testing), each with the exact binomial tail of the good documents it
would reject; testing stops at the first cutoff that fails. The error level is divided by strata
and rules (Bonferroni), and the permitted rate by rules, so that with probability ``1 - error`` the
documents of every stratum that pass the base rules lose at most ``rate`` of the good ones. Of the certified
cutoffs that is used which gains most, where a good document lost weighs ``good_weight`` bad ones.

Everything is DataFrame expressions. The text is read once, into a narrow table of measures.

Nulls: a null text has no words and fails the base; a null stratum is a stratum of its own; labels without
an id or a quality are left out; an id labelled twice counts as good if one label says so. One trial is one
distinct text of a stratum, so copies add no evidence; it is good if any of its copies is. Repeated rows of
``documents`` are judged alike, each on its own. With no labels, or too few, nothing is certified and the
method rejects nothing. Other columns of the inputs are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.binding import let
from docloom.llm.base import small, space_words, table
from docloom.llm.registry import register
from docloom.session import materialized

# Per rule its cutoffs from the loosest to the strictest, in units of its measure.
CUTOFFS = {
    "symbols": [2000, 1500, 1000, 700, 500, 350, 250, 150, 100, 50, 20, 0],
    "repeats": [480, 440, 400, 360, 320, 280, 240, 200, 160, 120, 80, 40],
    "dup_lines": [950, 900, 800, 700, 600, 500, 400, 300, 200, 150, 100, 50],
    "capitals": [950, 900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100],
    "shouts": [2000, 1500, 1000, 700, 500, 350, 250, 150, 100, 50, 20, 0],
    "long_words": [2000, 1600, 1400, 1200, 1100, 1000, 950, 900, 850, 800, 750, 700],
    "short_words": [6000, 5000, 4500, 4000, 3600, 3300, 3000, 2800, 2600, 2500, 2400, 2300],
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


FEW = 8


def window_hashes(words: Column, k: int = 3) -> Column:
    """A hash of each window of ``k`` words, in the order of the text."""
    shifted = [F.slice(words, j + 1, F.greatest(F.size(words) - k + 1, F.lit(0))).alias(f"w{j}") for j in range(k)]
    return F.transform(F.arrays_zip(*shifted), lambda window: F.xxhash64(window))


def repeated_words(hashes: Column, ordered: Column, k: int = 3) -> Column:
    """Words inside windows of ``k`` words that occur at least twice in the text, the first included.

    ``hashes`` are those of ``window_hashes`` and ``ordered`` the same ones sorted. Most texts repeat no window or a few; only where over
    ``FEW`` are repeated all windows are sorted with their places.
    """

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(k), F.get(at, i + 1) - p))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))

    def by_place(again: Column) -> Column:
        places = F.transform(hashes, lambda h, i: F.when(F.array_contains(again, h), i))
        return F.filter(places, lambda p: p.isNotNull())

    windows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    by_hash = let(F.sort_array(windows), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["p"])))
    again = F.array_distinct(F.filter(ordered, lambda h, i: h == F.get(ordered, i + 1)))
    many = let(again, lambda a: let(F.when(F.size(a) <= FEW, by_place(a)).otherwise(by_hash), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(many).cast("long")


def measured(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """Counts and rule measures of every row; one pass over the text, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = lambda pattern: (F.length("t") - F.length(F.regexp_replace("t", pattern, ""))).cast("long")
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum_col).alias("stratum"),
        text.alias("t"),
        F.xxhash64(text_col).alias("text_key"),
        space_words(text).alias("w"),
        F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    split = split.withColumn("h", window_hashes(F.col("w"))).withColumn("ordered", F.sort_array("h"))
    counted = split.select(
        "doc_id",
        "stratum",
        "text_key",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        gone("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("h"), F.col("ordered")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        gone(r"\p{Lu}+").alias("n_capitals"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
    )
    share = lambda a, b, of: F.coalesce(F.floor(F.col(a) * of / F.nullif(F.col(b), F.lit(0))), F.lit(0))
    measures = {
        "symbols": share("n_symbols", "n_words", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
        "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "capitals": share("n_capitals", "word_chars", 1000),
        "shouts": share("n_shouts", "n_words", 1000),
        "long_words": share("word_chars", "n_words", 100),
        "short_words": share("n_words", "word_chars", 10000),
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        "*", failed.alias("base_failed"), *[v.cast("long").alias(f"m_{k}") for k, v in measures.items()]
    )


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, stepped down; twelve digits or more for x >= 1."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y)
    series = series + 1 / (1260 * y * y * y * y * y)
    for j in range(8):
        series = series - F.log(x + j)
    return series


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of Binomial(n, rate) for k < n * rate; else 1, which no test passes.

    The sum runs down from the largest term. It stops after twelve standard deviations, where what is
    left is below the precision of a double, so its length grows with the square root of n.
    """
    kd, nd = k.cast("double"), n.cast("double")
    lead = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1)
    lead = F.exp(lead + kd * F.log(F.lit(rate)) + (nd - kd) * F.log(F.lit(1 - rate)))
    steps = F.least(k, F.ceil(12 * F.sqrt(nd * rate)) + 30).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(acc: Column, j: Column) -> Column:
        i = kd - j
        term = acc["term"] * (i + 1) / (nd - i) * ((1 - rate) / rate)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), zero, down)["total"]).otherwise(1.0)
    return F.when(kd < nd * rate, lead * tail).otherwise(1.0)


def certified_cutoffs(
    measures: DataFrame,
    labels: DataFrame,
    rate: float,
    error: float,
    good_weight: float,
    id_col: str = "doc_id",
    quality_col: str = "quality",
) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_lost, n_caught) of the cutoffs that are used.

    One aggregate over the labelled rows, then a table of at most strata x rules x cutoffs rows.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(quality_col).cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    trials = (
        measures.where(~F.col("base_failed"))
        .join(known, "doc_id")
        .groupBy("stratum", "text_key")
        .agg(F.max("quality").alias("good"), *[F.max(f"m_{r}").alias(f"m_{r}") for r in CUTOFFS])
    )
    rules = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule"),
                F.col(f"m_{r}").alias("m"),
                F.array(*[F.lit(c).cast("long") for c in cs]).alias("cs"),
            )
            for r, cs in CUTOFFS.items()
        ]
    )
    hits = trials.select("stratum", "good", F.explode(rules).alias("x"))
    # rejected by the first j cutoffs only: cutoffs fall, so a row is lost from the first one below it on
    first = F.size(F.filter(F.col("x.cs"), lambda c: F.col("x.m") <= c))
    hist = hits.groupBy("stratum", F.col("x.rule").alias("rule"), first.alias("first"), "good").count()
    per_rule = hist.groupBy("stratum", "rule").agg(
        F.sum(F.when(F.col("good") > 0, F.col("count")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("good") > 0, 0).otherwise(F.col("count"))).alias("n_bad"),
        F.collect_list(F.struct("first", "good", "count")).alias("bins"),  # two per cutoff at most
    )

    def upto(j: Column, good: bool) -> Column:
        side = F.filter("bins", lambda b: (b["first"] <= j) & ((b["good"] > 0) == F.lit(good)))
        return F.aggregate(side, F.lit(0).cast("long"), lambda a, b: a + b["count"])

    n_cutoffs = max(map(len, CUTOFFS.values()))
    tests = per_rule.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_cutoffs - 1))).alias("j"))
    cut = F.element_at(
        F.create_map(*[x for r, cs in CUTOFFS.items() for x in (F.lit(r), F.array(*map(F.lit, cs)))]), F.col("rule")
    )
    tests = tests.select(
        "stratum",
        "rule",
        "n_good",
        "n_bad",
        "j",
        F.get(cut, F.col("j")).cast("long").alias("cutoff"),
        upto(F.col("j"), True).alias("n_lost"),
        upto(F.col("j"), False).alias("n_caught"),
    )
    strata = per_rule.select("stratum").distinct().agg(F.count(F.lit(1)).alias("n_strata"))
    tail = binomial_tail(F.col("n_lost"), F.col("n_good"), rate / len(CUTOFFS))
    tests = tests.crossJoin(F.broadcast(strata)).withColumn(
        "ok", tail <= error / (F.col("n_strata") * len(CUTOFFS))
    )
    gain = F.col("n_caught") / F.greatest("n_bad", F.lit(1)) - good_weight * F.col("n_lost") / F.greatest(
        "n_good", F.lit(1)
    )
    stop = F.coalesce(F.min(F.when(~F.col("ok"), F.col("j"))), F.lit(n_cutoffs)).alias("stop")
    limits = tests.groupBy("stratum", "rule").agg(stop)
    found = (
        tests.withColumn("gain", gain)
        .join(limits.select(F.col("stratum").alias("s"), F.col("rule").alias("r"), "stop"),
              F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r")))
        .where("j < stop AND gain > 0")
        .groupBy("stratum", "rule")
        .agg(F.max(F.struct("gain", (-F.col("j")).alias("o"), "cutoff", "n_good", "n_lost", "n_caught")).alias("x"))
    )
    return found.select("stratum", "rule", "x.cutoff", "x.n_good", "x.n_lost", "x.n_caught")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    rate: float = 0.05,
    error: float = 0.05,
    good_weight: float = 10.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
) -> DataFrame:
    """The counts, the base verdict, the rules that reject and ``kept``, a row for each row of ``docs``.

    ``text_key`` is a hash of the text; with the id and the stratum it leads back to the row.
    """
    m = materialized(measured(docs, id_col, text_col, stratum_col), "quality-measures")
    used = materialized(certified_cutoffs(m, labels, rate, error, good_weight), "quality-cutoffs")
    wide = used.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in CUTOFFS]
    )
    wide = small(wide.withColumnRenamed("stratum", "s"), used.count(), 50_000)
    judged = m.join(wide, F.col("stratum").eqNullSafe(F.col("s")), "left")
    over = F.array_compact(
        F.array(*[F.when(F.col(f"m_{r}") > F.col(f"c_{r}"), F.lit(r)) for r in CUTOFFS])
    )
    return judged.select(
        "doc_id",
        "text_key",
        "stratum",
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & (F.size(over) == 0)).alias("kept"),
        over.alias("rejected_by"),
    )


def _sql(rate: float, error: float, good_weight: float) -> str:
    """The same in DuckDB's SQL, with the binomial tail as a plain sum of its terms."""
    share = rate / len(CUTOFFS)
    measures = {
        "symbols": ("n_symbols", "n_words", 1000),
        "repeats": ("n_repeat_words", "n_words", 1000),
        "dup_lines": ("n_dup_lines", "n_lines", 1000),
        "capitals": ("n_capitals", "word_chars", 1000),
        "shouts": ("n_shouts", "n_words", 1000),
        "long_words": ("word_chars", "n_words", 100),
        "short_words": ("n_words", "word_chars", 10000),
    }
    cols = ", ".join(f"coalesce({a} * {of} // nullif({b}, 0), 0) AS m_{k}" for k, (a, b, of) in measures.items())
    tests = " UNION ALL ".join(
        f"SELECT lang, '{r}' AS rule, good, m_{r} AS m, unnest(range({len(cs)})) AS j, unnest({cs}) AS cutoff FROM trials"
        for r, cs in CUTOFFS.items()
    )
    over = " OR ".join(
        f"coalesce(m_{r} > (SELECT cutoff FROM best b WHERE b.lang IS NOT DISTINCT FROM f.lang AND rule = '{r}'), FALSE)"
        for r in CUTOFFS
    )
    names = " || ".join(
        f"CASE WHEN coalesce(m_{r} > (SELECT cutoff FROM best b WHERE b.lang IS NOT DISTINCT FROM f.lang"
        f" AND rule = '{r}'), FALSE) THEN ['{r}'] ELSE [] END"
        for r in CUTOFFS
    )
    return rf"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines,
    row_number() OVER () AS k
  FROM documents),
grams AS (
  SELECT k, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g
  FROM t WHERE len(w) > 3),
twice AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS n FROM grams) WHERE n > 1),
reps AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY k),
c AS (
  SELECT t.k, doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals,
    length(t) - length(replace(t, '!', '')) AS n_shouts
  FROM t LEFT JOIN reps USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {cols} FROM c),
known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
trials AS (
  SELECT lang, t, max(quality) AS good, {", ".join(f"max(m_{r}) AS m_{r}" for r in CUTOFFS)}
  FROM f JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY lang, t),
tests AS (
  SELECT lang, rule, j, cutoff, count(*) FILTER (good > 0) AS n_good, count(*) FILTER (NOT good > 0) AS n_bad,
    count(*) FILTER (good > 0 AND m > cutoff) AS n_lost, count(*) FILTER (NOT good > 0 AND m > cutoff) AS n_caught
  FROM ({tests}) GROUP BY ALL),
tails AS (
  SELECT *, (SELECT sum(exp(lgamma(n_good + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END
      - CASE WHEN n_good > i THEN lgamma(n_good - i + 1) ELSE 0 END + i * ln({share!r}) + (n_good - i) * ln({1 - share!r})))
    FROM (SELECT unnest(range(n_lost + 1)) AS i)) AS tail FROM tests),
seq AS (
  SELECT *, min(CASE WHEN n_lost < n_good * {share!r}
      AND tail <= {error!r} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM trials)) * {len(CUTOFFS)}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY lang, rule ORDER BY j ROWS UNBOUNDED PRECEDING) AS ok,
    n_caught / greatest(n_bad, 1) - {good_weight!r} * n_lost / greatest(n_good, 1) AS gain
  FROM tails),
best AS (
  SELECT lang, rule, cutoff FROM seq WHERE ok = 1 AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, j) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({over}) AS kept, {names} AS rejected_by
FROM f"""


PARAMS = {"rate": 0.05, "error": 0.05, "good_weight": 10.0}


@register("op2_quality_rules", _sql(**PARAMS))
def op2(spark, sf_dir):
    rows = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **PARAMS)
    return rows.select("doc_id", *COUNTS, "base_failed", "kept", "rejected_by")
