"""Benchmark passages inside documents: a prefix-filtered join of word shingles with exact verification.

A benchmark item gives windows of ``width`` consecutive words (an item with fewer words is one window). The
tokens of a window are its shingles of ``shingle`` words. Tokens are ordered by how often they occur in
the documents; to contain a window a text must hold all of them, so the rarest alone is the necessary
prefix, and only its places are candidates. A candidate fixes where the window would begin: that
position must lie inside the text with room for the whole window (positional and length bounds), and then
every other token must stand at its own offset, word for word.

The text is read once. Its shingles meet the distinct benchmark shingles by hash, and matching ones are
compared as words in the same step, so only matches are kept and no text is shuffled. The benchmark side is
broadcast if its measured row count allows, else the join shuffles hashes. Everything is DataFrame expressions.

Nulls: a null text has no words, is never hit and contains nothing; a null item text has no windows, and
an item without an id is left out. Rows are matched by a key of their own, so repeated or null doc_ids are
judged each on their own text. Repeated items count once per item_id; equal windows of several items hit for
each of them. Other columns of the inputs are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import plain_words, small, table
from docloom.llm.registry import register
from docloom.session import materialized

END = 0  # the hash under which every row leaves one mark with its word count


def windows(benchmark: DataFrame, width: int, shingle: int, item_col: str, text_col: str) -> DataFrame:
    """(item, window, len, k, offset, token): the tokens of every window of every item."""
    words = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("w")
    )
    n = F.size("w")
    cut = words.where(n > 0).select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))),
                lambda s: F.slice("w", s + 1, F.lit(width)),
            )
        ).alias("ws"),
    )
    # equal windows are one window with several items
    shared = cut.groupBy("ws").agg(F.collect_set("item").alias("items"))
    length = F.size("ws")
    k = F.least(F.lit(shingle), length)
    tokens = F.transform(
        F.sequence(F.lit(0), length - k), lambda i: F.concat_ws(" ", F.slice(F.col("ws"), i + 1, k))
    )
    return shared.select(
        F.sha2(F.concat_ws(" ", "ws"), 256).alias("window"),
        "items",
        length.alias("len"),
        k.alias("k"),
        F.posexplode(tokens).alias("offset", "token"),
    )


def matches(docs: DataFrame, tokens: DataFrame, n_tokens: int, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text_key, n_words, pos, token): benchmark shingles in the texts, and a mark for every row.

    Words stand beside the words after them, once for each place of a text; a first place without words is the mark.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        plain_words(F.col(text_col)).alias("w"),
    )
    most = max(sizes, default=1)
    ahead = [F.slice("w", j + 1, F.size("w")).alias(f"w{j}") if j else F.col("w").alias("w0") for j in range(most)]
    blank = F.struct(*[F.lit(None).cast("string").alias(f"w{j}") for j in range(most)])
    each = rows.select("*", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(blank), F.arrays_zip(*ahead))).alias("at", "x"))
    each = each.select("row", "doc_id", "text_key", "n_words", (F.col("at") - 1).alias("pos"), *[F.col(f"x.w{j}").alias(f"w{j}") for j in range(most)])

    def of(k: int) -> Column:
        words = [f"w{j}" for j in range(k)]
        found = F.when(F.col(words[-1]).isNotNull(), F.xxhash64(F.lit(k), *words))
        return F.struct(F.lit(k).alias("k"), F.when(F.col("pos") < 0, F.lit(END).cast("long")).otherwise(found).alias("h"))

    if len(sizes) > 1:  # one of them is enough for the mark
        each = each.withColumn("s", F.explode(F.array(*map(of, sizes)))).where(F.col("pos").isNotNull() & ((F.col("pos") >= 0) | (F.col("s.k") == sizes[0])))
    else:
        each = each.withColumn("s", of(most))
    part = F.split("token", " ")
    sought = tokens.select("token", F.xxhash64("k", *[F.get(part, F.lit(j)) for j in range(most)]).alias("h")).union(
        tokens.sparkSession.range(1).select(F.lit(""), F.lit(END).cast("long"))
    )
    placed = each.select("*", F.col("s.k").alias("k"), F.col("s.h").alias("h"))
    here = F.concat_ws(" ", *[F.when(F.col("k") > j, F.col(f"w{j}")) for j in range(most)])
    hit = placed.join(small(sought, n_tokens, 500_000), "h").where(here == F.col("token"))
    return hit.select("row", "doc_id", "text_key", "n_words", "pos", "token")


def window_hits(found: DataFrame, wins: DataFrame) -> DataFrame:
    """(row, start, len, items): every occurrence of a window, from the places of its rarest token."""
    places = found.where("pos >= 0").select("row", "n_words", "pos", "token")
    rarity = places.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    prefixed = materialized(
        wins.join(rarity, "token", "left")
        .groupBy("window")
        .agg(
            F.first("items").alias("items"),
            F.first("len").alias("len"),
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("rare"),
            F.collect_list(F.struct("offset", "token")).alias("all"),  # ``width`` at most
        )
        .where("rare.n > 0")
        .select("window", "items", "len", "all", "rare.token", F.col("rare.offset").alias("at")),
        "contam-prefixes",
    )
    start = F.col("pos") - F.col("at")
    candidates = (
        places.join(small(prefixed, prefixed.count()), "token")
        .where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
        .select("row", "window", "items", "len", start.alias("start"), F.size("all").alias("need"), "all")
    )
    checks = candidates.select("row", "window", "items", "len", "start", "need", F.inline("all"))
    checks = checks.withColumn("pos", F.col("start") + F.col("offset")).drop("offset")
    return (
        checks.join(places.select("row", "pos", "token"), ["row", "pos", "token"])
        .groupBy("row", "window", "start")
        .agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"), F.first("len").alias("len"), F.first("items").alias("items"))
        .where("n = need")
        .select("row", "start", "len", "items")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    shingle: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, and the sorted ``items`` found, a row for each row of ``docs``."""
    wins = materialized(windows(benchmark, width, shingle, item_col, item_text_col), "contam-windows")
    sizes = sorted(r.k for r in wins.select("k").distinct().collect())  # at most ``shingle`` numbers
    tokens = materialized(wins.select("token", "k").distinct(), "contam-tokens")
    found = matches(docs, tokens, tokens.count(), sizes, id_col, text_col)
    found = materialized(found, "contam-matches")
    hits = materialized(window_hits(found, wins), "contam-hits")
    last = F.col("start") + F.col("len") - 1
    words = hits.select("row", F.explode(F.sequence("start", last.cast("int"))).alias("pos")).distinct()
    words = words.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("row", F.explode("items").alias("item")).distinct()
    items = items.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = found.where("pos = -1").join(words, "row", "left").join(items, "row", "left")
    return rows.select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT k, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT k, s, n, item FROM dw JOIN win USING (n, g)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)"""


@register("op6_contamination", SQL)
def op6(spark, sf_dir):
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
