"""Order-dependent operators: first-wins, ranks, caps, rolling windows, sampling, top-k.

Rank filters are written as ``row_number() <= k`` right over the window, so Spark limits each group
on the map side before it shuffles and a hot group never reaches one task whole. Operators that need
the rank of every row go through ``rank_by_position`` or the sliced windows below instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import urls as U
from docloom.functions.binding import let
from docloom.functions.ids import micros
from docloom.functions.text import slug as slug_of
from docloom.functions.text import slug_path_title
from docloom.operators.predicates import first_match, weighted
from docloom.session import joinable

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int
) -> DataFrame:
    """First ``k`` rows of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def first_wins(
    df: DataFrame, keys: Sequence[str | Column], pos: str | Sequence[str | Column]
) -> DataFrame:
    """One row per key, the first by input position. ``pos`` must be a total order within a key."""
    order = [pos] if isinstance(pos, str) else pos
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def rank_by_position(
    df: DataFrame, keys: Sequence[str], pos: str, out: str = "rank", chunk: int = 10_000
) -> DataFrame:
    """Exact rank of every row within its group by a non-negative integer position.

    Groups are cut into chunks of positions; each chunk is ranked on its own and shifted by the number
    of rows in earlier chunks. No task sees more than one chunk of a group, however large the group.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    sizes = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*_BEFORE)
    offsets = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    return (
        cut.join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.row_number().over(within) + F.col("_skip"))
        .drop("_chunk", "_skip")
    )


def group_ranks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "rank"
) -> DataFrame:
    """Row number within groups that are known to be small (one file, one page, one session)."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(out, F.row_number().over(w))


# -- W1, W2 -----------------------------------------------------------------------------------


def dedupe_urls(df: DataFrame, keys: Sequence[str] = (), url: str = "url", pos="pos") -> DataFrame:
    """First occurrence of each address, ignoring the fragment and a trailing slash."""
    return first_wins(df, [*keys, U.dedupe_key(F.col(url))], pos)


def publishable_pages(drafts: DataFrame, max_pages: int = rules.MAX_PAGES_SCHEMA) -> DataFrame:
    """First draft per normalised slug among the first ``max_pages`` of a repository."""
    head = top_per_group(drafts, ["repo_id"], ["pos"], max_pages)
    normal = head.withColumn("page_slug", slug_of(F.col("page_slug"))).filter("page_slug <> ''")
    return first_wins(normal, ["repo_id", "page_slug"], "pos")


def within(limit: Column, bound: int) -> Column:
    """``limit``, or a failure where it exceeds ``bound``."""
    too_large = F.raise_error(F.concat(F.lit(f"a limit exceeds the bound {bound}: "), limit.cast("string")))
    return F.when(limit > bound, too_large.cast("int")).otherwise(limit)


def cap_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    primary: Column,
    cap: Column | int = rules.MAX_PER_ORIGIN,
    primary_cap: Column | int = rules.MAX_PRIMARY_PER_ORIGIN,
    limit: int = rules.MAX_CANDIDATES_KEPT,
    limit_keys: Sequence[str] = (),
    bound: int | None = None,
) -> DataFrame:
    """Rows in order, at most ``cap`` per group and ``primary_cap`` of them primary.

    A primary row over its cap does not use up the group's cap, so primaries are ranked and cut first.
    ``limit`` then applies over ``limit_keys`` (for instance per repository), which must be part of
    the keys. A cap that is a column needs ``bound``, the largest it may be; a row above it fails the query.
    """
    if isinstance(cap, int):
        bound = cap
    elif bound is None:
        raise ValueError("a cap that is a column needs a bound")
    else:
        cap = within(cap, bound)
    marked = df.withColumn("_primary", F.coalesce(primary, F.lit(False)))
    by_kind = Window.partitionBy(*keys, "_primary").orderBy(*_cols(order))
    # A group keeps no more than ``bound`` rows of a kind: a plain number lets Spark cut before the shuffle.
    ranked = (
        marked.withColumn("_kind_rank", F.row_number().over(by_kind))
        .filter(F.col("_kind_rank") <= bound)
        .filter(~F.col("_primary") | (F.col("_kind_rank") <= primary_cap))
    )
    in_group = Window.partitionBy(*keys).orderBy(*_cols(order))
    capped = ranked.withColumn("_group_rank", F.row_number().over(in_group)).filter(
        F.col("_group_rank") <= cap
    )
    kept = capped.drop("_primary", "_kind_rank", "_group_rank")
    return top_per_group(kept, limit_keys, order, limit) if limit_keys else kept


# -- W5: unique slugs -------------------------------------------------------------------------


def numbered_slugs(
    df: DataFrame,
    keys: Sequence[str],
    base: str,
    pos: Sequence[str | Column],
    out: str = "slug",
    first_suffix: int = 2,
) -> DataFrame:
    """Disambiguate repeats by order: ``x``, ``x-2``, ``x-3`` or, with 1, ``x``, ``x-1``, ``x-2``.

    Grouped by the base itself, so only repeats of one slug meet.
    """
    w = Window.partitionBy(*keys, base).orderBy(*_cols(pos))
    n = F.row_number().over(w)
    suffix = F.concat(F.lit("-"), (n - 2 + first_suffix).cast("string"))
    return df.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), suffix)))


def page_slugs(
    df: DataFrame, keys: Sequence[str], base: str, pos: str, out: str = "slug"
) -> DataFrame:
    """Page slugs in order, skipping suffixes that are themselves taken.

    Sequential rule: a page takes the first free of ``x``, ``x-2``, ``x-3``, ... Only a repeated ``x``
    next to a literal ``x-k`` makes the order matter across slugs. Those pages (of one stem in one
    repository's index, which holds at most a thousand entries) are folded in order; every other page
    is numbered by a window over its own slug.
    """
    stem = F.regexp_replace(F.col(base), r"(?:-[1-9][0-9]*)+$", "")
    parent = F.regexp_replace(F.col(base), r"-[1-9][0-9]*$", "")
    marked = df.withColumn("_stem", stem)
    bases = marked.groupBy(*keys, "_stem", base).agg(F.count(F.lit(1)).alias("_n"))
    children = bases.filter(parent != F.col(base)).select(
        *keys, "_stem", F.col(base).alias("_child"), parent.alias(base)
    )
    links = children.join(bases, [*keys, "_stem", base])
    tangled = links.filter("_n > 1").select(*keys, "_stem").distinct()
    involved = links.join(tangled, [*keys, "_stem"], "left_semi").select(
        *keys, F.explode(F.array(base, "_child")).alias(base)
    )
    mixed = joinable(involved.distinct().withColumn("_mixed", F.lit(True)), "mixed-slugs")
    joined = marked.join(mixed, [*keys, base], "left")
    simple = numbered_slugs(joined.filter("_mixed is null"), keys, base, [pos], out)
    item = F.struct(F.col(pos).alias("p"), F.col(base).alias("b"))
    family = joined.filter("_mixed").groupBy(*keys, "_stem").agg(
        F.array_sort(F.collect_list(item)).alias("_items")
    )

    def take(taken: Column, it: Column) -> Column:
        b = it["b"]
        options = F.concat(
            F.array(b),
            F.transform(
                F.sequence(F.lit(2), F.size(taken) + 2),
                lambda i: F.concat_ws("-", b, i.cast("string")),
            ),
        )
        free = F.filter(options, lambda s: ~F.array_contains(taken, s))
        return F.concat(taken, F.array(F.get(free, F.lit(0))))

    folded = family.withColumn(
        "_slugs", F.aggregate("_items", F.array().cast("array<string>"), take)
    )
    solved = folded.select(
        *keys, F.explode(F.arrays_zip("_items", "_slugs")).alias("_z")
    ).select(
        *keys,
        F.col("_z._items.p").alias(pos),
        F.col("_z._items.b").alias(base),
        F.col("_z._slugs").alias(out),
    )
    mixed_rows = joined.filter("_mixed").drop(*([out] if out in df.columns else []))
    resolved = mixed_rows.join(solved, [*keys, base, pos])
    columns = [*df.columns, *([] if out in df.columns else [out])]
    return simple.select(*columns).unionByName(resolved.select(*columns))


# -- W6: rolling usage ------------------------------------------------------------------------


def trailing_usage(
    df: DataFrame,
    keys: Sequence[str],
    window_us: int,
    name: str,
    ts_us: str = "ts_us",
    row_id: str = "attempt_id",
    slices: int = 24,
) -> DataFrame:
    """Count and oldest time of the trailing window (both ends inclusive) at every row.

    The window over one key, or over all rows, would sit in one task. Instead time is cut into slices
    of ``window_us / slices``. A row adds up its own slice so far, the whole slices in between (small
    per-slice aggregates) and what is still alive of the slice the window starts in. That last part
    comes from re-emitting each row once, shifted by the window, as an expiry in a later slice. Each
    task handles one slice of one key, and the result is exact.
    """
    width = window_us // slices
    if width * slices != window_us:
        raise ValueError("window must divide into the slices")
    rows = df.select(
        *keys,
        F.col(row_id),
        F.col(ts_us).alias("_at"),
        F.floor(F.col(ts_us) / width).alias("_slice"),
        F.lit(None).cast("bigint").alias("_expired"),
    )
    expiries = rows.select(
        *keys,
        F.lit(None).cast("bigint").alias(row_id),
        (F.col("_at") + window_us).alias("_at"),
        (F.col("_slice") + slices).alias("_slice"),
        F.col("_at").alias("_expired"),
    )
    per_slice = rows.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    # Totals of the whole slices between, and of the slice the window starts in. A slice that only
    # holds expiries needs no totals, so the aggregates over slices with rows are enough.
    if keys:
        by_slice = Window.partitionBy(*keys).orderBy("_slice")
        between = by_slice.rangeBetween(-(slices - 1), -1)
        oldest = by_slice.rangeBetween(-slices, -slices)
        totals = per_slice.select(
            *keys,
            "_slice",
            F.coalesce(F.sum("_n").over(between), F.lit(0)).alias("_between"),
            F.min("_first").over(between).alias("_between_first"),
            F.coalesce(F.sum("_n").over(oldest), F.lit(0)).alias("_oldest"),
        )
    else:
        # Without a key a window would be one task: hand each slice's totals to the later ones.
        steps = F.explode(F.sequence(F.lit(0), F.lit(slices))).alias("_step")
        handed = per_slice.select((F.col("_slice")).alias("_from"), "_n", "_first", steps)
        inner = F.col("_step").between(1, slices - 1)
        totals = handed.groupBy((F.col("_from") + F.col("_step")).alias("_slice")).agg(
            F.coalesce(F.sum(F.when(inner, F.col("_n"))), F.lit(0)).alias("_between"),
            F.min(F.when(inner, F.col("_first"))).alias("_between_first"),
            F.coalesce(F.sum(F.when(F.col("_step") == slices, F.col("_n"))), F.lit(0)).alias(
                "_oldest"
            ),
        )
    both = rows.unionByName(expiries)
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("_at")
    so_far = in_slice.rangeBetween(Window.unboundedPreceding, 0)
    gone = in_slice.rangeBetween(Window.unboundedPreceding, -1)
    alive = in_slice.rangeBetween(0, Window.unboundedFollowing)
    measured = both.select(
        *keys,
        row_id,
        "_at",
        "_slice",
        F.count(row_id).over(so_far).alias("_own"),
        F.min(F.when(F.col(row_id).isNotNull(), F.col("_at"))).over(so_far).alias("_own_first"),
        F.count("_expired").over(gone).alias("_gone"),
        F.min("_expired").over(alive).alias("_alive_first"),
    ).filter(F.col(row_id).isNotNull())
    on = [*keys, "_slice"]
    joined = measured.join(totals, on)
    count = F.col("_own") + F.col("_between") + F.col("_oldest") - F.col("_gone")
    return joined.select(
        row_id,
        count.alias(f"{name}_count"),
        F.coalesce("_alive_first", "_between_first", "_own_first").alias(f"{name}_oldest"),
    )


def rolling_usage(
    attempts: DataFrame,
    cooldown_us: int = rules.GENERATION_LIMITS["cooldown_us"],
    ts: str = "created_at",
) -> DataFrame:
    """For each attempt the trailing usage of every quota scope, itself included.

    ``attempts`` has attempt_id, client_key, repo_full_name and a time. The counts are offered load:
    denied attempts are part of them (``streaming.admission`` decides sequentially).
    """
    base = attempts.withColumn("ts_us", micros(F.col(ts)))
    scopes = [
        ("client_hour", ["client_key"], rules.HOUR_US),
        ("client_day", ["client_key"], rules.DAY_US),
        ("global_hour", [], rules.HOUR_US),
    ]
    if cooldown_us > 0:
        scopes.append(("repo_cooldown", ["repo_full_name"], cooldown_us))
    parts = [
        trailing_usage(base, keys, window, "_").select(
            "attempt_id", F.lit(name).alias("_scope"), F.col("__count").alias("_count"), F.col("__oldest").alias("_oldest")
        )
        for name, keys, window in scopes
    ]
    wide = [
        F.max(F.when(F.col("_scope") == name, F.col(f"_{c}"))).alias(f"{name}_{c}") for name, _, _ in scopes for c in ("count", "oldest")
    ]
    # the scopes meet in one pass over their union and join the attempts once
    usage = reduce(DataFrame.unionByName, parts).groupBy("attempt_id").agg(*wide)
    return attempts.join(usage, "attempt_id")


# -- W7 .. W10 --------------------------------------------------------------------------------


def recent_history(
    messages: DataFrame, n: int = 8, max_chars: int = 4_000, state: str | None = None
) -> DataFrame:
    """Last ``n`` finished, non-blank messages of each conversation, trimmed and cut."""
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    kept = messages.filter(body != "")
    if state is not None:
        kept = kept.filter(~F.col(state).eqNullSafe(F.lit("thinking")))
    last = top_per_group(kept, ["conv_id"], [F.col("turn").desc()], n)
    return last.select("conv_id", "turn", "role", F.substring(body, 1, max_chars).alias("content"))


def active_job(jobs: DataFrame, repos: DataFrame) -> DataFrame:
    """One unfinished job per repository: the one it points at, else the newest."""
    open_jobs = jobs.filter(F.col("status").isin(rules.UNFINISHED_STATUSES))
    pointers = repos.select("repo_id", F.col("active_job_id").alias("_pointer"))
    marked = open_jobs.join(pointers, "repo_id", "left").withColumn(
        "_other", F.when(F.col("_pointer") == F.col("job_id"), 0).otherwise(1)
    )
    return top_per_group(
        marked, ["repo_id"], ["_other", F.col("started_at").desc(), "job_id"], 1
    ).drop("_pointer", "_other")


def headings_per_file(headings: DataFrame, n: int = rules.MAX_HEADINGS_PER_FILE) -> DataFrame:
    """First ``n`` kept headings of each file; a level-1 repeat of the file title is no topic."""
    from docloom.operators.predicates import keep_headings

    return top_per_group(keep_headings(headings), ["repo_id", "path"], ["pos"], n)


def latest_phase(job_events: DataFrame) -> DataFrame:
    """Latest phase and heartbeat per job. Heartbeats carry no phase but count as signs of life."""
    at = F.struct("ts", "event_id")
    return job_events.groupBy("job_id").agg(
        F.max_by("phase", F.when(F.col("phase").isNotNull(), at)).alias("phase"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("phase").isin("completed", "failed"), F.col("ts"))).alias("finished_at"),
    )


# -- K1 .. K6 ---------------------------------------------------------------------------------


def recent(df: DataFrame, n: int = 100, ts: str = "updated_at", name: str = "full_name") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(name).asc()).limit(n)


def refresh_class(version: str) -> Column:
    """0 featured and stale, 1 stale, 2 featured, 3 the rest. Version comparison is null-safe."""
    stale = F.col("current_commit").isNull() | ~F.col("current_version").eqNullSafe(F.lit(version))
    return (
        F.when(F.col("is_featured") & stale, 0).when(stale, 1).when(F.col("is_featured"), 2).otherwise(3)
    )


def refresh_priority(targets: DataFrame, version: str, n: int = rules.SCAN_LIMIT) -> DataFrame:
    """The next ``n`` repositories to check, most urgent first (ordered result)."""
    return (
        targets.withColumn("refresh_class", refresh_class(version))
        .orderBy(
            "refresh_class",
            F.col("last_checked_at").asc_nulls_first(),
            F.col("indexed_at").asc_nulls_first(),
            "full_name",
        )
        .limit(n)
    )


def search_rank(candidates: DataFrame, queries: DataFrame, n: int = 9) -> DataFrame:
    """Best ``n`` candidates per query: exact full name, exact name, prefixes, then the rest.

    ``candidates`` has query_id, pos, full_name (the hits a search returned for that query);
    ``queries`` has query_id and query.
    """
    full = F.lower("full_name")
    name = F.coalesce(F.get(F.split(full, "/"), F.lit(1)), full)
    q = F.lower("query")
    tier = (
        F.when(full == q, 0)
        .when(name == q, 1)
        .when(full.startswith(q), 2)
        .when(name.startswith(q), 3)
        .otherwise(4)
    )
    ranked = candidates.join(queries, "query_id").withColumn("tier", tier)
    return top_per_group(ranked, ["query_id"], ["tier", "pos"], n)


def url_order_key(p: Column) -> Column:
    lowered = F.lower(p)
    return F.concat_ws(":", first_match(lowered, rules.URL_ORDER, 4).cast("string"), lowered)


def docs_path_order_key(p: Column) -> Column:
    return F.concat_ws(":", first_match(p, rules.DOCS_PATH_ORDER, 3).cast("string"), p)


def natural_key(c: Column, width: int = 12) -> Column:
    """Case-insensitive key in which runs of digits sort by value."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    digits = lambda s: F.regexp_replace(s, "^0+(?=.)", "")
    padded = F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^\d"), F.lpad(digits(s), F.greatest(F.length(digits(s)), F.lit(width)), F.lit("0"))).otherwise(s),
    )
    return F.array_join(padded, "")


def docs_order(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the reading-order key of documentation addresses: getting started, guides, reference,
    examples, the rest; by path within each."""
    return df.withColumn("order_key", url_order_key(U.path(F.col(url))))


def site_group(url: Column) -> Column:
    """Section title of a documentation address."""

    def seg(segs: Column, i: Column) -> Column:
        return F.when(i >= 0, F.get(segs, i))

    def sub(segs: Column, i: Column) -> Column:
        lead_in = F.lower(F.get(segs, i)).rlike(rules.LEAD_IN_SEGMENT)
        return F.when(~lead_in, F.get(segs, i))

    def parts(segs: Column, at: Column) -> Column:
        section = seg(segs, at)
        # A section right at the root looks back at the last segment.
        previous = F.when(at >= 1, seg(segs, at - 1)).otherwise(U.last_segment(segs))
        own_group = (at >= 0) & (
            ((at == 0) & ~section.rlike(rules.PLAIN_DOCS_SEGMENT)) | U.is_version_segment(previous)
        )
        inside = F.array(F.coalesce(seg(segs, at + 1), section), sub(segs, at + 2))
        outside = F.array(F.coalesce(F.get(segs, F.lit(0)), F.lit("docs")), sub(segs, F.lit(1)))
        return (
            F.when(own_group, F.array(section, sub(segs, at + 1)))
            .when(at >= 0, inside)
            .otherwise(outside)
        )

    def group(segs: Column) -> Column:
        hits = F.transform(segs, lambda s: s.rlike(rules.SECTION_SEGMENT))
        return let((F.array_position(hits, True) - 1).cast("int"), lambda at: parts(segs, at))

    return slug_path_title(let(U.segments(U.path(url)), group))


def group_score(group: Column, size: Column) -> Column:
    return F.least(size, F.lit(80)) + weighted(group, rules.GROUP_SCORES)


def balanced_sample(
    df: DataFrame,
    keys: Sequence[str],
    group: str,
    order: Sequence[str | Column],
    n: int | Column,
    group_scores: DataFrame | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Take one row per group per round, groups by score, until ``n`` rows per key are taken.

    Rounds are clean: every group is visited once per round in the same order (score, then name).
    ``group_scores`` has the keys, the group and ``group_score``; by default sections are scored by
    size and name. ``n`` may be a column of per-key targets, of which ``bound`` is the largest allowed; a target
    above it fails the query.
    """
    if isinstance(n, int):
        bound, limit = n, F.lit(n)
    elif bound is None:
        raise ValueError("targets in a column need a bound")
    else:
        limit = within(n, bound)
    if group_scores is None:
        sizes = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_size"))
        group_scores = sizes.select(
            *keys, group, group_score(F.col(group), F.col("_size")).alias("group_score")
        )
    # No more than ``bound`` groups of a key, and ``bound`` rows of a group, can be chosen.
    ranked_groups = group_ranks_limited(
        group_scores, keys, [F.col("group_score").desc(), F.col(group).asc()], bound, "_group_rank"
    ).drop("group_score")
    rounds = group_ranks_limited(df, [*keys, group], order, bound, "_round")
    taken = Window.partitionBy(*keys).orderBy("_round", "_group_rank")
    return (
        rounds.join(ranked_groups, [*keys, group])
        .withColumn("take_order", F.row_number().over(taken))
        .filter(F.col("take_order") <= bound)
        .filter(F.col("take_order") <= limit)
        .drop("_round", "_group_rank")
    )


def visits(sizes: Sequence[int], n: int) -> list[tuple[int, int]]:
    """(group, which of its rows) of the first ``n`` visits: groups in turn, and from the first one again whenever one is empty."""
    left, out, cursor = [[i, 0, size] for i, size in enumerate(sizes) if size > 0], [], 0
    while left and len(out) < n:
        at = cursor % len(left)
        entry = left[at]
        out.append((entry[0], entry[1]))
        entry[1] += 1
        if entry[1] == entry[2]:
            del left[at]
            cursor = 0
        else:
            cursor += 1
    return out


def cursor_sample(
    df: DataFrame, keys: Sequence[str], group: str, order: Sequence[str], n: int, group_scores: DataFrame | None = None
) -> DataFrame:
    """Take ``n`` rows per key from its groups in turn, starting over with the best group whenever one is used up.

    Beside ``balanced_sample``, whose rounds are clean, this is the order of a cursor that goes back to the start: small groups
    that are first in line are emptied before later ones have their turn. Groups stand by score, then by their first row in ``order``. Which
    row of which group comes when follows from the groups' sizes alone: at most ``n`` groups of a key can be visited, so a
    schedule of ``n`` visits is made of at most that many counts, and the rows join it by their rank.
    """
    keys = list(keys)
    rounds = group_ranks_limited(df, [*keys, group], order, n, "_round")
    sizes = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_size"))
    if group_scores is None:
        group_scores = sizes.select(*keys, group, group_score(F.col(group), F.col("_size")).alias("group_score"))
    first = rounds.filter("_round = 1").select(*keys, group, *order).join(sizes, [*keys, group]).join(group_scores, [*keys, group])
    lined = group_ranks_limited(first, keys, [F.col("group_score").desc(), *order], n, "_line")
    listed = lined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_line", F.col(group).alias("_group"), "_size"))).alias("_groups"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, group).schema)

    def schedule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, groups in batch.itertuples(index=False):
                for at, (g, k) in enumerate(visits([x["_size"] for x in groups], n)):
                    rows.append((*key, groups[g]["_group"], k + 1, at + 1))
            yield pd.DataFrame(rows, columns=[*keys, group, "_round", "take_order"])

    plan = listed.select(*keys, "_groups").mapInPandas(schedule, f"{kinds}, _round int, take_order int")
    return rounds.join(plan, [*keys, group, "_round"]).drop("_round")


def priority_rank(priority: Column) -> Column:
    return (
        F.when(priority == "required", 3).when(priority == "recommended", 2).when(
            priority == "optional", 1
        )
    )


def trim_outline(outline: DataFrame, max_pages: int | str = "max_pages") -> DataFrame:
    """Keep a repository's ``max_pages`` pages: overview first, then priority, then position.

    ``max_pages`` is a number or the name of a column. Keep ``pos`` to restore the order.
    """
    limit = F.col(max_pages) if isinstance(max_pages, str) else F.lit(max_pages)
    w = Window.partitionBy("repo_id").orderBy(
        F.when(slug_of(F.col("slug")) == "overview", 0).otherwise(1),
        priority_rank(F.col("priority")).desc_nulls_last(),
        "pos",
    )
    return (
        outline.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= limit)
        .drop("_rn")
    )


# -- K7, K9, K10 ------------------------------------------------------------------------------


def top_files(files: DataFrame, rule_set: str, n: int | None = None) -> DataFrame:
    """Best files of each repository under a rule set: its class test and size limit, then its score.

    Equal scores go by path for the sets that rank by path, and by listing order otherwise.
    """
    from docloom.operators.predicates import any_match, is_planning_path, rule_score

    rs = rules.RULE_SETS[rule_set]
    p = F.lower("path")
    kept = files
    if rs.any_of is not None:
        kept = kept.filter(any_match(p, rs.any_of))
    if rule_set in ("context", "inventory", "docs_sources", "docs_tree"):
        kept = kept.filter(~is_planning_path(F.col("path")))
    if rule_set == "source_map":
        kept = kept.filter(~p.rlike(rules.SOURCE_MAP_UNUSED) & any_match(p, rules.SOURCE_MAP_KEPT))
    if rs.max_bytes is not None:
        kept = kept.filter(F.col("size") <= rs.max_bytes)
    scored = kept.withColumn("score", rule_score(F.col("path"), rs))
    if rs.floor is not None:
        scored = scored.filter(F.col("score") > rs.floor)
    score = F.col("score").desc() if rs.descending else F.col("score").asc()
    by_listing = rule_set in ("context", "chat_context", "chat_sandbox", "chat_inventory")
    ties = ["pos"] if by_listing else ["path", "pos"]
    if rule_set == "docs_tree":
        ties = [natural_key(F.col("path")), "path", "pos"]
    return group_ranks_limited(scored, ["repo_id"], [score, *ties], n or rs.limit)


def group_ranks_limited(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, out: str = "rank"
) -> DataFrame:
    """``top_per_group`` that keeps the rank."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def sandbox_files(files: DataFrame, context: DataFrame) -> DataFrame:
    """Context files first, then the best small files, 36 paths in all."""
    rs = rules.RULE_SETS["chat_sandbox"]
    seeds = context.select("repo_id", "path", F.lit(0).alias("_source"), F.col("rank").alias("_at"))
    ranked = top_files(files, "chat_sandbox", rs.limit)
    more = ranked.select("repo_id", "path", F.lit(1).alias("_source"), F.col("rank").alias("_at"))
    merged = first_wins(seeds.unionByName(more), ["repo_id", "path"], ["_source", "_at"])
    return group_ranks_limited(merged, ["repo_id"], ["_source", "_at"], rs.limit).drop(
        "_source", "_at"
    )


def landing_page(pages: DataFrame) -> DataFrame:
    """The overview page of a repository, else its first page by creation time."""
    order = F.struct(
        F.when(F.col("slug") == "overview", 0).otherwise(1), F.col("created_at"), F.col("page_id")
    )
    return pages.groupBy("repo_id").agg(
        F.min_by(F.struct("page_id", "slug", "title"), order).alias("p")
    ).select("repo_id", "p.*")


def plan_refresh(
    targets: DataFrame,
    now_us: Column,
    version: str,
    enqueue_limit: int = rules.ENQUEUE_LIMIT,
    catch_up_limit: int = rules.CATCH_UP_LIMIT,
    cooldown_hours: int = rules.COOLDOWN_HOURS,
    scan_limit: int = rules.SCAN_LIMIT,
) -> DataFrame:
    """Outcome of one scheduled refresh: queued, active, current, cooldown, deferred or error.

    Queueing a row changes what later rows may do, so this is a fold in priority order. Its input is
    the scan limit (100 rows), never the table. ``targets`` adds to ``refresh_priority``'s columns
    latest_commit (null: could not be read), has_open_job, attempted_commit, attempted_version and
    enqueued_at_us. A row without budget is deferred before its commit is compared.
    """
    scanned = refresh_priority(targets, version, scan_limit)
    items = scanned.select(
        F.struct(
            "refresh_class",
            F.coalesce(F.unix_micros("last_checked_at"), F.lit(-(2**62))).alias("checked"),
            F.coalesce(F.unix_micros("indexed_at"), F.lit(-(2**62))).alias("indexed"),
            "full_name",
            "is_featured",
            "current_commit",
            "current_version",
            "latest_commit",
            "has_open_job",
            "attempted_commit",
            "attempted_version",
            "enqueued_at_us",
        ).alias("t")
    )
    rows = items.agg(F.array_sort(F.collect_list("t")).alias("ts"))
    v = F.lit(version)

    def step(acc: Column, t: Column) -> Column:
        bootstrap = t["is_featured"] & t["current_commit"].isNull()
        catch_up = t["is_featured"] & ~t["current_version"].eqNullSafe(v)
        budget = (
            (acc["queued"] < enqueue_limit)
            | bootstrap
            | (catch_up & (acc["caught_up"] < catch_up_limit))
        )
        same_version = t["current_version"].eqNullSafe(v)
        same_commit = t["current_commit"].eqNullSafe(t["latest_commit"])
        cooling = (
            F.lit(cooldown_hours > 0)
            & ~bootstrap
            & t["attempted_commit"].eqNullSafe(t["latest_commit"])
            & t["attempted_version"].eqNullSafe(v)
            & F.coalesce(
                now_us - t["enqueued_at_us"] < cooldown_hours * rules.HOUR_US, F.lit(False)
            )
        )
        status = (
            F.when(~budget, F.lit("deferred"))
            .when(t["latest_commit"].isNull(), F.lit("error"))
            .when(same_commit & same_version, F.lit("current"))
            .when(cooling, F.lit("cooldown"))
            .when(t["has_open_job"], F.lit("active"))
            .otherwise(F.lit("queued"))
        )
        reason = F.when(
            status.isin("cooldown", "active", "queued"),
            F.when(same_commit, F.lit("generator")).otherwise(F.lit("repository")),
        )
        hit = (status == "queued").cast("int")
        return F.struct(
            (acc["queued"] + hit).alias("queued"),
            (acc["caught_up"] + F.when(catch_up, hit).otherwise(0)).alias("caught_up"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        t["full_name"].alias("full_name"),
                        t["is_featured"].alias("is_featured"),
                        status.alias("status"),
                        reason.alias("stale_reason"),
                    )
                ),
            ).alias("out"),
        )

    empty = F.array().cast(
        "array<struct<full_name:string,is_featured:boolean,status:string,stale_reason:string>>"
    )
    start = F.struct(F.lit(0).alias("queued"), F.lit(0).alias("caught_up"), empty.alias("out"))
    folded = rows.select(F.aggregate("ts", start, step).alias("r"))
    return folded.select(F.posexplode("r.out").alias("pos", "o")).select("pos", "o.*")


def refresh_records(outcomes: DataFrame, targets: DataFrame, now: Column, version: str) -> DataFrame:
    """Repository columns after the refresh run: check time always, attempt columns when enqueued."""
    enqueued = F.coalesce(F.col("status").isin("queued", "active"), F.lit(False))
    joined = targets.join(outcomes.select("full_name", "status"), "full_name", "left")
    seen = F.col("status").isNotNull()
    return joined.select(
        "full_name",
        F.when(seen, now).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
        F.when(enqueued, F.unix_micros(now)).otherwise(F.col("enqueued_at_us")).alias(
            "enqueued_at_us"
        ),
        F.when(enqueued, F.col("latest_commit")).otherwise(F.col("attempted_commit")).alias(
            "attempted_commit"
        ),
        F.when(enqueued, F.lit(version)).otherwise(F.col("attempted_version")).alias(
            "attempted_version"
        ),
    )
